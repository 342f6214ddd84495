"""From what was read to the values of the inferred Spark schema, and back."""

from __future__ import annotations

import json
from decimal import Decimal
from typing import Any

from pyspark.sql import types as T

from ..plans import syntax as S
from ..plans.layout import Layout, variant_name
from .reader import Unsigned, Variant, plain
from .values import Scope


def typed(layout: Layout, s: S.Struct, scope: Scope, names: bool, fields: set[str] | None = None, path: tuple[str, ...] = ()) -> dict[str, Any]:
    """A row of ``struct_schema``. Members of the top structure outside ``fields`` stay null."""
    path = (*path, s.name)
    out: dict[str, Any] = {}

    def add(members: list) -> None:
        for m in members:
            if isinstance(m, S.Step):
                add(m.members)
            elif not m.hidden and m.name in scope.out and (fields is None or m.name in fields):
                v = scope.out[m.name]
                if m.array is not None:
                    out[m.name] = [_value(layout, m.type, x, names, path) for x in v]
                else:
                    out[m.name] = _value(layout, m.type, v, names, path)
                    if names and m.type.kind == "ref" and m.type.name in layout.enums:
                        out[m.name + "_name"] = next((k for k, x in layout.enum_values[m.type.name].items() if x == v), None)
                if m.show_ptr:
                    out[m.name + "_ptr"] = scope.out.get(m.name + "_ptr")

    add(s.members)
    return out


def _value(layout: Layout, t: S.Type, v: Any, names: bool, path: tuple[str, ...]) -> Any:
    if v is None:
        return None
    if t.kind == "ptr":
        return [_value(layout, t.inner, x, names, path) for x in v] if t.inner_array is not None else _value(layout, t.inner, v, names, path)
    if isinstance(v, Variant):
        for a in t.arms:
            if variant_name(a) == v.name:
                x = v.value
                inner = [_value(layout, a.type, y, names, path) for y in x] if a.array is not None else _value(layout, a.type, x, names, path)
                return {"_variant": v.name, v.name: inner}
        return {"_variant": None}
    if isinstance(v, Scope):
        if t.name in layout.bits:
            return dict(v.out)
        if t.name in path:
            return json.dumps(plain(v), ensure_ascii=False, separators=(",", ":"))
        return typed(layout, layout.structs[t.name], v, names, None, path)
    if isinstance(v, Unsigned):
        return Decimal(int(v))
    if t.kind == "u64":
        return Decimal(v & (1 << 64) - 1)
    if t.kind in ("f32", "f64"):
        return float(v)
    if t.kind == "bool":
        return bool(v)
    return v


def untyped(x: Any) -> Any:
    """A Spark value as the writer takes it: rows become dicts, a match is its own value."""
    if isinstance(x, T.Row):
        x = x.asDict()
    if isinstance(x, dict):
        if "_variant" in x:
            return untyped(x.get(x["_variant"])) if x["_variant"] else None
        return {k: untyped(v) for k, v in x.items() if v is not None}
    if isinstance(x, list):
        return [untyped(v) for v in x]
    return int(x) if isinstance(x, Decimal) else x
