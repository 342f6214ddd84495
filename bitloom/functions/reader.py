"""Reading one cell along a layout: the general lowering, for everything that moves a cursor."""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Callable
from typing import Any

from ..plans import syntax as S
from ..plans.layout import ENCODINGS, Layout, int_type, variant_name
from .values import CellError, Compiler, Scope, number, true, wrap

MAX_DEPTH, MAX_ELEMENTS = 256, 10_000_000
#: What the Spark types of integers hold, from minus this on and below it.
SHOWN = {"byte": 1 << 7, "short": 1 << 15, "integer": 1 << 31, "long": 1 << 63}


class Variant:
    """A match's result: which arm, and what it read."""

    __slots__ = ("name", "value")

    def __init__(self, name: str, value: Any):
        self.name, self.value = name, value


class Unsigned(int):
    """An unsigned 64-bit integer as it is shown; in expressions it is a signed one."""


class Context:
    """The cursor over one cell."""

    __slots__ = ("buf", "depth", "index", "limit", "params", "pos", "reader", "size", "strict")

    def __init__(self, buf: bytes, params: dict, strict: bool, limit: int):
        self.buf, self.size, self.pos = buf, len(buf), 0
        self.params, self.strict, self.limit = params, strict, limit
        self.depth, self.index = 0, []

    def take(self, n: int) -> bytes:
        end = self.pos + n
        if n < 0 or self.pos < 0 or end > self.size:
            raise CellError("PE101", f"{n} bytes are not there", self.pos)
        out = self.buf[self.pos : end]
        self.pos = end
        return out

    def text_size(self, s: Scope, name: str | None, value: Any) -> int:
        if name is not None and s is not None and name in s.wire:
            return len(s.wire[name])
        return len(value) if isinstance(value, bytes) else len(str(value).encode())


Read = Callable[[Context, Scope], tuple[Any, Any]]


class Reader:
    """Closures for the structs of a layout; ``read`` gives a scope tree of a cell."""

    def __init__(self, layout: Layout, *, strict: bool = False, max_elements: int = MAX_ELEMENTS, max_depth: int = MAX_DEPTH, keep_nul: bool = False):
        self.l, self.expr = layout, Compiler(layout)
        self.strict, self.max_elements, self.max_depth, self.keep_nul = strict, max_elements, max_depth, keep_nul
        self.structs: dict[str, Callable[[Context, dict], Scope]] = {}

    def read(self, cell: bytes, entry: str | None = None, params: dict | None = None) -> tuple[Scope, int]:
        """(scope, bytes consumed); CellError if the cell doesn't follow the layout."""
        c = Context(bytes(cell), params or {}, self.strict, self.max_elements)
        scope = self.struct(self.l.entry(entry).name)(c, {})
        if self.strict and not self.l.entry(entry).partial and c.pos != c.size:
            raise CellError("PE102", f"{c.size - c.pos} bytes are left", c.pos)
        return scope, c.pos

    def struct(self, name: str) -> Callable[[Context, dict], Scope]:
        if name in self.structs:
            return self.structs[name]
        self.structs[name] = lambda c, args: self.structs[name](c, args)
        decl = self.l.structs[name]
        run = self.members(decl.members, frozenset(decl.params), name)
        limit = decl.max_depth or self.max_depth

        def read(c: Context, args: dict) -> Scope:
            if c.depth >= limit:
                raise CellError("PE100", f"Max depth {limit} reached in {name}", c.pos)
            c.depth += 1
            scope = Scope(c.pos, args)
            try:
                run(c, scope)
            finally:
                c.depth -= 1
            return scope

        self.structs[name] = read
        return read

    def members(self, members: list, args: frozenset[str], home: str) -> Callable[[Context, Scope], None]:
        steps = [self.step(m, args, home) if isinstance(m, S.Step) else self.field(m, args, home) for m in members]

        def run(c: Context, s: Scope) -> None:
            for step in steps:
                step(c, s)

        return run

    def step(self, m: S.Step, args: frozenset[str], home: str) -> Callable[[Context, Scope], None]:
        value = self.expr(m.expr, args)
        kind, name = m.kind, m.name

        def jump(c: Context, to: Any) -> None:
            c.pos = int(number(to))

        if kind == "let":
            return lambda c, s: s.vals.__setitem__(name, value(c, s, {}))
        if kind == "seek":
            return lambda c, s: jump(c, value(c, s, {}))
        if kind == "skip":
            return lambda c, s: jump(c, c.pos + value(c, s, {}))
        if kind == "align":
            return lambda c, s: jump(c, c.pos + -c.pos % max(1, int(number(value(c, s, {})))))
        if kind == "assert":

            def check(c: Context, s: Scope) -> None:
                if not true(value(c, s, {})):
                    raise CellError("PE100", name, c.pos)

            return check
        guard = self.expr(m.guard, args) if m.guard is not None else None
        inner = self.members(m.members, args, home)

        def at(c: Context, s: Scope) -> None:
            if guard is not None and not true(guard(c, s, {})):
                return
            back = c.pos
            jump(c, value(c, s, {}))
            inner(c, s)
            c.pos = back

        return at

    def field(self, m: S.Field, args: frozenset[str], home: str) -> Callable[[Context, Scope], None]:
        name, hidden = m.name, m.hidden
        if m.derived is not None:
            value, kind = self.expr(m.derived, args), m.type.kind
            limit = None if hidden or kind not in S.INTS or kind == "u64" else SHOWN[int_type(kind).typeName()]

            def derive(c: Context, s: Scope) -> None:
                v = value(c, s, {})
                s.vals[name] = v
                if limit is not None and isinstance(v, (int, float)) and not -limit <= v < limit:
                    raise CellError("PE100", f"{name} does not fit {kind}", c.pos)
                if not hidden:
                    s.out[name] = bool(v) if kind == "bool" and isinstance(v, int) else float(v) if kind in S.FLOATS and isinstance(v, int) else v

            return derive
        encoding = ENCODINGS.get((m.encoding or "").lower(), self.l.home[home].encoding)
        read = self.array(m.type, m.array, args, home, encoding, name)
        magic = self.expr(m.magic, args) if m.magic is not None else None
        checks = [(self.expr(e, args), text) for e, text in m.asserts]
        bits = self.l.bits.get(m.type.name) if m.type.kind == "ref" and m.array is None else None
        pointer = m.show_ptr and m.type.kind == "ptr"
        nul = m.type.kind in ("cstring", "string", "fixed_string") and m.array is None

        def run(c: Context, s: Scope) -> None:
            start = c.pos
            s.offset[name] = start
            v, shown = read(c, s)
            s.vals[name], s.size[name] = v, c.pos - start
            s.wire[name] = c.buf[start : c.pos]
            if nul and isinstance(v, str):
                s.wire[name] = _content(s.wire[name], m.type.kind, encoding)
            if magic is not None:
                want = magic(c, s, {})
                if (v if isinstance(v, (str, bytes)) else number(v)) != want:
                    raise CellError("PE100", f"{name} has another value", start)
            if bits is not None:
                s.vals.update(v.vals)
            if not hidden:
                s.out[name] = shown
                if pointer:
                    s.out[name + "_ptr"] = s.vals.get("\0ptr")
            for check, text in checks:
                if not true(check(c, s, {})):
                    raise CellError("PE100", text, start)

        return run

    def array(self, t: S.Type, spec: S.ArraySpec | None, args: frozenset[str], home: str, encoding: str, name: str) -> Read:
        one = self.type(t, args, home, encoding, name)
        if spec is None:
            return one
        kind = spec.kind
        var = spec.expr.name if isinstance(spec.expr, S.Lambda) else None
        test = self.expr(spec.expr, args) if spec.expr is not None else None

        def loop(c: Context, s: Scope) -> tuple[list, list]:
            vals: list = []
            outs: list = []
            count = max(0, int(number(test(c, s, {})))) if kind == "count" else 0
            s.vals[name] = vals
            c.index.append(0)
            try:
                while kind != "count" or len(vals) < count:
                    if len(vals) >= c.limit:
                        raise CellError("PE103", f"more than {c.limit} elements", c.pos)
                    c.index[-1] = len(vals)
                    start = c.pos
                    if kind == "greedy":
                        if start >= c.size:
                            break
                        try:
                            v, o = one(c, s)
                        except CellError:
                            c.pos = start
                            break
                    else:
                        v, o = one(c, s)
                    if kind == "sentinel" and true(test(c, s, {var: v})):
                        break
                    vals.append(v)
                    outs.append(o)
                    if kind == "until" and true(test(c, s, {} if var is None else {var: v})) or kind == "sentinel" and c.pos >= c.size or kind == "greedy" and c.pos == start:
                        break
            finally:
                c.index.pop()
            return vals, outs

        return loop

    def type(self, t: S.Type, args: frozenset[str], home: str, encoding: str, name: str) -> Read:
        kind = t.kind
        if kind in S.INTS:
            sign, size = S.INTS[kind]
            order, signed = "big" if (t.endian or self.l.home[home].endian) == "be" else "little", sign == "i"
            if kind == "u64":

                def wide(c: Context, s: Scope) -> tuple[int, Any]:
                    v = int.from_bytes(c.take(8), order)
                    return (v - (1 << 64) if v >> 63 else v), Unsigned(v)

                return wide

            def integer(c: Context, s: Scope) -> tuple[int, int]:
                v = int.from_bytes(c.take(size), order, signed=signed)
                return v, v

            return integer
        if kind in S.FLOATS:
            unpack = struct.Struct((">" if (t.endian or self.l.home[home].endian) == "be" else "<") + ("f" if kind == "f32" else "d"))

            def real(c: Context, s: Scope) -> tuple[float, float]:
                v = unpack.unpack(c.take(unpack.size))[0]
                return v, v

            return real
        if kind == "bool":

            def boolean(c: Context, s: Scope) -> tuple[int, bool]:
                v = c.take(1) != b"\0"
                return int(v), v

            return boolean
        if kind == "cstring":
            return lambda c, s: _twice(_cstring(c, encoding))
        if kind in ("string", "fixed_string", "bytes"):
            length = self.expr(t.size, args)
            strip = kind == "fixed_string" and not self.keep_nul

            def sized(c: Context, s: Scope) -> tuple[Any, Any]:
                raw = c.take(int(number(length(c, s, {}))))
                if kind == "bytes":
                    return raw, raw
                text = raw.decode(encoding, "replace")
                return _twice(text.rstrip("\0") if strip else text)

            return sized
        if kind == "bit" or kind == "bits":
            width = 1 if kind == "bit" else t.size

            def loose(c: Context, s: Scope) -> tuple[int, Any]:
                v = int.from_bytes(c.take(-(-width // 8)), "little") & (1 << width) - 1
                return v, bool(v) if kind == "bit" else v

            return loose
        if kind == "ptr":
            return self.pointer(t, args, home, encoding, name)
        if kind == "match":
            return self.match(t, args, home, encoding, name)
        if t.name in self.l.enums:
            return self.type(self.l.enums[t.name].base, args, t.name, encoding, name)
        if t.name in self.l.bits:
            return self.bit_fields(self.l.bits[t.name])
        given = [self.expr(a, args) for a in t.args]
        params = self.l.structs[t.name].params
        read = self.struct(t.name)

        def nested(c: Context, s: Scope) -> tuple[Scope, Scope]:
            scope = read(c, dict(zip(params, [g(c, s, {}) for g in given], strict=True)))
            return scope, scope

        return nested

    def bit_fields(self, decl: S.BitsStruct) -> Read:
        base = self.type(decl.base, frozenset(), decl.name, "utf-8", decl.name)
        full = 8 * S.INTS[decl.base.kind][1]

        def read(c: Context, s: Scope) -> tuple[Scope, Scope]:
            out = Scope(c.pos, {})
            word = base(c, s)[0] & (1 << full) - 1
            for name, width, one in decl.fields:
                v = wrap(word & (1 << width) - 1)
                word >>= width
                out.vals[name], out.out[name] = v, bool(v) if one else v
            return out, out

        return read

    def pointer(self, t: S.Type, args: frozenset[str], home: str, encoding: str, name: str) -> Read:
        word = self.type(t.width, args, home, encoding, name)
        encoding = ENCODINGS.get((t.encoding or "").lower(), encoding)
        target = self.array(t.inner, t.inner_array, args, home, encoding, name)
        bits = 8 * S.INTS[t.width.kind][1]

        def follow(c: Context, s: Scope) -> tuple[Any, Any]:
            start = c.pos
            address = word(c, s)[0]
            s.vals["\0ptr"] = address
            if t.nullable and address == 0:
                return None, None
            if t.relative:
                to = start + (address - (1 << bits) if address >> (bits - 1) == 1 else address)
            else:
                if "base_ptr" not in c.params:
                    raise CellError("PE100", "missing parameter base_ptr", start)
                to = address - c.params["base_ptr"]
            back, c.pos = c.pos, to
            if not 0 <= to <= c.size:
                raise CellError("PE101", f"pointer to {to} is outside", start)
            try:
                return target(c, s)
            finally:
                c.pos = back

        return follow

    def match(self, t: S.Type, args: frozenset[str], home: str, encoding: str, name: str) -> Read:
        on = self.expr(t.on, args)
        arms = []
        for a in t.arms:
            low = self.expr(a.low, args) if a.kind in ("value", "range") else None
            high = self.expr(a.high, args) if a.kind == "range" else None
            own = args | {a.low} if a.kind == "bind" else args
            guard = self.expr(a.guard, own) if a.guard is not None else None
            arms.append((a.kind, low, high, a.low if a.kind == "bind" else None, guard, variant_name(a), self.array(a.type, a.array, own, home, encoding, name)))

        def pick(c: Context, s: Scope) -> tuple[Any, Any]:
            d = on(c, s, {})
            for kind, low, high, bound, guard, label, read in arms:
                if kind == "value":
                    v = low(c, s, {})
                    if not (d == v if isinstance(d, str) or isinstance(v, str) else number(d) == number(v)):
                        continue
                elif kind == "range" and not number(low(c, s, {})) <= number(d) <= number(high(c, s, {})):
                    continue
                if guard is not None and not true(guard(c, s, {bound: d} if bound else {})):
                    continue
                v, o = read(c, s)
                return v, Variant(label, o)
            return None, Variant("", None)

        return pick


def _twice(x: Any) -> tuple[Any, Any]:
    return x, x


def _content(raw: bytes, kind: str, encoding: str) -> bytes:
    """The bytes of a string without its terminator or padding."""
    unit = b"\0\0" if encoding.startswith("utf-16") else b"\0"
    if kind == "cstring" and raw.endswith(unit):
        return raw[: -len(unit)]
    return raw.rstrip(b"\0") if kind == "fixed_string" and len(unit) == 1 else raw


def _cstring(c: Context, encoding: str) -> str:
    unit = 2 if encoding.startswith("utf-16") else 1
    end = c.buf.find(b"\0", c.pos) if unit == 1 else next((i for i in range(c.pos, c.size - 1, 2) if c.buf[i : i + 2] == b"\0\0"), -1)
    if end < 0:
        if c.strict or c.pos >= c.size:
            raise CellError("PE101", "a string has no end", c.pos)
        return c.take(c.size - c.pos).decode(encoding, "replace")
    text = c.take(end - c.pos).decode(encoding, "replace")
    c.pos += unit
    return text


# ---- shapes of the result ------------------------------------------------


def plain(x: Any) -> Any:
    """As JSON has it: absent members are left out, bytes are base64, a match is its value."""
    if isinstance(x, Scope):
        return {k: plain(v) for k, v in x.out.items() if not (isinstance(v, Variant) and not v.name)}
    if isinstance(x, Variant):
        return plain(x.value)
    if isinstance(x, list):
        return [plain(v) for v in x]
    return base64.b64encode(x).decode() if isinstance(x, bytes) else int(x) if isinstance(x, Unsigned) else x


def to_json(scope: Scope) -> str:
    return json.dumps(plain(scope), ensure_ascii=False, separators=(",", ":"))
