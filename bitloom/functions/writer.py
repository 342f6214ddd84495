"""Writing one cell along a layout, the inverse of ``reader``.

Magic values are written from the layout, derived fields are not on the wire, gaps are zero.
A counted array must have as many elements as its count says; a bits struct is put together
from its bits; pointers point to a region behind everything else. If a layout has expressions over
the cell's size, the cell is written twice, so that they see the final one.
"""

from __future__ import annotations

import base64
import json
import struct
from typing import Any

from ..plans import syntax as S
from ..plans.layout import ENCODINGS, Layout
from .values import CellError, Compiler, Scope, number, true


class _Out:
    def __init__(self, params: dict, size: int):
        self.buf, self.pos, self.size, self.params = bytearray(), 0, size, params
        self.index: list[int] = []
        self.later: list = []

    def put(self, raw: bytes) -> None:
        end = self.pos + len(raw)
        if self.pos < 0:
            raise CellError("PR101", "position before the start", self.pos)
        if len(self.buf) < end:
            self.buf.extend(bytes(end - len(self.buf)))
        self.buf[self.pos : end] = raw
        self.pos = end

    def text_size(self, s: Scope, name: str | None, value: Any) -> int:
        if name in s.wire:
            return len(s.wire[name])
        return len(value) if isinstance(value, bytes) else len(str(value).encode())


def _asks_size(x: Any) -> bool:
    """Whether a layout has an expression over the cell's size."""
    seen: set[int] = set()
    todo = [x]
    while todo:
        at = todo.pop()
        if id(at) in seen or isinstance(at, (str, bytes, int, float, type(None))):
            continue
        seen.add(id(at))
        if isinstance(at, S.Builtin) and at.name in ("@input_size", "@remaining"):
            return True
        todo += at.values() if isinstance(at, dict) else at if isinstance(at, (list, tuple, set, frozenset)) else vars(at).values() if hasattr(at, "__dict__") else [getattr(at, k, None) for k in getattr(at, "__slots__", ())]
    return False


class Writer:
    def __init__(self, layout: Layout):
        self.l, self.expr = layout, Compiler(layout)
        self.rounds = 2 if _asks_size(layout) else 1
        self.cache: dict[tuple[int, frozenset], Any] = {}

    def write(self, value: dict | str, entry: str | None = None, params: dict | None = None) -> bytes:
        data = json.loads(value) if isinstance(value, str) else value
        size = 0
        for _ in range(self.rounds):
            out = _Out(params or {}, size)
            self.struct(out, self.l.entry(entry), data or {}, {})
            while out.later:
                out.later.pop(0)()
            size = len(out.buf)
        return bytes(out.buf)

    def value(self, e: Any, out: _Out, s: Scope, env: dict | None = None) -> Any:
        key = (id(e), frozenset(s.args) | frozenset(env or ()))
        if key not in self.cache:
            self.cache[key] = (self.expr(e, key[1]), e)
        return self.cache[key][0](out, s, env or {})

    def struct(self, out: _Out, decl: S.Struct, data: dict, args: dict) -> Scope:
        s = Scope(out.pos, args)
        self.members(out, decl.members, data, s, decl.name)
        return s

    def members(self, out: _Out, members: list, data: dict, s: Scope, home: str) -> None:
        for m in members:
            if isinstance(m, S.Field):
                self.field(out, m, data, s, home)
                continue
            if m.kind == "let":
                s.vals[m.name] = self.value(m.expr, out, s)
            elif m.kind == "skip":
                out.put(bytes(int(m.expr.value)))
            elif m.kind == "align":
                out.put(bytes(-out.pos % max(1, int(number(self.value(m.expr, out, s))))))
            elif m.kind == "seek":
                out.pos = int(number(self.value(m.expr, out, s)))
            elif m.kind == "assert":
                if not true(self.value(m.expr, out, s)):
                    raise CellError("PR100", m.name, out.pos)
            elif m.guard is None or true(self.value(m.guard, out, s)):
                back, out.pos = out.pos, int(number(self.value(m.expr, out, s)))
                self.members(out, m.members, data, s, home)
                out.pos = back

    def field(self, out: _Out, m: S.Field, data: dict, s: Scope, home: str) -> None:
        if m.derived is not None:
            s.vals[m.name] = self.value(m.derived, out, s)
            return
        v = self.value(m.magic, out, s) if m.magic is not None else data.get(m.name)
        encoding = ENCODINGS.get((m.encoding or "").lower(), self.l.home[home].encoding)
        start = out.pos
        s.offset[m.name] = start
        s.vals[m.name] = self.array(out, m.type, m.array, v, s, home, encoding, m.name)
        s.size[m.name], s.wire[m.name] = out.pos - start, bytes(out.buf[start : out.pos])
        if m.type.kind == "cstring" and m.array is None:
            s.wire[m.name] = str(v or "").encode(encoding)
        if m.type.kind == "ref" and m.type.name in self.l.bits and m.array is None:
            s.vals.update(s.vals[m.name].vals)

    def array(self, out: _Out, t: S.Type, spec: S.ArraySpec | None, v: Any, s: Scope, home: str, encoding: str, name: str) -> Any:
        if spec is None:
            return self.one(out, t, v, s, home, encoding, name)
        items = v or []
        if spec.kind == "count" and (n := max(0, int(number(self.value(spec.expr, out, s))))) != len(items):
            raise CellError("PR100", f"{name} has {len(items)} elements, its count says {n}", out.pos)
        done: list = []
        s.vals[name] = done
        out.index.append(0)
        for i, x in enumerate(items):
            out.index[-1] = i
            done.append(self.one(out, t, x, s, home, encoding, name))
        out.index.pop()
        return done

    def one(self, out: _Out, t: S.Type, v: Any, s: Scope, home: str, encoding: str, name: str) -> Any:
        kind = t.kind
        end = t.endian or self.l.home[home].endian
        if kind in S.INTS:
            n = int(number(v))
            out.put((n & (1 << 8 * S.INTS[kind][1]) - 1).to_bytes(S.INTS[kind][1], "big" if end == "be" else "little"))
            return n
        if kind in S.FLOATS:
            out.put(struct.pack((">" if end == "be" else "<") + ("f" if kind == "f32" else "d"), float(number(v))))
            return float(number(v))
        if kind == "bool":
            out.put(b"\1" if v else b"\0")
            return int(bool(v))
        if kind == "cstring":
            out.put(str(v or "").encode(encoding) + ("\0".encode(encoding) if encoding.startswith("utf-16") else b"\0"))
            return v or ""
        if kind in ("string", "fixed_string", "bytes"):
            raw = (base64.b64decode(v) if isinstance(v, str) else bytes(v or b"")) if kind == "bytes" else str(v or "").encode(encoding)
            n = int(number(self.value(t.size, out, s)))
            if len(raw) > n and not (kind == "bytes" and out.size == 0 and self.rounds > 1):
                raise CellError("PR100", f"{name} takes {n} bytes, not {len(raw)}", out.pos)
            out.put(raw[: max(0, n)].ljust(max(0, n), b"\0"))
            return raw if kind == "bytes" else v or ""
        if kind in ("bit", "bits"):
            width = 1 if kind == "bit" else t.size
            out.put((int(v or 0) & (1 << width) - 1).to_bytes(-(-width // 8), "little"))
            return int(v or 0)
        if kind == "ptr":
            return self.pointer(out, t, v, s, home, encoding, name)
        if kind == "match":
            return self.match(out, t, v, s, home, encoding, name)
        if t.name in self.l.enums:
            if isinstance(v, str) and v in self.l.enum_values[t.name]:
                v = self.l.enum_values[t.name][v]
            return self.one(out, self.l.enums[t.name].base, v, s, t.name, encoding, name)
        if t.name in self.l.bits:
            decl, inner, word, at = self.l.bits[t.name], Scope(out.pos, {}), 0, 0
            for n, width, _ in decl.fields:
                inner.vals[n] = int((v or {}).get(n) or 0) & (1 << width) - 1
                word |= inner.vals[n] << at
                at += width
            self.one(out, decl.base, word, s, decl.name, encoding, name)
            return inner
        decl = self.l.structs[t.name]
        return self.struct(out, decl, v or {}, dict(zip(decl.params, [self.value(a, out, s) for a in t.args], strict=True)))

    def pointer(self, out: _Out, t: S.Type, v: Any, s: Scope, home: str, encoding: str, name: str) -> Any:
        start, width = out.pos, t.width
        self.one(out, width, 0, s, home, encoding, name)
        if v is None and t.nullable:
            return None
        inner = ENCODINGS.get((t.encoding or "").lower(), encoding)

        def place() -> None:
            back, out.pos = out.pos, len(out.buf)
            to = out.pos - start if t.relative else out.pos + out.params.get("base_ptr", 0)
            self.array(out, t.inner, t.inner_array, v, s, home, inner, name)
            out.pos = start
            self.one(out, width, to, s, home, encoding, name)
            out.pos = back

        out.later.append(place)
        return v

    def match(self, out: _Out, t: S.Type, v: Any, s: Scope, home: str, encoding: str, name: str) -> Any:
        d = self.value(t.on, out, s)
        for a in t.arms:
            env: dict = {}
            if a.kind == "value":
                x = self.value(a.low, out, s)
                if not (d == x if isinstance(d, str) or isinstance(x, str) else number(d) == number(x)):
                    continue
            elif a.kind == "range":
                if not number(self.value(a.low, out, s)) <= number(d) <= number(self.value(a.high, out, s)):
                    continue
            elif a.kind == "bind":
                env = {a.low: d}
            if a.guard is None or true(self.value(a.guard, out, s, env)):
                return self.array(out, a.type, a.array, v, s, home, encoding, name)
        return None
