"""The column lowering: a layout whose offsets are expressions becomes Catalyst columns.

Integers, booleans, enums, bits structs, sized strings and bytes, nested structs, counted arrays
of fixed-size elements, searches and indexes in them, checksums, magic values, assertions, seeks,
blocks at an offset, gaps and computed members are lowered; everything that needs a moving cursor
(NotLowered) goes to the reader. Unused members vanish from the plan, and a filter on a member
reaches down to its bytes.

No cell makes an expression fail, whatever the session's ANSI setting: integers wrap at 64 bits,
offsets that leave the range become null and fail their check, and what a cell lacks is an error
with the code and offset that the reader gives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import syntax as S
from .layout import ENCODINGS, Layout


ERROR = T.StructType([T.StructField("code", T.StringType()), T.StructField("message", T.StringType()), T.StructField("offset", T.LongType())])


class NotLowered(Exception):
    pass


#: Elements of an array at most, as in the reader.
MAX_ELEMENTS = 10_000_000
#: Map calls that are written out in one layout.
MAX_CALLS = 200
#: Nested operations that may overflow: each writes its operands out three times.
MAX_DEEP = 3
TOP = (1 << 63) - 1


class _Value:
    """A column and whether it is a boolean; ``members`` of a structure, by name; ``raw`` bytes
    of a field; ``element`` makes the value of an array's element from its column."""

    def __init__(self, column: Column | None, boolean: bool = False, members: dict | None = None, text: bool = False, raw: Column | None = None, element=None, span: tuple[int, int] | None = None, deep: int = 0):
        self.column, self.boolean, self.members, self.text, self.raw, self.element = column, boolean, members, text, raw, element
        #: Bounds of a number; how many operations that may overflow are nested in it.
        self.span, self.deep = span or ((0, 1) if boolean else (-TOP - 1, TOP)), deep

    def long(self) -> Column:
        if self.column is None or self.text:
            raise NotLowered("a structure or text as a number")
        return self.column.cast("long")

    def truth(self) -> Column:
        return self.column if self.boolean else self.long() != 0


class Offset:
    """A constant plus, perhaps, a column; adding constants keeps a constant."""

    def __init__(self, fixed: int, moving: Column | None = None):
        self.fixed, self.moving = fixed, moving

    def plus(self, n: int | Column) -> Offset:
        if isinstance(n, int):
            return Offset(self.fixed + n, self.moving)
        return Offset(self.fixed, n if self.moving is None else F.try_add(self.moving, n))

    def column(self) -> Column:
        """Null beyond the range of long."""
        return _long(self.fixed) if self.moving is None else F.try_add(self.moving, _long(self.fixed))


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _number(raw: Column, n: int, little: bool) -> Column:
    """Up to eight bytes as a long. Little-endian digits are turned round as a whole; the two
    digits of each byte then change places as numbers, so the bytes appear twice, not n times."""
    if not little or n == 1:
        return F.conv(F.hex(raw), 16, -10).cast("long")
    turned = F.conv(F.reverse(F.hex(raw)), 16, -10).cast("long")
    mask = _long(0x0F0F0F0F0F0F0F0F)
    return F.shiftleft(turned.bitwiseAND(mask), 4).bitwiseOR(F.shiftrightunsigned(turned, 4).bitwiseAND(mask))


def digits(value: Column, n: int, little: bool) -> Column:
    """The last ``n`` bytes of a long as hexadecimal digits, the inverse of ``_number``."""
    if little and n > 1:
        mask = _long(0x0F0F0F0F0F0F0F0F)
        value = F.shiftleft(value.bitwiseAND(mask), 4).bitwiseOR(F.shiftrightunsigned(value, 4).bitwiseAND(mask))
    out = F.substring(F.lpad(F.hex(value), 16, "0"), 17 - 2 * n, 2 * n)
    return F.reverse(out) if little and n > 1 else out


def _span(kind: str) -> tuple[int, int]:
    sign, n = S.INTS[kind]
    return (-1 << 8 * n - 1, (1 << 8 * n - 1) - 1) if sign == "i" else (0, (1 << 8 * n) - 1)


def two_64() -> Column:
    return F.lit("18446744073709551616").cast("decimal(20,0)")


def _spanned(op: str, a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int] | None:
    """Bounds of a op b; None if it may overflow."""
    ends = [{"+": x + y, "-": x - y, "*": x * y}[op] for x in a for y in b]
    return (min(ends), max(ends)) if -TOP - 1 <= min(ends) and max(ends) <= TOP else None


def _wrapped(op: str, x: Column, y: Column) -> Column:
    """x op y of longs, modulo 2**64; the long way is taken only where it overflows."""
    quick = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y)
    a, b = x.cast("decimal(19,0)"), y.cast("decimal(19,0)")
    whole = two_64()
    rest = F.pmod(({"+": a + b, "-": a - b, "*": a * b}[op]).cast("decimal(38,0)"), whole)
    slow = F.when(rest > F.lit(TOP).cast("decimal(20,0)"), rest - whole).otherwise(rest).cast("long")
    return F.coalesce(quick, slow)


class ColumnPlan:
    def __init__(self, layout: Layout, cell: Column, params: dict | None = None):
        self.l, self.cell, self.params = layout, cell, params or {}
        #: What a cell must satisfy, in reading order: (condition, code, message, offset).
        self.checks: list[tuple[Column, str, Column, Column]] = []
        #: Fixed offsets and sizes that are read, and the conditions of the other checks.
        self.leaves: list[tuple[int, int]] = []
        self.others: list[Column] = []
        self.calls, self.lambdas = 0, 0
        self.size = F.length(cell).cast("long")

    def build(self, entry: str | None = None, names: bool = False) -> tuple[Column, Column, Column, Column]:
        """(struct, whether the cell follows the layout, error, bytes consumed); the first check
        that fails makes the error."""
        self.names = names
        fields, end, _ = self.struct(self.l.entry(entry), Offset(0), {}, ())
        value = F.struct(*fields) if fields else F.struct(F.lit(None).alias("_"))
        if not self.checks:
            return value, F.lit(True), F.lit(None).cast(ERROR), end.column()
        wrong = None
        for good, code, message, offset in self.checks:
            made = F.struct(F.lit(code).alias("code"), message.alias("message"), F.coalesce(offset, _long(TOP)).alias("offset"))
            bad = ~F.coalesce(good, F.lit(False))
            wrong = F.when(bad, made) if wrong is None else wrong.when(bad, made)
        most = [self.size >= _long(max(at + n for at, n in self.leaves))] if self.leaves else []
        fine = F.coalesce(reduce(lambda a, b: a & b, most + self.others), F.lit(False))
        return value, fine, F.when(~fine, wrong).cast(ERROR), end.column()

    def check(self, good: Column, code: str, message: str | Column, offset: Column) -> None:
        self.checks.append((good, code, F.lit(message) if isinstance(message, str) else message, offset))
        self.others.append(F.coalesce(good, F.lit(False)))

    def slice(self, at: Offset, n: int | Column) -> Column:
        """``n`` bytes at an offset; the plan notes that they must be there."""
        length = _long(n) if isinstance(n, int) else n
        lacking = F.concat(length.cast("string"), F.lit(" bytes are not there"))
        if at.moving is None and isinstance(n, int):
            self.leaves.append((at.fixed, n))
            self.checks.append((self.size >= _long(at.fixed + n), "PE101", lacking, at.column()))
            return F.substring(self.cell, F.lit(at.fixed + 1), F.lit(n))
        here = at.column()
        self.check((here >= 0) & (length >= 0) & (F.try_subtract(self.size, here) >= length), "PE101", lacking, here)
        return F.substring(self.cell, F.try_add(here, _long(1)).try_cast("int"), length.try_cast("int"))

    # -- structures

    def struct(self, s: S.Struct, at: Offset, args: dict[str, _Value], path: tuple[str, ...]) -> tuple[list[Column], Offset, dict[str, _Value]]:
        if s.name in path:
            raise NotLowered("recursion")
        scope = dict(args)
        fields: list[Column] = []
        at = self.members(s.members, at, at, scope, fields, s.name, (*path, s.name), None)
        return fields, at, scope

    def members(self, members: list, at: Offset, start: Offset, scope: dict, fields: list, home: str, path: tuple, guard: Column | None) -> Offset:
        for m in members:
            if isinstance(m, S.Field):
                at = self.field(m, at, scope, fields, home, path)
                continue
            if m.kind == "let":
                scope[m.name] = self.expr(m.expr, scope, at)
            elif m.kind == "skip":
                at = at.plus(int(m.expr.value))
            elif m.kind == "align":
                n = self.constant(m.expr)
                if n is None or at.moving is not None:
                    raise NotLowered("alignment of a moving offset")
                at = at.plus(-at.fixed % max(1, n))
            elif m.kind == "seek":
                n = self.constant(m.expr)
                at = Offset(n) if n is not None else Offset(0, self.expr(m.expr, scope, at).long())
            elif m.kind == "assert":
                self.check(self.expr(m.expr, scope, at).truth(), "PE100", m.name, at.column())
            elif m.guard is None:
                self.members(m.members, Offset(0, self.expr(m.expr, scope, at).long()), start, scope, fields, home, path, None)
            else:
                raise NotLowered("a guarded block")
        return at

    def field(self, m: S.Field, at: Offset, scope: dict, fields: list, home: str, path: tuple) -> Offset:
        if m.derived is not None:
            v = self.expr(m.derived, scope, at)
            scope[m.name] = v
            if not m.hidden:
                from .layout import type_schema

                target = type_schema(self.l, m.type, False, ())
                if m.type.kind in S.INTS:
                    fits = v.long().try_cast(target)
                    self.check(fits.isNotNull(), "PE100", f"{m.name} does not fit {m.type.kind}", at.column())
                elif m.type.kind == "bool":
                    fits = v.truth()
                elif v.text:
                    fits = v.column.cast(target)
                else:
                    raise NotLowered("a computed " + m.type.kind)
                fields.append(fits.alias(m.name))
            return at
        if m.show_ptr:
            raise NotLowered("pointer")
        encoding = ENCODINGS.get((m.encoding or "").lower(), self.l.home[home].encoding)
        if m.array is not None:
            value, end = self.array(m, at, scope, home, encoding, path)
        else:
            value, end = self.type(m.type, at, scope, home, encoding, path)
        scope[m.name] = value
        if m.magic is not None:
            want = self.expr(m.magic, scope, at)
            self.check(value.column == want.column if value.text else value.long() == want.long(), "PE100", f"{m.name} has another value", at.column())
        if not m.hidden:
            fields.append(value.column.alias(m.name))
            if self.names and m.type.kind == "ref" and m.type.name in self.l.enums and m.array is None:
                named = F.lit(None).cast("string")
                for k, v in reversed(self.l.enum_values[m.type.name].items()):
                    named = F.when(value.column == v, k).otherwise(named)
                fields.append(named.alias(m.name + "_name"))
        if m.type.kind == "ref" and m.type.name in self.l.bits and m.array is None:
            scope.update(value.members)
        for e, text in m.asserts:
            self.check(self.expr(e, scope, end).truth(), "PE100", text, at.column())
        return end

    def array(self, m: S.Field, at: Offset, scope: dict, home: str, encoding: str, path: tuple) -> tuple[_Value, Offset]:
        if m.array.kind != "count":
            raise NotLowered("an array without a count")
        probe = ColumnPlan(self.l, self.cell, self.params)
        probe.names = self.names
        _, end = probe.type(m.type, Offset(0), scope, home, encoding, path)
        if end.moving is not None or probe.others:
            raise NotLowered("elements of moving size, or with checks")
        size, leaves = end.fixed, probe.leaves
        if not size:
            raise NotLowered("elements of no size")
        count = self.constant(m.array.expr)
        n = _long(max(0, count)) if count is not None else F.greatest(self.expr(m.array.expr, scope, at).long(), _long(0))
        total = max(0, count) * size if count is not None else F.try_multiply(n, _long(size))
        here = at.column()
        whole = (n == 0) | ((here >= 0) & (F.try_subtract(self.size, here) >= total))
        # the first field of the first element that is not wholly there
        last = F.greatest(F.call_function("div", F.try_subtract(self.size, here), _long(size)), _long(0))
        start = F.when(here < 0, here).otherwise(F.try_add(here, F.try_multiply(last, _long(size))))
        offset = length = None
        for o, k in leaves[:-1]:
            short = (here < 0) | (start > F.try_subtract(self.size, _long(o + k)))
            offset = F.when(short, F.try_add(start, _long(o))) if offset is None else offset.when(short, F.try_add(start, _long(o)))
            length = F.when(short, F.lit(k)) if length is None else length.when(short, F.lit(k))
        o, k = leaves[-1]
        offset = F.try_add(start, _long(o)) if offset is None else offset.otherwise(F.try_add(start, _long(o)))
        length = F.lit(k) if length is None else length.otherwise(F.lit(k))
        self.check(whole, "PE101", F.concat(length.cast("string"), F.lit(" bytes are not there")), offset)
        self.check(n <= MAX_ELEMENTS, "PE103", f"more than {MAX_ELEMENTS} elements", F.try_add(here, _long(MAX_ELEMENTS * size)))
        raw = F.substring(self.cell, F.try_add(here, _long(1)).try_cast("int"), (_long(total) if isinstance(total, int) else total).try_cast("int"))

        def one(i: Column) -> Column:
            plan = ColumnPlan(self.l, F.substring(raw, (i * size + 1).cast("int"), F.lit(size)), self.params)
            plan.names = self.names
            return plan.type(m.type, Offset(0), scope, home, encoding, path)[0].column

        turns = F.when(whole & (n <= MAX_ELEMENTS), n)
        items = F.when(turns > 0, F.transform(F.sequence(_long(0), F.greatest(turns, _long(1)) - 1), one))
        items = items.when(turns == 0, F.slice(F.transform(F.sequence(_long(0), _long(0)), one), 1, 0))
        return _Value(items, raw=raw, element=lambda x: self.element(m.type, x)), at.plus(total)

    def element(self, t: S.Type, x: Column) -> _Value:
        """An element (or a member of one) from its column."""
        if t.kind in S.INTS:
            if t.kind != "u64":
                return _Value(x, span=_span(t.kind))
            v = _Value(x)
            whole = two_64()
            v.long = lambda: F.when(x > F.lit(TOP).cast("decimal(20,0)"), x - whole).otherwise(x).cast("long")  # type: ignore[method-assign]
            return v
        if t.kind in ("string", "fixed_string", "bytes"):
            return _Value(x, text=True)
        if t.kind == "bool":
            return _Value(x, True)
        if t.kind != "ref":
            raise NotLowered(t.kind)
        if t.name in self.l.enums:
            return self.element(self.l.enums[t.name].base, x)
        if t.name in self.l.bits:
            return _Value(x, members={n: _Value(x.getField(n), one) for n, _, one in self.l.bits[t.name].fields})
        members = {}
        for m in self.l.structs[t.name].members:
            if isinstance(m, S.Field) and not m.hidden and m.array is None:
                members[m.name] = self.element(m.type, x.getField(m.name))
        return _Value(x, members=members)

    # -- types

    def type(self, t: S.Type, at: Offset, scope: dict, home: str, encoding: str, path: tuple) -> tuple[_Value, Offset]:
        kind = t.kind
        if kind in S.INTS:
            return self.integer(t, at, home), at.plus(S.INTS[kind][1])
        if kind == "bool":
            raw = self.slice(at, 1)
            return _Value(F.hex(raw) != "00", True, raw=raw), at.plus(1)
        if kind in ("string", "fixed_string", "bytes"):
            n = self.constant(t.size)
            length = n if n is not None else self.expr(t.size, scope, at).long()
            raw = self.slice(at, length)
            if kind == "bytes":
                return _Value(raw, text=True, raw=raw), at.plus(length)
            if encoding == "utf-8":
                text = F.make_valid_utf8(raw.cast("string"))
            elif encoding == "latin-1":
                text = F.decode(raw, "ISO-8859-1")
            else:
                raise NotLowered(encoding)
            if kind == "fixed_string":
                return _Value(F.rtrim(text, F.lit("\0")), text=True), at.plus(length)
            return _Value(text, text=True, raw=raw), at.plus(length)
        if kind == "ref":
            if t.name in self.l.enums:
                return self.type(self.l.enums[t.name].base, at, scope, t.name, encoding, path)
            if t.name in self.l.bits:
                return self.bit_fields(self.l.bits[t.name], at)
            decl = self.l.structs[t.name]
            args = {p: self.expr(a, scope, at) for p, a in zip(decl.params, t.args, strict=True)}
            fields, end, inner = self.struct(decl, at, args, path)
            if not fields:
                raise NotLowered("an empty structure")
            return _Value(F.struct(*fields), members=inner), end
        raise NotLowered(kind)

    def integer(self, t: S.Type, at: Offset, home: str) -> _Value:
        sign, n = S.INTS[t.kind]
        raw = self.slice(at, n)
        from .layout import int_type

        signed = _number(raw, n, (t.endian or self.l.home[home].endian) == "le")
        if n == 8:
            if sign == "i":
                return _Value(signed, raw=raw)
            v = _Value(F.conv(F.hex(signed), 16, 10).cast("decimal(20,0)"), raw=raw)
            v.long = lambda: signed  # type: ignore[method-assign]
            return v
        if sign == "i":  # the sign bit moves to the top and back
            signed = F.shiftright(F.shiftleft(signed, 64 - 8 * n), 64 - 8 * n)
        return _Value(signed.cast(int_type(t.kind)), raw=raw, span=_span(t.kind))

    def bit_fields(self, decl: S.BitsStruct, at: Offset) -> tuple[_Value, Offset]:
        word = self.integer(decl.base, at, decl.name).long()
        low, members = 0, {}
        for name, width, one in decl.fields:
            v = F.shiftright(word, low).bitwiseAND(_long((1 << width) - 1 if width < 64 else -1))
            members[name] = _Value(v == 1, True) if one else _Value(v.cast("int" if width < 32 else "long"), span=(0, (1 << width) - 1) if width < 64 else None)
            low += width
        return _Value(F.struct(*[v.column.alias(n) for n, v in members.items()]), members=members), at.plus(S.INTS[decl.base.kind][1])

    # -- expressions

    def constant(self, e) -> int | None:
        from ..functions.values import constant

        v = constant(e, self.l)
        return int(v) if isinstance(v, (int, bool)) else None

    def expr(self, e, scope: dict, at: Offset) -> _Value:
        from ..functions.values import constant

        if not (isinstance(e, S.Name) and e.id in scope):
            v = constant(e, self.l)
            if v is not None:
                return _Value(F.lit(v), text=True) if isinstance(v, str) else _Value(_long(int(v)), span=(int(v), int(v)))
        if isinstance(e, S.Name):
            if e.id in scope:
                return scope[e.id]
            if e.id in self.params:
                return _Value(F.lit(self.params[e.id]).cast("long"))
            raise NotLowered(e.id)
        if isinstance(e, S.Member):
            inner = self.expr(e.x, scope, at)
            if inner.members is None or e.name not in inner.members:
                raise NotLowered(e.name)
            found = inner.members[e.name]
            if isinstance(e.x, S.Index):  # no such element: 0
                if found.text or found.members is not None:
                    raise NotLowered("text of an element by index")
                return _Value(F.coalesce(found.long(), _long(0)))
            return found
        if isinstance(e, S.Builtin):
            if e.name == "@input_size":
                return _Value(self.size)
            if e.name == "@offset":
                return _Value(at.column())
            if e.name == "@remaining":
                return _Value(F.try_subtract(self.size, at.column()))
            return self.builtin(e, scope)
        if isinstance(e, S.Unary):
            x = self.expr(e.x, scope, at)
            if e.op == "-":
                return self.binary("-", _Value(_long(0), span=(0, 0)), x)
            return _Value(~x.truth(), True) if e.op == "!" else _Value(F.bitwise_not(x.long()), deep=x.deep)
        if isinstance(e, S.Binary):
            return self.binary(e.op, self.expr(e.a, scope, at), self.expr(e.b, scope, at))
        if isinstance(e, S.Call):
            self.calls += 1
            if self.calls > MAX_CALLS:
                raise NotLowered("more map calls than are written out")
            macro = self.l.macros[e.name]
            return self.expr(macro.body, {p: self.expr(a, scope, at) for p, a in zip(macro.params, e.args, strict=True)}, at)
        if isinstance(e, S.Block):
            scope = dict(scope)
            for n, x in e.lets:
                scope[n] = self.expr(x, scope, at)
            return self.expr(e.body, scope, at)
        if isinstance(e, S.Method) and e.name in ("starts_with", "ends_with", "contains"):
            a, b = self.expr(e.x, scope, at), self.expr(e.args[0], scope, at)
            return _Value({"starts_with": F.startswith, "ends_with": F.endswith, "contains": F.contains}[e.name](a.column, b.column), True)
        if isinstance(e, S.Index):
            items = self.expr(e.x, scope, at)
            if items.element is None:
                raise NotLowered("an index of something else than an array")
            i = self.expr(e.i, scope, at).long()
            got = items.element(F.get(items.column, F.when(i >= 0, i).try_cast("int")))
            return got if got.members is not None or got.text else _Value(F.coalesce(got.long(), _long(0)))
        if isinstance(e, S.Method) and e.name in ("any", "all", "find", "find_or"):
            return self.search(e, scope, at)
        raise NotLowered(type(e).__name__)

    def search(self, e: S.Method, scope: dict, at: Offset) -> _Value:
        items = self.expr(e.x, scope, at)
        if items.element is None or not isinstance(e.args[0], S.Lambda):
            raise NotLowered("a search in something else than an array")
        var, body = e.args[0].name, e.args[0].body

        def test(x: Column) -> Column:
            before = len(self.checks)
            self.lambdas += 1
            out = self.expr(body, {**scope, var: items.element(x)}, at).truth()
            self.lambdas -= 1
            if len(self.checks) > before:
                raise NotLowered("a search inside a search")
            return F.coalesce(out, F.lit(False))

        if e.name == "any":
            return _Value(F.exists(items.column, test), True)
        if e.name == "all":
            return _Value(F.forall(items.column, test), True)
        found = F.get(F.filter(items.column, test), F.lit(0))
        if e.name == "find":
            if self.lambdas:
                raise NotLowered("a search inside a search")
            self.check(found.isNotNull(), "PE100", "no element matches", at.column())
            return items.element(found)
        got, other = items.element(found), self.expr(e.args[1], scope, at)
        if got.members is not None and other.members is None and not other.text:  # a number has no members: 0
            numbers = {k: v for k, v in got.members.items() if not v.text and v.members is None and v.element is None}
            return _Value(None, members={k: _Value(F.coalesce(v.long(), _long(0))) for k, v in numbers.items()})
        if got.members is not None or got.text or other.members is not None or other.text:
            raise NotLowered("find_or of structures")
        return _Value(F.coalesce(got.long(), other.long()))

    def builtin(self, e: S.Builtin, scope: dict) -> _Value:
        values = [scope.get(a.id) if isinstance(a, S.Name) else None for a in e.args]
        if e.name == "@count" and values[0] is not None and values[0].element is not None:
            return _Value(F.greatest(F.size(values[0].column), F.lit(0)).cast("long"))
        if e.name in ("@strlen", "@crc32") and values and all(v is not None and v.raw is not None for v in values):
            if e.name == "@crc32":
                return _Value(F.crc32(F.concat(*[v.raw for v in values])))
            if values[0].text:
                return _Value(F.octet_length(values[0].raw).cast("long"))
        raise NotLowered(e.name)

    def binary(self, op: str, a: _Value, b: _Value) -> _Value:
        if op in ("&&", "||"):
            return _Value(a.truth() & b.truth() if op == "&&" else a.truth() | b.truth(), True)
        if op in ("==", "!=") and a.text and b.text:
            return _Value(a.column == b.column if op == "==" else a.column != b.column, True)
        x, y = a.long(), b.long()
        if op in ("==", "!=", "<", ">", "<=", ">="):
            return _Value({"==": x == y, "!=": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op], True)
        if op in ("+", "-", "*"):
            span, deep = _spanned(op, a.span, b.span), max(a.deep, b.deep)
            if span is not None:
                return _Value({"+": x + y, "-": x - y, "*": x * y}[op], span=span, deep=deep)
            if deep >= MAX_DEEP:
                raise NotLowered("a long expression that may overflow")
            return _Value(_wrapped(op, x, y), deep=deep + 1)
        if op in ("/", "%"):
            if op == "%":
                return _Value(F.when((y == 0) | (y == -1), _long(0)).otherwise(x % y), deep=max(a.deep, b.deep))
            negative = self.binary("-", _Value(_long(0), span=(0, 0)), a)
            wide = max(abs(a.span[0]), abs(a.span[1]))
            return _Value(F.when(y == 0, _long(0)).when(y == -1, negative.column).otherwise(F.call_function("div", x, y)), span=(-wide, wide) if wide <= TOP else None, deep=max(negative.deep, b.deep))
        deep = max(a.deep, b.deep)
        if op == "&" and min(a.span[0], b.span[0]) >= 0:
            return _Value(x.bitwiseAND(y), span=(0, min(a.span[1], b.span[1])), deep=deep)
        if op == "<<" and b.span[0] == b.span[1] and 0 <= b.span[0] < 63 and _spanned("*", a.span, (1 << b.span[0], 1 << b.span[0])):
            return _Value(F.shiftleft(x, b.span[0]), span=_spanned("*", a.span, (1 << b.span[0], 1 << b.span[0])), deep=deep)
        if op == ">>" and b.span[0] == b.span[1] and 0 <= b.span[0] <= 63:
            return _Value(F.shiftright(x, b.span[0]), span=(a.span[0] >> b.span[0], a.span[1] >> b.span[0]), deep=deep)
        if op in ("<<", ">>"):
            return _Value(F.call_function("shiftleft" if op == "<<" else "shiftright", x, y.bitwiseAND(_long(63)).cast("int")), deep=deep)
        return _Value({"&": x.bitwiseAND(y), "|": x.bitwiseOR(y), "^": x.bitwiseXOR(y)}[op], deep=deep)
