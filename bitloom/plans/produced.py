"""The column lowering of ``produce``: bytes from a struct column, without Python.

Integers, booleans, enums, bits structs, nested structs, UTF-8 strings, cstrings, bytes, gaps and
alignment are lowered while their places are fixed or simply follow each other; everything else
is NotLowered and goes to the writer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import syntax as S
from .columns import NotLowered, digits, two_64
from .layout import ENCODINGS, Layout

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class BytesPlan:
    def __init__(self, layout: Layout):
        self.l = layout
        self.parts: list[tuple[str, Column]] = []  # ("hex" digits or "raw" bytes)
        self.wrong: list[Column] = []
        self.at: int | None = 0  # None: it moves

    def build(self, value: Column, kind: T.StructType, entry: str | None = None) -> Column:
        """Null for a null value, and where the writer can't write it."""
        self.struct(self.l.entry(entry), value, kind, ())
        runs: list[tuple[str, list[Column]]] = []
        for how, part in self.parts:
            if runs and runs[-1][0] == how:
                runs[-1][1].append(part)
            else:
                runs.append((how, [part]))
        pieces = [F.unhex(F.concat(*own)) if how == "hex" else F.concat(*own) for how, own in runs]
        out = F.concat(*pieces) if pieces else F.lit(b"")
        keep = value.isNotNull()
        if self.wrong:
            keep = keep & ~reduce(lambda a, b: a | b, self.wrong)
        return F.when(keep, out)

    def put(self, how: str, part: Column, size: int | None) -> None:
        self.parts.append((how, part))
        self.at = None if self.at is None or size is None else self.at + size

    def gap(self, n: int) -> None:
        if n:
            self.put("hex", F.lit("00" * n), n)

    def struct(self, s: S.Struct, value: Column | None, kind: T.DataType | None, path: tuple[str, ...]) -> None:
        if s.name in path or s.params:
            raise NotLowered("recursion or parameters")
        if kind is not None and not isinstance(kind, T.StructType):
            raise NotLowered(f"{kind.simpleString()} as {s.name}")
        known = {f.name: f.dataType for f in kind.fields} if kind is not None else {}
        sizes: dict[str, Column] = {}
        for m in s.members:
            if isinstance(m, S.Field):
                if m.derived is not None:
                    continue
                if m.array is not None:
                    raise NotLowered("an array")
                own = value.getField(m.name) if m.name in known and m.magic is None else None
                if m.magic is not None:
                    own = F.lit(self.constant(m.magic))
                    own_kind: T.DataType | None = T.StringType() if isinstance(self.constant(m.magic), str) else T.LongType()
                    own = own.cast(own_kind)
                else:
                    own_kind = known.get(m.name)
                encoding = ENCODINGS.get((m.encoding or "").lower(), self.l.home[s.name].encoding)
                self.one(m.type, own, own_kind, s.name, encoding, sizes, m.name, (*path, s.name))
            elif m.kind == "skip":
                self.gap(int(m.expr.value))
            elif m.kind == "align":
                if self.at is None:
                    raise NotLowered("alignment of a moving offset")
                self.gap(-self.at % max(1, int(self.constant(m.expr))))
            else:
                raise NotLowered("@" + m.kind)

    def constant(self, e):
        from ..functions.values import constant

        v = constant(e, self.l)
        if v is None:
            raise NotLowered("an expression")
        return int(v) if isinstance(v, bool) else v

    def number(self, value: Column | None, kind: T.DataType | None) -> Column:
        """As a long; nothing is 0."""
        if value is None:
            return F.lit(0).cast("long")
        if isinstance(kind, (*_WHOLE, T.BooleanType)):
            return F.coalesce(value.cast("long"), F.lit(0).cast("long"))
        if isinstance(kind, T.DecimalType) and kind.scale == 0 and kind.precision <= 20:
            wide, whole = value.cast("decimal(21,0)"), two_64().cast("decimal(21,0)")
            return F.coalesce(F.when(wide > F.lit((1 << 63) - 1).cast("decimal(21,0)"), wide - whole).otherwise(wide).try_cast("long"), F.lit(0).cast("long"))
        raise NotLowered(f"{kind.simpleString() if kind else None} as a number")

    def integer(self, value: Column, size: int, endian: str) -> None:
        self.put("hex", digits(value, size, endian != "be"), size)

    def one(self, t: S.Type, value: Column | None, kind: T.DataType | None, home: str, encoding: str, sizes: dict[str, Column], name: str, path: tuple[str, ...]) -> None:
        if t.kind in S.INTS:
            sizes[name] = self.number(value, kind)
            self.integer(sizes[name], S.INTS[t.kind][1], t.endian or self.l.home[home].endian)
        elif t.kind == "bool":
            self.put("hex", F.when(self.number(value, kind) != 0, "01").otherwise("00"), 1)
        elif t.kind in ("cstring", "string", "fixed_string", "bytes"):
            if encoding != "utf-8" and t.kind != "bytes":
                raise NotLowered(encoding)
            if value is not None and not isinstance(kind, T.BinaryType if t.kind == "bytes" else T.StringType):
                raise NotLowered(f"{kind.simpleString()} as {t.kind}")
            raw = F.coalesce(value.cast("binary"), F.lit(b"")) if value is not None else F.lit(b"")
            if t.kind == "cstring":
                self.put("raw", F.concat(raw, F.lit(b"\0")), None)
                return
            if isinstance(t.size, S.Name) and t.size.id in sizes:
                n, fixed = F.greatest(sizes[t.size.id], F.lit(0).cast("long")), None
            else:
                fixed = max(0, int(self.constant(t.size)))
                n = F.lit(fixed).cast("long")
            self.wrong.append((F.octet_length(raw) > n) | (n > F.lit((1 << 31) - 16)))
            self.put("raw", F.rpad(raw, n.try_cast("int"), F.lit(b"\0")), fixed)
        elif t.kind == "ref" and t.name in self.l.enums:
            self.one(self.l.enums[t.name].base, value, kind, t.name, encoding, sizes, name, path)
        elif t.kind == "ref" and t.name in self.l.bits:
            decl, at, word = self.l.bits[t.name], 0, F.lit(0).cast("long")
            known = {f.name: f.dataType for f in kind.fields} if isinstance(kind, T.StructType) else {}
            for n, width, _ in decl.fields:
                own = self.number(value.getField(n) if n in known else None, known.get(n))
                word = word.bitwiseOR(F.shiftleft(own.bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1).cast("long")), at))
                at += width
            self.integer(word, S.INTS[decl.base.kind][1], decl.base.endian or self.l.home[decl.name].endian)
        elif t.kind == "ref" and not t.args:
            self.struct(self.l.structs[t.name], value, kind, path)
        else:
            raise NotLowered(t.kind)
