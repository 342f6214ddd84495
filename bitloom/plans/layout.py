"""From a script to a checked layout: imports, names, constants, and the Spark schema.

Schema rules: u8 short, u16 int, u32 long, u64 decimal(20,0), i8 byte ... i64 long, f32 float,
f64 double; strings and bytes as such; an enum is its base type (and, if asked, its name); a
bits struct is a struct of booleans and ints; an array is an array; a match is a struct of
_variant and one nullable field for each different arm; a pointer is its target; a structure
inside itself is the JSON text of its value.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import types as T

from . import syntax as S
from .syntax import Diagnostic, LayoutError

ENCODINGS = {"utf8": "utf-8", "utf-8": "utf-8", "ascii": "ascii", "utf16le": "utf-16-le", "utf16be": "utf-16-be", "latin1": "latin-1"}
_INT_TYPES = {("u", 1): T.ShortType(), ("u", 2): T.IntegerType(), ("u", 4): T.LongType(), ("u", 8): T.DecimalType(20, 0), ("i", 1): T.ByteType(), ("i", 2): T.ShortType(), ("i", 4): T.IntegerType(), ("i", 8): T.LongType()}


@dataclass
class Module:
    """Defaults of the file that a declaration comes from."""

    endian: str = "le"
    encoding: str = "utf-8"


@dataclass
class Layout:
    """A checked script. Every declaration knows the defaults of its own file."""

    structs: dict[str, S.Struct] = field(default_factory=dict)
    bits: dict[str, S.BitsStruct] = field(default_factory=dict)
    enums: dict[str, S.Enum] = field(default_factory=dict)
    macros: dict[str, S.Macro] = field(default_factory=dict)
    consts: dict[str, object] = field(default_factory=dict)
    params: dict[str, S.Type] = field(default_factory=dict)
    home: dict[str, Module] = field(default_factory=dict)
    enum_values: dict[str, dict[str, int | str]] = field(default_factory=dict)
    root: str | None = None
    diagnostics: list[Diagnostic] = field(default_factory=list)

    def entry(self, name: str | None) -> S.Struct:
        name = name or self.root
        if name is None:
            raise LayoutError([Diagnostic("error", "PE001", "the script has no root and no entry was named")])
        if name not in self.structs:
            raise LayoutError([Diagnostic("error", "API001", f"unknown entry {name!r}")])
        return self.structs[name]

    def recursive(self, name: str) -> bool:
        """Whether a struct can hold itself."""
        seen: set[str] = set()
        todo = list(self._inside(name))
        while todo:
            n = todo.pop()
            if n == name:
                return True
            if n not in seen:
                seen.add(n)
                todo += self._inside(n)
        return False

    def _inside(self, name: str) -> list[str]:
        return [t.name for t in _types(self.structs[name].members) if t.kind == "ref" and t.name in self.structs] if name in self.structs else []


def _types(members: list) -> list[S.Type]:
    out: list[S.Type] = []

    def add(t: S.Type) -> None:
        out.append(t)
        for x in [t.inner, *(a.type for a in t.arms)]:
            if x is not None:
                add(x)

    for m in members:
        if isinstance(m, S.Step):
            out += _types(m.members)
        elif m.derived is None:
            add(m.type)
    return out


def _names(x: object, bound: frozenset[str] = frozenset()) -> list[S.Name | S.Call]:
    """Free names and calls of an expression."""
    if isinstance(x, S.Name):
        return [] if x.id in bound else [x]
    if isinstance(x, S.Lambda):
        return _names(x.body, bound | {x.name})
    if isinstance(x, S.Block):
        out = []
        for n, e in x.lets:
            out += _names(e, bound)
            bound = bound | {n}
        return out + _names(x.body, bound)
    if isinstance(x, S.Call):
        return [x, *(n for a in x.args for n in _names(a, bound))]
    parts = {S.Unary: ("x",), S.Binary: ("a", "b"), S.Member: ("x",), S.Index: ("x", "i")}.get(type(x), ())
    out = [n for p in parts for n in _names(getattr(x, p), bound)]
    if isinstance(x, S.Method):
        out += _names(x.x, bound)
    if isinstance(x, (S.Method, S.Builtin)):
        out += [n for a in x.args for n in _names(a, bound)]
    return out


METHODS = {"starts_with": 1, "ends_with": 1, "contains": 1, "find": 1, "find_or": 2, "any": 1, "all": 1}


class Checker:
    """Names, arity, roots, recursion; every finding has a code."""

    def __init__(self, layout: Layout):
        self.l, self.found = layout, layout.diagnostics

    def error(self, code: str, message: str, at: tuple[int, int] = (0, 0)) -> None:
        self.found.append(Diagnostic("error", code, message, *at))

    def warn(self, code: str, message: str, at: tuple[int, int] = (0, 0)) -> None:
        self.found.append(Diagnostic("warning", code, message, *at))

    def all(self) -> None:
        for m in self.l.macros.values():
            self.macro_cycle(m)
        for s in self.l.structs.values():
            known = {*s.params}
            self.members(s.members, known, self.fields(s.members) | known)
            if self.endless(s.name, s.name, set()):
                self.error("BSC303", f"{s.name} contains itself without a guard", s.at)

    def fields(self, members: list) -> set[str]:
        out = set()
        for m in members:
            if isinstance(m, S.Step):
                out |= self.fields(m.members) | ({m.name} if m.kind == "let" else set())
            else:
                out.add(m.name)
                out |= {n for n, _, _ in self.l.bits[m.type.name].fields} if m.type.kind == "ref" and m.type.name in self.l.bits else set()
        return out

    def macro_cycle(self, macro: S.Macro, path: tuple[str, ...] = ()) -> None:
        if macro.name in path:
            self.error("BSC305", f"map {macro.name} calls itself", macro.at)
            return
        for n in _names(macro.body):
            if isinstance(n, S.Call) and n.name in self.l.macros and len(path) < 64 and not any(d.code == "BSC305" for d in self.found):
                self.macro_cycle(self.l.macros[n.name], (*path, macro.name))

    def endless(self, start: str, name: str, seen: set[str]) -> bool:
        """Whether ``start`` is reached by plain fields alone (no array, match, pointer or guard)."""
        for m in self.l.structs[name].members:
            if isinstance(m, S.Field) and m.derived is None and m.array is None and m.type.kind == "ref" and m.type.name in self.l.structs:
                if m.type.name == start or (m.type.name not in seen and self.endless(start, m.type.name, seen | {m.type.name})):
                    return True
        return False

    def members(self, members: list, known: set[str], later: set[str]) -> None:
        for m in members:
            if isinstance(m, S.Step):
                for e in (m.expr, m.guard):
                    if e is not None:
                        self.expr(e, known, later)
                self.members(m.members, known, later)
                if m.kind == "let":
                    known.add(m.name)
                continue
            if m.derived is not None:
                self.expr(m.derived, known, later)
                if m.asserts or m.encoding:
                    self.warn("BSC304", f"modifier without effect on derived field {m.name}", m.at)
            else:
                self.type(m.type, known, later)
                if m.magic is not None:
                    self.expr(m.magic, known, later)
            known.add(m.name)
            if m.array is not None and m.array.expr is not None:
                self.expr(m.array.expr, known, later)
            if m.type.kind == "ref" and m.type.name in self.l.bits:
                known |= {n for n, _, _ in self.l.bits[m.type.name].fields}
            for cond, _ in m.asserts:
                self.expr(cond, known, later)

    def type(self, t: S.Type, known: set[str], later: set[str]) -> None:
        if t.kind == "ref":
            if t.name in self.l.structs:
                want = len(self.l.structs[t.name].params)
                if len(t.args) != want:
                    self.error("BSC101", f"{t.name} takes {want} arguments, not {len(t.args)}", t.at)
            elif t.name not in self.l.bits and t.name not in self.l.enums:
                self.error("BSC102", f"unknown type {t.name}", t.at)
            for a in t.args:
                self.expr(a, known, later)
        if t.size is not None and t.kind != "bits":
            self.expr(t.size, known, later)
        if t.encoding and t.encoding.lower() not in ENCODINGS:
            self.error("BSC103", f"unknown encoding {t.encoding}", t.at)
        if t.kind == "ptr":
            if not t.relative and "base_ptr" not in self.l.params:
                self.error("BSC104", "an absolute pointer needs @param base_ptr", t.at)
            self.type(t.inner, known, later)
        if t.kind == "match":
            self.expr(t.on, known, later)
            if not any(a.kind == "any" and a.guard is None for a in t.arms):
                self.warn("BSC301", "match without a default arm", t.at)
            for a in t.arms:
                own = known | ({a.low} if a.kind == "bind" else set())
                for e in (a.low if a.kind in ("value", "range") else None, a.high, a.guard):
                    if e is not None:
                        self.expr(e, own, later)
                self.type(a.type, own, later)
                if a.array is not None and a.array.expr is not None:
                    self.expr(a.array.expr, own | {"_"}, later)

    def expr(self, e: object, known: set[str], later: set[str]) -> None:
        for n in _names(e):
            if isinstance(n, S.Call):
                macro = self.l.macros.get(n.name)
                if macro is None:
                    self.error("BSC105", f"unknown function {n.name}", n.at)
                elif len(macro.params) != len(n.args):
                    self.error("BSC101", f"{n.name} takes {len(macro.params)} arguments, not {len(n.args)}", n.at)
            elif n.id not in known and n.id not in self.l.consts and n.id not in self.l.params and n.id not in self.l.enums and n.id not in ("_index", "_"):
                forward = n.id in later
                self.error("BSC302" if forward else "BSC106", f"{n.id} is {'used before it is read' if forward else 'unknown'}", n.at)


def compile_script(source: str, modules: Mapping[str, str] | Callable[[str], str | None] | None = None) -> Layout:
    """A checked layout; an error raises LayoutError, warnings stay in ``diagnostics``."""
    find = modules if callable(modules) else (modules or {}).get
    out, seen = Layout(), set()

    def add(text: str, main: bool) -> None:
        script = S.parse_script(text)
        home = Module("be" if script.endian == "big" else "le", ENCODINGS.get((script.encoding or "utf8").lower(), "utf-8"))
        for name in script.imports:
            if name in seen:
                continue
            seen.add(name)
            found = find(name)
            if found is None:
                out.diagnostics.append(Diagnostic("error", "BSC200", f"unknown import {name!r}"))
            else:
                add(found, False)
        out.params.update(script.params)
        for name, value in script.consts.items():
            out.consts[name] = value
        roots = 0
        for d in script.decls:
            table = {S.Struct: out.structs, S.BitsStruct: out.bits, S.Enum: out.enums, S.Macro: out.macros}[type(d)]
            if any(d.name in t for t in (out.structs, out.bits, out.enums, out.macros)):
                out.diagnostics.append(Diagnostic("error", "BSC100", f"duplicate name {d.name}", *d.at))
            table[d.name] = d
            own = home
            if isinstance(d, S.Struct) and (d.endian or d.encoding):
                own = Module({"big": "be", "little": "le"}.get(d.endian, home.endian), ENCODINGS.get((d.encoding or "").lower(), home.encoding))
            out.home[d.name] = own
            if isinstance(d, S.Struct) and d.root and main:
                roots += 1
                out.root = d.name
        if roots > 1:
            out.diagnostics.append(Diagnostic("error", "BSC300", "more than one root"))

    add(source, True)
    Checker(out).all()
    errors = [d for d in out.diagnostics if d.severity == "error"]
    if errors:
        raise LayoutError(errors)
    for name in list(out.consts):
        out.consts[name] = fold(out.consts[name], out)
    for e in out.enums.values():
        out.enum_values[e.name] = {k: fold(v, out) for k, v in e.values}
    return out


def fold(e: object, layout: Layout) -> object:
    """The value of a constant expression; None if it isn't one."""
    from ..functions.values import constant

    return constant(e, layout)


# ---- schema --------------------------------------------------------------


def int_type(kind: str) -> T.DataType:
    return _INT_TYPES[S.INTS[kind]]


def variant_name(arm: S.Arm) -> str:
    t = arm.type
    name = t.name if t.kind == "ref" else {"ptr": "pointer"}.get(t.kind, t.kind + (t.endian or ""))
    return name + ("_list" if arm.array is not None else "")


def array_of(t: T.DataType, spec: S.ArraySpec | None) -> T.DataType:
    return t if spec is None else T.ArrayType(t)


def type_schema(layout: Layout, t: S.Type, names: bool, path: tuple[str, ...]) -> T.DataType:
    if t.kind in S.INTS:
        return int_type(t.kind)
    if t.kind in ("f32", "f64", "bool"):
        return {"f32": T.FloatType(), "f64": T.DoubleType(), "bool": T.BooleanType()}[t.kind]
    if t.kind in ("cstring", "string", "fixed_string"):
        return T.StringType()
    if t.kind == "bytes":
        return T.BinaryType()
    if t.kind == "bit":
        return T.BooleanType()
    if t.kind == "bits":
        return T.IntegerType() if t.size < 32 else T.LongType()
    if t.kind == "ptr":
        return array_of(type_schema(layout, t.inner, names, path), t.inner_array)
    if t.kind == "match":
        fields = {}
        for a in t.arms:
            fields.setdefault(variant_name(a), array_of(type_schema(layout, a.type, names, path), a.array))
        return T.StructType([T.StructField("_variant", T.StringType()), *(T.StructField(n, k) for n, k in fields.items())])
    if t.name in layout.enums:
        return type_schema(layout, layout.enums[t.name].base, names, path)
    if t.name in layout.bits:
        return T.StructType([T.StructField(n, T.BooleanType() if one else T.IntegerType() if w < 32 else T.LongType()) for n, w, one in layout.bits[t.name].fields])
    if t.name in path:
        return T.StringType()
    return struct_schema(layout, layout.structs[t.name], names, path)


def struct_schema(layout: Layout, s: S.Struct, names: bool = False, path: tuple[str, ...] = ()) -> T.StructType:
    """The Spark type of a struct. With ``names``, an enum field f is followed by f_name."""
    out: list[T.StructField] = []
    path = (*path, s.name)

    def add(members: list) -> None:
        for m in members:
            if isinstance(m, S.Step):
                add(m.members)
            elif not m.hidden:
                out.append(T.StructField(m.name, array_of(type_schema(layout, m.type, names, path), m.array)))
                if names and m.type.kind == "ref" and m.type.name in layout.enums and m.array is None:
                    out.append(T.StructField(m.name + "_name", T.StringType()))
                if m.show_ptr and m.type.kind == "ptr":
                    out.append(T.StructField(m.name + "_ptr", T.LongType()))

    add(s.members)
    return T.StructType(out)
