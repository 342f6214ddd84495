"""One cell at a time: what each construct reads, writes and refuses."""

import json
import struct
import zlib

import pytest

from bitloom.functions.reader import Reader, plain
from bitloom.functions.values import CellError, binary, unary
from bitloom.functions.writer import Writer
from bitloom.plans.layout import compile_script
from bitloom.plans.syntax import LayoutError, parse_script

LE = "@default_endian(little) "


def read(script, cell, **params):
    return plain(Reader(compile_script(script)).read(cell, None, params)[0])


def write(script, value, **params):
    return Writer(compile_script(script)).write(value, None, params)


@pytest.mark.parametrize(
    ("script", "cell", "want"),
    [
        ("@root struct R { a: u8, b: u16le, c: u32le }", bytes.fromhex("07014D01000000"), {"a": 7, "b": 0x4D01, "c": 1}),
        ("@default_endian(big) @root struct R { a: u32, b: u16le }", bytes.fromhex("000000010200"), {"a": 1, "b": 2}),
        ("@root struct R { a: i8, b: i16be, c: i32le }", b"\xff" + struct.pack(">h", -2) + struct.pack("<i", -3), {"a": -1, "b": -2, "c": -3}),
        ("@root struct R { a: u64le, b: i64le }", struct.pack("<Qq", 2**64 - 1, -1), {"a": 2**64 - 1, "b": -1}),
        ("@root struct R { a: f32le, b: f64be }", struct.pack("<f", 1.5) + struct.pack(">d", -2.25), {"a": 1.5, "b": -2.25}),
        ("@root struct R { a: bool, b: bool }", b"\0\2", {"a": False, "b": True}),
        ("@root struct R { a: cstring, b: u8 }", b"hi\0\5", {"a": "hi", "b": 5}),
        ("@root struct R { a: cstring @encoding(utf16le), b: u8 }", "hé".encode("utf-16-le") + b"\0\0\5", {"a": "hé", "b": 5}),
        ("@root struct R { a: fixed_string[6] }", b"TEST\0\0", {"a": "TEST"}),
        ("@root struct R { n: u8, a: string[n], b: bytes[@remaining] }", b"\2\xc3\xa9\xff", {"n": 2, "a": "é", "b": "/w=="}),
        ("@root struct R { n: u8, a: u16le[n] }", b"\2\1\0\2\0", {"n": 2, "a": [1, 2]}),
        ("@root struct R { a: u8[0], b: u8 }", b"\1", {"a": [], "b": 1}),
        ("@root struct R { a: u8[] @until(@remaining == 1), b: u8 }", b"\1\2\3", {"a": [1, 2], "b": 3}),
        ("struct E { k: u8 } @root struct R { a: E[] @until(e => e.k == 2) }", b"\1\2\3", {"a": [{"k": 1}, {"k": 2}]}),
        ("struct E { k: u8 } @root struct R { a: E[] @until(a.k == 2) }", b"\1\2\3", {"a": [{"k": 1}, {"k": 2}]}),
        ("struct E { k: u8 } @root struct R { a: E[] @until_sentinel(e => e.k == 0), b: u8 }", b"\1\2\0\7", {"a": [{"k": 1}, {"k": 2}], "b": 7}),
        ("struct E { k: u16le } @root struct R { a: E[] @greedy }", b"\1\0\2\0\3", {"a": [{"k": 1}, {"k": 2}]}),
        ("struct E { k: u8, @derived i: u32 = _index } @root struct R { a: E[2] }", b"\5\6", {"a": [{"k": 5, "i": 0}, {"k": 6, "i": 1}]}),
        ("bits struct B : u8 { a: bit, b: bit, c: bits[3], d: bits[3] } @root struct R { f: B, @derived e: u32 = f.c + d }", b"\xd5", {"f": {"a": True, "b": False, "c": 5, "d": 6}, "e": 11}),
        ("bits struct B : u64le { a: bits[64] } @root struct R { f: B }", b"\xff" * 8, {"f": {"a": -1}}),
        ("bits struct B : u64le { a: bits[63], b: bit } @root struct R { f: B }", struct.pack("<Q", 1 << 63 | 7), {"f": {"a": 7, "b": True}}),
        ("enum E : u8 { A = 1, B = 2 } @root struct R { e: E, @derived x: bool = e == E.B }", b"\2", {"e": 2, "x": True}),
        ("enum E : fixed_string[2] { A = \"ab\" } @root struct R { e: E, n: u8 }", b"ab\1", {"e": "ab", "n": 1}),
        ("@root struct R { w: u8, h: u8, @let t = w * h, @derived area: u32 = t, @hidden p: u8 }", b"\5\7\1", {"w": 5, "h": 7, "area": 35}),
        ("@root struct R { a: u8, @skip(2) b: u8, @align(8) c: u8 }", b"\1\0\0\2\0\0\0\0\3", {"a": 1, "b": 2, "c": 3}),
        ("@root struct R { o: u8, @seek(o) a: u8, @at(1) { b: u8 }, c: u8 }", b"\2\7\x08\x09", {"o": 2, "a": 8, "b": 7, "c": 9}),
        ("@root struct R { o: u8, @at(0) when o > 5 { b: u8 } }", b"\2", {"o": 2}),
        ("@root struct R { k: u8, v: match(k) { 1 => u8, 2..3 => u16le, x when x > 200 => cstring, _ => bytes[0] } }", b"\3\1\0", {"k": 3, "v": 1}),
        ("@root struct R { k: u8, v: match(k) { 1 => u8, 2..3 => u16le, x when x > 200 => cstring, _ => bytes[0] } }", b"\xffab\0", {"k": 255, "v": "ab"}),
        ("struct S(n) { a: u8[n] } @root struct R { n: u8, s: S(n + 1) }", b"\1\2\3", {"n": 1, "s": {"a": [2, 3]}}),
        ("struct E { id: u8, v: u8 } @root struct R { a: E[2], @let m = a.find(e => e.id == 2), @derived v: u32 = m.v, @derived any: bool = a.any(e => e.v == 9), @derived all: bool = a.all(e => e.v > 4), @derived o: u32 = a.find_or(e => e.id == 7, 42), @derived x: u32 = a[1].id }", b"\1\5\2\6", {"a": [{"id": 1, "v": 5}, {"id": 2, "v": 6}], "v": 6, "any": False, "all": True, "o": 42, "x": 2}),
        ("struct E { id: u8 } @root struct R { a: E[0], @derived any: bool = a.any(e => e.id == 2), @derived all: bool = a.all(e => e.id == 2), @derived n: u32 = @count(a) }", b"", {"a": [], "any": False, "all": True, "n": 0}),
        ("@map twice(x: u32): u32 = { @let y = x + x, y } @map four(x: u32): u32 = twice(twice(x)) @root struct R { a: u8, b: u8, @derived c: u32 = four(a) + twice(b) }", b"\1\2", {"a": 1, "b": 2, "c": 8}),
        ("@root struct R { pad: u8, a: u16le, s: cstring, @derived z: u32 = @sizeof(s), @derived o: u32 = @offsetof(a), @derived l: u32 = @strlen(s) }", b"\0\1\0abc\0", {"pad": 0, "a": 1, "s": "abc", "z": 4, "o": 1, "l": 3}),
    ],
)
def test_reads(script, cell, want):
    assert read(script, cell) == want


def test_checksums_match_zlib():
    got = read("@root struct R { a: u16be, b: bytes[3], @derived c: u32 = @crc32(a, b), @derived d: u32 = @adler32(b) }", b"\1\2xyz")
    assert (got["c"], got["d"]) == (zlib.crc32(b"\1\2xyz"), zlib.adler32(b"xyz"))


def test_pointers_and_recursion():
    script = LE + "@param base_ptr: u64 struct N { v: i32, next: ptr<N, u64>? } @root struct R { head: ptr<N, u64>?, rel: relptr<u8, u32>, list: ptr<u8[2], u32> }"
    cell = struct.pack("<QII", 0x1010, 24, 0x1000 + 16) + struct.pack("<iQ", 42, 0x1000 + 28) + struct.pack("<iQ", 17, 0) + b"\x09"
    cell = cell[:8] + struct.pack("<I", len(cell) - 1 - 8) + cell[12:]
    got = read(script, cell, base_ptr=0x1000)
    assert got == {"head": {"v": 42, "next": {"v": 17, "next": None}}, "rel": 9, "list": [42, 0]}


@pytest.mark.parametrize(
    ("script", "cell", "code", "said"),
    [
        ("@root struct R { a: u32le }", b"\1\2\3", "PE101", "bytes"),
        ('@root struct R { a: fixed_string[2] = "MZ" }', b"XX", "PE100", "not"),
        ('@root struct R { a: u8, @assert(a > 1, "too small") }', b"\1", "PE100", "too small"),
        ('@root struct R { a: u8 @assert(a > 1, "too small") }', b"\1", "PE100", "too small"),
        ("struct E { id: u8 } @root struct R { a: E[1], @let m = a.find(e => e.id == 2) }", b"\1", "PE100", "matches"),
        ("@root struct R @max_depth(2) { a: u8, @at(a) when a < 9 { r: R } }", b"\1\2\3\4\5", "PE100", "Max depth"),
        ("@param n: u32 @root struct R { a: u8[n] }", b"\1", "PE100", "parameter"),
        ("@root struct R { a: u8[] @until(@remaining == 0) }", b"", "PE101", "bytes"),
    ],
)
def test_refuses(script, cell, code, said):
    with pytest.raises(CellError) as e:
        read(script, cell)
    assert e.value.code == code and said in e.value.message


def test_element_limit_and_strict_mode():
    layout = compile_script("@root struct R { n: u8, a: u8[n] }")
    with pytest.raises(CellError, match="more than 2"):
        Reader(layout, max_elements=2).read(b"\3abc")
    with pytest.raises(CellError, match="left"):
        Reader(layout, strict=True).read(b"\1ab")
    assert Reader(layout).read(b"\1ab")[1] == 2


@pytest.mark.parametrize(
    ("script", "code"),
    [
        ("struct R { a: u8 ", "BSC001"),
        ("@root struct R { a: $ }", "BSC001"),
        ("struct A { } struct A { }", "BSC100"),
        ("struct A(n) { } @root struct R { a: A }", "BSC101"),
        ("@root struct R { a: Nope }", "BSC102"),
        ("@root struct R { a: ptr<u8> }", "BSC104"),
        ("@root struct R { a: u8[f(1)] }", "BSC105"),
        ("@root struct R { a: u8[zz] }", "BSC106"),
        ('@import "gone" @root struct R { }', "BSC200"),
        ("@root struct A { } @root struct B { }", "BSC300"),
        ("@root struct R { a: u8[n], n: u8 }", "BSC302"),
        ("@root struct R { r: R }", "BSC303"),
        ("@map f(x: u8): u8 = g(x) @map g(x: u8): u8 = f(x) @root struct R { a: u8 }", "BSC305"),
    ],
)
def test_diagnostics(script, code):
    with pytest.raises(LayoutError) as e:
        compile_script(script)
    assert code in {d.code for d in e.value.diagnostics}


def test_entry_errors_and_warnings():
    layout = compile_script("struct A { k: u8, v: match(k) { 1 => u8 } }")
    assert [d.code for d in layout.diagnostics] == ["BSC301"]
    for name, code in ((None, "PE001"), ("B", "API001")):
        with pytest.raises(LayoutError) as e:
            layout.entry(name)
        assert e.value.diagnostics[0].code == code


def test_imports_keep_their_own_defaults():
    got = Reader(compile_script('@import "x" ' + LE + "@root struct R { a: u16, b: Big }", {"x": "@default_endian(big) struct Big { v: u16 }"})).read(b"\1\0\0\1")
    assert plain(got[0]) == {"a": 1, "b": {"v": 1}}


def test_precedence_and_literals():
    script = parse_script("const A = 0x10 + 2 * 3 - 0b11 << 1; const B = 1 | 2 ^ 3 & 4 == 4; @root struct R { }")
    layout = compile_script("const A = 0x10 + 2 * 3 - 0b11 << 1; const B = 1 | 2 ^ 3 & 4 == 4; @root struct R { }")
    assert set(script.consts) == {"A", "B"}
    assert layout.consts == {"A": (0x10 + 6 - 3) << 1, "B": 1 | (2 ^ (3 & 1))}


def test_integer_rules():
    assert binary("+", 2**63 - 1, 1) == -(2**63)
    assert (binary("/", -7, 2), binary("%", -7, 3), binary("/", 5, 0), binary("%", 5, 0)) == (-3, -1, 0, 0)
    assert (binary("<<", 1, 65), binary(">>", -8, 1)) == (2, -4)
    assert (unary("!", 0), unary("~", 0), unary("-", -(2**63))) == (1, -1, -(2**63))


ROUND = [
    ("@root struct R { a: u8, b: u16be, c: i32le, d: u64le, e: f64le, f: bool }", struct.pack("<B", 1) + b"\1\2" + struct.pack("<iQd?", -5, 2**63, 0.5, True)),
    ("@root struct R { n: u8, s: string[n], c: cstring, p: fixed_string[4], b: bytes[2] }", b"\2hi" + b"yo\0" + b"ab\0\0" + b"\xff\0"),
    ("struct E { x: u8, @align(4) y: u16le } @root struct R { n: u8, @skip(3) a: E[n] }", b"\2\0\0\0\1\0\0\0\2\0\3\0\4\0"),
    ("bits struct B : u16be { a: bit, b: bits[7], c: bits[8] } enum E : u8 { X = 3 } @root struct R { f: B, e: E }", b"\x12\x35\3"),
    ("@root struct R { k: u8, v: match(k) { 1 => u16le, _ => cstring } }", b"\2abc\0"),
    ("@root struct R { o: u8, @at(o) { v: u8 }, w: u8 }", b"\3\7\0\x09"),
    ("@root struct R { s: cstring @encoding(utf16be), n: u8 }", "hé".encode("utf-16-be") + b"\0\0\1"),
    ("@root struct R { a: relptr<cstring, u32>, b: u8 }", b"\5\0\0\0\x07hi\0"),
]


@pytest.mark.parametrize(("script", "cell"), ROUND)
def test_round_trip(script, cell):
    value = read(script, cell)
    assert write(script, json.dumps(value)) == cell


def test_writer_fills_in_and_checks():
    assert write(LE + '@root struct R { m: u16 = 0x4D42, d: u8, @derived x: u32 = d * 2 }', {"d": 5}) == b"\x42\x4d\5"
    with pytest.raises(CellError, match="count"):
        write("@root struct R { n: u8, a: u8[n] }", {"n": 2, "a": [1]})
    script = LE + "@param base_ptr: u64 struct N { v: i32, next: ptr<N, u64>? } @root struct R { head: ptr<N, u64>? }"
    value = {"head": {"v": 1, "next": {"v": 2, "next": None}}}
    assert read(script, write(script, value, base_ptr=0x2000), base_ptr=0x2000) == value


def test_truncation_at_every_byte_is_an_error_or_a_prefix():
    script, cell = "@root struct R { n: u8, s: string[n], a: u16le[2], c: cstring }", b"\3abc\1\0\2\0xy\0"
    reader = Reader(compile_script(script))
    for k in range(len(cell)):
        try:
            got = plain(reader.read(cell[:k])[0])
        except CellError as e:
            assert e.code == "PE101"
        else:
            assert got["c"] == "xy"[: k - 8]
