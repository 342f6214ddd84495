"""The DataFrame operators: both lowerings, modes, outputs, files, streams and all queries."""

import json
import random

import pytest
from conftest import DATA
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from bitloom import queries as Q
from bitloom.operators import decode_column, encode_column, nodes, parse, records, register
from bitloom.plans.columns import NotLowered
from bitloom.sources import read_layout
from bitloom.streaming import parse_stream, read_layout_stream

SCRIPTS = [
    "@root struct R { a: u8, b: i16le, c: u32be, d: u64le, e: i64be }",
    "bits struct B : u16le { x: bit, y: bits[7], z: bits[8] } @root struct R { f: B, @derived s: i64 = f.y * 3 - f.z, @skip(1) t: bool }",
    "@default_endian(little) struct P { x: u16, y: i8 } @root struct R { n: u8, p: P, q: P[2], @derived m: i64 = n / (p.y + 1), @derived k: i64 = n % (p.y - 3) }",
    "@default_endian(little) @root struct R { n: u8, @let k = n & 7, a: u8[k], s: bytes[2], @seek(1) b: u8, @at(0) { again: u8 } }",
    "enum E : u8 { A = 1, B = 2 } @root struct R { e: E, s: fixed_string[3] @encoding(latin1), @derived g: bool = e > 1 && s != \"abc\" || !(e == 7) }",
    "@root struct R { n: i64le, a: u8, @derived p: i64 = n * n + a, @derived q: i64 = -n / (a - 5), @derived s: i64 = n << a, @seek(n) b: u8 }",
    "@root struct R { size: u64le, body: bytes[size], t: u8 }",
    "@root struct R { n: i64le, a: u16le[n], @derived c: u32 = @count(a) }",
    "@root struct R { a: u8, @derived b: i8 = a * 2, m: u8 = 7 }",
    "struct E { k: u8, v: i16le } @root struct R { n: u8, @let k = n & 3, a: E[k], @derived any: bool = a.any(e => e.v > 9), @derived all: bool = a.all(e => e.k != 2), @derived x: i64 = a[1].v, @let f = a.find(e => e.k > 60), @derived y: u32 = f.v & 255, @let g = a.find_or(e => e.v < 0, 3), @derived w: i64 = g.v, s: string[2], @derived z: u32 = @crc32(s, n) + @strlen(s) }",
    "bits struct B : u64le { x: bits[64] } @root struct R { f: B, @derived y: i64 = f.x + 1 }",
    "@map f(v: u8): u8 = { @let w = v + 1, w << 2 } @root struct R { a: u8, @derived b: i64 = f(a) | 1, @align(4) c: u8 }",
]


@pytest.mark.parametrize("script", SCRIPTS)
def test_both_lowerings_agree(spark, script):
    rng = random.Random(script)
    cells = [None, b""] + [rng.randbytes(rng.randrange(0, 40)) for _ in range(200)]
    extreme = [0, 1, 2, 5, 7, 1 << 31, (1 << 31) - 1, (1 << 61) + 1, (1 << 63) - 1, 1 << 63, (1 << 64) - 1, (1 << 64) - 4]
    cells += [n.to_bytes(8, "little") + rng.randbytes(rng.choice([0, 1, 4, 9])) for n in extreme for _ in range(3)]
    df = spark.createDataFrame([(i, None if c is None else bytearray(c)) for i, c in enumerate(cells)], "i int, cell binary")
    both = df.select("i", decode_column(F.col("cell"), script, lowering="columns").alias("x"), decode_column(F.col("cell"), script, lowering="reader").alias("y"))
    assert both.schema["x"].dataType["value"].dataType.simpleString() == both.schema["y"].dataType["value"].dataType.simpleString()
    for r in both.collect():
        assert r.x.value == r.y.value and r.x.consumed == r.y.consumed, (cells[r.i], r)
        assert r.x.error == r.y.error, (cells[r.i], r)


def test_column_lowering_prunes_and_keeps_out_of_python(spark):
    df = spark.createDataFrame([(bytearray(12),)], "cell binary")
    got = parse(df, "cell", "@root struct R { a: u32le, b: u32le, c: u32le }", metadata=False).select("parsed.b")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    with pytest.raises(NotLowered):
        decode_column(F.col("cell"), "@root struct R { a: cstring }", lowering="columns")


def test_modes(spark):
    df = spark.createDataFrame([(1, bytearray(b"\1\0")), (2, bytearray(b"\1")), (3, None)], "k int, cell binary")
    script = "@root struct R { a: u16le, b: cstring }".replace(", b: cstring", "")
    rows = {r.k: r for r in parse(df, "cell", script).collect()}
    assert rows[1].parsed.a == 1 and rows[1]._bytes_consumed == 2 and rows[1]._error is None
    assert rows[2].parsed is None and rows[2]._error.code == "PE101" and rows[2]._input_size == 1
    assert rows[3].parsed is None and rows[3]._error is None
    assert {r.k for r in parse(df, "cell", script, mode="DROPMALFORMED").collect()} == {1, 3}
    with pytest.raises(PySparkException, match="PE101"):
        parse(df, "cell", script, mode="FAILFAST").collect()
    with pytest.raises(ValueError, match="mode"):
        parse(df, "cell", script, mode="LOOSE")


def test_outputs_names_and_clashes(spark):
    df = spark.createDataFrame([(1, bytearray(b"\2ab\0"))], "parsed int, cell binary")
    script = "enum E : u8 { A = 1, B = 2 } @root struct R { e: E, s: cstring }"
    row = parse(df, "cell", script, enum_names=True, metadata=False).first()
    assert row.parsed.asDict() == {"e": 2, "e_name": "B", "s": "ab"}
    assert json.loads(parse(df, "cell", script, output="json").first().parsed) == {"e": 2, "s": "ab"}
    assert parse(df, "cell", script, fields=["s"]).schema["parsed"].dataType.fieldNames() == ["s"]
    register(spark, "decode_it", script)
    assert json.loads(df.selectExpr("decode_it(cell) as j").first().j)["s"] == "ab"


def test_records_and_nodes(spark):
    df = spark.createDataFrame([(1, bytearray(b"\2\5\6")), (2, bytearray(b"\0")), (3, bytearray(b""))], "k int, cell binary")
    got = {(r.k, r.pos): r.element for r in records(df, "cell", "@root struct R { n: u8, a: u8[n] }", "a").collect()}
    assert got == {(1, 0): 5, (1, 1): 6, (2, None): None, (3, None): None}
    tree = nodes(df.where("k = 1"), "cell", "struct E { v: u8 } @root struct R { n: u8, a: E[n] }").orderBy("node_id").collect()
    assert [(r.node_id, r.parent_id, r.depth, r.field, r.value) for r in tree] == [(0, None, 0, "", '{"n":2}'), (1, 0, 1, "a", '{"v":5}'), (2, 0, 1, "a", '{"v":6}')]


def test_produce_from_structs_and_json(spark):
    script = "@root struct R { k: u8, v: match(k) { 1 => u16le, _ => cstring } }"
    df = spark.createDataFrame([('{"k":1,"v":7}',), ('{"k":2,"v":"hi"}',), ("no json",), (None,)], "j string")
    cells = [None if r.c is None else bytes(r.c) for r in df.select(encode_column(F.col("j"), script).alias("c")).collect()]
    assert cells == [b"\1\7\0", b"\2hi\0", None, None]
    back = parse(spark.createDataFrame([(bytearray(c),) for c in cells[:2]], "cell binary"), "cell", script)
    again = [bytes(r.c) for r in back.select(encode_column(F.col("parsed"), script).alias("c")).collect()]
    assert again == cells[:2]


PRODUCED = [
    ("@default_endian(little) @root struct R { m: u16 = 0x4D42, o: u32, n: u8, @align(4) q: i16, @skip(2) b: bool }", "o bigint, n int, q bigint, b boolean"),
    ("bits struct B : u16be { x: bit, y: bits[7], z: bits[8] } struct P { a: u64le, b: i8 } @root struct R { f: B, p: P, s: fixed_string[5], t: cstring }", "f struct<x:boolean,y:int,z:int>, p struct<a:decimal(20,0),b:int>, s string, t string"),
    ("@root struct R { n: u8, body: string[n], raw: bytes[3], t: cstring }", "n int, body string, raw binary, t string"),
]


@pytest.mark.parametrize(("script", "schema"), PRODUCED)
def test_both_ways_of_producing_agree(spark, script, schema):
    from bitloom.operators import explain, produce, size_column

    rng = random.Random(schema)
    whole = {"bigint": lambda: rng.randrange(-(1 << 40), 1 << 40), "int": lambda: rng.randrange(0, 9), "boolean": lambda: rng.random() < 0.5, "decimal(20,0)": lambda: __import__("decimal").Decimal(rng.randrange(1 << 64)), "string": lambda: rng.choice(["", "a", "abcd", "éé"]), "binary": lambda: bytearray(rng.randbytes(rng.randrange(5)))}
    kind = spark.createDataFrame([], schema).schema

    def made(t):
        if rng.random() < 0.1:
            return None
        return {f.name: made(f.dataType) for f in t.fields} if hasattr(t, "fields") else whole[t.simpleString()]()

    df = spark.createDataFrame([(i, made(kind)) for i in range(120)], f"i int, v struct<{','.join(f.name + ':' + f.dataType.simpleString() for f in kind.fields)}>")
    quick, slow = (produce(df, "v", script, lowering=how) for how in ("columns", "writer"))
    assert "Python" not in quick._jdf.queryExecution().executedPlan().toString() and "produce: Catalyst columns" in explain(script)
    want = {r.i: None if r.bytes is None else bytes(r.bytes) for r in slow.collect()}
    assert {r.i: None if r.bytes is None else bytes(r.bytes) for r in quick.collect()} == want
    assert {r.i: r.n for r in df.select("i", size_column(F.col("v"), script).alias("n")).collect()} == {i: None if b is None else len(b) for i, b in want.items()}


def test_variant_records_function_and_explain(spark):
    from bitloom.operators import explain, register_records

    df = spark.createDataFrame([(1, bytearray(b"\2\5\6")), (2, bytearray(b"\3")), (3, None)], "k int, cell binary")
    script = "struct E { v: u8 } @root struct R { n: u8, a: E[n] }"
    got = parse(df, "cell", script, output="variant")
    assert [r.v for r in got.orderBy("k").selectExpr("variant_get(parsed, '$.a[1].v', 'int') as v").collect()] == [6, None, None]
    df.createOrReplaceTempView("cells_of_records")
    register_records(spark, "parse_records", script, "a")
    rows = spark.sql("select k, r.pos, r.element from cells_of_records, lateral parse_records(cell) r").collect()
    assert sorted((r.k, r.pos, r.element) for r in rows) == [(1, 0, '{"v":5}'), (1, 1, '{"v":6}')]
    assert "parse: Catalyst columns" in explain(script) and "rows in Python" in explain("@root struct R { a: cstring }")


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "cell binary")
    assert parse(empty, "cell", "@root struct R { a: cstring }").count() == 0
    assert nodes(empty, "cell", "@root struct R { a: u8 }").count() == 0


def test_files_and_streams(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"f{i}.bin").write_bytes(bytes([i]) + b"ab\0")
    script = "@root struct R { k: u8, s: cstring }"
    assert {r.parsed.k for r in read_layout(spark, str(tmp_path), script, glob="*.bin").collect()} == {0, 1, 2}
    stream = read_layout_stream(spark, str(tmp_path), script, files_per_trigger=1)
    query = stream.select("parsed.k").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r.k for r in spark.table("seen").collect()) == [0, 1, 2]
    assert parse_stream(stream.select(F.lit(b"\1a\0").alias("cell")), "cell", script).isStreaming


def _rows(rows):
    return sorted(tuple("" if v is None else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.REGISTRY))
def test_query_equals_its_sql(spark, duck, name):
    query, sql = Q.REGISTRY[name]
    df = query(spark, DATA)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    assert got
    if sql is not None:
        found = duck.execute(sql)
        at = [[d[0] for d in found.description].index(c) for c in cols]
        assert _rows(got) == _rows(tuple(r[i] for i in at) for r in found.fetchall())


def test_checksums_query_equals_zlib(spark):
    import zlib

    texts = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in Q.checksums(spark, DATA).collect():
        assert (r.crc, r.adler) == (zlib.crc32(texts[r.doc_id]), zlib.adler32(texts[r.doc_id]))


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(entry.queries()) >= set(Q.REGISTRY)
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["variant", "n", "cents", "users"]
