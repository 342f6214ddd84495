"""Registered queries over the driver's tables, each with DuckDB SQL for the same rows.

A query packs table columns into a binary cell with Spark functions of its own (hex digits in
explicit byte order, never the engine's writer, but for the produce queries), applies the
operator under test, and returns plain columns. All run over whole tables.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import decode_column, encode_column, nodes, parse, produce, records


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def be(c: Column, n: int) -> Column:
    """The low n bytes of an integer, big-endian."""
    return F.unhex(F.right(F.lpad(F.hex(c.cast("long")), 16, "0"), F.lit(2 * n)))


def le(c: Column, n: int) -> Column:
    x, low = c.cast("long"), F.lit(0x0F0F0F0F0F0F0F0F)
    swapped = F.shiftleft(x.bitwiseAND(low), 4).bitwiseOR(F.shiftrightunsigned(x, 4).bitwiseAND(low))  # the digits of each byte
    return F.unhex(F.reverse(F.substring(F.lpad(F.hex(swapped), 16, "0"), 17 - 2 * n, 2 * n)))


def text(c: Column) -> Column:
    return F.encode(c, "UTF-8")


def utf16(c: Column) -> Column:
    return F.encode(c, "UTF-16LE")


def joined(items: Column) -> Column:
    """An array of cells as one cell."""
    return F.unhex(F.array_join(F.transform(items, F.hex), ""))


ITEM = "@default_endian(little) struct Item { line: u8, quantity: u16, part: u32 } "


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, items): each order's lines as 7-byte records, by line number."""
    li = table(spark, sf_dir, "lineitem")
    record = F.concat(le(F.col("l_linenumber"), 1), le(F.col("l_quantity"), 2), le(F.col("l_partkey"), 4))
    got = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_partkey", record.alias("r")))).alias("rs"))
    return got.select("l_orderkey", F.size("rs").alias("n"), joined(F.transform("rs", lambda x: x["r"])).alias("items"))


def flat_le(spark, d):
    li = table(spark, d, "lineitem").select(F.concat(le(F.col("l_orderkey"), 8), le(F.col("l_partkey"), 4), le(F.col("l_linenumber"), 2)).alias("cell"))
    got = parse(li, "cell", "@default_endian(little) @root struct R { o: i64, p: u32, n: u16 }", metadata=False)
    return got.groupBy(F.col("parsed.n").cast("long").alias("line")).agg(F.count("*").alias("n"), F.sum("parsed.o").alias("orders"), F.sum("parsed.p").alias("parts"))


def flat_be(spark, d):
    li = table(spark, d, "lineitem").select(F.concat(be(F.col("l_orderkey"), 4), be(F.col("l_linenumber"), 1)).alias("cell"))
    return parse(li, "cell", "@default_endian(big) @root struct R { o: u32, n: u8 }", metadata=False).select(F.col("parsed.o").alias("orderkey"), F.col("parsed.n").cast("long").alias("line"))


def signed_fold(spark, d):
    k = F.col("c_nationkey") - 12
    cells = table(spark, d, "customer").select("c_custkey", F.concat(le(k, 1), le(k * 100, 2), be(k * 100_000, 4), le(k * 10_000_000_000, 8)).alias("cell"))
    got = parse(cells, "cell", "@root struct R { a: i8, b: i16le, c: i32be, e: i64le }", metadata=False)
    return got.select("c_custkey", *[F.col(f"parsed.{x}").cast("long").alias(x) for x in "abce"])


_FLOAT = "@root struct R { cents: i64le, f: f64le }"


def float_reads(spark, d):
    """f64 bits made by numpy from the table's own doubles."""
    @F.pandas_udf("binary")
    def bits(v: pd.Series) -> pd.Series:
        return pd.Series([x.tobytes() for x in v.to_numpy("<f8")])

    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(le(F.col("l_orderkey"), 8), bits("l_extendedprice")).alias("cell"))
    got = parse(li, "cell", _FLOAT, metadata=False)
    return got.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("parsed.f").alias("price"))


def magic_filter(spark, d):
    li = table(spark, d, "lineitem").select(F.concat(text(F.col("l_returnflag")), le(F.col("l_orderkey"), 4)).alias("cell"))
    got = parse(li, "cell", '@root struct R { flag: fixed_string[1] = "R", o: u32le }', mode="DROPMALFORMED", metadata=False)
    return got.groupBy(F.col("parsed.flag").alias("flag")).agg(F.count("*").alias("n"), F.sum("parsed.o").alias("orders"))


def bits_flags(spark, d):
    cells = table(spark, d, "part").select("p_partkey", le(F.col("p_partkey"), 2).alias("cell"))
    got = parse(cells, "cell", "bits struct B : u16 { odd: bit, second: bit, mid: bits[6], top: bits[8] } @root struct R { b: B }", metadata=False)
    return got.select("p_partkey", F.col("parsed.b.odd").alias("odd"), F.col("parsed.b.second").alias("second"), F.col("parsed.b.mid").cast("long").alias("mid"), F.col("parsed.b.top").cast("long").alias("top"))


def enum_names(spark, d):
    code = F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "F", 2).otherwise(3)
    cells = table(spark, d, "orders").select(le(code, 1).alias("cell"))
    got = parse(cells, "cell", "enum Status : u8 { Open = 1, Finished = 2, Partial = 3 } @root struct R { s: Status }", enum_names=True, metadata=False)
    return got.groupBy(F.col("parsed.s_name").alias("status"), F.col("parsed.s").cast("long").alias("code")).agg(F.count("*").alias("n"))


def fixed_str(spark, d):
    cells = table(spark, d, "region").select(F.concat(text(F.col("r_name")), F.unhex(F.repeat(F.lit("00"), 16 - F.length("r_name")))).alias("cell"))
    return parse(cells, "cell", "@root struct R { name: fixed_string[16] }", metadata=False).select("parsed.name")


def cstr(spark, d):
    cells = table(spark, d, "nation").select(F.concat(text(F.col("n_name")), F.lit(b"\0"), le(F.col("n_nationkey"), 2)).alias("cell"))
    return parse(cells, "cell", "@root struct R { name: cstring, key: u16le }", metadata=False).select("parsed.name", F.col("parsed.key").cast("long").alias("key"))


def lp_str(spark, d):
    """Length-prefixed whole texts."""
    cells = table(spark, d, "documents").select("doc_id", F.concat(le(F.octet_length("text"), 4), text(F.col("text"))).alias("cell"))
    got = parse(cells, "cell", "@root struct R { size: u32le, body: string[size] }", metadata=False)
    return got.select("doc_id", F.col("parsed.size").alias("size"), F.md5("parsed.body").alias("digest"))


def utf16_str(spark, d):
    cells = table(spark, d, "nation").select("n_nationkey", F.concat(utf16(F.col("n_name")), F.lit(b"\0\0")).alias("cell"))
    return parse(cells, "cell", "@root struct R { name: cstring @encoding(utf16le) }", metadata=False).select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "parsed.name")


def count_array(spark, d):
    cells = _orders(spark, d).select("l_orderkey", F.concat(le(F.col("n"), 1), "items").alias("cell"))
    got = records(cells, "cell", ITEM + "@root struct R { n: u8, items: Item[n] }", "items")
    return got.select("l_orderkey", F.col("element.line").cast("long").alias("line"), F.col("element.quantity").cast("long").alias("quantity"), F.col("element.part").alias("part"), (F.col("pos") + 1).cast("long").alias("nth"))


def _turns(spark, d):
    c = table(spark, d, "conversations").where("text is not null")
    record = F.concat(le(F.col("turn"), 2), le(F.octet_length("text"), 4), text(F.col("text")))
    got = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.md5("text").alias("m"), record.alias("r")))).alias("rs"))
    return got.select("conv_id", joined(F.transform("rs", lambda x: x["r"])).alias("cell"))


_TURN = "struct Turn { turn: u16le, size: u32le, body: string[size] } "


def _turn_rows(got: DataFrame) -> DataFrame:
    return got.select("conv_id", F.col("element.turn").cast("long").alias("turn"), F.md5("element.body").alias("digest"))


def until_array(spark, d):
    return _turn_rows(records(_turns(spark, d), "cell", _TURN + "@root struct R { turns: Turn[] @until(@remaining == 0) }", "turns"))


def sentinel_array(spark, d):
    cells = _turns(spark, d).select("conv_id", F.concat("cell", F.unhex(F.lit("FFFF00000000")), F.lit(b"rest")).alias("cell"))
    return _turn_rows(records(cells, "cell", _TURN + "@root struct R { turns: Turn[] @until_sentinel(t => t.turn == 0xFFFF), rest: fixed_string[4] }", "turns"))


def greedy_array(spark, d):
    """Every cell loses its last byte, so its last turn is incomplete and is left out."""
    cells = _turns(spark, d).select("conv_id", F.substring("cell", F.lit(1), F.length("cell") - 1).alias("cell"))
    return _turn_rows(records(cells, "cell", _TURN + "@root struct R { turns: Turn[] @greedy }", "turns")).where("turn is not null")


_SEARCH = ITEM + """@root struct R {
    n: u8, items: Item[n],
    @let big = items.find_or(i => i.quantity > 40, 0),
    @derived any_big: bool = items.any(i => i.quantity > 40),
    @derived all_big: bool = items.all(i => i.quantity > 10),
    @derived first_part: u32 = items[0].part,
    @derived found: u32 = big.part,
    @derived total: u32 = @count(items),
}"""


def array_search(spark, d):
    """find_or, any, all, an index and @count over each order's lines."""
    cells = _orders(spark, d).select("l_orderkey", F.concat(le(F.col("n"), 1), "items").alias("cell"))
    got = parse(cells, "cell", _SEARCH, fields=["any_big", "all_big", "first_part", "found", "total"], metadata=False)
    return got.select("l_orderkey", "parsed.any_big", "parsed.all_big", F.col("parsed.first_part").alias("first_part"), F.col("parsed.found").alias("found"), F.col("parsed.total").alias("total"))


_EVENT = """@default_endian(little)
struct Purchase { cents: i64 }
struct Click { user: u32 }
struct Other { user: u32, cents: i64 }
@root struct E { code: u8, @let k = code, body: match(k) { 1 => Purchase, 2..3 => Click, x when x > 3 => Other, _ => bytes[0] } }"""


def match_variant(spark, d):
    """Events as tagged unions: a value, a range, a guarded and a default arm."""
    code = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "view", 3).when(F.col("event_type") == "error", 0).otherwise(9)
    cents = F.coalesce(F.floor(F.abs(F.col("value"))), F.lit(0))
    body = F.when(code == 1, le(cents, 8)).when(code.isin(2, 3), le(F.col("user_id"), 4)).when(code == 0, F.lit(b"")).otherwise(F.concat(le(F.col("user_id"), 4), le(cents, 8)))
    cells = table(spark, d, "events").select(F.concat(le(code, 1), body).alias("cell"))
    got = parse(cells, "cell", _EVENT, metadata=False).select("parsed.*")
    total = F.coalesce(F.sum("body.Purchase.cents"), F.lit(0)) + F.coalesce(F.sum("body.Other.cents"), F.lit(0))
    users = F.coalesce(F.sum("body.Click.user"), F.lit(0)) + F.coalesce(F.sum("body.Other.user"), F.lit(0))
    return got.groupBy(F.col("body._variant").alias("variant")).agg(F.count("*").alias("n"), total.alias("cents"), users.alias("users"))


def let_derived(spark, d):
    script = """@default_endian(little) const SCALE = 3;
    @map area(w: u32, h: u32): u32 = w * h
    @root struct R { size: u16, key: u32, @let twice = size * 2, @derived scaled: i64 = twice * SCALE + 1, @derived area: i64 = area(size, twice), @hidden pad: u8 }"""
    cells = table(spark, d, "part").select("p_partkey", F.concat(le(F.col("p_size"), 2), le(F.col("p_partkey"), 4), F.lit(b"\0")).alias("cell"))
    return parse(cells, "cell", script, metadata=False).select("p_partkey", F.col("parsed.scaled").alias("scaled"), F.col("parsed.area").alias("area"))


def expr_operators(spark, d):
    script = """@default_endian(little) @root struct R { a: u32, b: u16,
    @derived q: i64 = a / (b - 7), @derived r: i64 = a % (b - 7), @derived m: i64 = (a & 0xFF) | (b << 4) ^ 5, @derived s: i64 = a >> 2, @derived n: i64 = -a,
    @derived c: bool = a > 100 && b != 7 || !(b <= 20) }"""
    cells = table(spark, d, "part").select("p_partkey", F.concat(le(F.col("p_partkey"), 4), le(F.col("p_size"), 2)).alias("cell"))
    got = parse(cells, "cell", script, metadata=False)
    return got.select("p_partkey", *[F.col(f"parsed.{x}").alias(x) for x in "qrmsnc"])


def str_methods(spark, d):
    script = """@root struct R { n: u32le, url: string[n], @derived secure: bool = url.starts_with("https:"), @derived page: bool = url.ends_with(".html"), @derived spam: bool = url.contains("spam"), @derived size: u32 = @strlen(url) }"""
    cells = table(spark, d, "pages").select("page_id", F.concat(le(F.octet_length("url"), 4), text(F.col("url"))).alias("cell"))
    return parse(cells, "cell", script, metadata=False).select("page_id", "parsed.secure", "parsed.page", "parsed.spam", "parsed.size")


def seek_at(spark, d):
    """A directory in front that points to the payload behind a gap."""
    cells = table(spark, d, "customer").select(F.concat(le(F.lit(20), 4), le(F.octet_length("c_name"), 2), F.lit(bytes(14)), text(F.col("c_name")), le(F.col("c_custkey"), 4)).alias("cell"))
    script = "@default_endian(little) @root struct R { at: u32, size: u16, @at(at) { name: string[size] }, tag: u16, @seek(at + size) key: u32 }"
    return parse(cells, "cell", script, metadata=False).select(F.col("parsed.key").alias("key"), "parsed.name", F.col("parsed.tag").cast("long").alias("tag"))


def align_skip(spark, d):
    cells = table(spark, d, "supplier").select(F.concat(le(F.col("s_nationkey"), 1), F.lit(bytes(3)), le(F.col("s_suppkey"), 4), F.lit(bytes(5)), le(F.col("s_nationkey"), 2)).alias("cell"))
    script = "@default_endian(little) @root struct R { a: u8, @align(4) key: u32, @skip(5) b: u16 }"
    return parse(cells, "cell", script, metadata=False).select(F.col("parsed.key").alias("key"), F.col("parsed.a").cast("long").alias("a"), F.col("parsed.b").cast("long").alias("b"))


def ptr_heap(spark, d):
    """An absolute, a relative and a null pointer into a heap of names."""
    name, n = text(F.col("n_name")), F.octet_length("n_name")
    head = F.concat(le(F.lit(0x1000 + 24), 8), le(F.lit(16) + n + 1, 8), le(F.lit(0), 8))
    cells = table(spark, d, "nation").select("n_nationkey", F.concat(head, name, F.lit(b"\0"), le(F.col("n_regionkey"), 4)).alias("cell"))
    script = "@default_endian(little) @param base_ptr: u64 @root struct R { name: ptr<cstring, u64>, region: relptr<u32, u64>, none: ptr<cstring, u64>? }"
    got = parse(cells, "cell", script, params={"base_ptr": 0x1000}, metadata=False)
    return got.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "parsed.name", F.col("parsed.region").alias("region"), F.col("parsed.none").isNull().alias("is_null"))


def linked_list(spark, d):
    """Each order's lines as a chain of nodes; depth is the place in the chain."""
    from .sources.formats import LINKED_LIST

    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("ns"))
    node = lambda x, i: F.concat(le(x, 4), le(F.when(i == F.size("ns") - 1, F.lit(0)).otherwise(F.lit(0x2000 + 8) + (i + 1) * 12), 8))
    cells = li.select("l_orderkey", F.concat(le(F.lit(0x2000 + 8), 8), joined(F.transform("ns", node))).alias("cell"))
    got = nodes(cells, "cell", LINKED_LIST, params={"base_ptr": 0x2000}).where("depth > 0")
    return got.select("l_orderkey", F.col("depth").cast("long").alias("depth"), F.get_json_object("value", "$.value").cast("long").alias("line"))


def rva_lookup(spark, d):
    """A range lookup through a map: which of three bands an order's price falls in."""
    script = """@default_endian(little) struct Band { low: u32, high: u32, code: u8 }
    @map band_of(v: u32, bands: Band[]): u32 = { @let b = bands.find(x => v >= x.low && v < x.high), b.code }
    @root struct R { bands: Band[3], price: u32, @derived band: u32 = band_of(price, bands) }"""
    bands = F.concat(*[F.concat(le(F.lit(a), 4), le(F.lit(b), 4), le(F.lit(c), 1)) for a, b, c in ((0, 50_000, 1), (50_000, 150_000, 2), (150_000, 100_000_000, 3))])
    cells = table(spark, d, "orders").select(F.concat(bands, le(F.floor("o_totalprice"), 4)).alias("cell"))
    return parse(cells, "cell", script, fields=["band"], metadata=False).groupBy(F.col("parsed.band").alias("band")).agg(F.count("*").alias("n"))


def produce_hex(spark, d):
    script = "@default_endian(little) @root struct R { magic: u16 = 0x4D42, o: u32, n: u8, @align(4) q: i16 }"
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), (-F.col("l_quantity")).cast("long").alias("q"))
    return produce(li.select("o", "n", F.struct("o", "n", "q").alias("v")), "v", script).select("o", F.col("n").cast("long").alias("n"), F.hex("bytes").alias("hex"))


def roundtrip_documents(spark, d):
    script = "@root struct R { id: i64le, size: u32be, body: string[size], lang: cstring }"
    docs = table(spark, d, "documents").select("doc_id", F.struct(F.col("doc_id").alias("id"), F.octet_length("text").alias("size"), F.col("text").alias("body"), "lang").alias("v"))
    back = parse(docs.withColumn("cell", encode_column(F.col("v"), script)), "cell", script, metadata=False)
    return back.select("doc_id", F.col("parsed.id").alias("id"), F.md5("parsed.body").alias("digest"), "parsed.lang")


def checksums(spark, d):
    """@crc32 and @adler32 of whole texts; DuckDB has neither, so the tests hold it to zlib."""
    script = "@root struct R { n: u32le, body: bytes[n], @derived crc: u32 = @crc32(body), @derived adler: u32 = @adler32(body) }"
    cells = table(spark, d, "documents").select("doc_id", F.concat(le(F.octet_length("text"), 4), text(F.col("text"))).alias("cell"))
    return parse(cells, "cell", script, fields=["crc", "adler"], metadata=False).select("doc_id", "parsed.crc", "parsed.adler")


def errors_permissive(spark, d):
    """Cells cut at key % 6 bytes: the outcome of each is its error code and what was consumed."""
    k = F.col("o_orderkey") % 6
    cells = table(spark, d, "orders").select(F.substring(le(F.col("o_orderkey"), 5), F.lit(1), k.cast("int")).alias("cell"))
    got = cells.withColumn("g", decode_column(F.col("cell"), "@root struct R { a: u32le, b: u8 }"))
    return got.groupBy(F.col("g.error.code").alias("code"), F.col("g.consumed").alias("consumed")).agg(F.count("*").alias("n"))


def json_output(spark, d):
    cells = table(spark, d, "supplier").select("s_suppkey", F.concat(le(F.col("s_suppkey"), 4), le(F.col("s_nationkey"), 1)).alias("cell"))
    got = cells.withColumn("g", decode_column(F.col("cell"), "@root struct R { key: u32le, n: u8, @at(0) when n > 12 { again: u32le } }", output="json"))
    return got.select("s_suppkey", F.col("g.value").alias("json"))


def embeddings_vec(spark, d):
    """f32 arrays: the vector's floats go through numpy's bytes and the layout's counted array."""
    @F.pandas_udf("binary")
    def bits(v: pd.Series) -> pd.Series:
        return v.map(lambda x: np.asarray(x, "<f4").tobytes())

    e = table(spark, d, "embeddings").select("vec_id", F.concat(le(F.size("embedding"), 4), bits("embedding")).alias("cell"))
    got = records(e, "cell", "@root struct R { n: u32le, v: f32le[n] }", "v")
    return got.select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("element").cast("double").alias("x"))


_Q = "l_quantity::BIGINT"
_TURN_SQL = "SELECT conv_id, turn::BIGINT AS turn, md5(text) AS digest FROM conversations WHERE text IS NOT NULL"
_CODE = "CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 WHEN 'error' THEN 0 ELSE 9 END"

#: name: (query, SQL or None).
REGISTRY = {
    "flat_le": (flat_le, "SELECT l_linenumber::BIGINT AS line, count(*) AS n, sum(l_orderkey)::BIGINT AS orders, sum(l_partkey)::BIGINT AS parts FROM lineitem GROUP BY 1"),
    "flat_be": (flat_be, "SELECT l_orderkey AS orderkey, l_linenumber::BIGINT AS line FROM lineitem"),
    "signed_fold": (signed_fold, "SELECT c_custkey, k AS a, k * 100 AS b, k * 100000 AS c, k * 10000000000 AS e FROM (SELECT c_custkey, c_nationkey::BIGINT - 12 AS k FROM customer)"),
    "float_reads": (float_reads, "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_extendedprice AS price FROM lineitem"),
    "magic_filter": (magic_filter, "SELECT l_returnflag AS flag, count(*) AS n, sum(l_orderkey)::BIGINT AS orders FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1"),
    "bits_flags": (bits_flags, "SELECT p_partkey, p_partkey & 1 = 1 AS odd, (p_partkey >> 1) & 1 = 1 AS second, (p_partkey >> 2) & 63 AS mid, (p_partkey >> 8) & 255 AS top FROM part"),
    "enum_names": (enum_names, "SELECT CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Finished' ELSE 'Partial' END AS status, (CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END)::BIGINT AS code, count(*) AS n FROM orders GROUP BY ALL"),
    "fixed_str": (fixed_str, "SELECT r_name AS name FROM region"),
    "cstr": (cstr, "SELECT n_name AS name, n_nationkey::BIGINT AS key FROM nation"),
    "lp_str": (lp_str, "SELECT doc_id, octet_length(encode(text))::BIGINT AS size, md5(text) AS digest FROM documents"),
    "utf16_str": (utf16_str, "SELECT n_nationkey::BIGINT AS n_nationkey, n_name AS name FROM nation"),
    "count_array": (count_array, f"SELECT l_orderkey, l_linenumber::BIGINT AS line, {_Q} AS quantity, l_partkey AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_partkey) AS nth FROM lineitem"),
    "until_array": (until_array, _TURN_SQL),
    "sentinel_array": (sentinel_array, _TURN_SQL),
    "greedy_array": (greedy_array, "SELECT conv_id, turn, digest FROM (SELECT conv_id, turn::BIGINT AS turn, md5(text) AS digest, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, md5(text) DESC) AS r FROM conversations WHERE text IS NOT NULL) WHERE r > 1"),
    "array_search": (array_search, f"SELECT l_orderkey, bool_or({_Q} > 40) AS any_big, bool_and({_Q} > 10) AS all_big, list(l_partkey ORDER BY l_linenumber, l_quantity, l_partkey)[1] AS first_part, coalesce((list(l_partkey ORDER BY l_linenumber, l_quantity, l_partkey) FILTER ({_Q} > 40))[1], 0) AS found, count(*) AS total FROM lineitem GROUP BY 1"),
    "match_variant": (match_variant, f"""
        SELECT CASE code WHEN 1 THEN 'Purchase' WHEN 2 THEN 'Click' WHEN 3 THEN 'Click' WHEN 0 THEN 'bytes' ELSE 'Other' END AS variant, count(*) AS n,
               sum(CASE WHEN code IN (1, 9) THEN cents ELSE 0 END)::BIGINT AS cents, sum(CASE WHEN code IN (2, 3, 9) THEN user_id ELSE 0 END)::BIGINT AS users
        FROM (SELECT {_CODE} AS code, user_id, coalesce(floor(abs(value)), 0)::BIGINT AS cents FROM events) GROUP BY 1"""),
    "let_derived": (let_derived, "SELECT p_partkey, p_size::BIGINT * 6 + 1 AS scaled, p_size::BIGINT * p_size * 2 AS area FROM part"),
    "expr_operators": (expr_operators, """
        SELECT p_partkey, CASE WHEN b = 7 THEN 0 ELSE a // (b - 7) END AS q, CASE WHEN b = 7 THEN 0 ELSE a % (b - 7) END AS r, (a & 255) | xor(b << 4, 5) AS m,
               a >> 2 AS s, -a AS n, a > 100 AND b <> 7 OR NOT b <= 20 AS c
        FROM (SELECT p_partkey, p_partkey AS a, p_size::BIGINT AS b FROM part)"""),
    "str_methods": (str_methods, "SELECT page_id, starts_with(url, 'https:') AS secure, ends_with(url, '.html') AS page, contains(url, 'spam') AS spam, octet_length(encode(url))::BIGINT AS size FROM pages"),
    "seek_at": (seek_at, "SELECT c_custkey AS key, c_name AS name, 0::BIGINT AS tag FROM customer"),
    "align_skip": (align_skip, "SELECT s_suppkey AS key, s_nationkey::BIGINT AS a, s_nationkey::BIGINT AS b FROM supplier"),
    "ptr_heap": (ptr_heap, "SELECT n_nationkey::BIGINT AS n_nationkey, n_name AS name, n_regionkey::BIGINT AS region, true AS is_null FROM nation"),
    "linked_list": (linked_list, "SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS depth, l_linenumber::BIGINT AS line FROM lineitem"),
    "rva_lookup": (rva_lookup, "SELECT (CASE WHEN p < 50000 THEN 1 WHEN p < 150000 THEN 2 ELSE 3 END)::BIGINT AS band, count(*) AS n FROM (SELECT floor(o_totalprice) AS p FROM orders) GROUP BY 1"),
    "produce_hex": (produce_hex, """
        WITH t AS (SELECT l_orderkey AS o, l_linenumber::BIGINT AS n, printf('%08X', l_orderkey) AS a, printf('%02X', l_linenumber) AS b, printf('%04X', 65536 - l_quantity::BIGINT) AS c FROM lineitem)
        SELECT o, n, '424D' || a[7:8] || a[5:6] || a[3:4] || a[1:2] || b || '00' || c[3:4] || c[1:2] AS hex FROM t"""),
    "roundtrip_documents": (roundtrip_documents, "SELECT doc_id, doc_id AS id, md5(text) AS digest, lang FROM documents"),
    "checksums": (checksums, None),
    "errors_permissive": (errors_permissive, "SELECT CASE WHEN o_orderkey % 6 < 5 THEN 'PE101' END AS code, (CASE WHEN o_orderkey % 6 = 5 THEN 5 END)::BIGINT AS consumed, count(*) AS n FROM orders GROUP BY ALL"),
    "json_output": (json_output, """SELECT s_suppkey, '{"key":' || s_suppkey || ',"n":' || s_nationkey || CASE WHEN s_nationkey > 12 THEN ',"again":' || s_suppkey ELSE '' END || '}' AS json FROM supplier"""),
    "embeddings_vec": (embeddings_vec, "SELECT vec_id, (p - 1)::BIGINT AS pos, x::DOUBLE AS x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings)"),
}


def queries() -> dict:
    return {name: q for name, (q, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
