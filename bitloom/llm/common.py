"""Helpers shared by the operators: scratch tables, Arrow plumbing, column quoting."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one vectorised step holds at once (a longer single text is held whole).
PIECE_BYTES = 4 << 20

_scratch: dict[str, list[str]] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where it is unset, a local session (as in
    tests) gets a temporary folder, and a cluster an error."""
    small_batches(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="bitloom-")
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def save(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: the lineage
    ends there, and a lost executor costs only the tasks it ran."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/bitloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _scratch.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_tables(spark: SparkSession) -> list[str]:
    return list(_scratch.get(spark.sparkContext.applicationId, []))


def clear_scratch(spark: SparkSession, tables: list[str]) -> None:
    """Delete tables that ``save`` wrote. Call it only when every result that was made from
    them has been written (the pipeline does, between its stages)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    known = _scratch.get(spark.sparkContext.applicationId, [])
    for path in tables:
        if path in known:
            known.remove(path)
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of frames that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def text_bytes(df: DataFrame, text: str) -> int:
    """UTF-8 bytes of the whole column: one pass without a shuffle of rows."""
    return df.agg(F.sum(F.octet_length(col(text).cast("string")))).first()[0] or 0


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as (bytes, offsets); a null counts as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each; a longer row makes a range of its own."""
    n, start = len(offsets) - 1, 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(n, max(end, start + 1))
        yield start, end
        start = end


#: Bytes in one Arrow batch: a task holds a few of them, in the JVM and in its worker.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's bound on Arrow batches to BATCH_BYTES, if it is above."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key)).lower().removesuffix("b")
    if not now.lstrip("-").isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def _slices(column: pa.Array, limit: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """Row ranges of a string column and their texts; only one range's texts are copied at a time."""
    data, offsets = buffers(column)
    view = memoryview(data)
    for lo, hi in pieces(offsets, limit):
        yield lo, hi, [view[offsets[i] : offsets[i + 1]].tobytes() for i in range(lo, hi)]


def filter_texts(df: DataFrame, text: str, make: Callable[[], Callable[[list[bytes]], np.ndarray]], limit: int = PIECE_BYTES) -> DataFrame:
    """The rows of ``df`` whose text a function accepts (it returns a boolean for each text; a
    null counts as empty), all columns as they are. Each text passes to Python once."""
    place = df.columns.index(text)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for lo, hi, texts in _slices(batch.column(place).cast(pa.string()), limit):
                yield batch.slice(lo, hi - lo).filter(pa.array(work(texts), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def map_texts(
    df: DataFrame,
    text: str,
    fields: str,
    make: Callable[[], Callable[[list[bytes]], list]],
    keep: list[str] | None = None,
    limit: int = PIECE_BYTES,
) -> DataFrame:
    """Add columns computed from whole texts, in Arrow batches and without a shuffle.

    ``make()`` runs once in each task and returns a function from a list of UTF-8 texts
    (null: empty) to one list or Arrow array for each of ``fields`` (a DDL string). Columns
    of ``keep`` (all by default) travel in a struct, so they may have any names; where one
    has the name of a new column, the new one takes its place. The text itself travels once,
    kept or not. ``limit`` bounds the bytes of text that one call holds.
    """
    small_batches(df.sparkSession)
    keep = list(df.columns) if keep is None else keep
    ddl = [f.strip().split(None, 1) for f in fields.split(",")]
    names = [n for n, _ in ddl]
    whole_text = text in keep and text not in names and df.schema[text].dataType == T.StringType()
    carried = [c for c in keep if not (whole_text and c == text)]
    row = F.struct(*[col(c) for c in carried]) if carried else F.struct(F.lit(1).alias("_"))
    packed = df.select(row.alias("row"), col(text).cast("string").alias("text"))
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    types = [kinds[t] for _, t in ddl]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for lo, hi, texts in _slices(batch.column(1), limit):
                arrays = [a if isinstance(a, pa.Array) else pa.array(a, t) for a, t in zip(work(texts), types, strict=True)]
                out = pa.StructArray.from_arrays(arrays, names)
                whole = [batch.column(1).slice(lo, hi - lo)] if whole_text else []
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *whole, out], ["row", *["text"] * whole_text, "out"])

    schema = [T.StructField("row", packed.schema["row"].dataType), *[T.StructField("text", T.StringType())] * whole_text, T.StructField("out", T._parse_datatype_string(fields))]
    done = packed.mapInArrow(run, T.StructType(schema))
    kept = [(F.col("text") if whole_text and c == text else F.col("row." + quoted(c))).alias(c) for c in keep if c not in names]
    return done.select(*kept, *[F.col("out." + quoted(n)).alias(n) for n in names])


MIX_A, MIX_B, GOLD = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(33))) * MIX_A
    x = (x ^ (x >> np.uint64(33))) * MIX_B
    return x ^ (x >> np.uint64(33))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * GOLD)
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_BLANK = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes other than blank and 9 to 13) of texts that lie end to end: first
    byte and length of each, and the number of words before each text and at the end."""
    solid = ~_BLANK[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | begins[1:-1]
    end = solid
    end[:-1] = solid[:-1] & (~solid[1:] | begins[1:-1])
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1 - starts, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte runs, ASCII letters lower-cased."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = int(sizes.sum())
    first = np.cumsum(sizes) - sizes
    place = np.arange(total) - np.repeat(first, sizes)
    power = np.multiply.accumulate(np.full(int(sizes.max()), GOLD, np.uint64))
    value = _BYTE[_LOWER[data[place + np.repeat(starts, sizes)]]] * power[place]
    return mixed(np.add.reduceat(value, first) + sizes.astype(np.uint64) * MIX_B)
