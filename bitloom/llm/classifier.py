"""Quality classifier: random-indexing vectors, pooled, and a two-layer network.

Tokens are runs of lower-case letters, of capitals (their shape only), of digits, and of one
repeated symbol; a run of letters that stands up to NEAR tokens before already is the token "again".
Each token falls into one of SLOTS slots. Every slot has a sparse random index
vector of DIM places with entries of 1 and -1, and its context vector is the sum of the index
vectors of all tokens up to REACH places away from it, over the whole corpus. A document's
features are the means of its tokens' index vectors (what words it has) and context vectors (in
what company they stand; logarithmic, of unit length each), and nothing else. A network of one
hidden layer in numpy learns the labels on the driver, from at most ``sample`` labelled rows
(those first in order of a hash of their id); a temperature, fitted on rows set aside from them,
calibrates its probabilities.

Neither ids, languages, sources nor labels are inputs of a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GOLD, MIX_A, buffers, col, filter_texts, map_texts, mixed, pieces, span_hashes

#: Words share a slot where their hashes meet; index and context vectors are of slots.
SLOTS, DIM, REACH, PICKS = 16384, 48, 2, 2
NEAR = 3
HIDDEN, EPOCHS = 24, 400
SAMPLE = 20_000
FOLDS, THRESHOLD = 5, 0.3

_KIND = np.array([1 if 97 <= c <= 122 or c >= 128 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 0 if c == 32 or 9 <= c <= 13 else c + 10 for c in range(256)], np.int16)


def slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each token, and the number of tokens before each text and at the end."""
    kind = _KIND[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    start = kind != 0
    start[1:] &= (kind[1:] != kind[:-1]) | begins[1:-1]
    end = kind != 0
    end[:-1] &= (kind[:-1] != kind[1:]) | begins[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    size, k = ends - starts, kind[starts]
    shape = k != 1
    h = np.empty(len(starts), np.uint64)
    h[~shape] = span_hashes(data, starts[~shape], size[~shape])
    h[shape] = mixed(k[shape].astype(np.uint64) * GOLD + np.minimum(size[shape], 4).astype(np.uint64))
    bounds = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    again = np.zeros(len(h), bool)
    for d in range(1, NEAR + 1):
        again[d:] |= (h[d:] == h[:-d]) & (doc[d:] == doc[:-d]) & ~shape[d:]
    h[again] = MIX_A
    return (h % np.uint64(SLOTS)).astype(np.int64), bounds


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each slot's index vector; a rule, not a table."""
    r = mixed(np.arange(SLOTS * PICKS, dtype=np.uint64).reshape(SLOTS, PICKS) * GOLD + np.uint64(1))
    return (r % np.uint64(DIM)).astype(np.int64), 1.0 - 2.0 * ((r >> np.uint64(40)) & np.uint64(1)).astype(np.float64)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, sign = index_vectors()
    total = np.zeros(SLOTS * DIM)
    for batch in batches:
        data, offsets = buffers(batch.column(0))
        for lo, hi in pieces(offsets):
            own = offsets[lo : hi + 1]
            slot, bounds = slots(data[own[0] : own[-1]], own - own[0])
            doc = np.repeat(np.arange(hi - lo), np.diff(bounds))
            for d in range(1, REACH + 1):
                near = doc[d:] == doc[:-d]
                for a, b in ((slot[d:][near], slot[:-d][near]), (slot[:-d][near], slot[d:][near])):
                    for p in range(PICKS):
                        total += np.bincount(a * DIM + place[b, p], sign[b, p], SLOTS * DIM)
    rows = total.reshape(SLOTS, DIM)
    used = np.flatnonzero(np.abs(rows).sum(axis=1))
    for lo in range(0, len(used), 2048):
        own = used[lo : lo + 2048]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.FixedSizeListArray.from_arrays(rows[own].ravel(), DIM).cast(pa.list_(pa.float64()))], ["slot", "v"])


def context_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The SLOTS x DIM context vectors of all of ``docs``. Tasks send sums of a fixed size."""
    parts = docs.select(col(text).cast("string").alias("text")).mapInArrow(_contexts, "slot int, v array<double>")
    sums = parts.groupBy("slot").agg(F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(DIM)]).alias("v"))
    out = np.zeros((SLOTS, DIM))
    for r in sums.collect():  # at most SLOTS rows
        out[r.slot] = r.v
    out = np.sign(out) * np.log1p(np.abs(out))
    return out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))


def features(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Mean index vector and mean context vector of each text; zeros without tokens."""
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    slot, bounds = slots(data, offsets)
    n = np.diff(bounds)
    out = np.zeros((len(texts), 2 * DIM))
    doc = np.repeat(np.arange(len(n)), n)
    place, sign = index_vectors()
    for p in range(PICKS):
        out[:, :DIM] += np.bincount(doc * DIM + place[slot, p], sign[slot, p], len(n) * DIM).reshape(-1, DIM)
    for j in range(DIM):
        out[:, DIM + j] = np.bincount(doc, vectors[slot, j], len(n))
    return out / np.maximum(n, 1)[:, None]


class Network:
    """tanh hidden layer and one logistic output over standardised features; Adam, full batch."""

    def __init__(self, x: np.ndarray, y: np.ndarray, calibrate: np.ndarray):
        fit = ~calibrate if (~calibrate).any() else np.ones(len(y), bool)
        self.mean, self.scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-6
        rng = np.random.default_rng(7)
        size = x.shape[1]
        p = [rng.normal(0, size**-0.5, (size, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        moments = [(np.zeros_like(a), np.zeros_like(a)) for a in p]
        z, t = self._scaled(x[fit]), y[fit].astype(float)
        for step in range(1, EPOCHS + 1):
            h = np.tanh(z @ p[0] + p[1])
            e = (_sigmoid(h @ p[2] + p[3]) - t) / len(t)
            back = np.outer(e, p[2]) * (1 - h * h)
            for a, g, (m, v) in zip(p, (z.T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ e + 1e-4 * p[2], np.array([e.sum()])), moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                a -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.p, self.temperature = p, 1.0
        if calibrate.any():
            s, t = self.logit(x[calibrate]), y[calibrate]
            tries = np.exp(np.linspace(-2, 2, 81))
            loss = [-np.where(t == 1, np.log(_sigmoid(s / k) + 1e-12), np.log(1 - _sigmoid(s / k) + 1e-12)).mean() for k in tries]
            self.temperature = float(tries[int(np.argmin(loss))])

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self._scaled(x) @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.round(_sigmoid(self.logit(x) / self.temperature), 9)  # the last digits depend on the rows beside it


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fold(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, Network | None]:
    """Context vectors of all ``docs`` and the network; no usable label: no network."""
    vectors = context_vectors(docs, text)
    good = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_q")).where("_id is not null and _q in (0, 1)").where(fold(F.col("_id")) != 0)
    good = good.groupBy("_id").agg(F.min("_q").alias("_q"))
    chosen = good.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(col("doc_id").alias("_id"), col(text).cast("string").alias("text")).join(F.broadcast(chosen), "_id")
    held = docs.sparkSession.sparkContext.broadcast(vectors)

    def measured(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            raw = data.tobytes()
            for lo, hi in pieces(offsets):
                x = features([raw[offsets[i] : offsets[i + 1]] for i in range(lo, hi)], held.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(list(x), pa.list_(pa.float64()))], ["id", "q", "x"])

    learned = rows.select(F.col("_id").cast("string"), "text", F.col("_q").cast("int")).mapInArrow(measured, "id string, q int, x array<double>")
    got = learned.groupBy("id").agg(F.max("q").alias("q"), F.min("x").alias("x")).collect()  # at most ``sample`` rows
    got.sort(key=lambda r: r.id)
    if not got:
        return vectors, None
    x, y = np.array([r.x for r in got]), np.array([r.q for r in got])
    aside = np.array([zlib.crc32(r.id.encode()) % FOLDS == 1 for r in got])
    return vectors, Network(x, y, aside)


def score(docs: DataFrame, labels: DataFrame, *, text: str = "text", keep: list[str] | None = None, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from THRESHOLD on).

    Null and empty texts are scored on features of zero. Without any usable label all scores
    are 0.5. Labels with a null, a repeated id or another value than 0 and 1: null and other
    values are left out, and of a repeated id's labels the least counts. Repeated rows repeat.
    """
    vectors, network = fit(docs, labels, text=text, sample=sample)
    held = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def make():
        v, net = held.value

        def work(texts: list[bytes]) -> list:
            s = net.score(features(texts, v)) if net else np.full(len(texts), 0.5)
            return [pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))]

        return work

    return map_texts(docs, text, "score double, predicted int", make, keep)


def accepted(docs: DataFrame, labels: DataFrame, *, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that ``score`` predicts as 1, all columns as they are."""
    vectors, network = fit(docs, labels, text=text, sample=sample)
    held = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def make():
        v, net = held.value
        return lambda texts: net.score(features(texts, v)) >= THRESHOLD if net else np.full(len(texts), 0.5 >= THRESHOLD)

    return filter_texts(docs, text, make)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
