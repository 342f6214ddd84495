"""Near-duplicates by BagMinHash over multisets of five-word shingles.

A shingle that occurs w times has weight w. Each shingle owns Poisson processes over its
weight axis, one for each of the intervals (0,1], (1,2], (2,4], (4,8] ...: points arrive with
the signature size times the interval's length as their rate, each falls on a random component
and a random unit of the interval, and counts if that unit is within the weight. A component
keeps the earliest point; two texts agree in a component with probability
sum(min weights) / sum(max weights). Points after the time by which all components are filled
are never drawn, so a long text costs about one draw for each shingle.

Signatures are cut into bands. Texts that share a band form a bucket; each member is held
against the bucket's pivot, and the exact overlap of the two multisets decides. Links make
components. Where a bucket then still holds texts of different components, its members are
compared slice by slice (only pairs of different components, and each pair only in the first
band that it shares), inside the tasks and without a row for a pair, so that no link that shows
in any bucket is lost. Buckets are never merged, so texts that meet by chance enlarge no other
bucket. A bucket of texts that are all alike, but below the threshold, costs its square in
comparisons; a slice is bounded by SIDE texts and SIDE_BYTES, whatever the bucket holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLD, MIX_A, MIX_B, buffers, col, map_texts, mixed, save, span_hashes, word_spans
from .components import components

SHINGLE = 5
SIZE, ROWS = 128, 4
THRESHOLD = 0.8
#: Members of a bucket that one block holds against the same text.
BLOCK = 200
#: Orders in which buckets choose their pivots.
ORDERS = 2
#: Texts, and bytes of text, on each side of a pair of slices.
SIDE, SIDE_BYTES = 512, 2 << 20
#: Bytes of text that are signed or expanded at once. A shingle takes about 150 bytes of arrays
#: while it is signed, so a worker stays below 40 MB of them but for a longer single text.
SIGN_BYTES = 512 << 10


def multisets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, weight), ordered by text and hash, and the shingles' text offsets.
    A text of fewer words than a shingle, but not none, is one shingle."""
    starts, sizes, words = word_spans(data, offsets)
    h = span_hashes(data, starts, sizes)
    n = np.diff(words)
    full = np.maximum(n - SHINGLE + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), full)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full) + words[doc]
    value = np.zeros(len(doc), np.uint64)
    for k in range(SHINGLE):
        inside = at + k < words[doc + 1]
        value = value * MIX_A + np.where(inside, h[np.minimum(at + k, len(h) - 1)] if len(h) else np.uint64(0), np.uint64(1))
    value = mixed(value)
    bounds = np.append(0, np.cumsum(full))
    for i in range(len(n)):
        value[bounds[i] : bounds[i + 1]].sort()
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[first], value[first], np.diff(np.append(first, len(value)))


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """BagMinHash signatures, n x SIZE; a text without shingles has only infinities."""
    out = np.full((n, SIZE), np.inf)
    total = np.bincount(doc, weight, n)
    todo = np.flatnonzero(total > 0)
    for spare in (2.0, 14.0, 60.0, 1e9):
        if not len(todo):
            break
        latest = np.zeros(n)
        latest[todo] = (math.log(SIZE) + spare) / total[todo]
        on = latest[doc] > 0
        _draw(out, doc[on], shingle[on], weight[on], latest)
        todo = todo[np.isinf(out[todo]).any(axis=1)]
        out[todo] = np.inf
    return out


def _draw(out: np.ndarray, doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, latest: np.ndarray) -> None:
    parts = 1 + np.ceil(np.log2(weight)).astype(np.int64)
    owner = np.repeat(np.arange(len(doc)), parts)
    level = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    length = np.where(level < 2, 1, 1 << np.maximum(level - 1, 0))
    low = np.where(level == 0, 0, length)
    low[level == 1] = 1
    doc, weight = doc[owner], weight[owner]
    seed = mixed(shingle[owner] + (level.astype(np.uint64) + np.uint64(1)) * MIX_B)
    del owner, level, shingle
    live = [doc, weight, seed, np.zeros(len(doc)), latest[doc], low, length]
    del doc, weight, seed, low, length
    step = np.zeros(1, np.uint64)
    while len(live[0]):
        step = step + np.uint64(1)
        r = mixed(live[2] + step * GOLD)
        live[3] = live[3] - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (SIZE * live[6])
        on = np.flatnonzero(live[3] <= live[4])
        for k in range(len(live)):  # one by one, so that only one array is held twice
            live[k] = live[k][on]
        doc, weight, _, time, _, low, length = live
        r = mixed(r[on] ^ MIX_A)
        unit = low + ((r >> np.uint64(40)).astype(np.int64) * length >> 24) + 1
        good = unit <= weight
        np.minimum.at(out.reshape(-1), doc[good] * SIZE + (r[good] & np.uint64(SIZE - 1)).astype(np.int64), time[good])


def bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of ROWS components."""
    bits = signature.view(np.uint64).reshape(len(signature), SIZE // ROWS, ROWS)
    key = np.broadcast_to(np.arange(1, SIZE // ROWS + 1, dtype=np.uint64) * MIX_B, bits.shape[:2]).copy()
    for k in range(ROWS):
        key = mixed(key + bits[:, :, k] * MIX_A + GOLD)
    return key.view(np.int64)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])


def _sign(texts: list[bytes]) -> list:
    sig = signatures(*multisets(*_joined(texts)), len(texts))
    some = np.isfinite(sig[:, 0])
    keys = bands(sig)
    return [pa.array([k if s else None for k, s in zip(keys, some.tolist(), strict=True)], pa.list_(pa.int64()))]


def _elements(texts: list[bytes]) -> list[np.ndarray]:
    """Each multiset as a sorted set: the k-th copy of a shingle is an element of its own."""
    doc, shingle, weight = multisets(*_joined(texts))
    owner = np.repeat(np.arange(len(doc)), weight)
    copy = (np.arange(len(owner)) - np.repeat(np.cumsum(weight) - weight, weight)).astype(np.uint64)
    element = mixed(shingle[owner] + copy * GOLD)
    bounds = np.searchsorted(doc[owner], np.arange(len(texts) + 1))
    return [np.sort(element[bounds[i] : bounds[i + 1]]) for i in range(len(texts))]


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets."""
    both = np.sort(np.concatenate([a, b]))
    common = int((both[1:] == both[:-1]).sum())
    return common / max(1, len(a) + len(b) - common)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered: the text b of a block, then all that it is held against."""
    center, against = None, None
    for batch in batches:
        b, a = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        data, offsets = buffers(batch.column(2))
        raw = memoryview(data)
        left, right = [], []
        lo = 0
        while lo < len(a):
            hi = max(lo + 1, min(len(a), int(np.searchsorted(offsets, offsets[lo] + SIGN_BYTES, "right")) - 1))
            for i, e in zip(range(lo, hi), _elements([raw[offsets[i] : offsets[i + 1]].tobytes() for i in range(lo, hi)]), strict=True):
                if a[i] == b[i]:
                    center, against = b[i], e
                elif center == b[i] and overlap(against, e) >= THRESHOLD:
                    left.append(a[i])
                    right.append(b[i])
            lo = hi
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose multisets overlap enough. b is sent once for each block of BLOCK
    partners, so neither a task nor a block grows with the number of partners of one text."""
    blocks = pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"))
    dealt = pairs.join(blocks, "b").select("a", "b", F.pmod(F.xxhash64("a"), "k").alias("s"))
    members = dealt.join(texts, dealt.a == texts.nid).select("b", "s", "a", "text")
    heads = dealt.select("b", "s").distinct().join(texts, F.col("b") == texts.nid).select("b", "s", F.col("b").alias("a"), "text")
    rows = members.unionByName(heads).repartition("b", "s").sortWithinPartitions("b", "s", F.col("a") != F.col("b"))
    return rows.select("b", "a", "text").mapInArrow(_verified, "a long, b long")


def _pivots(shared: DataFrame) -> DataFrame:
    """Each member of a bucket against the bucket's pivot, first in one of ORDERS orders."""
    order = F.xxhash64("a", F.pmod("key", F.lit(ORDERS)))
    pivot = shared.groupBy("key").agg(F.min(F.struct(order.alias("o"), F.col("a").alias("b"))).alias("p"))
    met = shared.join(pivot, "key").where(F.col("a") != F.col("p.b"))
    return met.select(F.greatest("a", F.col("p.b")).alias("a"), F.least("a", F.col("p.b")).alias("b")).distinct()


def _open(shared: DataFrame, labels: DataFrame) -> DataFrame | None:
    """(key, a, c) of the members of buckets that hold several components, or None."""
    labelled = shared.join(labels, F.col("a") == F.col("node"), "left").select("key", "a", F.coalesce("component", "a").alias("c"))
    keys = labelled.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    members = save(labelled.join(keys, "key"))
    return None if members.isEmpty() else members


def _blocks(members: DataFrame, bands_of: DataFrame, texts: DataFrame) -> DataFrame:
    """Links across the components of a bucket, found slice against slice; a pair of slices sends
    on only as many links as join its components."""
    sized = members.join(texts.select(F.col("nid").alias("a"), F.octet_length("text").cast("long").alias("size")), "a")
    slices = sized.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / SIDE), F.ceil(F.sum("size") / SIDE_BYTES)).cast("int").alias("k"))
    own = F.pmod(F.xxhash64("a"), F.col("k")).cast("int")
    dealt = members.join(slices, "key").select("key", "a", "c", own.alias("o"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("x"))
    dealt = dealt.select("key", "a", "c", "o", F.least("o", "x").alias("i"), F.greatest("o", "x").alias("j"))
    held = members.select(F.col("a").alias("nid")).distinct().join(texts, "nid").join(bands_of, "nid").select(F.col("nid").alias("id"), "text", "bands")
    rows = dealt.join(save(held), F.col("a") == F.col("id"))
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").select("key", "i", "j", "o", "a", "c", "bands", "text")
    return save(rows.mapInArrow(_met, "a long, b long"))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Common elements of each pair of sorted sets, by products of 0/1 matrices in slices."""
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.float32)

    def placed(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        owner, value = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
        at = np.minimum(np.searchsorted(both, value), max(0, len(both) - 1))
        on = both[at] == value if len(both) else np.zeros(len(value), bool)
        order = np.argsort(at[on], kind="stable")
        return owner[on][order], at[on][order]

    (lo, la), (ro, ra) = placed(left), placed(right)
    for k in range(0, len(both), 2048):
        a, b = np.zeros((len(left), 2048), np.float32), np.zeros((len(right), 2048), np.float32)
        for m, owner, at in ((a, lo, la), (b, ro, ra)):
            own = slice(*np.searchsorted(at, [k, k + 2048]))
            m[owner[own], at[own] - k] = 1
        out += a @ b.T
    return out


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by pair of slices; each pair is held until its last row, and small ones
    are expanded together."""
    whole: list[list[tuple]] = []  # complete pairs of slices that wait for their comparison
    now, rows, size = None, [], 0

    def compared() -> pa.RecordBatch:
        sets = _elements([r[-1] for group in whole for r in group])
        links, lo = [], 0
        for group in whole:
            links += _links(group, sets[lo : lo + len(group)])
            lo += len(group)
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    for batch in batches:
        key, i, j, o, a, c = (batch.column(x).to_numpy().tolist() for x in range(6))
        keys = batch.column(6).flatten().to_numpy().reshape(len(key), -1)
        data, offsets = buffers(batch.column(7))
        view = memoryview(data)
        for x in range(len(key)):
            if (key[x], i[x], j[x]) != now:
                if rows:
                    whole.append(rows)
                if size > SIGN_BYTES:
                    yield compared()
                    whole, size = [], 0
                now, rows = (key[x], i[x], j[x]), []
            text = view[offsets[x] : offsets[x + 1]].tobytes()
            rows.append((key[x], o[x] == i[x], o[x] == j[x], a[x], c[x], keys[x], text))
            size += len(text)
    if rows:
        whole.append(rows)
    if whole:
        yield compared()


def _links(rows: list[tuple], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between the two slices of ``rows`` that join components, each pair judged only in
    the first band that it shares."""
    c, keys, size = np.array([r[4] for r in rows]), np.stack([r[5] for r in rows]), np.array([len(x) for x in sets])
    left, right = np.flatnonzero([r[1] for r in rows]), np.flatnonzero([r[2] for r in rows])
    if not len(left) or not len(right):
        return []
    band = int(np.flatnonzero(keys[0] == rows[0][0])[0])
    meet = c[left][:, None] != c[right][None, :]
    for b in range(band):
        meet &= keys[left, b][:, None] != keys[right, b][None, :]
    small, large = np.minimum(size[left][:, None], size[right][None, :]), np.maximum(size[left][:, None], size[right][None, :])
    meet &= small >= THRESHOLD * large - 1e-3
    if meet.sum() > 64:
        common = overlaps([sets[x] for x in left], [sets[x] for x in right])
        meet &= common >= THRESHOLD * (size[left][:, None] + size[right][None, :] - common) - 1e-3
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for p, q in np.argwhere(meet).tolist():
        x, y = left[p], right[q]
        u, v = find(int(c[x])), find(int(c[y]))
        if u != v and overlap(sets[x], sets[y]) >= THRESHOLD:
            root[u] = v
            out.append((rows[x][3], rows[y][3]))
    return out


def classes(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: doc_id, node (digest of the text), class_id (least
    doc_id of the class) and kept (true for one row of each class).

    Equal texts are one node from the start. Texts without words (null or blank) stand alone,
    unless they are equal. A null doc_id counts as the largest; repeated rows are members like
    others, and only one of them is kept; an empty table gives an empty result.
    """
    content = F.coalesce(col(text).cast("string"), F.lit(""))
    rows = docs.select(col(doc_id).alias("doc_id"), content.alias("text"), F.unhex(F.md5(content)).alias("node"))
    signed = map_texts(rows, "text", "bands array<long>", lambda: _sign, ["doc_id", "node"], SIGN_BYTES)
    signed = save(signed.withColumn("uid", F.monotonically_increasing_id()))
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("uid").alias("u"))
    nodes = signed.groupBy("node").agg(F.min(order).alias("least"), F.first("bands").alias("bands"))
    nodes = save(nodes.withColumn("nid", F.monotonically_increasing_id()))

    buckets = nodes.select("nid", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = save(buckets.join(shared, "key").select("key", F.col("nid").alias("a")))
    wanted = save(nodes.join(shared.select(F.col("a").alias("nid")).distinct(), "nid", "left_semi").select("node", "nid"))
    found = wanted.count()
    texts = rows.select("node", "text").join(F.broadcast(wanted) if found * 40 <= 32 << 20 else wanted, "node")
    texts = save(texts.groupBy("nid").agg(F.first("text").alias("text")) if found else texts.select("nid", "text"))

    links = save(verify(save(_pivots(shared)), texts))
    labels = save(components(links))
    members = _open(shared, labels)
    if members is not None:
        more = _blocks(members, nodes.select("nid", "bands"), texts)
        labels = save(components(links.unionByName(more)))
    grouped = nodes.join(labels, F.col("nid") == labels.node, "left").select(nodes.node, "least", F.coalesce("component", "nid").alias("c"))
    least = grouped.groupBy("c").agg(F.min("least").alias("first"))
    named = grouped.join(least, "c").select("node", "first")
    return signed.join(named, "node").select("doc_id", "node", F.col("first.d").alias("class_id"), (F.col("uid") == F.col("first.u")).alias("kept"))


def deduplicate(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each class."""
    kept = classes(docs, text=text, doc_id=doc_id).where("kept").select(F.col("doc_id").alias("_k"), F.hex("node").alias("_n"))
    digest = F.upper(F.md5(F.coalesce(col(text).cast("string"), F.lit(""))))
    keyed = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), col(doc_id).alias("_d"), digest.alias("_n"))
    joined = keyed.alias("l").join(kept.alias("r"), F.col("l._d").eqNullSafe(F.col("r._k")) & (F.col("l._n") == F.col("r._n")), "left_semi")
    return joined.dropDuplicates(["_d", "_n"]).select("row.*")


def op3_neardup(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "kept")
