"""Suffix-array deduplication: every byte covered by a SPAN-byte string that starts anywhere else.

All positions are covered, in three steps.

1. *Anchors.* In each run of SPAN bytes the GRAM-byte string with the least hash (of equals,
   the last) is its anchor. Equal runs have equal anchors, so only runs whose anchor's hash
   occurs at least twice can repeat. Each start belongs to exactly one anchor; the starts of an
   anchor are consecutive and make, with the SPAN - 1 bytes after them, its context.
2. *Suffix order.* Equal contexts are one, with a weight. Contexts with the same anchor go to
   the same shard (a frequent anchor's are dealt over several); a shard's contexts are sorted by
   external induced sorting (``induced``), and neighbours in the order that share SPAN bytes make
   a class. Classes of an anchor that was dealt out are joined across its shards by digest.
   A class of total weight two or more repeats.
3. *Removal.* The marked starts return to their texts; the union of their runs is removed.

Equal whole texts are one text with a weight throughout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GOLD, MIX_A, MIX_B, buffers, clear_scratch, col, mixed, pieces, release, save, scratch_tables
from .induced import suffix_order

SPAN, GRAM = 200, 32
CHUNK_BITS = 20
SHARD_BYTES = 3 << 20
#: Contexts of one anchor that one shard takes.
DEAL = 12_000

_POWER = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full((1 << CHUNK_BITS) + SPAN, GOLD, np.uint64)]))
_BACK = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full((1 << CHUNK_BITS) + SPAN, np.uint64(pow(int(GOLD), -1, 1 << 64)), np.uint64)]))
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * MIX_A)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first start, starts, anchor, hash, digest) of each context; at most 2**CHUNK_BITS bytes."""
    width, n = SPAN - GRAM + 1, len(data)
    if n < SPAN:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    sums = np.append(np.zeros(1, np.uint64), np.add.accumulate(_BYTE[data] * _POWER[:n]))
    gram = mixed((sums[GRAM:] - sums[:-GRAM]) * _BACK[: n - GRAM + 1])
    low = np.uint64((1 << CHUNK_BITS) - 1)
    key = (gram & ~low) | (low - np.arange(len(gram), dtype=np.uint64))
    best, size = key, 1
    while size * 2 <= width:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    best = np.minimum(best[: len(best) - (width - size)], best[width - size :])
    anchor = (low - (best & low)).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    start = np.flatnonzero(np.arange(len(anchor)) + SPAN <= offsets[doc + 1])
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    anchor, doc = anchor[start], doc[start]
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1))
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(start)))
    begin, at = start[first], anchor[first]
    digest = mixed((sums[begin + many + SPAN - 1] - sums[begin]) * _BACK[begin])
    digest = mixed(digest + many.astype(np.uint64) * MIX_B + (at - begin).astype(np.uint64) * GOLD)
    return doc[first], begin, many, at, gram[at].view(np.int64), digest.view(np.int64)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (n1, n2, weight, text) to a row for each context."""
    names = ["n1", "n2", "w", "h", "c", "begin", "many"]
    most, step = 1 << CHUNK_BITS, (1 << CHUNK_BITS) - SPAN + 1
    for batch in batches:
        data, offsets = buffers(batch.column(3))
        n1, n2, w = (batch.column(i).to_numpy() for i in range(3))
        for lo, hi in pieces(offsets, most):
            for chunk in range(int(offsets[lo]), max(int(offsets[hi]) - SPAN + 1, int(offsets[lo]) + 1), step if hi == lo + 1 else most):
                end = min(int(offsets[hi]), chunk + most)
                own = offsets[lo : hi + 1] - chunk if hi > lo + 1 else np.array([0, end - chunk])
                doc, begin, many, _, h, c = anchors(data[chunk:end], own)
                d = doc + lo
                begin = begin + chunk - offsets[d]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (n1[d], n2[d], w[d], h, c, begin, many)], names)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (text, contexts) to a row for each context with its bytes."""
    for batch in batches:
        data, offsets = buffers(batch.column(0))
        raw = data.tobytes()
        lists = batch.column(1)
        flat, bounds = lists.flatten(), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
        begin, many = flat.field("begin").to_numpy(), flat.field("many").to_numpy()
        for i in range(len(lists)):
            lo, hi = int(bounds[i]), int(bounds[i + 1])
            at = offsets[i] + begin[lo:hi]
            parts = [raw[a : a + m + SPAN - 1] for a, m in zip(at.tolist(), many[lo:hi].tolist(), strict=True)]
            own = flat.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([*(own.field(f) for f in ("shard", "dealt", "h", "c", "w", "many")), pa.array(parts, pa.binary())], ["shard", "dealt", "h", "c", "w", "many", "bytes"])


def classes(parts: list[bytes], many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, start, class) of all starts: equal classes, equal SPAN bytes. By suffix order."""
    text = np.frombuffer(b"\n".join(parts), np.uint8).astype(np.int64) + 2
    size = np.array([len(p) for p in parts])
    first = np.cumsum(size + 1) - size - 1
    text[first[1:] - 1] = 1
    owner = np.repeat(np.arange(len(parts)), size + 1)[: len(text)]
    inside = np.arange(len(text)) - first[owner]
    order = suffix_order(np.append(text, 0), 258, depth=SPAN)[1:]
    order = order[inside[order] < many[owner[order]]]
    narrow = (text - 2).astype(np.uint8)
    words = np.lib.stride_tricks.as_strided(narrow, (len(narrow) - SPAN + 1, SPAN), (1, 1))
    same = np.zeros(len(order), bool)
    for lo in range(0, len(order) - 1, 1 << 15):
        a, b = order[lo : lo + (1 << 15) + 1][:-1], order[lo + 1 : lo + (1 << 15) + 1]
        same[lo + 1 : lo + 1 + len(b)] = (words[a[: len(b)]] == words[b]).all(axis=1)
    return owner[order], inside[order], np.cumsum(~same) - 1


RESULT = "h long, c long, w long, start int, g binary, starts array<int>"


def _sorted_shard(table: pa.Table) -> pa.Table:
    """Marked runs of starts of each context; for dealt-out anchors each start with its digest."""
    parts, many = table.column("bytes").to_pylist(), table.column("many").to_numpy()
    h, c, w, dealt = (table.column(x).to_numpy() for x in ("h", "c", "w", "dealt"))
    owner, inside, group = classes(parts, many)
    total = np.bincount(group, w[owner])
    fixed = ~dealt[owner]
    mark = (total[group] >= 2) & fixed
    rows: dict[str, list] = {k: [] for k in ("h", "c", "w", "start", "g", "starts")}
    order = np.lexsort((inside[mark], owner[mark]))
    o, s = owner[mark][order], inside[mark][order]
    new = np.append(True, (o[1:] != o[:-1]) | (s[1:] != s[:-1] + 1)) if len(o) else np.zeros(0, bool)
    run, end = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(o))
    bounds = np.append(np.flatnonzero(np.append(True, o[run][1:] != o[run][:-1])), len(run)) if len(run) else np.zeros(1, int)
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        x = o[run[lo]]
        rows["h"].append(h[x]), rows["c"].append(c[x]), rows["w"].append(w[x]), rows["start"].append(None), rows["g"].append(None)
        rows["starts"].append(np.stack([s[run[lo:hi]], s[end[lo:hi] - 1]], 1).ravel().astype(np.int32))
    digest, last = b"", -1
    for x, s, k in zip(owner[~fixed].tolist(), inside[~fixed].tolist(), group[~fixed].tolist(), strict=True):
        if k != last:
            digest, last = hashlib.sha256(parts[x][s : s + SPAN]).digest()[:16], k
        rows["h"].append(h[x]), rows["c"].append(c[x]), rows["w"].append(w[x]), rows["start"].append(s), rows["g"].append(digest), rows["starts"].append(None)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()))
    return pa.table([pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)], names=list(rows))


def removed_runs(n: int, begin: np.ndarray, runs: list[np.ndarray]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that marked starts cover."""
    cover = np.zeros(n + 1, np.int32)
    for b, r in zip(begin, runs, strict=True):
        for lo, hi in np.asarray(r).reshape(-1, 2).tolist():
            cover[b + lo] += 1
            cover[b + hi + SPAN] -= 1
    on = np.append(False, np.cumsum(cover[:-1]) > 0)
    step = np.diff(np.append(on, False).astype(np.int8))
    return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (n1, n2, text, marks) to the text's figures and what is left of it."""
    for batch in batches:
        data, offsets = buffers(batch.column(2))
        raw = data.tobytes()
        out: list[list] = [[], [], [], [], []]
        for i, marks in enumerate(batch.column(3)):
            text = raw[offsets[i] : offsets[i + 1]]
            runs: list[tuple[int, int]] = []
            if marks.is_valid and len(marks.values):
                own = marks.values
                starts = own.field("starts")
                flat, bounds = starts.flatten().to_numpy(), np.append(0, np.cumsum(starts.value_lengths().to_numpy()))
                runs = removed_runs(len(text), own.field("begin").to_numpy(), [flat[a:b] for a, b in zip(bounds, bounds[1:], strict=False)])
            kept, last = [], 0
            for lo, hi in runs:
                kept.append(text[last:lo])
                last = hi
            left = b"".join([*kept, text[last:]])
            for k, v in enumerate((len(text), len(text) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left)):
                out[k].append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, t) for v, t in zip(out, kinds, strict=True))], ["n1", "n2", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _key(text: Column, part: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1 + 16 * part, 16), 16, -10).cast("long")


def remove_repeats(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, kept: bool = True) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, kept_sha256 and (if asked) kept, the remaining bytes.

    A null text counts as empty. Repeated rows and equal texts repeat each other, so from SPAN
    bytes on nothing is left of any of them. Texts shorter than SPAN bytes lose nothing. An empty
    table gives an empty result; columns named like a new one are replaced.
    """
    spark = docs.sparkSession
    names = list(docs.columns) if keep is None else keep
    content = F.coalesce(col(text).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[col(c) for c in names]).alias("row"), content.alias("text"), _key(content, 0).alias("n1"), _key(content, 1).alias("n2"))
    whole = rows.groupBy("n1", "n2").agg(F.first("text").alias("text"), F.count("*").alias("w"))
    before = scratch_tables(spark)

    all_anchors = save(whole.select("n1", "n2", "w", "text").mapInArrow(_contexts, "n1 long, n2 long, w long, h long, c long, begin long, many long"))
    release(spark)
    often = all_anchors.groupBy("h").agg(F.sum("w").alias("t")).where("t > 1").select("h")
    repeated = save(all_anchors.join(save(often), "h"))  # from tables, so that frequent anchors' partitions can be split
    release(spark)
    clear_scratch(spark, [t for t in scratch_tables(spark) if t not in before][:-1])
    contexts = repeated.groupBy("h", "c").agg(F.sum("w").alias("w"), *[F.first(x).alias(x) for x in ("n1", "n2", "begin", "many")])
    contexts = save(contexts)
    variety = contexts.groupBy("h").agg(F.count("*").alias("n"))
    contexts = save(contexts.join(save(variety), "h"))
    volume, widest = contexts.agg(F.sum(F.col("many") + SPAN), F.max("n")).first()
    shards = max(1, -(-(volume or 0) // SHARD_BYTES))
    shard = F.pmod(F.xxhash64("h", F.pmod("c", F.ceil(F.col("n") / DEAL))), F.lit(shards)).cast("int")
    listed = contexts.groupBy("n1", "n2").agg(F.collect_list(F.struct(shard.alias("shard"), (F.col("n") > DEAL).alias("dealt"), "h", "c", "w", "begin", "many")).alias("contexts"))
    found = whole.select("n1", "n2", "text").join(listed, ["n1", "n2"]).select("text", "contexts").mapInArrow(_extracted, "shard int, dealt boolean, h long, c long, w long, many long, bytes binary")
    judged = save(found.groupBy("shard").applyInArrow(_sorted_shard, RESULT))
    release(spark)
    marks = judged.where("g is null").select("h", "c", "starts")
    if (widest or 0) > DEAL:
        apart = judged.where("g is not null")
        twice = apart.groupBy("g").agg(F.sum("w").alias("t")).where("t > 1").select("g")
        single = F.transform(F.array_sort(F.collect_list("start")), lambda s: F.array(s, s))
        marks = marks.unionByName(apart.join(twice, "g").groupBy("h", "c").agg(F.flatten(single).alias("starts")))
    placed = repeated.join(marks, ["h", "c"]).groupBy("n1", "n2").agg(F.collect_list(F.struct("begin", "starts")).alias("marks"))
    cut = whole.select("n1", "n2", "text").join(placed, ["n1", "n2"], "left").select("n1", "n2", "text", "marks")
    done = cut.mapInArrow(_cut, "n1 long, n2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    new = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * kept
    if not kept:
        done = done.drop("kept")
    joined = rows.select("row", "n1", "n2").join(done, ["n1", "n2"])
    return joined.select(*[F.col("row").getField(c).alias(c) for c in names if c not in new], *new)


def op5_repeats(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"], kept=False)
