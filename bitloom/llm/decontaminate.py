"""Benchmark decontamination by Wu-Manber search.

Texts and benchmark items become words (ASCII letters lower-cased; digits, letters and all
non-ASCII bytes belong to words). Every ``window`` consecutive item words form a pattern; a
shorter item with at least one word is one pattern. Patterns are searched in the document's
words joined by single blanks, each pattern framed by blanks, so that only whole words meet.

The search is Wu-Manber's: with m the shortest pattern's length, a table over hashed blocks of
up to eight bytes says how far a window of m bytes may move on; only where it says 0 does the
block select a bucket of patterns (by that suffix block, then by a prefix block), and a direct
comparison of all bytes confirms an occurrence. Many windows move at once, as numpy lanes.
Patterns are parted by length, so that a few short ones do not shorten the moves of the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLD, MIX_A, MIX_B, buffers, col, filter_texts, map_texts, mixed, pieces, save, span_hashes

#: Lower-cases A-Z, keeps 0-9, a-z and bytes from 0x80 on; everything else becomes a blank.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Patterns are parted at these lengths in bytes.
LENGTHS = (1, 12, 24, 40, 56, 80, 1 << 62)
LANE = 2048
#: Benchmark text that one table holds. Its windows take about ten times as much.
TABLE_BYTES = 8 << 20
TABLE_BITS = 20
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class WuManber:
    """All occurrences of a set of byte strings, given as spans of one buffer."""

    def __init__(self, source: bytes, starts: np.ndarray, sizes: np.ndarray):
        self.source = np.frombuffer(source + bytes(8), np.uint8)
        self.starts, self.sizes = starts, sizes
        order = np.argsort(sizes, kind="stable")
        cuts = np.searchsorted(sizes[order], LENGTHS)
        self.groups = [self._group(order[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False) if hi > lo]

    @classmethod
    def of(cls, patterns: list[bytes]) -> WuManber:
        sizes = np.array([len(p) for p in patterns], np.int64)
        return cls(b"".join(patterns), np.cumsum(sizes) - sizes, sizes)

    @staticmethod
    def _blocks(buffer: np.ndarray) -> np.ndarray:
        """The eight bytes from each position on, as integers; the buffer ends with eight spare bytes."""
        return np.lib.stride_tricks.as_strided(buffer, (len(buffer) - 7, 8), (1, 1))

    @classmethod
    def _load(cls, buffer: np.ndarray, at: np.ndarray, mask: np.uint64) -> np.ndarray:
        return np.ascontiguousarray(cls._blocks(buffer)[at]).view("<u8").ravel() & mask

    @staticmethod
    def _slot(block: np.ndarray) -> np.ndarray:
        return ((block * MIX) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def _group(self, own: np.ndarray) -> dict:
        m = int(self.sizes[own[0]])
        size = min(8, m)
        mask = np.uint64((1 << (8 * size)) - 1)
        starts = self.starts[own]
        shift = np.full(1 << TABLE_BITS, m - size + 1, np.int32)
        for j in range(m - size + 1):
            np.minimum.at(shift, self._slot(self._load(self.source, starts + j, mask)), m - size - j)
        suffix = self._load(self.source, starts + m - size, mask)
        order = np.argsort(suffix, kind="stable")
        keys, first = np.unique(suffix[order], return_index=True)
        prefix = self._load(self.source, starts, mask)[order]
        return {"m": m, "size": size, "mask": mask, "shift": shift, "keys": keys, "first": np.append(first, len(own)), "which": own[order], "prefix": prefix}

    def find(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Start and pattern number of every occurrence."""
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        buffer = np.frombuffer(text + bytes(8), np.uint8)
        for g in self.groups:
            last = len(text) - g["m"]
            if last < 0:
                continue
            at = np.arange(0, last + 1, LANE, dtype=np.int64)
            end = np.minimum(at + LANE, last + 1)
            back = g["m"] - g["size"]
            while len(at):
                block = self._load(buffer, at + back, g["mask"])
                move = g["shift"][self._slot(block)]
                stop = np.flatnonzero(move == 0)
                if len(stop):
                    found.append(self._confirmed(g, buffer, len(text), at[stop], block[stop]))
                at = at + np.maximum(move, 1)
                on = at < end
                if not on.all():
                    at, end = at[on], end[on]
        return np.concatenate([a for a, _ in found]), np.concatenate([p for _, p in found])

    def _confirmed(self, g: dict, buffer: np.ndarray, n: int, at: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(g["keys"], block)
        k[k == len(g["keys"])] = 0
        hit = g["keys"][k] == block
        at, k = at[hit], k[hit]
        low, many = g["first"][k], g["first"][k + 1] - g["first"][k]
        which = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
        at = np.repeat(at, many)
        same = self._load(buffer, at, g["mask"]) == g["prefix"][which]
        at, own = at[same], g["which"][which[same]]
        left, size = self.sizes[own], g["size"]
        good = at + left <= n
        at, own, left = at[good], own[good], left[good] - size
        on, k = np.arange(len(at)), size
        ok = np.ones(len(at), bool)
        while len(on):  # the bytes behind the first block, block by block, all candidates at once
            off = np.minimum(k, left[on])
            equal = self._load(buffer, at[on] + off, g["mask"]) == self._load(self.source, self.starts[own[on]] + off, g["mask"])
            ok[on[~equal]] = False
            on = on[equal & (k < left[on])]
            k += size
        return at[ok], own[ok]


class Matcher:
    """Item windows in arrays: about 60 bytes for each different window, built once."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        texts: dict[bytes, set[str]] = {}
        for item, text in items:
            words = words_of(text)
            if words:
                texts.setdefault(b" ".join(words), set()).update(() if item is None else (item,))
        self.names = sorted({x for ids in texts.values() for x in ids})
        number = {x: i for i, x in enumerate(self.names)}
        source = b"".join(b" " + t + b" \n" for t in texts)
        data = np.frombuffer(source, np.uint8)
        blank = np.flatnonzero(data == 32)
        ends = np.flatnonzero(data == 10)
        n = np.searchsorted(blank, ends) - np.append(0, np.searchsorted(blank, ends)[:-1]) - 1  # words of each text
        many = np.maximum(n - window + 1, 1)
        owner = np.repeat(np.arange(len(n)), many)
        first = np.repeat(np.cumsum(n + 1) - n - 1, many) + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        size = np.minimum(n, window)[owner]
        starts, sizes = blank[first], blank[first + size] + 1 - blank[first]
        one, two = self._keys(data, blank, first, size, window)
        order = np.lexsort((two, one))
        new = np.append(True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]))[: len(order)]
        head = order[new]
        self.words = size[head]
        #: Items of each window: ``ids[bounds[w] : bounds[w + 1]]``.
        ids = [np.array([number[x] for x in own], np.int64) for own in texts.values()]
        sizes_of = np.array([len(x) for x in ids], np.int64)
        flat, base = np.concatenate(ids) if ids else np.zeros(0, np.int64), np.cumsum(sizes_of) - sizes_of
        text = owner[order]
        reps = sizes_of[text] if len(text) else np.zeros(0, np.int64)
        at = np.repeat(base[text], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) if len(text) else np.zeros(0, np.int64)
        self.ids = flat[at]
        self.bounds = np.append(np.append(0, np.cumsum(reps))[:-1][new], reps.sum()) if len(text) else np.zeros(1, np.int64)
        self.search = WuManber(source, starts[head], sizes[head])

    @staticmethod
    def _keys(data: np.ndarray, blank: np.ndarray, first: np.ndarray, size: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each window; together they stand for its words."""
        after = np.flatnonzero(data[np.minimum(blank + 1, len(data) - 1)] != 10) if len(blank) else blank
        h = np.zeros(len(blank), np.uint64)
        h[after] = span_hashes(data, blank[after] + 1, blank[np.minimum(after + 1, len(blank) - 1)] - blank[after] - 1)
        one, two = size.astype(np.uint64), size.astype(np.uint64)
        for k in range(window):
            x = np.where(k < size, h[np.minimum(first + k, len(h) - 1)] if len(h) else np.uint64(0), np.uint64(1))
            one, two = one * MIX_A + x, mixed(two * MIX_B + x * GOLD)
        return one, two

    def hits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text; whether each word, end to end, is hit; and (text, item number) pairs."""
        words = [words_of(t) for t in texts]
        n = np.array([len(w) for w in words], np.int64)
        whole = b"".join(b" " + b" ".join(w) + b" \n" for w in words)
        at, which = self.search.find(whole)
        mark = np.zeros(int(n.sum()) + 1, np.int64)
        if not len(at):
            return n, mark[:-1] > 0, at, at
        blank = np.flatnonzero(np.frombuffer(whole, np.uint8) == 32)
        place = np.searchsorted(blank, at)
        bounds = np.cumsum([0] + [max(2, k + 1) for k in n.tolist()])  # a text without words has two blanks
        doc = np.searchsorted(bounds, place, "right") - 1
        word = place - bounds[doc] + (np.cumsum(n) - n)[doc]
        np.add.at(mark, word, 1)
        np.add.at(mark, word + self.words[which], -1)
        pair = np.unique(doc * len(self.words) + which)
        doc, which = pair // len(self.words), pair % len(self.words)
        many = self.bounds[which + 1] - self.bounds[which]
        ids = self.ids[np.repeat(self.bounds[which] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        pair = np.unique(np.repeat(doc, many) * max(1, len(self.names)) + ids)
        return n, np.cumsum(mark)[:-1] > 0, pair // max(1, len(self.names)), pair % max(1, len(self.names))

    def named(self, count: int, doc: np.ndarray, item: np.ndarray) -> list[list[str]]:
        out: list[list[str]] = [[] for _ in range(count)]
        for d, i in zip(doc.tolist(), item.tolist(), strict=True):
            out[d].append(self.names[i])
        return out

    def work(self, texts: list[bytes]) -> list[list]:
        n, mark, doc, item = self.hits(texts)
        return [n.tolist(), _summed(mark, n).tolist(), self.named(len(texts), doc, item)]


def _summed(mark: np.ndarray, n: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(mark))
    return total[np.cumsum(n)] - total[np.cumsum(n) - n]


def _items(items: DataFrame, item: str, item_text: str, table_bytes: int) -> tuple[DataFrame, int]:
    """The items as text, and the number of blocks of ``table_bytes`` that they make."""
    items = items.select(col(item).cast("string").alias("item"), F.encode(col(item_text).cast("string"), "UTF-8").alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    return items, max(1, -(-size // table_bytes))


def _matcher(items: DataFrame, window: int) -> Matcher:
    return Matcher([(r.item, bytes(r.t or b"")) for r in items.collect()], window)


def scan(
    docs: DataFrame, items: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = 10, keep: list[str] | None = None, table_bytes: int = TABLE_BYTES,
) -> DataFrame:
    """``docs`` with n_words, n_hit (words inside an occurrence) and items (sorted ids).

    A null text has no words; an item without words has no pattern; a null item id makes
    hits but is not listed; repeated items and rows count as they stand; an empty side gives
    zeros. Columns named like a new one are replaced. The benchmark's size is measured first:
    up to ``table_bytes`` of text makes one table, built on the driver and broadcast. A larger
    benchmark is held against all documents block by block: each block is a job of its own that
    writes only the hits, so that neither the driver nor a worker ever holds two blocks.
    """
    items, blocks = _items(items, item, item_text, table_bytes)
    if blocks == 1:
        held = docs.sparkSession.sparkContext.broadcast(_matcher(items, window))
        return map_texts(docs, text, "n_words long, n_hit long, items array<string>", lambda: held.value.work, keep)
    return _blockwise(docs, items, text, window, keep, blocks)


def clean(docs: DataFrame, items: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows of ``docs`` without a hit, all columns as they are."""
    own, blocks = _items(items, item, item_text, table_bytes)
    if blocks == 1:
        held = docs.sparkSession.sparkContext.broadcast(_matcher(own, window))

        def make():
            def untouched(texts: list[bytes]) -> np.ndarray:
                n, mark, _, _ = held.value.hits(texts)
                return _summed(mark, n) == 0

            return untouched

        return filter_texts(docs, text, make)
    row = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), col(text).alias("text"))
    return scan(row, items, item=item, item_text=item_text, window=window, table_bytes=table_bytes).where("n_hit = 0").select("row.*")


def _blockwise(docs: DataFrame, items: DataFrame, text: str, window: int, keep: list[str] | None, blocks: int) -> DataFrame:
    """The documents are numbered once; every block adds rows of hits, and they are merged."""
    names = list(docs.columns) if keep is None else keep
    numbered = docs.select(F.struct(*[col(c) for c in names], F.lit(1).alias("_")).alias("row"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("uid"))
    numbered = save(numbered)
    found = None
    for b in range(blocks):
        held = docs.sparkSession.sparkContext.broadcast(_matcher(items.where(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == b), window))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            matcher = held.value
            for batch in batches:
                data, offsets = buffers(batch.column(1))
                view, uid = memoryview(data), batch.column(0).to_numpy()
                for lo, hi in pieces(offsets):
                    n, mark, doc, item = matcher.hits([view[offsets[i] : offsets[i + 1]].tobytes() for i in range(lo, hi)])
                    hit = np.flatnonzero(_summed(mark, n))
                    ids, end = matcher.named(hi - lo, doc, item), np.cumsum(n)
                    words = [np.flatnonzero(mark[end[i] - n[i] : end[i]]).astype(np.int32) for i in hit]
                    yield pa.RecordBatch.from_arrays([pa.array(uid[lo:hi][hit]), pa.array(words, pa.list_(pa.int32())), pa.array([ids[i] for i in hit], pa.list_(pa.string()))], ["uid", "words", "ids"])

        own = save(numbered.select("uid", "text").mapInArrow(run, "uid long, words array<int>, ids array<string>"))
        held.unpersist()
        found = own if found is None else found.unionByName(own)
    merged = found.groupBy("uid").agg(F.size(F.array_distinct(F.flatten(F.collect_list("words")))).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("items"))
    counted = map_texts(numbered, "text", "n_words long", lambda: lambda texts: [[len(words_of(t)) for t in texts]], ["row", "uid"])
    joined = counted.join(merged, "uid", "left")
    new = {"n_words": F.col("n_words"), "n_hit": F.coalesce("n_hit", F.lit(0)), "items": F.coalesce("items", F.array().cast("array<string>"))}
    return joined.select(*[F.col("row").getField(c).alias(c) for c in names if c not in new], *[e.alias(c) for c, e in new.items()])


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's row for each document."""
    found = scan(docs, items, keep=["doc_id"])
    listed = F.array_join("items", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def digest_of(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


#: The same in DuckDB: every window of item words against every run of as many document words.
OP2_SQL = r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), patterns AS (
  SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS p
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM items WHERE len(w) > 0)
), places AS (
  SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS p
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, (SELECT DISTINCT size FROM patterns))
), hits AS (
  SELECT r, i, size, item FROM places JOIN patterns USING (size, p)
), covered AS (
  SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS k FROM (SELECT DISTINCT r, i, size FROM hits)) GROUP BY r
), listed AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN listed USING (r)
"""


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
