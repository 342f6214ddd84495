"""Language-model scoring with a hidden Markov model.

Tokens are words and one end for each text. The corpus gives every token's count. The model's
symbols are classes of tokens: the most frequent words, OWN_SCALE times the root of the number of
different tokens, are classes of their own, so the model grows with the corpus; any other word
falls into a class by its form (its last two bytes and its length).

A text's probability is that of its class sequence under the hidden Markov model times, for each
token, its share of its class. A class by form keeps a share for unknown words, as large as its
words seen once, and deals it to *all* byte strings of that form that are not known, by a byte
model: independent bytes and an end, with the shares found in the different words. The byte
model's mass of a form has a closed form, so the shares of a class sum to one, and with them the
probabilities of all texts.

Baum-Welch: each pass runs the scaled forward and backward recursions over all training texts
(numpy, many texts in step); tasks send expected counts, whose number is fixed by the model,
and the sums give the next parameters. The final score is the scaled forward recursion's exact
likelihood.

Two passes read the texts. The first counts words. The second knows the HEAD most frequent words
by broadcast and codes every token as its class. Other words are numbered within a bucket of
about BUCKET_BYTES of text: one row for each of them meets the corpus counts and returns to its
bucket, so neither a frequent word nor a whole text passes a join.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buffers, clear_scratch, col, release, save, scratch_tables

OWN_SCALE, FORMS, STATES, PASSES = 2, 1024, 8, 4
#: Words that are broadcast with their counts: at most so many, of at most HEAD_WORD bytes.
HEAD, HEAD_WORD = 1 << 16, 64
BUCKET_BYTES, BUCKET_ROWS = 12 << 20, 1 << 20
#: Bytes of a text that are split into words at once, and words counted before they are sent on.
STRETCH, COUNTED = 1 << 20, 200_000
#: Words whose figures are looked up at once.
WAITING = 1 << 16
CELLS = 1 << 18
FOLDS, HELD = 7, 2
#: The end of a text; no word has a blank.
END = b" "
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes that a word may hold.
INNER = np.array([not (c == 32 or 9 <= c <= 13 or 65 <= c <= 90) for c in range(256)])
_GAP = re.compile(rb"[ \t-\r]")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS, is HELD; a null id is not held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS == HELD, F.lit(False))


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, STRETCH bytes at a time, so that a long text is never a long list."""
    low, at = text.translate(LOWER), 0
    while at < len(low):
        cut = _GAP.search(low, at + STRETCH) if at + STRETCH < len(low) else None
        end = cut.start() if cut else len(low)
        yield low[at:end].split()
        at = end


def _texts(column: pa.Array) -> Iterator[bytes]:
    data, offsets = buffers(column)
    view = memoryview(data)
    for i in range(len(offsets) - 1):
        yield view[offsets[i] : offsets[i + 1]].tobytes()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (word, n); a word may have several rows."""
    found: Counter[bytes] = Counter()

    def sent() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
        found.clear()
        return out

    for batch in batches:
        for text in _texts(batch.column(0)):
            found[END] += 1
            for words in word_lists(text):
                found.update(words)
                if len(found) > COUNTED:
                    yield sent()
    if found:
        yield sent()


class Spelling:
    """A byte model of words: independent bytes, then an end; its mass of each form is known."""

    def __init__(self, bytes_seen: np.ndarray, words_seen: float):
        seen = np.where(INNER, bytes_seen + 1.0, 0.0)
        total = seen.sum() + words_seen + 1
        self.byte, self.end = seen / total, (words_seen + 1) / total
        with np.errstate(divide="ignore"):
            self.log = np.log10(self.byte)
        self.last = math.log10(self.end / (1 - self.end))

    def of(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 probabilities of words that lie end to end."""
        return np.add.reduceat(self.log[data], starts) + self.last if len(starts) else np.zeros(0)

    def masses(self) -> np.ndarray:
        """The probability of all words of each form."""
        out = np.zeros(FORMS)
        one = np.flatnonzero(INNER)
        np.add.at(out, form(one, np.full(len(one), -1), 1), self.byte[one] * self.end / (1 - self.end))
        b, a = (x.ravel() for x in np.meshgrid(one, one))
        pair = self.byte[a] * self.byte[b] * self.end / (1 - self.end)
        on = 1 - self.end
        for bucket in range(11):  # words of n = 4 * bucket .. 4 * bucket + 3 bytes; the last has no upper end
            low = max(2, 4 * bucket)
            lengths = on ** (low - 2) / self.end if bucket == 10 else sum(on ** (n - 2) for n in range(low, 4 * bucket + 4))
            out += np.bincount(form(b, a, 4 * bucket), pair * lengths, FORMS)
        return out


def form(last: np.ndarray, before: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """The form of a word by its last byte, the one before (-1: none) and its length."""
    bucket = np.minimum(size, 40) // 4
    return ((last + 257 * (before + 1)) * 0x9E3779B1 + bucket * 0x85EBCA6B >> 7) % FORMS


def laid_out(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, first bytes and lengths of words laid end to end."""
    size = np.array([len(w) for w in words], np.int64)
    return np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size


def forms_of(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    last = data[starts + size - 1].astype(np.int64)
    before = np.where(size > 1, data[np.maximum(starts + size - 2, 0)].astype(np.int64), -1)
    return form(last, before, size)


class Lexicon:
    """What the second pass knows of the corpus; its size is bounded by HEAD and the forms.

    Classes: 0 the end, then the own words, then the forms.
    """

    def __init__(self, train: int, types: int, head: list[tuple[bytes, int]]):
        self.train, self.types = train, types
        self.own = min(len(head), math.ceil(OWN_SCALE * types**0.5))
        self.number = {END: 0} | {w: i + 1 for i, (w, _) in enumerate(head)}
        self.count = np.array([0] + [n for _, n in head])  # the end's count comes with learn()
        self.classes = 1 + self.own + FORMS
        data, starts, size = laid_out([w for w, _ in head])
        own_forms = 1 + self.own + forms_of(data, starts, size) if head else np.zeros(0, np.int64)
        self.klass = np.append(0, np.where(np.arange(len(head)) < self.own, np.arange(1, len(head) + 1), own_forms))

    def learn(self, ends: int, mass: np.ndarray, once: np.ndarray, spelling: Spelling, spelled: np.ndarray) -> None:
        """``mass`` and ``once``: tokens, and words seen once, of each form but for own words;
        ``spelled``: the byte model's mass of the known words of each form, own words too."""
        self.count[0] = ends
        self.spelling = spelling
        self.mass = np.concatenate([[ends], self.count[1 : 1 + self.own], mass])
        unseen = np.where(mass > 0, (once + 1) / (mass + once + 2), 1.0)
        left = np.maximum(spelling.masses() - spelled, 1e-300)
        self.unknown = np.log10(unseen) - np.log10(left)
        share = np.concatenate([np.ones(1 + self.own), 1 - unseen])
        with np.errstate(divide="ignore"):
            self.known = np.log10(share) - np.log10(np.maximum(self.mass, 1))
            self.within = np.log10(self.count) + self.known[self.klass]  # of head words


class _Vocabulary(dict):
    """Numbers of words; a new word takes the next number."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


NAMES = ["bucket", "word", "number", "known", "unknown", "place", "row", "held", "n_tokens", "n_known", "base", "within", "classes", "tail"]


def _coding(held, row_type: pa.DataType):
    """Batches of (row, held, text) to rows of texts (place, figures of head words, classes of
    all tokens, numbers of the others) and rows of a bucket's other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon: Lexicon = held.value
        head = len(lexicon.number)
        code = np.dtype("<u2" if lexicon.classes <= 1 << 16 else "<u4")
        base_of = np.log10(lexicon.count + 1.0)
        task = TaskContext.get().partitionId() << 20
        bucket, size = 0, 0
        numbers = _Vocabulary(lexicon.number)
        docs: list[list] = []

        def texts_rows() -> pa.RecordBatch:
            m = len(docs)
            for d in docs:
                d[6] += stop
            cols = list(zip(*[d[2:] for d in docs], strict=True))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary())
            rows = pa.concat_arrays([d[0] for d in docs])
            places = (task + bucket << 20) + np.arange(m)
            return pa.RecordBatch.from_arrays([pa.array([task + bucket] * m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64()), pa.array(places), rows, pa.array([d[1] for d in docs], pa.bool_()), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], NAMES)

        def words_rows() -> pa.RecordBatch:
            words = list(numbers)[head:]
            n = len(words)
            data, starts, sizes = laid_out(words)
            f = forms_of(data, starts, sizes)
            known, unknown = lexicon.known[1 + lexicon.own + f], lexicon.unknown[f] + lexicon.spelling.of(data, starts)
            kinds = (pa.int64(), row_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([task + bucket] * n, pa.int64()), pa.array(words, pa.binary()), pa.array(np.arange(n), pa.int32()), pa.array(known), pa.array(unknown), *[pa.nulls(n, k) for k in kinds]], NAMES)

        def flush() -> None:
            """Figures, classes and numbers of the words that wait, added to their texts."""
            nonlocal grown, waiting, n_waiting
            if not waiting:
                return
            x = np.concatenate([w for _, w in waiting])
            size = np.array([len(w) for _, w in waiting])
            first = np.cumsum(size) - size
            if len(numbers) - head > len(grown):  # forms of the words that are new in this bucket
                fresh = list(numbers)[head:] if len(grown) == 0 else _last(numbers, len(numbers) - head - len(grown))
                grown = np.append(grown, 1 + lexicon.own + forms_of(*laid_out(fresh)))
            k = np.append(lexicon.klass, grown)[x].astype(code)
            front = x < head
            rare = (x[~front] - head).astype("<u4")
            own = np.where(front, x, head)
            n_known = np.add.reduceat(front.astype(np.int64), first)
            base, within = np.add.reduceat(bases[own], first), np.add.reduceat(shares[own], first)
            cut = np.append(0, np.cumsum(size - n_known))
            for j, (doc, _) in enumerate(waiting):
                doc[2] += int(size[j])
                doc[3] += int(n_known[j])
                doc[4] += float(base[j])
                doc[5] += float(within[j])
                doc[6] += k[first[j] : first[j] + size[j]].tobytes()
                doc[7] += rare[cut[j] : cut[j + 1]].tobytes()
            waiting, n_waiting = [], 0

        end = [1, int(lexicon.count[0] > 0), float(base_of[0]), float(lexicon.within[0]) if lexicon.count[0] > 0 else 0.0]
        stop = np.zeros(1, code).tobytes()
        bases, shares = np.append(base_of, 0.0), np.append(lexicon.within, 0.0)
        grown = np.zeros(0, np.int64)
        waiting: list[tuple[list, np.ndarray]] = []
        n_waiting = 0
        for batch in batches:
            own = batch.column(1).to_pylist()
            for i, text in enumerate(_texts(batch.column(2))):
                docs.append([batch.column(0).slice(i, 1), own[i], *end, bytearray(), bytearray()])
                for words in word_lists(text):
                    if words:
                        waiting.append((docs[-1], np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))))
                        n_waiting += len(words)
                        if n_waiting >= WAITING:
                            flush()
                size += len(text)
                if size >= BUCKET_BYTES or len(docs) >= BUCKET_ROWS:
                    flush()
                    yield texts_rows()
                    yield words_rows()
                    bucket, size, docs, numbers, grown = bucket + 1, 0, [], _Vocabulary(lexicon.number), np.zeros(0, np.int64)
        if docs:
            flush()
            yield texts_rows()
            yield words_rows()

    return run


def _last(numbers: dict, n: int) -> list[bytes]:
    """The n newest words."""
    newest = reversed(numbers)
    return [next(newest) for _ in range(n)][::-1]


class Hmm:
    """Scaled recursions over many class sequences at once."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, shares: np.ndarray) -> Hmm:
        """The classes' own shares, stirred differently for each state, and states that last."""
        rng = np.random.default_rng(11)
        emit = shares * np.exp(rng.normal(0, 0.5, (STATES, len(shares))))
        move = np.full((STATES, STATES), 0.2 / (STATES - 1))
        np.fill_diagonal(move, 0.8)
        return cls(np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=1, keepdims=True))

    def _steps(self, texts: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Texts of like length together: their places, lengths (falling) and padded classes."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        lo = 0
        while lo < len(order):
            longest = len(texts[order[lo]])
            hi = min(len(order), lo + max(1, CELLS // longest))
            own = order[lo:hi]
            size = np.array([len(texts[i]) for i in own])
            padded = np.zeros((longest, len(own)), np.int64)
            for j, i in enumerate(own):
                padded[: len(texts[i]), j] = texts[i]
            yield own, size, padded
            lo = hi

    def _forward(self, size: np.ndarray, padded: np.ndarray, seen: list | None = None) -> np.ndarray:
        """Arrays have a row for each state, so that the inner loops run over texts. ``seen`` gets
        the scaled forward variables and the factors of each place."""
        total = np.zeros(len(size))
        alive = np.searchsorted(-size, -np.arange(len(padded)), "left")
        onward = np.ascontiguousarray(self.move.T)
        a = self.start[:, None]
        for t in range(len(padded)):
            n = alive[t]
            emit = self.emit.take(padded[t, :n], axis=1)
            a = emit * (a if t == 0 else onward @ a[:, :n])
            scale = a.sum(axis=0)
            total[:n] += np.log10(scale)
            scale = 1 / scale
            a *= scale
            if seen is not None:
                seen.append((a, scale))
        return total

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(texts))
        for own, size, padded in self._steps(texts):
            out[own] = self._forward(size, padded)
        return out

    def expected(self, texts: list[np.ndarray], counts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        """Add the expected counts of starts, moves and emissions."""
        start, move, emit = counts
        table = np.ascontiguousarray(self.emit.T)
        for _, size, padded in self._steps(texts):
            seen: list[tuple[np.ndarray, np.ndarray]] = []
            self._forward(size, padded, seen)
            marks, moved, back = [], np.zeros((STATES, STATES)), None
            for t in range(len(padded) - 1, -1, -1):
                a = seen[t][0]
                n = a.shape[1]
                marks.append(padded[t, :n])
                now = np.ones((STATES, n))
                if back is not None:
                    m = back.shape[1]
                    ahead = self.emit.take(padded[t + 1, :m], axis=1)
                    ahead *= back
                    ahead *= seen[t + 1][1]
                    now[:, :m] = self.move @ ahead
                    moved += a[:, :m] @ ahead.T
                    np.multiply(seen[t + 1][0], back, out=seen[t + 1][0])
                back = now
            np.multiply(seen[0][0], back, out=seen[0][0])
            start += seen[0][0].sum(axis=1)
            move += self.move * moved
            mark = np.concatenate(marks[::-1])
            for k in range(STATES):
                emit[k] += np.bincount(mark, np.concatenate([a[k] for a, _ in seen]), emit.shape[1])


def _classes_of(column: pa.Array, model: Hmm) -> list[np.ndarray]:
    code = "<u2" if model.emit.shape[1] <= 1 << 16 else "<u4"
    return [np.frombuffer(x, code).astype(np.int64) for x in column.to_pylist()]


def _trained(coded: DataFrame, model: Hmm) -> Hmm:
    spark = coded.sparkSession
    held = spark.sparkContext.broadcast(model)
    size = model.emit.shape[1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = (np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, size)))
        for batch in batches:
            held.value.expected(_classes_of(batch.column(0), held.value), sums)
        flat = np.concatenate([x.ravel() for x in sums])
        some = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(flat[some])], ["place", "v"])

    parts = coded.where("not held").select("classes").mapInArrow(count, "place int, v double")
    flat = np.zeros(STATES + STATES**2 + STATES * size)
    for r in parts.groupBy("place").agg(F.sum("v").alias("v")).collect():  # as many as the model has parameters
        flat[r.place] = r.v
    start, move = flat[:STATES] + 0.1, flat[STATES : STATES + STATES**2].reshape(STATES, STATES) + 0.1
    emit = flat[STATES + STATES**2 :].reshape(STATES, size)
    emit = emit + 0.5 * model.emit.mean(axis=0) + 1e-9
    return Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


def _lexicon(known: DataFrame) -> Lexicon:
    """From (word, n): the head by a threshold on n, found in a histogram, and figures by form."""
    words = known.where(F.col("word") != F.lit(bytearray(END)))
    train, types, ends = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == F.lit(bytearray(END)), F.col("n"))), F.lit(0))).first()
    short = words.where(F.octet_length("word") <= HEAD_WORD)
    level = F.floor(F.log2("n") * 16)
    total, least = 0, None
    for r in short.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # at most 16 * 63 levels
        total += r["count"]
        if total > HEAD:
            break
        least = r.level
    head = [] if least is None else [(bytes(r.word), r.n) for r in short.where(level >= least).collect()]  # at most HEAD rows
    head.sort(key=lambda x: (-x[1], x[0]))
    lexicon = Lexicon(train, types, head)
    first = words.sparkSession.sparkContext.broadcast(lexicon)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {w for w, i in first.value.number.items() if 1 <= i <= first.value.own}
        mass, once, seen = np.zeros(FORMS), np.zeros(FORMS), np.zeros(257)
        for batch in batches:
            listed, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            data, starts, size = laid_out(listed)
            seen[:256] += np.bincount(data, minlength=256)
            seen[256] += len(listed)
            rest = np.array([w not in own for w in listed], bool)
            f = forms_of(data, starts, size)
            mass += np.bincount(f[rest], n[rest], FORMS)
            once += np.bincount(f[rest], n[rest] == 1, FORMS)
        flat = np.concatenate([mass, once, seen])
        some = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(flat[some])], ["place", "v"])

    def summed_up(run, size: int) -> np.ndarray:
        flat = np.zeros(size)
        for r in words.mapInArrow(run, "place int, v double").groupBy("place").agg(F.sum("v").alias("v")).collect():  # at most ``size`` rows
            flat[r.place] = r.v
        return flat

    flat = summed_up(summed, 2 * FORMS + 257)
    spelling = Spelling(flat[2 * FORMS : 2 * FORMS + 256], flat[-1])

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FORMS)
        for batch in batches:
            data, starts, size = laid_out(batch.column(0).to_pylist())
            total += np.bincount(forms_of(data, starts, size), 10.0 ** spelling.of(data, starts), FORMS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FORMS), pa.int32()), pa.array(total)], ["place", "v"])

    lexicon.learn(ends, flat[:FORMS], flat[FORMS : 2 * FORMS], spelling, summed_up(spelled, FORMS))
    return lexicon


def score(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with held_out, n_tokens, n_known, train_tokens, base_score and score.

    A null text counts as empty and is one end. A null doc_id is learned from. Repeated rows
    count as often as they stand there. Without training texts all tokens are unknown and the
    model has its first parameters. Columns named like a new one are replaced. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    names = [c for c in (docs.columns if keep is None else keep)]
    texts = docs.select(F.struct(*[col(c) for c in names], F.lit(1).alias("_")).alias("row"), held_out(col(doc_id)).alias("held"), col(text).cast("string").alias("text"))
    counts = save(texts.where("not held").select("text").mapInArrow(_counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    release(spark)
    lexicon = _lexicon(counts)
    lost = math.log10(lexicon.train + lexicon.types + 1)
    held = spark.sparkContext.broadcast(lexicon)

    row = texts.schema["row"].dataType
    kinds = (T.LongType(), T.BinaryType(), T.IntegerType(), T.DoubleType(), T.DoubleType(), T.LongType(), row, T.BooleanType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.BinaryType(), T.BinaryType())
    schema = T.StructType([T.StructField(n, t) for n, t in zip(NAMES, kinds, strict=True)])
    parts = save(texts.mapInArrow(_coding(held, _arrow_type(row)), schema))
    coded = parts.where("word is null")

    words = parts.where("word is not null").select("bucket", "number", "word", "known", "unknown")
    met = words.join(counts, "word", "left").select("bucket", "number", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") > 0, F.log10("n") + F.col("known")).otherwise(F.col("unknown")).alias("v"))

    def resolved(docs: pa.Table, own: pa.Table) -> pa.Table:
        number = own.column("number").to_numpy()
        n, v = np.zeros(len(number), np.int64), np.zeros(len(number))
        n[number], v[number] = own.column("n").to_numpy(), own.column("v").to_numpy()
        base = np.log10(n + 1.0)
        ids = [np.frombuffer(x, "<u4") for x in docs.column("tail").to_pylist()]
        out = [docs.column("place").combine_chunks(), pa.array([int((n[x] > 0).sum()) for x in ids], pa.int64()), pa.array([float(base[x].sum()) for x in ids]), pa.array([float(v[x].sum()) for x in ids])]
        return pa.table(out, names=["place", "k", "b", "v"])

    rare = coded.where(F.octet_length("tail") > 0).select(F.col("bucket").alias("run"), "place", "tail")
    rest = save(rare.groupBy("run").cogroup(met.groupBy("bucket")).applyInArrow(resolved, "place long, k long, b double, v double"))
    release(spark)

    model = Hmm.first((lexicon.mass + 1) / (lexicon.mass + 1).sum())
    for _ in range(PASSES if lexicon.train else 0):
        model = _trained(coded.select("held", "classes"), model)
    final = spark.sparkContext.broadcast(model)

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = final.value.score(_classes_of(batch.column(3), final.value)) + batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s)], ["place", "rest", "score"])

    ready = coded.select("place", F.struct("row", "held", "n_tokens", "n_known", "base").alias("rest"), "within", "classes")
    scored = ready.mapInArrow(likelihood, T.StructType([*ready.schema.fields[:2], T.StructField("score", T.DoubleType())]))
    done = scored.join(rest, "place", "left").select("rest.*", "score", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("k", "b", "v")])
    new = {
        "held_out": F.col("held"), "n_tokens": F.col("n_tokens"), "n_known": F.col("n_known") + F.col("k"), "train_tokens": F.lit(int(lexicon.train)).cast("long"),
        "base_score": F.col("base") + F.col("b") - F.col("n_tokens") * F.lit(lost), "score": F.col("score") + F.col("v"),
    }
    return done.select(*[F.col("row").getField(c).alias(c) for c in names if c not in new], *[e.alias(c) for c, e in new.items()])


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def op10_lm(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
