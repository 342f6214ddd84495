"""BPE encoding and decoding by dynamic programming over prefixes.

Each prefix of a word has exactly one BPE encoding, so it is enough to keep the last token of
it. A token that ends at position i is that token if the pair (last token of the prefix before
it, this token) is *compatible*: encoding the two tokens' text gives the two tokens again.
Candidates come from the automaton of all vocabulary suffixes (the longest token that ends
here, then ever shorter ones); compatibility is decided by splitting the two tokens back along
the merges that made them, later merge first, until a merge across the seam would have come
earlier. Back-pointers from the end give the ids. No merge loop runs over the text.

All words of a batch move in step as numpy lanes; a word seen before costs a dictionary look-up.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

END = "</w>"
#: White space as Unicode has it (fixed values).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The vocabulary file's own contractions (fixed values).
SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
#: Words that a Python worker keeps the encoding of (about 350 bytes each).
CACHE_WORDS = 100_000
LANE_CELLS = 1 << 21


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Table:
    """An int64 -> int32 hash table whose look-ups are numpy operations; absent: -1."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 6).bit_length())
        self.move = np.uint64(64 - bits)
        self.keys = np.full((1 << bits) + 64, -1, np.int64)
        self.values = np.full((1 << bits) + 64, -1, np.int32)
        at = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] == -1
            self.keys[at[todo[free]]] = keys[todo[free]]  # of two for one place, the last stays
            won = self.keys[at[todo]] == keys[todo]
            self.values[at[todo[won]]] = values[todo[won]]
            todo = todo[~won]
            at[todo] += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.move).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        todo = np.flatnonzero((found != keys) & (found != -1))
        while len(todo):
            at[todo] += 1
            found = self.keys[at[todo]]
            out[todo] = np.where(found == keys[todo], self.values[at[todo]], -1)
            todo = todo[(found != keys[todo]) & (found != -1)]
        return out


class Vocabulary:
    """Tables of a byte-level BPE vocabulary with word ends, read from a tokenizers JSON file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with matching options are not supported")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        chars = byte_chars()
        base = chars + [c + END for c in chars]
        own = {t: i for i, t in enumerate(base)}
        self.base = len(base)
        left, right, parts = list(range(self.base)), list(range(self.base)), [(i,) for i in range(self.base)]
        for a, b in merges:
            if a + b in own:
                raise ValueError(f"two merges make {a + b!r}")
            own[a + b] = len(left)
            left.append(own[a])
            right.append(own[b])
            parts.append(parts[own[a]] + parts[own[b]])
        self.names = list(own)
        self.left, self.right = np.array(left, np.int32), np.array(right, np.int32)
        self.length = np.array([len(p) for p in parts], np.int32)
        self.ids = np.array([vocab[t] for t in self.names], np.uint32)
        made = np.arange(self.base, len(left), dtype=np.int64)
        self.pairs = Table(self.left[made].astype(np.int64) << 20 | self.right[made], made.astype(np.int32))
        self._automaton(parts)

    def _automaton(self, parts: list[tuple[int, ...]]) -> None:
        """States are prefixes of tokens. A token that its own text doesn't encode to is left out."""
        rank = {(int(self.left[t]), int(self.right[t])): t for t in range(self.base, len(parts))}

        def reached(t: int) -> bool:
            seq = list(parts[t])
            while len(seq) > 1:
                best, k = min((rank.get((a, b), 1 << 30), i) for i, (a, b) in enumerate(zip(seq, seq[1:], strict=False)))
                if best == 1 << 30:
                    break
                seq[k : k + 2] = [best]
            return seq == [t]

        child: dict[tuple[int, int], int] = {}
        above, token = [0], [-1]
        for t, seq in enumerate(parts):
            if t >= self.base and not reached(t):
                continue
            s = 0
            for c in seq:
                n = child.get((s, c))
                if n is None:
                    n = child[s, c] = len(token)
                    above.append(s)
                    token.append(-1)
                s = n
            token[s] = t
        depth = [0] * len(token)
        into = [0] * len(token)
        for (s, c), n in child.items():
            into[n] = c
        fail, longest = [0] * len(token), [-1] * len(token)
        for n in range(1, len(token)):
            depth[n] = depth[above[n]] + 1
        for n in sorted(range(1, len(token)), key=depth.__getitem__):
            s = above[n]
            while s:
                s = fail[s]
                if (s, into[n]) in child:
                    fail[n] = child[s, into[n]]
                    break
            longest[n] = token[n] if token[n] >= 0 else longest[fail[n]]
        self.fail, self.longest = np.array(fail, np.int32), np.array(longest, np.int32)
        self.shorter = np.full(len(parts), -1, np.int32)
        for n in range(1, len(token)):
            if token[n] >= 0:
                self.shorter[token[n]] = longest[fail[n]]
        self.step = Table(np.array([s << 10 | c for s, c in child], np.int64), np.array(list(child.values()), np.int32))

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE would leave each pair of tokens side by side."""
        out = np.zeros(len(a), bool)
        at, limit = np.arange(len(a)), np.full(len(a), 1 << 30, np.int64)
        a, b = a.astype(np.int64), b.astype(np.int64)
        while len(at):
            joint = self.pairs.get(a << 20 | b)
            on = (joint < 0) | (joint >= limit)
            whole = np.maximum(a, b) < self.base
            out[at[on & whole]] = True
            on &= ~whole
            at, a, b = at[on], a[on], b[on]
            first = a > b
            limit = np.where(first, a, b + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return out

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """Internal token numbers of each word (not empty)."""
        size = np.array([len(w) for w in words], np.int64)
        order = np.argsort(size, kind="stable")
        out: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and (hi + 1 - lo) * (size[order[hi]] + 1) <= LANE_CELLS:
                hi += min(4096, len(order) - hi) if (hi + 4096 - lo) * (size[order[min(hi + 4095, len(order) - 1)]] + 1) <= LANE_CELLS else 1
            for i, t in zip(order[lo:hi].tolist(), self._lanes([words[i] for i in order[lo:hi]], size[order[lo:hi]]), strict=True):
                out[i] = t
            lo = hi
        return out

    def _lanes(self, words: list[bytes], size: np.ndarray) -> list[np.ndarray]:
        n, width = len(words), int(size[-1])
        flat = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(size) - size
        last = np.zeros((width + 1, n), np.int32)
        state = np.zeros(n, np.int64)
        for i in range(1, width + 1):
            alive = np.arange(int(np.searchsorted(size, i)), n)
            symbol = flat[starts[alive] + i - 1].astype(np.int64) + 256 * (size[alive] == i)
            s = state[alive]
            to = self.step.get(s << 10 | symbol).astype(np.int64)
            todo = np.flatnonzero(to < 0)
            while len(todo):
                s[todo] = self.fail[s[todo]]
                to[todo] = self.step.get(s[todo] << 10 | symbol[todo])
                todo = todo[to[todo] < 0]
            state[alive] = to
            token = self.longest[to].copy()
            todo = np.arange(len(alive))
            while len(todo):
                begin = i - self.length[token[todo]]
                good = begin == 0
                check = np.flatnonzero(~good)
                good[check] = self.compatible(last[begin[check], alive[todo[check]]], token[todo[check]])
                todo = todo[~good]
                token[todo] = self.shorter[token[todo]]
            last[i, alive] = token
        back, at, lanes = [], size.copy(), np.arange(n)
        while len(lanes):
            t = last[at[lanes], lanes]
            back.append((lanes, t))
            at[lanes] -= self.length[t]
            lanes = lanes[at[lanes] > 0]
        lane = np.concatenate([x for x, _ in back])
        tokens = np.concatenate([t for _, t in back])
        turn = np.concatenate([np.full(len(x), -k) for k, (x, _) in enumerate(back)])
        order = np.lexsort((turn, lane))
        return np.split(tokens[order], np.cumsum(np.bincount(lane, minlength=n))[:-1])


def _classes(top: int) -> re.Pattern:
    """The splitting pattern for texts whose characters are all below ``top``."""
    kinds = {"L": [], "N": []}
    for c in range(top):
        k = unicodedata.category(chr(c))[0]
        if k in kinds:
            kinds[k].append(re.escape(chr(c)))
    letters, numbers = "".join(kinds["L"]), "".join(kinds["N"])
    return re.compile(f"{SHORT}|[{letters}]+|[{numbers}]|[^{SPACE}{letters}{numbers}]+")


class Encoder:
    """Whole texts to ids, with the encodings of words seen before at hand."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.low, self.full = _classes(0x250), regex.compile(rf"{SHORT}|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        self.beyond = re.compile("[^\x00-ɏ]")
        self.specials = re.compile("(" + "|".join(map(re.escape, vocabulary.special)) + ")") if vocabulary.special else None
        self.ids: dict[str, bytes] = {}
        self.shown: dict[str, str] = {}

    def split(self, text: str) -> list[str]:
        """Lower-cased words; a special token keeps its own spelling."""
        if self.specials and "<|" in text:
            out = []
            for k, part in enumerate(self.specials.split(text)):
                out += [part] if k % 2 else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return (self.full if self.beyond.search(text) else self.low).findall(text)

    def learn(self, words: Iterable[str]) -> None:
        if len(self.ids) > CACHE_WORDS:
            self.ids.clear()
            self.shown.clear()
        for name, i in self.v.special.items():
            self.ids[name], self.shown[name] = np.array([i], "<u4").tobytes(), name
        new = [w for w in words if w not in self.ids]
        names = self.v.names
        for w, tokens in zip(new, self.v.encode([w.encode() for w in new]) if new else (), strict=True):
            self.ids[w] = self.v.ids[tokens].astype("<u4").tobytes()
            self.shown[w] = " ".join([names[t] for t in tokens.tolist()])

    def encode(self, texts: list[bytes]) -> list[tuple[bytes, str]]:
        """(ids as little-endian 32-bit integers, decoded text) of each text."""
        split = [self.split(t.decode("utf-8", "replace")) for t in texts]
        self.learn(set().union(*split))
        ids, shown = self.ids.__getitem__, self.shown.__getitem__
        return [(b"".join(map(ids, words)), " ".join(map(shown, words))) for words in split]


_encoders: dict[str, Encoder] = {}


def _encoder(held) -> Encoder:
    """One for each vocabulary and Python worker."""
    key, vocabulary = held.value
    if key not in _encoders:
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def load(spark, path: str):
    """The vocabulary file as a broadcast; its size is fixed by the file."""
    with open(path, encoding="utf-8") as f:
        content = f.read()
    return spark.sparkContext.broadcast((hashlib.sha256(content.encode()).hexdigest(), Vocabulary(content)))


def encode(docs: DataFrame, path: str, *, text: str = "text", keep: list[str] | None = None, ids: bool = True) -> DataFrame:
    """``docs`` with n_tokens, ids (array<int>, unless ``ids`` is false), ids_sha256 and
    decoded_sha256. A null text counts as empty and has no tokens. Rows are taken one by one:
    repeated rows repeat, an empty table stays empty, and text of any length is encoded whole."""
    held = load(docs.sparkSession, path)

    def make():
        encoder = _encoder(held)

        def work(texts: list[bytes]) -> list:
            done = encoder.encode(texts)
            out = [[len(i) // 4 for i, _ in done], [hashlib.sha256(i).hexdigest() for i, _ in done], [hashlib.sha256(t.encode()).hexdigest() for _, t in done]]
            if ids:
                flat = np.frombuffer(b"".join(i for i, _ in done), "<i4")
                out.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0] + out[0]), pa.int32()), pa.array(flat)))
            return out

        return work

    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return map_texts(docs, text, fields, make, keep)


def decode(docs: DataFrame, path: str, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Token strings joined by blanks, special tokens included; null ids give null. An unknown
    id gives nothing, as in the library."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    names = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    listed = [names.get(i) for i in range(max(names) + 1)]
    held = docs.sparkSession.sparkContext.broadcast(listed)

    @F.pandas_udf("string")
    def joined(column):
        at = held.value
        return column.map(lambda a: None if a is None else " ".join([at[i] for i in a if 0 <= i < len(at) and at[i] is not None]))

    return docs.withColumn(out, joined(F.col(ids)))


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, word_bpe_path(), keep=["doc_id"], ids=False)
