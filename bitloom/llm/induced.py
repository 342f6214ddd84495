"""Suffix order by induced sorting, with queues that can lie on disk.

Symbols are non-negative integers; the last one must be the only 0. A suffix is of type S if
it is smaller than the one after it, else L; a leftmost S suffix (LMS) follows an L. Sorting
the LMS substrings by induction names them; if names repeat, the string of names is sorted by
recursion; from the order of the LMS suffixes a second induction gives the order of all.

Induction runs over the symbols in order. Each symbol has a queue of suffixes that start with
it; taking a queue in numpy, the suffixes one place earlier go behind the queues of *their*
first symbols, and those that start with the same symbol make the queue's next round. So the
queues are drained in the order of a priority queue, and every entry is moved once. Queues of
more than ``memory`` bytes lie in an unnamed temporary file that vanishes with the process.
A string of names that fits in memory (BASE) ends the recursion; of a longer one, names above
LIMIT are written as two symbols, which keeps the number of queues small at every level.
"""

from __future__ import annotations

import tempfile

import numpy as np

LIMIT = 256
#: Names that are sorted in memory; more of them recur.
BASE = (1 << 21) - 2
MEMORY = 256 << 20


class Queues:
    """First-in first-out queues of suffix numbers, one for each symbol, of known sizes: they lie
    end to end in one array, on disk if it would exceed ``memory`` bytes."""

    def __init__(self, sizes: np.ndarray, memory: int = MEMORY):
        self.first = np.cumsum(sizes) - sizes
        self.next = self.first.copy()
        total = int(sizes.sum())
        if total * 4 > memory:
            self.items = np.memmap(tempfile.TemporaryFile(), np.int32, "w+", shape=total)
        else:
            self.items = np.empty(total, np.int32)

    def push(self, symbols: np.ndarray, items: np.ndarray) -> None:
        """Append each item to its symbol's queue, in the given order."""
        if not len(items):
            return
        order = np.argsort(symbols, kind="stable")
        symbols = symbols[order].astype(np.int64)
        new = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
        begin = np.concatenate(([0], new))
        size = np.concatenate((new, [len(items)])) - begin
        own = symbols[begin]
        place = np.arange(len(items)) + np.repeat(self.next[own] - begin, size)
        self.items[place] = items[order]
        self.next[own] += size

    def all(self, symbol: int) -> np.ndarray:
        return np.asarray(self.items[self.first[symbol] : self.next[symbol]])


def _small(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is of type S."""
    step = np.sign(np.diff(text.astype(np.int64), append=-1))
    known = np.where(step != 0, np.arange(len(text)), len(text) - 1)
    nearest = np.minimum.accumulate(known[::-1])[::-1]
    small = step[nearest] > 0
    small[-1] = True
    return small


def _induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray, symbols: int, memory: int) -> np.ndarray:
    """The suffix order that follows from the LMS suffixes' order."""
    keys = text.astype(np.uint16) if symbols <= 1 << 16 else text
    count = np.bincount(text, minlength=symbols)
    n_small = np.bincount(text, small, symbols).astype(np.int64)
    seeds = Queues(np.bincount(text[lms], minlength=symbols), memory)
    seeds.push(keys[lms], lms)
    large = Queues(count - n_small, memory)

    def earlier(items: np.ndarray, want_small: bool) -> np.ndarray:
        p = items[items > 0] - 1
        return p[small[p] == want_small]

    def drain(queues: Queues, c: int, want_small: bool) -> None:
        """Take the queue of c round by round; each round may put more of c behind itself."""
        done = queues.first[c]
        while done < queues.next[c]:
            now = np.asarray(queues.items[done : queues.next[c]])
            done = queues.next[c]
            p = earlier(now, want_small)
            queues.push(keys[p], p)

    for c in np.flatnonzero(count).tolist():
        drain(large, c, False)
        p = earlier(seeds.all(c), False)
        large.push(keys[p], p)
    back = Queues(n_small, memory)
    parts: list[np.ndarray] = []
    back.push(keys[-1:], np.array([len(text) - 1]))
    for c in np.flatnonzero(count).tolist()[::-1]:
        if c:
            drain(back, c, True)
        p = earlier(large.all(c)[::-1], True)
        back.push(keys[p], p)
    for c in np.flatnonzero(count).tolist():
        parts += [large.all(c), back.all(c)[::-1]]
    return np.concatenate(parts)


def suffix_order(text: np.ndarray, symbols: int, memory: int = MEMORY, depth: int = 1 << 40) -> np.ndarray:
    """Positions of all suffixes of ``text`` in order. The last symbol is the only 0. Suffixes
    that share their first ``depth`` symbols may come in any order."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    small = _small(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) > 1:
        order = _induce(text, small, lms, symbols, memory)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        ranked = order[is_lms[order]]
        name_of, names = _names(text, lms, ranked, n)
        if names < len(lms):
            lms = lms[_reduced_order(name_of, names, memory, depth)]
        else:
            lms = ranked
    return _induce(text, small, lms, symbols, memory)


def _names(text: np.ndarray, lms: np.ndarray, ranked: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings in text order, from their sorted order."""
    end = np.append(lms[1:], n - 1)
    place = np.empty(n, np.int64)
    place[lms] = np.arange(len(lms))
    size = (end - lms + 1)[place[ranked]]
    same = np.append(False, size[1:] == size[:-1])
    at = np.flatnonzero(same)
    k = 0
    while len(at):
        at = at[k < size[at]]
        if not len(at):
            break
        on = text[ranked[at] + k] == text[ranked[at - 1] + k]
        same[at[~on]] = False
        at = at[on]
        k += 1
    name = np.cumsum(~same) - 1
    out = np.empty(len(lms), np.int64)
    out[place[ranked]] = name
    return out, int(name[-1]) + 1


def _reduced_order(name: np.ndarray, names: int, memory: int, depth: int) -> np.ndarray:
    """Order of the suffixes of the string of names (the last name, of the sentinel, is 0)."""
    if len(name) <= BASE:
        return _doubled(name, depth)
    if names <= LIMIT:
        return suffix_order(name, names, memory, depth)
    base = int(names**0.5) + 1
    pair = np.empty(2 * len(name), np.int64)
    pair[0::2], pair[1::2] = name // base + 1, name % base + 1
    order = suffix_order(np.append(pair[:-2], 0), base + 2, memory, 2 * depth)
    return order[order % 2 == 0] // 2


def _doubled(name: np.ndarray, depth: int) -> np.ndarray:
    """The base of the recursion, in memory: ranks of ever longer prefixes, each the pair of two
    shorter ones, sorted as single integers with their place. Prefixes of ``depth`` are enough."""
    n, rank, reach = len(name), name, 1
    place = np.arange(n, dtype=np.uint64)
    while True:
        after = np.zeros(n, np.uint64)
        if reach < n:
            after[:-reach] = rank[reach:] + 1
        key = np.sort((rank.astype(np.uint64) << np.uint64(43)) | (after << np.uint64(21)) | place)
        order = (key & np.uint64((1 << 21) - 1)).astype(np.int64)
        key >>= np.uint64(21)
        rank = np.empty(n, np.int64)
        rank[order] = np.append(0, np.cumsum(key[1:] != key[:-1]))
        reach *= 2
        if reach >= min(depth, n) or rank[order[-1]] == n - 1:
            return order
