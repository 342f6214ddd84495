"""URL filter: all glob rules at once in a bit-parallel wildcard automaton.

A glob has literal bytes, ? (any byte) and * (any run of bytes), and is matched against a whole
canonical URL: the host in lower case, one byte that occurs in no UTF-8 text, and the path. Each
glob takes one bit for each of its states, all globs lie end to end in words of 64 bits, and a
byte of the URL moves every state at once (Shift-And, with bits that stay where a * stands).
The URLs of a batch are numpy lanes.

A rule (host, path) is two globs: the host itself, and any host that ends with a dot and it. Of
the rules that fit, the longest decides; where none fits, the globs of the block list do.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

#: Verdict and rule (fixed values of the contract).
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Globs over host and path that block a URL no rule speaks of (fixed values).
BLOCKED = ["*spam*", "*casino*", "*adult*", "*xxx*", "*phish*", "*malware*", "*tracker*", "*click-farm*", "*/ads/*", "*/login*", "*/wp-admin*", "*.exe", "*.zip", "*.apk"]
SEAM = b"\xff"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def split(url: bytes) -> tuple[bytes, bytes]:
    """(host, path): host after the first :// up to / ? # or the end, path up to ? # or the end."""
    _, found, rest = url.partition(b"://")
    if not found:
        return b"", b""
    end = min((i for i in (rest.find(b"/"), rest.find(b"?"), rest.find(b"#")) if i >= 0), default=len(rest))
    path = rest[end:]
    stop = min((i for i in (path.find(b"?"), path.find(b"#")) if i >= 0), default=len(path))
    return rest[:end].translate(LOWER), path[:stop]


class Globs:
    """The automaton of a list of globs (bytes)."""

    def __init__(self, globs: list[bytes]):
        states = [len(g.replace(b"*", b"")) + 1 for g in globs]
        first = np.cumsum([0] + states)
        self.words = max(1, -(-int(first[-1]) // 64))
        bits = self.words * 64
        moves, stay, start = np.zeros((256, bits), bool), np.zeros(bits, bool), np.zeros(bits, bool)
        self.ends = first[1:] - 1
        for g, at in zip(globs, first.tolist(), strict=False):
            start[at] = True
            for c in g:
                if c == 42:
                    stay[at] = True
                else:
                    at += 1
                    moves[:, at] |= True if c == 63 else np.arange(256) == c
        self.moves, self.stay, self.start = self._packed(moves), self._packed(stay), self._packed(start)

    @staticmethod
    def _packed(bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits, axis=-1, bitorder="little").view("<u8")

    def match(self, urls: list[bytes]) -> np.ndarray:
        """Which glob matches which URL, as a boolean matrix."""
        size = np.array([len(u) for u in urls])
        order = np.argsort(-size, kind="stable")
        flat = np.frombuffer(b"".join(urls) or b"\0", np.uint8)
        first = (np.cumsum(size) - size)[order]
        alive = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), "left")
        state = np.repeat(self.start[None, :], len(urls), axis=0)
        for t, n in enumerate(alive.tolist()):
            s = state[:n]
            up = s << np.uint64(1)
            up[:, 1:] |= s[:, :-1] >> np.uint64(63)
            state[:n] = (up & self.moves[flat[first[:n] + t]]) | (s & self.stay)
        out = np.zeros((len(urls), len(self.ends)), bool)
        out[order] = (state[:, self.ends // 64] >> (self.ends % 64).astype(np.uint64)) & np.uint64(1) == 1
        return out


def judge(pages: DataFrame, *, url: str = "url", keep: list[str] | None = None, rules: list[tuple[str, str]] | None = None, blocked: list[str] | None = None) -> DataFrame:
    """``pages`` with host, path, rule (else null) and verdict (allow or block).

    A null URL, or one without ://, has an empty host and path, which no rule fits. Of equally
    long rules the first given decides. Repeated rows repeat, an empty table stays empty.
    """
    rules = RULES if rules is None else rules
    blocked = BLOCKED if blocked is None else blocked
    order = sorted(rules, key=lambda r: -len(r[1]))

    def make():
        globs: list[bytes] = []
        for _, rule in order:
            host, _, path = rule.encode().partition(b"/")
            tail = SEAM + b"/" + path + b"*"
            globs += [host + tail, b"*." + host + tail]
        # The seam may lie anywhere in a block list's glob, so it is matched over the joined text.
        own, other = Globs(globs), Globs([g.encode() for g in blocked])

        def work(urls: list[bytes]) -> list:
            parts = [split(u) for u in urls]
            fits = own.match([h + SEAM + p for h, p in parts]).reshape(len(urls), len(order), 2).any(axis=2)
            bad = other.match([h + p for h, p in parts]).any(axis=1)
            which = np.where(fits.any(axis=1), fits.argmax(axis=1), -1).tolist()
            rule = [order[k][1] if k >= 0 else None for k in which]
            verdict = [order[k][0] if k >= 0 else "block" if b else "allow" for k, b in zip(which, bad.tolist(), strict=True)]
            text = lambda b: b.decode("utf-8", "replace")
            return [[text(h) for h, _ in parts], [text(p) for _, p in parts], rule, verdict]

        return work

    return map_texts(pages, url, "host string, path string, rule string, verdict string", make, keep)


def op9_urls(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), keep=["page_id"])


def _fits(rule: str) -> str:
    host, _, path = rule.partition("/")
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}'))"


_LONGEST = sorted(RULES, key=lambda r: -len(r[1]))
OP9_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path
  FROM cut
), ruled AS (
  SELECT *, CASE {" ".join(f"WHEN {_fits(r)} THEN '{r}'" for _, r in _LONGEST)} END AS rule FROM parts
)
SELECT page_id, host, path, rule,
       CASE {" ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in _LONGEST)}
            WHEN {" OR ".join(f"host || path LIKE '{g.replace('*', '%')}'" for g in BLOCKED)} THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
