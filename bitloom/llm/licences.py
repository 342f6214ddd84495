"""Licence scan: canonical digests, hash-joined to known licences, in DataFrame functions only.

A text is brought to canonical form: lower case, curly quotes and dashes made plain, lines with
a copyright claim taken out, punctuation and blanks folded to single blanks, equivalent
spellings made one. The digest of the entire form meets the digests of the known texts in a
broadcast hash join. Each line of a document is a text of its own too, so notices such as
"Released under the MIT License." are found inside other text.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col

#: Equivalent spellings, as whole words of the canonical form (fixed values).
SPELLINGS = {
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "licencing": "licensing",
    "sublicence": "sublicense",
    "acknowledgement": "acknowledgment",
    "favour": "favor",
    "honour": "honor",
    "organisation": "organization",
    "recognise": "recognize",
    "whilst": "while",
    "v2": "version 2",
    "v3": "version 3",
    "gpl": "gnu general public license",
    "https": "http",
}
#: Characters replaced one for one before anything else: curly quotes and dashes.
CURLY, PLAIN = "‘’“”‐‑–—", "''\"\"----"
#: Entire licence texts, one file for each identifier.
TEXTS = Path(__file__).parent / "texts"
#: Known notices (fixed values): identifier and text.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Known texts up to this size are broadcast; a larger table is joined by shuffle.
BROADCAST_BYTES = 16 << 20


def canonical(text: Column) -> Column:
    """The canonical form; null stays null. Only ASCII letters change their case."""
    plain = F.translate(text, CURLY + "ABCDEFGHIJKLMNOPQRSTUVWXYZ", PLAIN + "abcdefghijklmnopqrstuvwxyz")
    claims = F.regexp_replace(plain, r"(^|\n)[ \t]*(copyright|\(c\)|©|all rights reserved)[^\n]*", "$1")
    words = F.concat(F.lit(" "), F.regexp_replace(claims, "[\x00-/:-`{-\\x7f]+", "  "), F.lit(" "))
    for old, new in SPELLINGS.items():
        words = F.replace(words, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(F.regexp_replace(words, " +", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def notices(spark) -> DataFrame:
    return spark.createDataFrame(NOTICES, "license string, text string")


def known_texts(spark) -> DataFrame:
    """The notices and the entire licence texts. The MIT text counts with and without its title."""
    texts = [(p.stem, p.read_text(encoding="utf-8")) for p in sorted(TEXTS.glob("*.txt"))]
    titled = [(i, f"{title}\n{t}") for i, t in texts for title in ("MIT License", "The MIT License", "The MIT License (MIT)") if i == "MIT"]
    return spark.createDataFrame(NOTICES + texts + titled, "license string, text string")


def scan(docs: DataFrame, known: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with text_digest, license (of the entire text, else null) and notices (sorted
    identifiers of lines that are entire known texts, joined by commas; else empty).

    ``known`` has columns license and text. A null text counts as empty; a known text that is
    null, or empty in canonical form, matches nothing, and with several identifiers for one form
    the least counts. Repeated rows repeat, an empty table stays empty, and columns named like
    a new one are replaced.
    """
    names = list(docs.columns) if keep is None else keep
    table = known.where(canonical(F.col("text")) != "").groupBy(digest(F.col("text")).alias("d")).agg(F.min("license").alias("l"))
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    table = F.broadcast(table) if size <= BROADCAST_BYTES else table
    content = F.coalesce(col(text).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[col(c) for c in names]).alias("row"), F.md5(content).alias("node"), digest(content).alias("text_digest"))
    lines = docs.select(F.md5(content).alias("node"), F.explode(F.split(content, "\n")).alias("line")).where(F.col("line").rlike("[A-Za-z]"))
    found = lines.select("node", digest(F.col("line")).alias("d")).join(table, "d").groupBy("node").agg(F.array_join(F.array_sort(F.collect_set("l")), ",").alias("found"))
    joined = rows.join(table, F.col("text_digest") == F.col("d"), "left").join(found, "node", "left")
    new = {"text_digest": F.col("text_digest"), "license": F.col("l"), "notices": F.coalesce("found", F.lit(""))}
    return joined.select(*[F.col("row").getField(c).alias(c) for c in names if c not in new], *[e.alias(c) for c, e in new.items()])


def op1_licences(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), known_texts(spark), keep=["doc_id"])


def _sql_canonical(text: str) -> str:
    quoted = (CURLY + "ABCDEFGHIJKLMNOPQRSTUVWXYZ").replace("'", "''"), (PLAIN + "abcdefghijklmnopqrstuvwxyz").replace("'", "''")
    form = f"translate({text}, '{quoted[0]}', '{quoted[1]}')"
    form = rf"regexp_replace({form}, '(^|\n)[ \t]*(copyright|\(c\)|©|all rights reserved)[^\n]*', '\1', 'g')"
    form = rf"' ' || regexp_replace({form}, '[\x00-/:-`{{-\x7f]+', '  ', 'g') || ' '"
    for old, new in SPELLINGS.items():
        form = f"replace({form}, ' {old} ', ' {new} ')"
    return f"trim(regexp_replace({form}, ' +', ' ', 'g'))"


_VALUES = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in NOTICES)
OP1_SQL = f"""
WITH known AS (
  SELECT sha256({_sql_canonical("t")}) AS d, min(l) AS license FROM (VALUES {_VALUES}) AS v(l, t) GROUP BY 1
), lines AS (
  SELECT DISTINCT md5(coalesce(text, '')) AS node, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents
), found AS (
  SELECT node, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
  FROM lines JOIN known ON sha256({_sql_canonical("line")}) = d WHERE regexp_matches(line, '[A-Za-z]') GROUP BY node
), forms AS (
  SELECT doc_id, md5(coalesce(text, '')) AS node, sha256({_sql_canonical("coalesce(text, '')")}) AS text_digest FROM documents
)
SELECT doc_id, text_digest, license, coalesce(notices, '') AS notices
FROM forms LEFT JOIN known ON text_digest = d LEFT JOIN found USING (node)
"""
