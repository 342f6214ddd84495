"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule rejects texts whose rate of something exceeds a cutoff. Cutoffs are chosen for each
stratum (language) from labelled texts: of a fixed grid, the lowest cutoff whose false rejection
rate is certified to be at most LIMIT / number of rules. Certified means: were the rate that
large, as few rejected good texts as seen would have at most the probability RISK divided by all
tests made (strata x rules x cutoffs, Bonferroni), by the exact binomial distribution. So with
probability 1 - RISK, in no stratum more than LIMIT of the good texts are rejected by these rules.
A stratum without enough labels rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, save

LIMIT, RISK = 0.05, 0.05
#: Cutoffs in percent.
GRID = [1, 2, 3, 5, 8, 10, 15, 20, 30, 40, 50, 60, 70, 80, 90]
#: What is counted, and what it is counted against.
RULES = [("n_symbols", "word_chars"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"), ("n_capitals", "word_chars"), ("n_exclamations", "n_words")]
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED = 50, 50
#: Strata that may be broadcast with their cutoffs.
STRATA = 100_000


def _others(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def counts(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Base counts of whole texts. A null text has no words and no lines."""
    content = F.coalesce(col(text).cast("string"), F.lit(""))
    rows = docs.select(*[col(c) for c in keep], content.alias("_t"))
    bare = F.btrim("_t", F.lit(BLANKS))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t-\r]+"))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    rows = rows.withColumns({"_w": words, "_l": lines})
    start = F.sequence(F.lit(0), F.size("_w") - 3)
    window = F.transform(start, lambda i: F.struct(F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("p")))
    measured = rows.select(
        *[col(c) for c in keep], F.size("_w").cast("long").alias("n_words"), _others(F.col("_t"), BLANKS).cast("long").alias("word_chars"),
        (F.length("_t") - _others(F.col("_t"), SYMBOLS)).cast("long").alias("n_symbols"), F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        (F.length("_t") - _others(F.col("_t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long").alias("n_capitals"),
        (F.length("_t") - _others(F.col("_t"), "!")).cast("long").alias("n_exclamations"),
        F.when(F.size("_w") >= 3, F.sort_array(window)).alias("_s"),
    )
    equal = F.filter("_s", lambda x, j: ((j > 0) & (F.get("_s", j - 1)["h"] == x["h"])) | F.coalesce(F.get("_s", j + 1)["h"] == x["h"], F.lit(False)))
    placed = measured.withColumn("_p", F.sort_array(F.transform(equal, lambda x: x["p"]))).drop("_s")
    covered = F.aggregate("_p", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")))
    return placed.withColumn("n_repeat_words", F.coalesce(covered["n"], F.lit(0)).cast("long")).drop("_p")


def _above(rule: tuple[str, str], cutoff: Column | int) -> Column:
    return 100 * F.col(rule[0]) > F.col(rule[1]) * cutoff


def tail(n: Column, k: Column, rate: float) -> Column:
    """P(Binomial(n, rate) <= k), summed in logarithms; 1 where k is at or above the mean."""
    odds = F.lit(rate / (1 - rate))
    first = n * F.log1p(F.lit(-rate))

    def step(acc: Column, j: Column) -> Column:
        term = acc["term"] + F.log((n - j + 1) / j * odds)
        high = F.greatest(acc["all"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(F.least(acc["all"], term) - high))).alias("all"))

    more = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    total = F.aggregate(more, F.struct(first.alias("term"), first.alias("all")), step)["all"]
    return F.when(k >= n * rate, F.lit(1.0)).otherwise(F.exp(total))


def cutoffs(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """(stratum, cut): the certified cutoffs of each stratum in percent, null for none."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1 and doc_id is not null").select("doc_id")
    seen = measured.join(good, "doc_id", "left_semi")
    hits = [F.sum(F.when(_above(r, c), 1).otherwise(0)).alias(f"k{i}_{c}") for i, r in enumerate(RULES) for c in GRID]
    table = save(seen.groupBy("stratum").agg(F.count("*").alias("n"), *hits))
    tests = F.lit(len(RULES) * len(GRID)) * F.lit(table.count())
    rate = LIMIT / len(RULES)
    best = []
    for i in range(len(RULES)):
        held = F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"k{i}_{c}").cast("long").alias("k")) for c in GRID])
        sure = F.filter(held, lambda x: tail(F.col("n"), x["k"], rate) * tests <= RISK)
        best.append(F.array_min(F.transform(sure, lambda x: x["c"])))
    return table.select("stratum", F.array(*best).alias("cut"))


def judge(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", stratum: str = "lang") -> DataFrame:
    """One row for each row of ``docs``: doc_id, base counts, base_failed and kept.

    Null and empty texts have no words and fail the base rule. A null stratum is a stratum. Of a
    repeated label the least counts; labels of null or unknown documents say nothing, and
    repeated rows of a labelled text count as often as they stand there.
    """
    renamed = docs.select(col(doc_id).alias("doc_id"), F.coalesce(col(stratum).cast("string"), F.lit("")).alias("stratum"), col(text).cast("string").alias("text"))
    measured = save(counts(renamed, "text", ["doc_id", "stratum"]))
    chosen = save(cutoffs(measured, labels))
    chosen = F.broadcast(chosen) if chosen.count() <= STRATA else chosen
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    rejected = F.lit(False)
    for i, r in enumerate(RULES):
        rejected = rejected | F.coalesce(_above(r, F.get("cut", F.lit(i))), F.lit(False))
    judged = measured.join(chosen, "stratum", "left")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~rejected).alias("kept"))


def op7_rules(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_W = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '')"
_HITS = ",\n         ".join(f"(SELECT count(*) FROM good g WHERE g.stratum = s.stratum AND 100 * g.{a} > g.{b} * c) AS k{i}" for i, (a, b) in enumerate(RULES))
OP7_SQL = rf"""
WITH split AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t, {_W} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS l
  FROM documents
), windows AS (
  SELECT rid, generate_subscripts(w, 1) AS p, unnest(w) AS a, unnest(w[2:] || [NULL]) AS b, unnest(w[3:] || [NULL, NULL]) AS c FROM split WHERE len(w) >= 3
), twice AS (
  SELECT rid, p, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM windows WHERE c IS NOT NULL
), repeated AS (
  SELECT rid, count(DISTINCT p + d) AS n FROM twice, (VALUES (0), (1), (2)) AS v(d) WHERE n > 1 GROUP BY rid
), measured AS (
  SELECT doc_id, stratum, len(w) AS n_words, length(regexp_replace(t, '[ \t-\r]', '', 'g')) AS word_chars,
         length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals, length(t) - length(replace(t, '!', '')) AS n_exclamations,
         coalesce(repeated.n, 0) AS n_repeat_words
  FROM split LEFT JOIN repeated USING (rid)
), good AS (
  SELECT measured.* FROM measured JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1) USING (doc_id)
), strata AS (
  SELECT stratum, count(*) AS n FROM good GROUP BY stratum
), tested AS (
  SELECT s.stratum, s.n, c, {_HITS}
  FROM strata s, (VALUES {", ".join(f"({c})" for c in GRID)}) AS v(c)
), flat AS (
  {" UNION ALL ".join(f"SELECT stratum, n, c, {i} AS rule, k{i} AS k FROM tested" for i in range(len(RULES)))}
), chances AS (
  SELECT stratum, rule, c, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({LIMIT / len(RULES)}) + (n - j) * ln(1 - {LIMIT / len(RULES)}))) AS p
  FROM (SELECT *, unnest(range(0, k + 1)) AS j FROM flat WHERE k < n * {LIMIT / len(RULES)}) GROUP BY stratum, rule, c
), cuts AS (
  SELECT stratum, rule, min(c) AS c FROM chances WHERE p * {len(RULES) * len(GRID)} * (SELECT count(*) FROM strata) <= {RISK} GROUP BY stratum, rule
), cut AS (
  SELECT stratum, {", ".join(f"max(c) FILTER (rule = {i}) AS c{i}" for i in range(len(RULES)))} FROM cuts GROUP BY stratum
), judged AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
         {" OR ".join(f"coalesce(100 * {a} > {b} * c{i}, false)" for i, (a, b) in enumerate(RULES))} AS rejected
  FROM measured LEFT JOIN cut USING (stratum)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM judged
"""
