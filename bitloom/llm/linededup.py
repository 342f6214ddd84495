"""Line deduplication with a log-template tree, in DataFrame functions only.

A line becomes tokens; a token with a digit is a variable field. The tree has a fixed depth:
token count, then DEPTH leading tokens, then the leaf. A leaf with several different lines has
a common form: at each place the most frequent token (of equals, the least). If more than half of
its lines agree with that form in at least SAME of the places, those share one template, whose
other places are variable. All other lines go on: their leaf is split by the token at the place of
its most frequent token that not all of them have (tokens of a single line stay together), and the
parts are treated like leaves, until no two lines of a part have a token that another line lacks.
A line that is left is a template of its own, but for its variable fields, and so is a line of
fewer than MIN_TOKENS tokens.

A template recurs if it stands in at least MIN_DOCS different texts, between mostly different
neighbours: more than half as many pairs of neighbouring lines as texts. Copies of a whole
document repeat a line between the same neighbours, so they don't make it recur; they are the
near-duplicate operator's work. All lines of a recurring template are dropped.

A template between equal neighbours (inside a repeated block, or held by a group of near copies)
recurs as well if MIN_DOCS of its texts have content of their own: more than OWN of their tokens,
as far as sampled, stand in EDGE tokens at an edge of a line that no other text with such a
template has. Near copies have less, by the measure of the near-duplicate operator: of two texts
alike to 0.8, a ninth of each is its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, save

DEPTH, SAME, MIN_DOCS, MIN_TOKENS = 4, 0.8, 5, 4
EDGE, OWN = 5, 1 / 9
#: Rows of leaves that may be broadcast: 8 bytes each, so 16 MB at most as data.
LEAVES = 2_000_000
#: Forms, and bytes of them, of a part that is split to its end as one row; larger ones are split by joins.
PART, PART_BYTES = 256, 256 << 10
#: Steps of splitting such rows in one query.
STEPS = 16


def masked(line: Column) -> Column:
    """Tokens joined by single blanks, variable fields as <*>. Most lines are so already."""
    fields = F.regexp_replace(line, r"(?<![^ \t-\r])[^ \t-\r0-9]*+[0-9][^ \t-\r]*+", "<*>")
    return F.when(line.rlike(r"[0-9\t-\r]|  |^ | $"), F.trim(F.regexp_replace(fields, r"[ \t-\r]+", " "))).otherwise(line)


def _line(form: Column) -> Column:
    """Hash, leaf, token count and, where it can share a leaf, text of a form, and the hashes of
    its first and last EDGE tokens; ``form`` must be a variable or a column."""
    n = F.when(form == "", 0).otherwise(F.octet_length(form) - F.octet_length(F.replace(form, F.lit(" "), F.lit(""))) + 1)
    ends = [F.xxhash64(F.substring_index(form, " ", k)).alias(c) for c, k in (("first", EDGE), ("last", -EDGE))]
    return F.struct(F.xxhash64(form).alias("h"), F.xxhash64(n, F.substring_index(form, " ", DEPTH)).alias("leaf"), n.alias("n"), F.when(n >= MIN_TOKENS, form).alias("form"), *ends)


def _lines(docs: DataFrame, text: str) -> DataFrame:
    """A row for each line: node (digest of its text), pos, h, leaf, n, form (as _line has it), its
    neighbours' hash and those of its edges."""
    content = F.coalesce(col(text).cast("string"), F.lit(""))
    rows = docs.select(F.unhex(F.md5(content)).alias("node"), F.transform(F.transform(F.split(content, "\n"), masked), _line).alias("ls"))

    def near(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get("ls", i - 1)["h"]).otherwise(F.lit(0))
        return F.struct(i.alias("pos"), x["h"].alias("h"), x["leaf"].alias("leaf"), x["n"].alias("n"), x["form"].alias("form"), F.xxhash64(before, F.coalesce(F.get("ls", i + 1)["h"], F.lit(0))).alias("near"), x["first"].alias("first"), x["last"].alias("last"))

    return rows.select("node", F.explode(F.transform("ls", near)).alias("l")).select("node", "l.*")


def _generalised(lines: DataFrame) -> DataFrame:
    """(h, template) of the lines that agree with the common form of their leaf, or of a part."""
    leaves = lines.where(F.col("n") >= MIN_TOKENS).groupBy("leaf").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("leaf")
    leaves = save(leaves)
    own = lines.where(F.col("n") >= MIN_TOKENS).select("form", "h", "leaf", "n")
    own = own.join(F.broadcast(leaves) if leaves.count() <= LEAVES else leaves, "leaf", "left_semi")
    own = save(own.groupBy("h", "leaf", "n").agg(F.first("form").alias("form")))
    own = own.withColumn("g", F.xxhash64(F.lit("leaf"), "leaf"))
    found = small = None
    while True:
        tokens = own.select("h", "g", "n", F.posexplode(F.split("form", " ")).alias("pos", "token"))
        counts = tokens.groupBy("g", "pos", "token").agg(F.count("*").alias("k"))
        common = counts.groupBy("g", "pos").agg(F.min(F.struct((-F.col("k")).alias("k"), "token")).alias("m")).select("g", "pos", F.col("m.token").alias("token"))
        same = tokens.join(common, ["g", "pos", "token"]).groupBy("h", "g", "n").agg(F.count("*").alias("same"))
        named = same.where(F.col("same") >= SAME * F.col("n")).select("h", F.col("g").alias("template"))
        settled = named.groupBy("template").agg(F.count("*").alias("k")).join(own.groupBy("g").agg(F.count("*").alias("size")), F.col("g") == F.col("template")).where("2 * k > size")
        named = save(named.join(settled.select("template"), "template", "left_semi").select("h", "template"))
        found = named if found is None else found.unionByName(named)
        own = _split(own.join(named, "h", "left_anti"))
        part = own.where("small").drop("small")
        small = part if small is None else small.unionByName(part)
        own = own.where("not small").drop("small")
        if own.isEmpty():
            return found.unionByName(_settled(small))


def _split(left: DataFrame) -> DataFrame:
    """The lines in smaller groups, without those that are alone, and whether their group is
    small. No group has all lines of another, so splitting ends."""
    left = save(left)
    sizes = left.groupBy("g").agg(F.count("*").alias("size")).where("size > 1")
    tokens = left.select("g", F.posexplode(F.split("form", " ")).alias("pos", "token"))
    counts = tokens.groupBy("g", "pos", "token").agg(F.count("*").alias("k")).where("k > 1").join(sizes, "g").where("k < size")
    counts = save(counts)
    place = counts.groupBy("g").agg(F.max(F.struct("k", (-F.col("pos")).alias("p"))).alias("m")).select("g", (-F.col("m.p")).alias("pos"))
    parts = counts.join(place, ["g", "pos"]).select("g", "token", F.lit(True).alias("often"))
    at = left.join(place, "g").withColumn("token", F.get(F.split("form", " "), F.col("pos")))
    parted = at.join(parts, ["g", "token"], "left").select("h", "leaf", "n", "form", F.xxhash64("g", "pos", F.when(F.col("often"), F.col("token"))).alias("g"))
    parted = save(parted)
    small = (F.count("*") <= PART) & (F.sum(F.octet_length("form")) <= PART_BYTES)
    sizes = parted.groupBy("g").agg(F.count("*").alias("size"), small.alias("small")).where("size > 1").select("g", "small")
    return save(parted.join(sizes, "g").select("h", "leaf", "n", "form", "g", "small"))


def _settled(own: DataFrame) -> DataFrame:
    """(h, template) of the lines of small groups that share a template: the same steps, with a
    group and then each of its parts as a row, so that many steps are one projection."""
    line = F.struct("h", F.split("form", " ").alias("ts"))
    groups = own.groupBy("g").agg(F.collect_list(line).alias("ls")).select("g", "ls", F.lit(False).alias("done"))
    found, step = None, _step()
    while True:
        for columns in step * STEPS:
            groups = groups.select(*columns)
        groups = save(groups)
        named = groups.where("done").select(F.explode("ls.h").alias("h"), F.col("g").alias("template"))
        found = named if found is None else found.unionByName(named)
        groups = groups.where("not done")
        if groups.isEmpty():
            return found


def _step() -> list[list]:
    """Projections that turn each group that is not done into its lines that share a template
    (done) and its parts of several lines."""

    def each_place(ls: str, f) -> Column:
        """An array of f(place, tokens of all lines there)."""
        places = F.sequence(F.lit(0), F.size(F.get(ls, F.lit(0))["ts"]) - 1)
        return F.transform(F.transform(places, lambda p: F.struct(p.alias("p"), F.transform(ls, lambda x: F.get(x["ts"], p)).alias("ts"))), lambda c: f(c["p"], c["ts"]))

    def times(ts: Column, token: Column) -> Column:
        return F.size(F.filter(ts, lambda t: t == token))

    def most(p: Column, ts: Column) -> Column:
        return F.array_min(F.transform(F.array_distinct(ts), lambda t: F.struct((-times(ts, t)).alias("k"), t.alias("token"))))["token"]

    def often(p: Column, ts: Column) -> Column:
        ks = F.transform(F.array_distinct(ts), lambda t: times(ts, t))
        return F.struct(F.array_max(F.filter(ks, lambda k: (k > 1) & (k < F.size(ts)))).alias("k"), (-p).alias("p"))

    live = ~F.col("done")
    good = F.transform("ls", lambda x: F.size(F.filter(F.zip_with(x["ts"], "common", lambda a, b: a == b), lambda y: y)) >= SAME * F.size("common"))
    settles = live & (2 * F.size(F.filter("good", lambda y: y)) > F.size("good"))
    named = F.when(F.col("done"), F.col("ls")).when(F.col("settles"), F.filter("ls", lambda x, i: F.get("good", i)))
    rest = F.when(F.col("settles"), F.filter("ls", lambda x, i: ~F.get("good", i))).when(live, F.col("ls"))
    place = F.array_max(F.filter(each_place("rest", often), lambda c: c["k"].isNotNull()))
    at = F.when(F.col("pos").isNotNull(), F.transform("rest", lambda x: F.get(x["ts"], F.col("pos"))))
    token = F.transform("at", lambda t: F.when(times(F.col("at"), t) > 1, t))
    parts = F.transform(F.array_distinct("token"), lambda t: F.struct(F.xxhash64("g", "pos", t).alias("g"), F.filter("rest", lambda x, i: F.get("token", i).eqNullSafe(t)).alias("ls"), F.lit(False).alias("done")))
    parts = F.coalesce(F.filter(parts, lambda x: F.size(x["ls"]) > 1), F.array())
    done = F.when(F.col("named").isNotNull(), F.array(F.struct("g", F.col("named").alias("ls"), F.lit(True).alias("done")))).otherwise(F.array())
    return [
        ["g", "ls", "done", F.when(live, each_place("ls", most)).alias("common")],
        ["g", "ls", "done", F.when(live, good).alias("good")],
        ["g", "ls", "done", "good", settles.alias("settles")],
        ["g", named.alias("named"), rest.alias("rest")],
        ["g", "named", "rest", (-F.when(F.size("rest") > 1, place)["p"]).alias("pos")],
        ["g", "named", "rest", "pos", at.alias("at")],
        ["g", "named", "rest", "pos", token.alias("token")],
        [F.explode(F.concat(done, parts)).alias("x")],
        ["x.*"],
    ]


def _own_content(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of ``nodes`` with content that no other of them has. Such an edge has one text, so
    its count says whose it is, and no edge meets its texts in a join."""
    held = lines.join(nodes, "node", "left_semi")
    edges = F.array(F.struct(F.col("first").alias("u"), F.least("n", F.lit(EDGE)).alias("w")), F.struct(F.col("last").alias("u"), F.least(F.greatest(F.col("n") - EDGE, F.lit(0)), F.lit(EDGE)).alias("w")))
    parts = save(held.select("node", F.xxhash64("node").alias("id"), F.explode(edges).alias("e")).select("node", "id", "e.u", "e.w").where("w > 0"))
    alone = parts.groupBy("u").agg(F.min("id").alias("id"), F.max("id").alias("hi"), F.sum("w").alias("own")).where("id = hi").groupBy("id").agg(F.sum("own").alias("own"))
    sizes = parts.groupBy("node", "id").agg(F.sum("w").alias("w"))
    return sizes.join(alone, "id").where(F.col("own") > OWN * F.col("w")).select("node")


def _recurring(lines: DataFrame, named: DataFrame) -> DataFrame:
    seen = named.groupBy("template").agg(F.count_distinct("node").alias("docs"), F.count_distinct("near").alias("places")).where(F.col("docs") >= MIN_DOCS)
    varied = 2 * F.col("places") > F.col("docs")
    seen = save(seen)
    held = save(named.join(seen.where(~varied), "template", "left_semi").select("template", "node").distinct())
    own = _own_content(lines, held.select("node").distinct())
    more = held.join(own, "node", "left_semi").groupBy("template").count().where(F.col("count") >= MIN_DOCS)
    return seen.where(varied).select("template").unionByName(more.select("template"))


def flags(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """(node, drop): for each different text with a line to drop, whether each line goes."""
    lines = save(_lines(docs, text))
    general = _generalised(lines)
    named = save(lines.join(general, "h", "left").select("node", "pos", "near", "n", F.coalesce("template", "h").alias("template")))
    recurring = _recurring(lines, named.where("n > 0")).withColumn("recurs", F.lit(True))
    judged = named.join(recurring, "template", "left").select("node", "pos", (F.coalesce("recurs", F.lit(False)) & (F.col("n") > 0)).alias("drop"))
    each = judged.groupBy("node").agg(F.array_sort(F.collect_set(F.struct("pos", "drop"))).alias("ls"))
    return each.where(F.exists("ls", lambda x: x["drop"])).select("node", F.transform("ls", lambda x: x["drop"]).alias("drop"))


def drop_lines(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the text's remaining lines, n_lines and n_dropped.

    Lines are the parts between newlines, so an empty or null text has one empty line; lines
    without tokens always stay. A null text stays null. Repeated rows are all judged alike;
    columns named like a new one are replaced. An empty table gives an empty result.
    """
    names = list(docs.columns) if keep is None else keep
    marks = flags(docs, text=text)
    content = F.coalesce(col(text).cast("string"), F.lit(""))
    row = docs.select(F.struct(*[col(c) for c in names]).alias("row"), col(text).cast("string").alias("text"), F.unhex(F.md5(content)).alias("node"))
    joined = row.join(marks, "node", "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    left = F.array_join(F.filter(lines, lambda x, i: ~F.get("drop", i)), "\n")
    new = {
        text: F.when(F.col("drop").isNull(), F.col("text")).otherwise(left),
        "n_lines": F.size(lines).cast("long"),
        "n_dropped": F.coalesce(F.size(F.filter("drop", lambda x: x)), F.lit(0)).cast("long"),
    }
    kept = [new[c].alias(c) if c == text else F.col("row").getField(c).alias(c) for c in names if c == text or c not in new]
    return joined.select(*kept, *[e.alias(c) for c, e in new.items() if c not in names or c != text])


def op4_linededup(spark, sf_dir: str) -> DataFrame:
    done = drop_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: The same in DuckDB, with the templates themselves instead of their hashes. ``{docs}`` is the
#: table to read.
LINES_SQL = r"""
lines AS (
  SELECT md5(coalesce(text, '')) AS node, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM (SELECT DISTINCT coalesce(text, '') AS text FROM {docs})
), formed AS (
  SELECT node, pos, list_transform(list_filter(regexp_split_to_array(line, '[ \t-\r]+'), lambda x: x <> ''),
         lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS ts
  FROM lines
), placed AS MATERIALIZED (
  SELECT node, pos, ts, len(ts) AS n, array_to_string(ts, ' ') AS form, array_to_string(ts[1:4], ' ') AS lead,
         coalesce(lag(array_to_string(ts, ' ')) OVER w, chr(1)) || chr(2) || coalesce(lead(array_to_string(ts, ' ')) OVER w, chr(1)) AS near
  FROM formed WINDOW w AS (PARTITION BY node ORDER BY pos)
), own AS (
  SELECT DISTINCT form, n, n || ' ' || lead AS g FROM placed WHERE n >= 4
), rounds AS (
  SELECT form, n, g, false AS settled FROM own WHERE g IN (SELECT g FROM own GROUP BY g HAVING count(*) > 1)
  UNION ALL
  (WITH now AS (SELECT form, n, g FROM rounds WHERE NOT settled
  ), tokens AS (
    SELECT form, n, g, unnest(string_split(form, ' ')) AS token, generate_subscripts(string_split(form, ' '), 1) AS pos FROM now
  ), common AS (
    SELECT g, pos, token FROM (
      SELECT g, pos, token, row_number() OVER (PARTITION BY g, pos ORDER BY count(*) DESC, token) AS r FROM tokens GROUP BY g, pos, token) WHERE r = 1
  ), same AS (
    SELECT form, n, g FROM tokens JOIN common USING (g, pos, token) GROUP BY form, n, g HAVING count(*) >= 0.8 * n
  ), good AS (
    SELECT g FROM (SELECT g, count(*) AS k FROM same GROUP BY g) JOIN (SELECT g, count(*) AS size FROM now GROUP BY g) USING (g) WHERE 2 * k > size
  ), named AS (
    SELECT form, n, g FROM same WHERE g IN (SELECT g FROM good)
  ), rest AS (
    SELECT form, n, g FROM now WHERE form NOT IN (SELECT form FROM named)
  ), counts AS (
    SELECT g, pos, token, k FROM (
      SELECT g, pos, token, count(*) AS k FROM tokens WHERE form NOT IN (SELECT form FROM named) GROUP BY g, pos, token
    ) JOIN (SELECT g, count(*) AS size FROM rest GROUP BY g) USING (g) WHERE k > 1 AND k < size
  ), place AS (
    SELECT g, pos FROM (SELECT g, pos, row_number() OVER (PARTITION BY g ORDER BY k DESC, pos) AS r FROM counts) WHERE r = 1
  ), parted AS (
    SELECT form, n, g || chr(2) || pos || coalesce(chr(3) || counts.token, '') AS g
    FROM (SELECT form, n, g, pos, string_split(form, ' ')[pos] AS token FROM rest JOIN place USING (g)) LEFT JOIN counts USING (g, pos, token)
  )
  SELECT form, n, g, true FROM named
  UNION ALL
  SELECT form, n, g, false FROM parted WHERE g IN (SELECT g FROM parted GROUP BY g HAVING count(*) > 1))
), general AS (
  SELECT form, g FROM rounds WHERE settled
), named AS MATERIALIZED (
  SELECT node, placed.pos, near, n, coalesce('L' || g, 'H' || placed.form) AS template FROM placed LEFT JOIN general ON placed.form = general.form
), seen AS (
  SELECT template, 2 * count(DISTINCT near) > count(DISTINCT node) AS varied FROM named WHERE n > 0 GROUP BY template HAVING count(DISTINCT node) >= 5
), held AS (
  SELECT DISTINCT template, node FROM named JOIN seen USING (template) WHERE NOT varied
), edges AS (
  SELECT node, array_to_string(ts[1:5], ' ') AS u, least(n, 5) AS w FROM placed WHERE n > 0 AND node IN (SELECT node FROM held)
  UNION ALL
  SELECT node, array_to_string(ts[n - 4:n], ' '), least(n - 5, 5) FROM placed WHERE n > 5 AND node IN (SELECT node FROM held)
), distinct_nodes AS (
  SELECT node FROM (SELECT min(node) AS node, sum(w) AS own FROM edges GROUP BY u HAVING min(node) = max(node)) JOIN (SELECT node, sum(w) AS w FROM edges GROUP BY node) USING (node)
  GROUP BY node, w HAVING sum(own) > w / 9.0
), recurring AS (
  SELECT template FROM seen WHERE varied
  UNION ALL
  SELECT template FROM held WHERE node IN (SELECT node FROM distinct_nodes) GROUP BY template HAVING count(*) >= 5
), judged AS (
  SELECT node, named.pos, line, recurring.template IS NOT NULL AND n > 0 AS dropped
  FROM named JOIN lines USING (node, pos) LEFT JOIN recurring ON named.template = recurring.template
), left_over AS (
  SELECT node, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '') AS kept
  FROM judged GROUP BY node
)"""

OP4_SQL = "WITH RECURSIVE " + LINES_SQL.format(docs="documents").lstrip() + """
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256
FROM documents JOIN left_over ON md5(coalesce(text, '')) = node
"""
