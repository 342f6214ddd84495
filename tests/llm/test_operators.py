"""Each operator on hand-made rows with nulls, empty and repeated ones, against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.llm import bpe, classifier, components, decontaminate, induced, licences, linededup, lm, neardup, rules, substrings, urls

RNG = np.random.default_rng(5)
VOCABULARY = [f"{a}{b}" for a in ("ta", "ri", "mo", "len", "su", "pa", "ke") for b in ("n", "ro", "st", "", "x", "mil")]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY, n))


BASE = [prose(120) for _ in range(6)]
TEXTS = [
    *BASE, BASE[0], BASE[0].replace(BASE[0].split()[50], "other", 1), None, "", "   \n\t", "word", "é " * 80, BASE[1] + "\n" + BASE[2],
    "x" * 900, "ab" * 600, BASE[3] + "\nfooter 12 of the page\n" + BASE[4], "Licensed under CC BY-NC 4.0.", BASE[5].upper(),
]
ROWS = [(i, t, "en" if i % 3 else None, "s", 1) for i, t in enumerate(TEXTS)] + [(None, BASE[2], "fr", "s", 1), (3, BASE[3], "en", "s", 1)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(18)] + [(None, 1, 0), (99, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


# ---- 1 licences


def test_licences(spark, docs, empty):
    got = {r.doc_id: r for r in licences.scan(docs, licences.notices(spark)).collect() if r.doc_id is not None}
    assert got[17].license == "CC-BY-NC-4.0" and got[17].notices == "CC-BY-NC-4.0"
    assert got[0].license is None and got[0].notices == "" and got[8].text_digest == got[9].text_digest
    assert licences.scan(docs, licences.notices(spark)).count() == len(ROWS)
    assert licences.scan(empty, licences.notices(spark)).count() == 0
    same = ["The  LICENCE,\nCopyright (c) 2020 Me\nsays: so.", "the license says so", "THE “LICENSE” says - so"]
    df = spark.createDataFrame([(t,) for t in same], "t string").select(licences.canonical(F.col("t")).alias("c"))
    assert {r.c for r in df.collect()} == {"the license says so"}
    assert docs.limit(0).select(licences.canonical(F.lit(None).cast("string"))).count() == 0


def test_entire_licence_texts_are_known(spark, tmp_path):
    texts = {p.stem: p.read_text() for p in licences.TEXTS.glob("*.txt")}
    mit = "MIT License\n\nCopyright (c) 2021 Someone\n\n" + "\n".join(x for x in texts["MIT"].split("\n") if "Copyright (c)" not in x)
    rows = [*texts.items(), ("MIT", mit), (None, mit + " But not so.")]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string").write.parquet(path)
    got = {r.doc_id: r.license for r in licences.op1_licences(spark, str(tmp_path)).collect()}
    assert len(texts) == 9 and [got[i] for i in range(len(rows))] == [x for x, _ in rows]


# ---- 2 decontamination


def brute_hits(text, items, window=10):
    w = words(text)
    hit, found = [False] * len(w), set()
    for item, t in items:
        v = words(t)
        for k in range(max(1, len(v) - window + 1)) if v else []:
            p = v[k : k + window]
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    found |= set() if item is None else {str(item)}
                    hit[i : i + len(p)] = [True] * len(p)
    return len(w), sum(hit), sorted(found)


ITEMS = [(1, BASE[0][:200]), (2, "word"), (10, BASE[1][300:500]), (3, None), (4, "..."), (None, BASE[4][:150]), (2, "word"), (5, "É é é é é é é é é é é"), (6, prose(12))]


@pytest.mark.parametrize("block", [64 << 20, 150])
def test_decontamination_equals_brute_force(spark, docs, block):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = decontaminate.scan(docs.withColumn("n_words", F.lit("clash")), items, table_bytes=block).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert (r.n_words, r.n_hit, list(r["items"])) == brute_hits(r.text, ITEMS), r.text
    assert any(r.n_hit for r in rows)
    left = decontaminate.clean(docs, items, table_bytes=block)
    assert left.columns == docs.columns and left.count() == sum(not r.n_hit for r in rows)


def test_decontamination_digest_and_empty_sides(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for r in decontaminate.contamination(docs, items).collect():
        if r.doc_id is not None:
            ids = brute_hits(TEXTS[r.doc_id], ITEMS)[2]
            assert r.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest() and r.n_items == len(ids)
    assert decontaminate.contamination(empty, items).count() == 0
    assert decontaminate.contamination(docs, items.limit(0)).where("contaminated").count() == 0


def test_wu_manber_finds_overlaps():
    patterns = [b"aba", b"a", b"abab" * 20, b"ba"]
    text = b"abab" * 30
    want = sorted((i, p) for p in patterns for i in range(len(text)) if text.startswith(p, i))
    at, which = decontaminate.WuManber.of(patterns).find(text)
    assert sorted(zip(at.tolist(), [patterns[i] for i in which], strict=True)) == want
    assert not len(decontaminate.WuManber.of([]).find(text)[0])


# ---- 3 near duplicates


def shingles(text):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def test_near_duplicates_equal_brute_force(docs, empty):
    rows = neardup.classes(docs).collect()
    assert len(rows) == len(ROWS) and neardup.classes(empty).count() == 0
    sets = [shingles(t) for _, t, *_ in ROWS]
    root = list(range(len(ROWS)))
    for i in range(len(ROWS)):
        for j in range(i):
            common, total = sum((sets[i] & sets[j]).values()), sum((sets[i] | sets[j]).values())
            if (ROWS[i][1] or "") == (ROWS[j][1] or "") or total and common / total >= 0.8:
                old, new = root[i], root[j]
                root = [new if x == old else x for x in root]
    want = {}
    for i, (d, *_) in enumerate(ROWS):
        want.setdefault(root[i], []).append(d)
    least = Counter(min((d for d in ds if d is not None), default=None) for ds in want.values() for _ in ds)
    assert Counter(r.class_id for r in rows) == least
    assert sum(r.kept for r in rows) == len(want)
    kept = neardup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len(want)


def test_signatures_are_unbiased():
    a = [f"t{i}" for i in range(300)] * 2
    b = a[:500] + [f"u{i}" for i in range(100)]
    texts = [" ".join(x).encode() for x in (a, b, a)]
    sig = neardup.signatures(*neardup.multisets(*neardup._joined(texts)), 3)
    x, y = neardup._elements(texts)[:2]
    assert np.isfinite(sig).all() and (sig[0] == sig[2]).all()
    assert abs((sig[0] == sig[1]).mean() - neardup.overlap(x, y)) < 0.15
    common = neardup.overlaps([x, y], [y])
    assert common[1, 0] == len(y) and common[0, 0] == len(np.intersect1d(x, y))


def test_blocks_find_links_across_components(spark):
    base = prose(200).split()
    texts = []
    for k in range(12):
        w = list(base)
        for i in range(0, 3 * k, 3):
            w[(i * 7) % 200] = f"edit{k // 2}x{i}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t) for t in texts]
    root = list(range(12))
    for i in range(12):
        for j in range(i):
            if sum((sets[i] & sets[j]).values()) / sum((sets[i] | sets[j]).values()) >= 0.8:
                root = [root[j] if x == root[i] else x for x in root]
    want = {i: min(j for j in range(12) if root[j] == root[i]) for i in range(12)}
    assert {r.doc_id: r.class_id for r in neardup.classes(df).collect()} == want


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 9), *((i, i + 1) for i in range(100, 140))]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} | {i: 100 for i in range(100, 141)}


# ---- 4 lines


def test_lines_of_recurring_templates_go(spark, empty):
    page = [(i, f"{prose(9)}\nServed by node {i} of the cluster\n{prose(8)}") for i in range(8)]
    copies = [(20 + i, BASE[0] + "\n" + BASE[1]) for i in range(8)] + [(40, None), (41, ""), (42, "a b\na b")]
    df = spark.createDataFrame([(i, t, 7) for i, t in page + copies], "doc_id long, text string, n_lines int")
    got = {r.doc_id: r for r in linededup.drop_lines(df).collect()}
    for i, t in page:
        lines = t.split("\n")
        assert got[i].text == lines[0] + "\n" + lines[2] and (got[i].n_lines, got[i].n_dropped) == (3, 1)
    assert got[20].text == copies[0][1] and got[20].n_dropped == 0
    assert got[40].text is None and (got[41].text, got[41].n_lines, got[42].text) == ("", 1, "a b\na b")
    assert linededup.drop_lines(empty).count() == 0


def test_leaf_generalises_a_variable_word(spark):
    names = ["anna", "boris", "clara", "dmitri", "elena", "farid"]
    df = spark.createDataFrame([(i, f"{prose(9)}\nthis page was last edited by {n} on the wiki\n{prose(7)}") for i, n in enumerate(names)], "doc_id long, text string")
    assert {r.n_dropped for r in linededup.drop_lines(df).collect()} == {1}


def dropped(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.n_dropped for r in linededup.drop_lines(df).collect()}


def test_blocks_of_lines_go(spark):
    header, footer = [prose(8) for _ in range(2)], [prose(9) for _ in range(5)]
    got = dropped(spark, ["\n".join([*header, prose(30), prose(30), *footer]) for _ in range(8)])
    assert set(got.values()) == {7}


def test_near_copies_hide_no_template(spark):
    line, body = prose(9), [prose(30) for _ in range(6)]
    alone = [f"{prose(20)}\n{line}\n{prose(20)}" for _ in range(7)]
    near = []
    for i in range(24):
        own = [x + f" edit{chr(97 + i)}" if k == i % 6 else x for k, x in enumerate(body)]
        near.append("\n".join([*own[:3], line, *own[3:]]))
    got = dropped(spark, alone + near)
    assert set(got.values()) == {1}
    assert set(dropped(spark, near).values()) == {0}


def test_leaf_holds_several_templates(spark):
    names = ["anna", "boris", "clara", "dmitri", "elena", "farid"]
    ends = ["on the wiki of our town", "from the mirror in the north"]
    lines = [f"this page was last {a} {n} {e}" for a, e in zip(("edited by", "copied to"), ends, strict=True) for n in names]
    other = [f"this page was last {prose(8)}" for _ in range(12)]
    got = dropped(spark, [f"{prose(9)}\n{x}\n{prose(7)}" for x in lines + other])
    assert [got[i] for i in range(24)] == [1] * 12 + [0] * 12


def test_lines_equal_their_sql(spark):
    import duckdb

    names = ["anna", "boris", "clara", "dmitri", "elena", "farid"]
    ends = ["on the wiki of our town", "from the mirror in the north"]
    lines = [f"this page was last {a} {n} {e}" for a, e in zip(("edited by", "copied to"), ends, strict=True) for n in names] + [f"this page was last {prose(8)}" for _ in range(12)]
    footer = [prose(9) for _ in range(3)]
    texts = [f"{prose(9)}\n{x}\n{prose(7)}" for x in lines] + ["\n".join([prose(30), *footer]) for _ in range(7)] + [t for _, t, *_ in ROWS] + [f"{prose(9)}\nPage {i}\n a\t b" for i in range(6)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in linededup.drop_lines(df).collect()}
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert got == {r[0]: tuple(r[1:]) for r in con.execute(linededup.OP4_SQL).fetchall()} and sum(x[1] for x in got.values()) > 30


def test_parts_are_split_in_few_tables_as_their_sql_does(spark, monkeypatch):
    import duckdb

    from bitloom.llm.common import scratch_tables

    lines = [f"this page was last {' '.join(RNG.choice(['red', 'blue', 'green'], 6))}" for _ in range(30)]
    texts = [f"{prose(9)}\n{lines[i % 30]}\n{lines[i * 7 % 30]} again\n{prose(7)}" for i in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = {r[0]: tuple(r[1:]) for r in con.execute(linededup.OP4_SQL).fetchall()}
    assert sum(x[1] for x in want.values()) > 0
    for part, steps, most in ((256, 16, 16), (12, 4, None)):
        monkeypatch.setattr(linededup, "PART", part, raising=False)
        monkeypatch.setattr(linededup, "STEPS", steps, raising=False)
        before = len(scratch_tables(spark))
        got = {r.doc_id: (r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in linededup.drop_lines(df).collect()}
        assert got == want
        assert most is None or len(scratch_tables(spark)) - before <= most


def test_short_lines_go(spark):
    got = dropped(spark, [f"{prose(9)}\n\n{prose(7)}\nAll rights reserved.\nPage {i}\nnext" for i in range(8)] + [f"{prose(9)}\nonce more"] * 3)
    assert [got[i] for i in range(11)] == [3] * 8 + [0] * 3


# ---- 5 substrings


def brute_removed(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + 200] for t in raw for i in range(len(t) - 199))
    out = []
    for t in raw:
        mark = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                mark[i : i + 200] = True
        spans = int((np.diff(np.append(0, mark.astype(int))) == 1).sum())
        out.append((len(t), int(mark.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~mark].tobytes()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("deal", [substrings.DEAL, 1])
def test_repeats_equal_brute_force(docs, empty, monkeypatch, deal):
    monkeypatch.setattr(substrings, "DEAL", deal)
    monkeypatch.setattr(substrings, "SHARD_BYTES", 4000)
    rows = substrings.remove_repeats(docs).collect()
    got = Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)
    assert got == brute_removed([t for _, t, *_ in ROWS])
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in rows)
    assert substrings.remove_repeats(empty).count() == 0


@pytest.mark.parametrize(("limit", "memory"), [(2048, 1 << 28), (4, 1 << 28), (2048, 64)])
def test_induced_sorting_equals_sorting(monkeypatch, limit, memory):
    monkeypatch.setattr(induced, "LIMIT", limit)
    for _ in range(120):
        a = int(RNG.integers(1, 5))
        text = np.append(RNG.integers(1, a + 1, int(RNG.integers(1, 70))), 0)
        assert induced.suffix_order(text, a + 1, memory).tolist() == sorted(range(len(text)), key=lambda i: tuple(text[i:]))


def test_anchors_cover_each_start_once_and_cut_long_texts(monkeypatch):
    data = np.frombuffer(prose(400).encode(), np.uint8)
    doc, begin, many, at, h, c = substrings.anchors(data, np.array([0, 1000, len(data)]))
    starts = [(d, s) for d, b, m in zip(doc, begin, many, strict=True) for s in range(b, b + m)]
    assert starts == [(0, s) for s in range(801)] + [(1, s) for s in range(1000, len(data) - 199)]


# ---- 6 BPE


def test_bpe_equals_the_library(docs, empty, spark):
    from tokenizers import Tokenizer

    path = bpe.word_bpe_path()
    library = Tokenizer.from_file(path)
    odd = ["<|endoftext|>a<|startoftext|>B", "ΑΣ Σίσυφος", "İstanbul ﬁ ²½ ٣ 漢字 🎉", "it's I'LL we'd", "é" * 300 + "1234", "</w> <</w>> w</w>", "a\x1c\x85b　c"]
    df = docs.select("text").unionByName(spark.createDataFrame([(t,) for t in odd], "text string"))
    for r in bpe.decode(bpe.encode(df, path), path).collect():
        want = library.encode(r.text or "", add_special_tokens=False)
        shown = library.decode(want.ids, skip_special_tokens=False)
        assert list(r.ids) == want.ids and r.n_tokens == len(want.ids) and r.decoded == shown
        assert r.decoded_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(np.array(want.ids, "<u4").tobytes()).hexdigest()
    assert bpe.encode(empty, path).count() == 0


# ---- 7 rules


def test_base_counts_equal_brute_force(docs, empty):
    rows = rules.counts(docs, "text", ["text"]).collect()
    for r in rows:
        t = r.text or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = {i + d for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(cover))
        assert r.n_dup_lines == len(lines) - len(set(lines)) and r.n_symbols == len(re.findall(r"[#*$%&|<>]", t))
    assert rules.counts(empty, "text", ["doc_id"]).count() == 0


def test_binomial_tail(spark):
    df = spark.createDataFrame([(n, k) for n in (1, 40, 900) for k in (0, 1, 3, 8)], "n long, k long").select("n", "k", rules.tail(F.col("n"), F.col("k"), 0.01).alias("p"))
    for r in df.collect():
        want = sum(math.comb(r.n, j) * 0.01**j * 0.99 ** (r.n - j) for j in range(min(r.k, r.n) + 1)) if r.k < r.n * 0.01 else 1.0
        assert r.p == pytest.approx(want, rel=1e-9)


def test_rules_are_certified_only_with_enough_labels(spark, docs, labels, empty):
    got = rules.judge(docs, labels)
    assert got.count() == len(ROWS) and got.where("kept and base_failed").count() == 0 and rules.judge(empty, labels).count() == 0
    assert got.where("not kept and not base_failed").count() == 0  # too few labels to reject anyone
    good = [(i, prose(60), "en") for i in range(2500)]
    bad = [(9000 + i, " ".join(w + "***" for w in prose(60).split()), "en") for i in range(20)]
    many = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    marked = spark.createDataFrame([(i, 1) for i in range(2500)], "doc_id long, quality int")
    out = {r.doc_id: r.kept for r in rules.judge(many, marked).where("not base_failed").collect()}
    assert not any(out[9000 + i] for i in range(20) if 9000 + i in out)
    assert np.mean([not k for i, k in out.items() if i < 9000]) <= rules.LIMIT


# ---- 8 classifier


def test_classifier_learns_and_ignores_labels_it_must_not_see(spark, empty):
    good = [(i, prose(80)) for i in range(150)]
    bad = [(1000 + i, " ".join(w + "$$$" for w in prose(80).split())) for i in range(60)]
    df = spark.createDataFrame([*good, *bad, (5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1), (1, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in classifier.score(df, labels).collect()}
    assert np.mean([got[i].predicted == 1 for i, _ in good]) > 0.98 and np.mean([got[i].predicted == 0 for i, _ in bad]) > 0.9
    assert 0 <= got[5000].score <= 1 and got[5000].score == got[5001].score
    held = [i for i, _ in good + bad if zlib.crc32(str(i).encode()) % 5 == 0]
    flipped = labels.where("doc_id is not null and quality is not null").withColumn("quality", F.when(classifier.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in classifier.score(df, flipped).collect()}
    assert held and all(abs(again[i] - got[i].score) < 1e-9 for i in got)
    assert {r.score for r in classifier.score(df, labels.limit(0)).collect()} == {0.5}
    assert classifier.score(empty, labels).count() == 0


# ---- 9 URLs


def test_automaton_equals_fnmatch():
    import fnmatch

    globs = [b"*", b"", b"a*b", b"*ab*", b"?b", b"a?*c", b"abc" * 30 + b"*", b"*x*y*z"]
    texts = [b"", b"ab", b"abc", b"xayz", b"abc" * 31, b"aab", b"b", b"zzxyz"] + [bytes(RNG.choice(list(b"abxyz"), 9)) for _ in range(60)]
    got = urls.Globs(globs).match(texts)
    for i, t in enumerate(texts):
        for j, g in enumerate(globs):
            assert got[i, j] == fnmatch.fnmatchcase(t.decode(), g.decode()), (t, g)


def test_urls(spark):
    cases = {
        "https://EXAMPLE.org/es/1?x": ("example.org", "/es/1", "example.org/es/", "block"), "http://a.example.org/en/12#t": ("a.example.org", "/en/12", "example.org/en/1", "block"),
        "http://b.org/en/2": ("b.org", "/en/2", "org/", "allow"), "http://x.com/de/": ("x.com", "/de/", "com/de/", "block"), "http://x.com/fr/spam": ("x.com", "/fr/spam", "com/fr/", "allow"),
        "http://spam.net/": ("spam.net", "/", None, "block"), "http://ok.net/x": ("ok.net", "/x", None, "allow"), "http://xorg/": ("xorg", "/", None, "allow"), "http://org": ("org", "", None, "allow"),
        "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "http://a.com?x/de/": ("a.com", "", None, "allow"),
    }
    df = spark.createDataFrame([(u, "clash") for u in cases], "url string, rule string")
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df).collect()}
    assert got == cases and urls.judge(df.limit(0)).count() == 0


# ---- 10 language model


def test_language_model(docs, empty, monkeypatch):
    monkeypatch.setattr(lm, "BUCKET_BYTES", 1500)
    rows = lm.score(docs).collect()
    tokens = lambda t: bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split() + [b" "]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(x for i, t, *_ in ROWS if not held(i) for x in tokens(t))
    total = sum(counts.values())
    assert len(rows) == len(ROWS) and lm.score(empty).count() == 0
    for r in rows:
        own = tokens(r.text)
        base = sum(math.log10((counts[x] + 1) / (total + len(counts) + 1)) for x in own)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(own), sum(counts[x] > 0 for x in own), total, held(r.doc_id))
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score <= 0


def test_language_model_scores_equal_brute_force(spark, monkeypatch):
    """With its first parameters, the model's score by a plain forward recursion over plain counts."""
    monkeypatch.setattr(lm, "PASSES", 0)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 300)
    monkeypatch.setattr(lm, "HEAD", 20)
    texts = [prose(30) for _ in range(20)] + ["a bb zzz", "", "Ta tan, unheard-of " + "q" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    split = lambda t: bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode()).split()
    counts = Counter(w for i, t in enumerate(texts) if not held(i) for w in split(t))
    ends = sum(not held(i) for i in range(len(texts)))
    head = sorted(counts, key=lambda w: (-counts[w], w))
    own = head[: math.ceil(lm.OWN_SCALE * (len(counts) + 1) ** 0.5)]
    form = lambda w: int(lm.forms_of(*lm.laid_out([w]))[0])
    mass, once, seen = np.zeros(lm.FORMS), np.zeros(lm.FORMS), np.zeros(256)
    for w, n in counts.items():
        seen += np.bincount(np.frombuffer(w, np.uint8), minlength=256)
        if w not in own:
            mass[form(w)] += n
            once[form(w)] += n == 1
    total = sum(seen[b] + 1 for b in range(256) if lm.INNER[b]) + len(counts) + 1
    end = (len(counts) + 1) / total
    spelled = lambda w: math.prod((seen[b] + 1) / total for b in w) * end / (1 - end)
    left = lm.Spelling(seen, len(counts)).masses()
    for w in counts:
        left[form(w)] -= spelled(w)
    shares = np.concatenate([[ends], [counts[w] for w in own], mass]) + 1
    model = lm.Hmm.first(shares / shares.sum())

    def token(w):
        if w is None:
            return 0, 1.0
        if w in own:
            return 1 + own.index(w), 1.0
        k = form(w)
        unseen = (once[k] + 1) / (mass[k] + once[k] + 2) if mass[k] else 1.0
        return 1 + len(own) + k, (1 - unseen) * counts[w] / mass[k] if counts[w] else unseen * spelled(w) / left[k]

    for r in lm.score(df.withColumn("score", F.lit("clash"))).collect():
        a, log = None, 0.0
        for w in [*split(r.text), None]:
            k, share = token(w)
            a = (model.start if a is None else a @ model.move) * model.emit[:, k]
            log += math.log10(a.sum()) + math.log10(share)
            a = a / a.sum()
        assert r.score == pytest.approx(log, rel=1e-9), r.text


def test_spelling_and_words_in_stretches(monkeypatch):
    spelling = lm.Spelling(np.bincount(np.frombuffer(b"abcabca", np.uint8), minlength=256), 3)
    assert spelling.masses().sum() == pytest.approx(1, rel=1e-9)
    one = np.flatnonzero(lm.INNER)
    short = np.zeros(lm.FORMS)
    for words in ([bytes([a]) for a in one], [bytes([a, b]) for a in one for b in one]):
        data, starts, size = lm.laid_out(words)
        np.add.at(short, lm.forms_of(data, starts, size), 10 ** spelling.of(data, starts))
    assert (short <= spelling.masses() + 1e-12).all()
    monkeypatch.setattr(lm, "STRETCH", 7)
    text = b"Some words, and  one-much-longer\tword " * 5
    assert [w for ws in lm.word_lists(text) for w in ws] == text.lower().split() and list(lm.word_lists(b"")) == []


def test_many_texts_are_coded_at_once(monkeypatch):
    import types

    import pyarrow as pa

    texts = [f"{prose(20)} w{i} own{i % 3}" if i % 9 else "" for i in range(300)]
    head = [(w.encode(), 5) for w in sorted(set(VOCABULARY[:20]))]
    lexicon = lm.Lexicon(6000, 400, head)
    lexicon.learn(300, np.full(lm.FORMS, 9.0), np.ones(lm.FORMS), lm.Spelling(np.ones(256), 100.0), np.zeros(lm.FORMS))
    row = pa.struct([("doc_id", pa.int64())])
    rows = pa.StructArray.from_arrays([pa.array(range(300))], ["doc_id"])
    batch = pa.RecordBatch.from_arrays([rows, pa.array([False] * 300), pa.array(texts)], ["row", "held", "text"])
    monkeypatch.setattr(lm, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    calls, real = [], lm.forms_of
    monkeypatch.setattr(lm, "forms_of", lambda *a: calls.append(1) or real(*a))
    coding = lm._coding(types.SimpleNamespace(value=lexicon), row)
    docs, words = coding(iter([batch]))
    assert len(calls) <= 3
    vocabulary = [w for w, _ in head] + words.column("word").to_pylist()
    code, known = ("<u2" if lexicon.classes <= 1 << 16 else "<u4"), {w: i + 1 for i, (w, _) in enumerate(head)}
    for t, n, k, classes, tail in zip(texts, *(docs.column(c).to_pylist() for c in ("n_tokens", "n_known", "classes", "tail")), strict=True):
        want = t.encode().split()
        assert n == len(want) + 1 == len(np.frombuffer(classes, code)) and k == 1 + sum(w in known for w in want)
        assert [vocabulary[len(head) + i] for i in np.frombuffer(tail, "<u4")] == [w for w in want if w not in known]
    monkeypatch.setattr(lm, "WAITING", 7, raising=False)
    again, _ = coding(iter([batch]))
    assert all(again.column(c).equals(docs.column(c)) for c in ("n_tokens", "n_known", "classes", "tail"))
    assert np.allclose(again.column("within").to_numpy(), docs.column("within").to_numpy())


def test_forward_and_counts_equal_enumeration():
    from itertools import product

    rng = np.random.default_rng(3)
    k, v = lm.STATES, 5
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    model = lm.Hmm(norm(rng.random(k)), norm(rng.random((k, k))), norm(rng.random((k, v))))
    texts = [np.array(x) for x in ([0, 3, 1], [4], [2, 2])]
    counts = (np.zeros(k), np.zeros((k, k)), np.zeros((k, v)))
    model.expected(texts, counts)
    start, move, emit = (np.zeros_like(c) for c in counts)
    for text, got in zip(texts, model.score(texts), strict=True):
        paths = {}
        for path in product(range(k), repeat=len(text)):
            p = model.start[path[0]] * model.emit[path[0], text[0]]
            for a, b, x in zip(path, path[1:], text[1:], strict=False):
                p *= model.move[a, b] * model.emit[b, x]
            paths[path] = p
        whole = sum(paths.values())
        assert got == pytest.approx(math.log10(whole))
        for path, p in paths.items():
            start[path[0]] += p / whole
            for a, b in zip(path, path[1:], strict=False):
                move[a, b] += p / whole
            for s, x in zip(path, text, strict=True):
                emit[s, x] += p / whole
    for a, b in zip(counts, (start, move, emit), strict=True):
        assert np.allclose(a, b)


# ---- every operator


def test_clashing_columns_and_very_long_texts(spark, labels):
    """Columns named like new ones, and a text of 0.2 MB with words of 20 kB, go through every operator."""
    long = (prose(3000) + "\n") * 10 + "w" * 20_000 + " " + "é" * 10_000
    names = ["n_words", "n_hit", "items", "score", "predicted", "held_out", "n_tokens", "n_bytes", "kept", "node", "class_id", "n_lines", "n_dropped", "row", "word", "bucket", "license", "ids"]
    rows = [(i, t) for i, t in enumerate([long, long + " more", BASE[0], None])]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in names])
    items = spark.createDataFrame([(1, BASE[0])], "item_id long, text string")
    done = {
        "licences": licences.scan(df, licences.notices(spark)), "decontaminate": decontaminate.scan(df, items), "clean": decontaminate.clean(df, items),
        "neardup": neardup.deduplicate(df), "lines": linededup.drop_lines(df), "repeats": substrings.remove_repeats(df), "bpe": bpe.encode(df, bpe.word_bpe_path()),
        "classifier": classifier.score(df, labels), "accepted": classifier.accepted(df, labels), "lm": lm.score(df),
    }
    got = {name: out.count() for name, out in done.items()}
    assert got == dict.fromkeys(done, 4) | {"clean": 3, "neardup": 3, "accepted": got["accepted"]}
    for name, out in done.items():
        assert len(set(out.columns)) == len(out.columns), name
