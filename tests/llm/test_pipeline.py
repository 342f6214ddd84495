"""Each stage of the pipeline on what the one before it keeps, against brute force."""

import hashlib
import importlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from bitloom.llm import bpe

from test_operators import SCHEMA, brute_hits, prose, shingles

pipeline = importlib.import_module("corpus_pipeline")

GOOD = [prose(90) for _ in range(40)]
NEAR = " ".join(["other", *GOOD[3].split()[1:]])
JUNK = [" ".join(w + "$$$" for w in prose(60).split()) for _ in range(25)]
FOOTER = "this footer closes every page of the site"
ITEM = prose(14)
TEXTS = [f"{t}\n{FOOTER}" for t in GOOD[:12]] + GOOD[12:] + [NEAR + "\n" + FOOTER, GOOD[20], f"{prose(40)} {ITEM} {prose(30)}", *JUNK]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    junk = range(len(TEXTS) - len(JUNK), len(TEXTS))
    spark.createDataFrame([(i, int(i not in junk), 0) for i in range(len(TEXTS))], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_equal_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept = []
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, tables)
        if name != "tokens":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), docs.schema)
            kept.append({r.doc_id: r.text for r in docs.collect()})
    quality, lines, alone, clean = kept
    good = range(len(TEXTS) - len(JUNK))
    assert set(good) <= set(quality) and len(set(quality) - set(good)) <= 2
    assert lines == {i: "\n".join(x for x in t.split("\n") if x != FOOTER) for i, t in quality.items()}
    sets = {i: shingles(t) for i, t in lines.items()}
    first = {}
    for i in sorted(lines):
        like = [j for j in first if sum((sets[i] & sets[j]).values()) >= 0.8 * sum((sets[i] | sets[j]).values())]
        first[i] = first[like[0]] if like else i
    assert sorted(alone) == sorted(set(first.values())) and {40, 41}.isdisjoint(alone)
    assert clean == {i: t for i, t in alone.items() if not brute_hits(t, [(1, ITEM)])[1]} and 42 in alone and 42 not in clean
    library = Tokenizer.from_file(bpe.word_bpe_path())
    rows = pipeline.run(spark, tables).collect()
    assert {r.doc_id for r in rows} == set(clean)
    for r in rows:
        want = library.encode(clean[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()


def test_nulls_empty_texts_and_empty_tables(spark, tables):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, None, "en", "s", None)], SCHEMA)
    for name, stage in pipeline.STAGES:
        assert stage(spark, odd.limit(0), tables).count() == 0
        assert stage(spark, odd, tables).count() <= 4, name
