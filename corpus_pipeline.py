"""From raw documents to token ids: five stages, each written as Parquet before the next.

STAGES lists them by name. A stage takes (spark, docs, sf_dir) and works on all that the one
before it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm import bpe, classifier, decontaminate, linededup, neardup
from bitloom.llm.common import clear_scratch, scratch_root, scratch_tables

_left: list[str] = []


def _stage(f: Callable) -> Callable:
    """A stage's own scratch tables go when the next one begins: its result is written by then."""

    @functools.wraps(f)
    def wrapped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        clear_scratch(spark, _left)
        before = set(scratch_tables(spark))
        out = f(spark, docs, sf_dir)
        _left[:] = [t for t in scratch_tables(spark) if t not in before]
        return out

    return wrapped


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from the labels of the documents here."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classifier.accepted(docs, labels)


@_stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of recurring templates; n_chars follows the text."""
    done = linededup.drop_lines(docs)
    chars = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return done.withColumn("n_chars", chars).select(*docs.columns)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group."""
    return neardup.deduplicate(docs)


@_stage
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(docs, items)


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and digests of them and of the decoded text."""
    return bpe.encode(docs, bpe.word_bpe_path(), keep=["doc_id", "lang", "source"])


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("tokens", tokens)]

#: The classifier and the signatures have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{scratch_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
