"""Structured Streaming entry points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import parse
from ..sources.formats import layout_of

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def read_layout_stream(spark: SparkSession, path: str, script: str, *, files_per_trigger: int | None = None, into: str = "parsed", **options) -> DataFrame:
    """New files of a folder as they arrive, parsed; the content isn't kept."""
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return parse(reader.load(path), "content", layout_of(script), into=into, **options).drop("content")


def parse_stream(stream: DataFrame, column: str, script: str, *, mode: str = "PERMISSIVE", **options) -> DataFrame:
    """Cells of any stream, Kafka values for instance. FAILFAST would end the query at the first
    wrong cell; PERMISSIVE keeps it with its error, DROPMALFORMED drops it."""
    return parse(stream, column, layout_of(script), mode=mode, **options)
