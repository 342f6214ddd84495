"""Binary files through Spark's own readers, so any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import parse
from .formats import layout_of


def read_layout(spark: SparkSession, path: str, script: str, *, glob: str | None = None, recursive: bool = True, into: str = "parsed", **options) -> DataFrame:
    """One row for each file: path, length and the parsed content. ``script`` is a layout or the
    name of a bundled one. The content itself isn't kept."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return parse(reader.load(path), "content", layout_of(script), into=into, **options).drop("content")


def write_cells(df: DataFrame, column: str, path: str) -> None:
    """Cells as a Parquet table of one binary column. Spark has no writer of single raw files."""
    df.select(column).write.parquet(path)
