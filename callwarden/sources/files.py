"""Artifacts and documents as bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_DOCUMENT_BYTES = 10 * 1024 * 1024


def read_files(spark: SparkSession, path: str, pattern: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """``path, name, length, content``. The size limit is pushed to the listing, so large files are never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(path)
    if max_bytes is not None:
        files = files.where(F.col("length") <= max_bytes)
    return files.select("path", F.substring_index("path", "/", -1).alias("name"), "length", "content")


def oversized(spark: SparkSession, path: str, max_bytes: int = MAX_DOCUMENT_BYTES) -> DataFrame:
    """Files above the limit, by name and length only."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .where(F.col("length") > max_bytes).select("path", "length")
    )
