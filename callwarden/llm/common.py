"""Helpers shared by the operators: stored intermediate tables, distributed ranks, word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callwarden.session import scratch_path

_MASK = (1 << 64) - 1
WORD = r"[^\x20\x09-\x0D]+"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the cluster's shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty); other columns cannot clash with an operator's own."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def crc_bucket(column: str, n: int) -> Column:
    """crc32 of an id written as text, modulo ``n``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


def prefix_sums(df: DataFrame, order: list[str], measures: dict[str, str], name: str) -> DataFrame:
    """Exclusive running sums over all rows in the given order, without one task that sorts everything.

    Rows are range-partitioned on ``order``; the partition number is stored with each row, so a retried task cannot
    change it. Sums inside a partition come from a window over that partition; the sums carried into a partition come from
    a window over one row per partition.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id())
    rows = store(ranged, name)
    parts = rows.groupBy("_part").agg(*[F.sum(F.expr(e)).alias(f"_t_{m}") for m, e in measures.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("_part", *[F.coalesce(F.sum(f"_t_{m}").over(before), F.lit(0)).alias(f"_c_{m}") for m in measures])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.select("*", *[F.coalesce(F.sum(F.expr(e)).over(inside), F.lit(0)).alias(f"_s_{m}") for m, e in measures.items()])
    keep = [c for c in rows.columns if c != "_part"]
    return summed.join(carried, "_part").select(*keep, *[(F.col(f"_s_{m}") + F.col(f"_c_{m}")).alias(m) for m in measures])


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply) on an array of uint64."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def slices(batch: pa.RecordBatch, column: int, rows: int = 1000, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch: at most ``rows`` rows, and at most ``size`` bytes of the column's texts unless one text is longer."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for at, length in enumerate(lengths):
        if at > start and (at - start == rows or held + length > size):
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += length
    if start < batch.num_rows:
        yield batch.slice(start)


class WordHashes(dict):
    """64-bit hash of a word (bytes), remembered up to a bounded number of words."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(words: list[bytes], width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles; a shorter text is one shingle, no words are none."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    span = min(n, width)
    acc = np.full(n - span + 1, 0x9E3779B97F4A7C15 * span & _MASK, np.uint64)
    for i in range(span):
        acc = acc * np.uint64(0x9FB21C651E98DF25) + h[i:n - span + 1 + i]
    return np.unique(mix(acc))
