"""A training corpus from raw documents: toxicity filter, near-duplicates, personal data, source mix, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callwarden.llm import minhash, mixing, packing, pii, toxicity
from callwarden.llm.common import store, table
from callwarden.llm.queries import TOKENIZER

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; null and empty texts stay."""
    model = toxicity.train(docs, toxicity.split_out(table(spark, sf_dir, "labels")))
    return toxicity.with_score(docs, model, "_toxicity").where(F.col("_toxicity") < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id, once if its row repeats. Rows without an id stay."""
    groups = minhash.near_duplicates(docs, shingle_words=5, similarity=(80, 100))
    gone = groups.where(~F.col("kept")).select("doc_id").distinct()
    named = docs.where("doc_id IS NOT NULL").join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id"])
    return named.union(docs.where("doc_id IS NULL").select(*named.columns)).select(*docs.columns)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and telling terms are replaced in the texts, and ``n_chars`` follows."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, repeated as often as it takes them."""
    return mixing.mix_sources(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.pack(docs, TOKENIZER)


STAGES = [("toxicity", drop_toxic), ("minhash", drop_near_duplicates), ("pii", sanitise), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
