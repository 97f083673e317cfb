"""Mixing sources to target weights with hash-threshold histograms.

Token counts are summed by source and hash bucket, which gives nested thresholds: the documents of a smaller budget are part of
every larger one. Only the bucket that holds a source's border is refined, and documents are chosen by comparing their hash with
the threshold; nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callwarden.llm.common import WORD, prefix_sums, store

WEIGHTS = (5, 2, 1)
MOST = 3
_BITS, _STEP = 60, 12


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(doc_id: Column) -> Column:
    """60 bits of the id's md5: the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def _targets(sources: DataFrame, most: int) -> DataFrame:
    """Share the total by weight; a source stops at ``most`` times its size, and what is left is shared again."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    rest, weight = total, None
    while True:
        if weight is None:
            over = F.lit(False)
        else:
            over = F.col("source_size").cast("decimal(38,0)") * (most * weight) < F.col("weight").cast("decimal(38,0)") * F.lit(str(rest)).cast("decimal(38,0)")
        got = sources.agg(F.sum(F.when(over, F.col("source_size") * most).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        state = (total - (got[0] or 0), got[1] or 0)
        if state == (rest, weight) or state[1] == 0:
            break
        rest, weight = state
    weight = max(weight or 1, 1)
    target = F.when(over, (F.col("source_size") * most).cast("double")).otherwise((F.col("weight") * rest).cast("double") / F.lit(weight).cast("double"))
    return sources.withColumn("target", target)


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies`` for every row; ``copies`` (0 to ``most``) is how often the mix takes it.

    Size is the number of words (null text: 0). Sources in code point order, null last, get the weights in turn. Each source takes all its
    documents ``floor(target / source_size)`` times and those below a hash threshold once more; the threshold is the one whose total
    comes nearest to the target, so a source misses it by at most half a document (or half of the rows that repeat one id).
    Sources without words have the target 0. Extra columns are ignored; an empty table gives an empty result.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                        size_of(F.col("text")).alias("size"), hash_of(F.col("doc_id")).alias("h"))
    sized = sized.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("t")))
    sized = store(sized, "mix-sizes")
    totals = sized.groupBy("key").agg(F.sum("size").alias("source_size"))
    ranked = prefix_sums(totals, ["key"], {"rank": "1"}, "mix-sources")
    cycle = F.array(*[F.lit(w) for w in weights])
    sources = store(ranked.select("key", "source_size", F.get(cycle, (F.col("rank") % len(weights)).cast("int")).cast("long").alias("weight")), "mix-weights")
    targets = store(_targets(sources, most), "mix-targets").withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    state = targets.select("key", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"), F.lit(0).cast("long").alias("prefix"))
    for bits in range(_BITS - _STEP, -1, -_STEP):
        inside = sized.join(state.where("budget > 0"), "key").where(F.shiftright("h", bits + _STEP) == F.col("prefix"))
        sums = inside.groupBy("key", F.shiftright("h", bits).alias("bucket")).agg(F.sum("size").alias("own"), F.first("budget").alias("budget"))
        running = Window.partitionBy("key").orderBy("bucket")
        cut = (sums.withColumn("upto", F.sum("own").over(running)).where("upto >= budget").groupBy("key")
               .agg(F.min_by(F.struct("bucket", "own", (F.col("budget") - F.col("upto") + F.col("own")).alias("left")), "bucket").alias("b")))
        state = store(cut.select("key", F.col("b.left").alias("budget"), F.col("b.bucket").alias("prefix"), F.col("b.own").alias("own")), "mix-border")
    # the border document goes in if that comes nearer to the budget
    border = state.select("key", F.when(F.col("own") < 2 * F.col("budget"), F.col("prefix") + 1).otherwise(F.col("prefix")).alias("below"))
    plan = targets.join(border, "key", "left").select("key", "source_size", "target", "whole", F.coalesce("below", F.lit(0)).alias("below"))
    copies = F.col("whole") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)
    return sized.join(plan, "key").select("doc_id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mixed documents: all columns of the input, a row for each copy that the plan takes.

    The plan depends on the id and the source only through one hash and one threshold, so rows are matched by these.
    """
    plan = plan_mix(docs, weights, most).select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("t")).alias("_key"), hash_of(F.col("doc_id")).alias("_h"), "copies")
    # per source: the copies of all its documents, and the largest hash that gets one more
    rule = plan.groupBy("_key").agg(F.min("copies").alias("_least"), F.max("copies").alias("_most"), F.max(F.struct("copies", "_h")).alias("_top"))
    rule = rule.select("_key", "_least", "_most", F.when(F.col("_least") < F.col("_most"), F.col("_top._h")).otherwise(F.lit(-1)).alias("_last"))
    rows = docs.withColumn("_key", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("t"))).join(rule, "_key")
    copies = F.when(hash_of(F.col("doc_id")) <= F.col("_last"), F.col("_most")).otherwise(F.col("_least"))
    copies = F.when(F.col("_least") == F.col("_most"), F.col("_least")).otherwise(copies)
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies))).select(*docs.columns)
