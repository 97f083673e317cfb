"""Information flow: labels of what was read, the level a task carries, and writes that leak it.

Levels run from 0 to 3, so the level of a task over time is known from the moments at which it first reached
1, 2 and 3. Those moments are one aggregated row per task, however many reads the task has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callwarden.operators.running import running
from callwarden.rules.policy import CONFIDENTIAL
from callwarden.session import cut_lineage

LEVELS = (1, 2, 3)


def label_reads(reads: DataFrame, catalog: DataFrame) -> DataFrame:
    """Label of each read: case law is public; a document outside the trusted catalog counts as confidential."""
    known = catalog.select("path", F.col("label").alias("_label"))
    label = F.when(F.col("tool") == "legal_db.search", 0).when(F.col("tool") == "doc.read", F.coalesce("_label", F.lit(CONFIDENTIAL)))
    return reads.join(known, "path", "left").withColumn("label", label.cast("int")).drop("_label")


def first_reached(reads: DataFrame, key: str = "task_id") -> DataFrame:
    """One row per key: when it first read at level 1, 2 and 3 or above."""
    moment = F.struct("ts", "id")
    return reads.groupBy(key).agg(*[F.min(F.when(F.col("label") >= n, moment)).alias(f"at{n}") for n in LEVELS])


def level_before(moment: Column, prefix: str = "at") -> Column:
    """Level reached strictly before a (ts, id) moment."""
    out = F.lit(0)
    for n in LEVELS:
        out = F.when(F.col(f"{prefix}{n}") < moment, n).otherwise(out)
    return out


def taint_timeline(calls: DataFrame, reads: DataFrame) -> DataFrame:
    """Level of the calling task before each call."""
    reached = first_reached(reads.withColumn("label", F.coalesce("label", F.lit(CONFIDENTIAL))))
    joined = calls.join(reached, "task_id", "left")
    return joined.withColumn("level", level_before(F.struct("ts", "id"))).drop(*[f"at{n}" for n in LEVELS])


def rises(tasks: DataFrame, closure: DataFrame, reads: DataFrame) -> DataFrame:
    """One row per task: ``seed``, the level inherited at creation, and the (ts, id) moments ``at1`` to ``at3`` at which it rose.

    A read raises the task and all its ancestors at once. A child starts with its parent's level at that time, and
    the parent started with its own parent's, so the seed is the highest level any ancestor had when the next
    task below it on the path was created.
    """
    own = first_reached(reads.withColumn("label", F.coalesce("label", F.lit(CONFIDENTIAL))))
    up = closure.join(own, "task_id")
    reached = up.groupBy(F.col("ancestor_id").alias("id")).agg(*[F.min(f"at{n}").alias(f"at{n}") for n in LEVELS])
    born = tasks.select(F.col("id").alias("via_id"), F.col("created_at").alias("via_created"))
    above = closure.where(F.col("depth") > 0).join(born, "via_id").join(reached.withColumnRenamed("id", "ancestor_id"), "ancestor_id")
    level_then = F.lit(0)
    for n in LEVELS:
        level_then = F.when(F.col(f"at{n}.ts") < F.col("via_created"), n).otherwise(level_then)
    seeds = above.groupBy(F.col("task_id").alias("id")).agg(F.max(level_then).alias("seed"))
    joined = tasks.select("id").join(reached, "id", "left").join(seeds, "id", "left")
    return joined.select("id", F.coalesce("seed", F.lit(0)).alias("seed"), *[f"at{n}" for n in LEVELS])


def tree_levels(calls: DataFrame, tasks: DataFrame, closure: DataFrame, reads: DataFrame) -> DataFrame:
    """Level of the calling task before each call: what it inherited, read itself, or had read below it in the tree."""
    return levels_from(calls, rises(tasks, closure, reads))


def levels_from(calls: DataFrame, risen: DataFrame) -> DataFrame:
    """Level of the calling task before each call, from the ``rises`` of the tasks."""
    level = F.greatest(F.coalesce("seed", F.lit(0)), level_before(F.struct("ts", "id")))
    return calls.join(risen.withColumnRenamed("id", "task_id"), "task_id", "left").withColumn("level", level).drop("seed", *[f"at{n}" for n in LEVELS])


def propagate_taint(tasks: DataFrame, closure: DataFrame, reads: DataFrame) -> DataFrame:
    """Per task: level inherited at creation, moments at which it rose, and final level."""
    joined = rises(tasks, closure, reads)
    seed = F.col("seed")
    final = F.lit(0)
    for n in LEVELS:
        final = F.when(F.col(f"at{n}").isNotNull(), n).otherwise(final)
    return joined.select(
        "id", seed.alias("seed_level"), F.greatest(seed, final).alias("final_level"),
        *[F.col(f"at{n}.ts").alias(f"reached_{n}") for n in LEVELS],
    )


def bind_memory(writes: DataFrame, recalls: DataFrame) -> DataFrame:
    """(id, ts, task_id, write_id) per recall that finds something: the newest write of its cell (case_id, key) before it."""
    written = writes.select("case_id", "key", "ts", "id", F.lit(None).cast("string").alias("_task"), F.lit(0).alias("_kind"))
    asked = recalls.select("case_id", "key", "ts", "id", F.col("task_id").alias("_task"), F.lit(1).alias("_kind"))
    newest = F.when(F.col("_kind") == 0, F.struct("ts", "id"))
    bound = running(written.unionByName(asked), ["case_id", "key"], ["ts", "id", "_kind"], {"_newest": ("max", newest)})
    found = bound.where((F.col("_kind") == 1) & F.col("_newest").isNotNull())
    return found.select("id", "ts", F.col("_task").alias("task_id"), F.col("_newest.id").alias("write_id"))


def memory_labels(tasks: DataFrame, closure: DataFrame, reads: DataFrame, writes: DataFrame, recalls: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Labels that travel through memory: a write stores the level of its task, a later recall of the cell raises the reader with it.

    Reads: id, ts, task_id, label. Writes and recalls: id, ts, task_id, case_id, key; all of them executed. Which write a recall sees
    does not depend on labels and is bound once. Then levels and labels are raised in turn, for all tasks and cells at once, until a
    round changes nothing: labels only grow and come from strictly earlier moments, so the least fixpoint is the sequential answer.
    Rounds: one more than the writes on the longest chain of write and recall along which a level rises.

    Returns the writes (id, ts, task_id, level), all reads with those of memory (id, ts, task_id, label), and the number of rounds.
    """
    closure = cut_lineage(closure)
    reads = cut_lineage(reads.select("id", "ts", "task_id", F.coalesce("label", F.lit(CONFIDENTIAL)).cast("int").alias("label")))
    moments = cut_lineage(writes.select("id", "ts", "task_id"))
    bound = cut_lineage(bind_memory(writes, recalls))
    every, rounds, before = reads, 0, 0
    while True:
        rounds += 1
        stored = cut_lineage(tree_levels(moments, tasks, closure, every))
        total = stored.agg(F.coalesce(F.sum("level"), F.lit(0))).first()[0]
        if total == before:
            return stored, every, rounds
        before = total
        labels = stored.where("level > 0").select(F.col("id").alias("write_id"), F.col("level").alias("label"))
        every = reads.unionByName(bound.join(labels, "write_id").select("id", "ts", "task_id", F.col("label").cast("int").alias("label")))


def flow_violations(calls_with_level: DataFrame) -> DataFrame:
    """Writes whose task carries more than the sink may receive (columns: level, clearance, writes)."""
    return calls_with_level.where(F.col("writes") & (F.col("level") > F.col("clearance")))
