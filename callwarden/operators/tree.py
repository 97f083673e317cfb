"""The delegation tree: ancestry, delegation limits and status changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callwarden.functions.globs import glob_regexes, matches_any
from callwarden.operators.running import running
from callwarden.session import cut_lineage


def _edges(tasks: DataFrame) -> DataFrame:
    """(task_id, parent_id) where the parent is in the table."""
    parents = tasks.select(F.col("id").alias("parent_id"))
    return tasks.select(F.col("id").alias("task_id"), "parent_id").join(parents, "parent_id", "left_semi").select("task_id", "parent_id")


def ancestry(tasks: DataFrame) -> DataFrame:
    """(task_id, ancestor_id, depth, via_id): every task with itself (depth 0) and all its ancestors, each once.

    ``via_id`` is the task just below the ancestor on the path. Rows up to distance d joined with the rows at exactly d give those up to
    2d: O(log depth) rounds, whatever the depth, and each round's rows are stored. On a cycle, or below one, the path ends where it would
    come back to a task: a task of a cycle shows up as its own ancestor in the round that closes it, and from then on rows that are known
    at a smaller distance are dropped.
    """
    edges = _edges(tasks)
    own = tasks.select(F.col("id").alias("task_id"), F.col("id").alias("ancestor_id"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via_id"))
    # a parent of its own is the shortest cycle
    first = edges.where("task_id <> parent_id").select("task_id", F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("depth"), F.col("task_id").alias("via_id"))
    newest = cut_lineage(first)
    known, reach, cyclic = own.unionByName(newest), 1, False
    while True:
        far = newest.where(F.col("depth") == reach).select("task_id", F.col("ancestor_id").alias("_at"))
        above = known.where("depth > 0").select(F.col("task_id").alias("_at"), "ancestor_id", "depth", "via_id")
        found = far.join(above, "_at").select("task_id", "ancestor_id", (F.col("depth") + reach).alias("depth"), "via_id")
        found = cut_lineage(found)
        rows, returning = found.agg(F.count(F.lit(1)), F.count_if(F.col("task_id") == F.col("ancestor_id"))).first()
        cyclic = cyclic or returning > 0
        if cyclic:
            found = cut_lineage(found.join(known.select("task_id", "ancestor_id"), ["task_id", "ancestor_id"], "left_anti"))
            rows = found.count()
        if rows == 0:
            return known
        known, newest, reach = known.unionByName(found), found, 2 * reach


def chain_lengths(tasks: DataFrame) -> DataFrame:
    """(id, links, root_id) per task: tasks from it up to its root, itself included; both null on a cycle and below one.

    Pointer doubling: each round a task that has not reached its root skips as far again as the task it points to. A path without a
    cycle ends within log2(tasks) rounds; who still climbs then is above a cycle. One row per task, no closure.
    """
    state = cut_lineage(tasks.select("id", F.lit(1).alias("links"), F.col("id").alias("root_id")).join(
        _edges(tasks).withColumnRenamed("task_id", "id"), "id", "left").withColumnRenamed("parent_id", "next"))
    rounds = max(1, state.count()).bit_length()
    for _ in range(rounds):
        if state.where(F.col("next").isNotNull()).limit(1).count() == 0:
            break
        target = state.select(F.col("id").alias("next"), F.col("links").alias("_links"), F.col("root_id").alias("_root"), F.col("next").alias("_next"))
        moving = state.where(F.col("next").isNotNull()).join(target, "next").select("id", (F.col("links") + F.col("_links")).alias("links"),
                                                                                      F.col("_root").alias("root_id"), F.col("_next").alias("next"))
        state = cut_lineage(state.where(F.col("next").isNull()).unionByName(moving))
    return state.select("id", F.when(F.col("next").isNull(), F.col("links")).cast("bigint").alias("links"), F.when(F.col("next").isNull(), F.col("root_id")).alias("root_id"))


def check_delegations(children: DataFrame, parents: DataFrame, chain_length: DataFrame, max_depth: int) -> DataFrame:
    """Verdict per child: ``OK`` or the first violated rule.

    ``children``: id, parent_id, tools, resources, tokens. ``parents``: id, tools, resources, tokens.
    ``chain_length``: id, links (tasks from the parent up to its root, the parent included).
    """
    p = parents.select(
        F.col("id").alias("parent_id"), F.col("tools").alias("p_tools"), F.col("resources").alias("p_resources"),
        glob_regexes(F.col("resources")).alias("p_regexes"), F.col("tokens").alias("p_tokens"),
    )
    links = chain_length.select(F.col("id").alias("parent_id"), "links")
    joined = children.join(p, "parent_id").join(links, "parent_id")  # no length: the chain never ends
    extra_tools = F.array_sort(F.array_except("tools", "p_tools"))
    bad = F.filter(
        "resources", lambda r: ~(F.array_contains("p_resources", r) | matches_any(r, F.col("p_regexes")))
    )
    return joined.select(
        "id", "parent_id", "links",
        F.when(F.col("links").isNull() | (F.col("links") > max_depth), "DELEGATION_TOO_DEEP")
        .when((F.size(extra_tools) > 0) | (F.size(bad) > 0) | (F.col("tokens") > F.col("p_tokens")), "DELEGATION_ESCALATION")
        .otherwise("OK").alias("verdict"),
        extra_tools.alias("extra_tools"), bad.alias("bad_resources"),
    )


def apply_status_events(tasks: DataFrame, events: DataFrame) -> DataFrame:
    """Final status per task. An event changes the task and its direct children, but only rows still active.

    So the earliest event of the task or of its parent, from the task's creation on, decides. The first
    parent event after each creation is a running minimum from the end, which needs no per-parent pairs.
    """
    own = events.groupBy(F.col("task_id").alias("id")).agg(F.min(F.struct("ts", F.col("id").alias("event_id"), "status")).alias("own"))
    happened = events.select(
        F.col("task_id").alias("key"), "ts", F.lit(1).alias("kind"), F.col("id").cast("string").alias("ref"),
        F.struct("ts", F.col("id").alias("event_id"), "status").alias("event"), F.lit(None).cast("string").alias("child"),
    )
    asked = tasks.where(F.col("parent_id").isNotNull()).select(
        F.col("parent_id").alias("key"), F.col("created_at").alias("ts"), F.lit(0).alias("kind"), F.col("id").alias("ref"),
        F.lit(None).cast(happened.schema["event"].dataType).alias("event"), F.col("id").alias("child"),
    )
    following = running(
        happened.unionByName(asked), ["key"], ["ts", "kind", "ref"], {"next_event": ("min", F.col("event"))},
        reverse=True,
    ).where(F.col("child").isNotNull()).select(F.col("child").alias("id"), F.col("next_event").alias("from_parent"))
    joined = tasks.join(own, "id", "left").join(following, "id", "left")
    first = F.least("own", "from_parent")
    return joined.select(
        "id", "parent_id", F.coalesce(first["status"], F.lit("active")).alias("status"),
        first["ts"].alias("changed_at"),
        F.when(first.isNotNull() & (F.col("own").isNull() | (F.col("own") != first)), True).otherwise(False).alias("by_parent"),
    )
