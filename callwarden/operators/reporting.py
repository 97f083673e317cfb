"""Reports over the audit log and the governance tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callwarden.operators.content import level_name
from callwarden.operators.running import exact_quantiles, nearest_rank, running


def _top(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(int(limit))


def _listed(log: DataFrame, include_synthetic: bool = False) -> DataFrame:
    return log if include_synthetic else log.where(~F.col("synthetic"))


def decisions(log: DataFrame, include_synthetic: bool = False) -> DataFrame:
    """Rows that statistics count: system events of a log with a ``kind`` are no decisions."""
    rows = log.where("kind = 'DECISION'") if "kind" in log.columns else log
    return _listed(rows, include_synthetic)


def audit_query(log: DataFrame, task_id=None, rule_id=None, action=None, kind=None, since=None,
                include_synthetic: bool = False, limit: int | None = 200) -> DataFrame:
    """The newest rows; every filter reaches the scan, and the limit is a top-k of any size (None: all rows)."""
    for column, wanted in (("task_id", task_id), ("rule_id", rule_id), ("action", action), ("kind", kind)):
        if wanted is not None:
            log = log.where(F.col(column) == wanted)
    if since is not None:
        log = log.where(F.col("ts") >= F.lit(since))
    return _top(_listed(log, include_synthetic).orderBy(F.col("id").desc()), limit)


def totals(log: DataFrame, include_synthetic: bool = False) -> DataFrame:
    return decisions(log, include_synthetic).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def by_channel(log: DataFrame, include_synthetic: bool = False) -> DataFrame:
    return decisions(log, include_synthetic).groupBy("channel", "action").agg(F.count(F.lit(1)).alias("n"))


def top_rules(log: DataFrame, include_synthetic: bool = False, k: int | None = None) -> DataFrame:
    counted = decisions(log, include_synthetic).where(F.col("action") != "ALLOW").groupBy("rule_id", "reason_code", "action").agg(
        F.count(F.lit(1)).alias("n")
    )
    return _top(counted.orderBy(F.col("n").desc(), "rule_id", "reason_code", "action"), k)


def latency(log: DataFrame, include_synthetic: bool = False) -> DataFrame:
    q = exact_quantiles(decisions(log, include_synthetic), [], "latency_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return q.select("n", *[F.round(p, 3).alias(p) for p in ("p50", "p95", "p99")])


def stage_latency(log: DataFrame, include_synthetic: bool = False, timings: str = "timings") -> DataFrame:
    """Per-stage percentiles of a JSON object ``{"stage": milliseconds}``."""
    rows = decisions(log, include_synthetic).select(
        F.explode(F.from_json(timings, "map<string,double>")).alias("stage", "ms")
    )
    q = exact_quantiles(rows, ["stage"], "ms", {"p50": 0.5, "p95": 0.95})
    return q.select("stage", "n", F.round("p50", 3).alias("p50"), F.round("p95", 3).alias("p95"))


def timeline(log: DataFrame, as_of: Column | None = None, minutes: int = 60, include_synthetic: bool = False) -> DataFrame:
    """Decisions per minute, one column per action; ``as_of`` replaces the wall clock (null: whole log)."""
    rows = decisions(log, include_synthetic)
    if as_of is not None:
        rows = rows.where(F.col("ts") > as_of - F.expr(f"interval {int(minutes)} minutes"))
    bucket = F.date_trunc("minute", "ts").cast(dict(log.dtypes)["ts"]).alias("minute")
    return rows.groupBy(bucket).agg(
        *[F.count_if(F.col("action") == a).alias(a.lower()) for a in ("ALLOW", "REDACT", "BLOCK")]
    )


def task_overview(tasks: DataFrame, budgets: DataFrame, status: str | None = None, include_synthetic: bool = False,
                  limit: int | None = None) -> DataFrame:
    if status is not None:
        tasks = tasks.where(F.col("status") == status)
    if not include_synthetic:
        tasks = tasks.where(~F.col("synthetic"))
    # the newest tasks first, so only they meet the budgets
    newest = _top(tasks.orderBy(F.col("created_at").desc(), "id"), limit).withColumn("scope_id", F.concat(F.lit("task:"), "id"))
    return newest.join(budgets, "scope_id", "left").select(
        F.col("id").alias("task_id"), "principal", "agent_id", "parent_id", "status", "created_at", "spent", "reserved",
        "token_limit", "calls_used", "calls_limit",
    )


def task_detail(tasks: DataFrame, budgets: DataFrame, log: DataFrame, per_page: int = 500) -> DataFrame:
    """Every task with its budget, the count of its children, and all its events in ascending order, page by page.

    Page 1 holds the newest ``per_page`` events and is there also for a task without any; a task with more has a row for each further page,
    so an array has bounded length and no event is left out.
    """
    recent = running(log, ["task_id"], ["ts", "id"], {"_rank": ("count", F.lit(1))}, reverse=True)
    page = F.expr(f"(_rank - 1) div {int(per_page)} + 1")
    arrays = recent.groupBy("task_id", page.alias("page")).agg(F.array_sort(F.collect_list(F.struct("ts", "id", "action"))).alias("events"))
    children = tasks.where(F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("task_id")).agg(
        F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("status") == "active").alias("n_active_children")
    )
    base = tasks.select(F.col("id").alias("task_id"), "principal", "agent_id", "status",
                        F.concat(F.lit("task:"), "id").alias("scope_id"))
    return (
        base.join(budgets, "scope_id", "left").join(children, "task_id", "left").join(arrays, "task_id", "left")
        .select("task_id", F.coalesce("page", F.lit(1)).cast("bigint").alias("page"), "principal", "agent_id", "status", "spent", "reserved", "token_limit",
                F.coalesce("n_children", F.lit(0)).alias("n_children"),
                F.coalesce("n_active_children", F.lit(0)).alias("n_active_children"), "events")
    )


def approval_queue(approvals: DataFrame, tasks: DataFrame, status: str | None = None, limit: int | None = None) -> DataFrame:
    if status is not None:
        approvals = approvals.where(F.col("status") == status)
    owners = tasks.select(F.col("id").alias("task_id"), "principal", "agent_id", "profile")
    return _top(approvals.join(owners, "task_id").orderBy(F.col("created_at").desc(), "id"), limit)


def reservation_list(reservations: DataFrame, status: str | None = None, limit: int | None = None) -> DataFrame:
    if status is not None:
        reservations = reservations.where(F.col("status") == status)
    return _top(reservations.orderBy(F.col("created_at").desc(), F.col("id").desc()), limit)


def budget_list(budgets: DataFrame, include_synthetic: bool = False) -> DataFrame:
    return budgets if include_synthetic else budgets.where(~F.col("scope_id").like(r"principal:sim\_%"))


def budget_summary(budgets: DataFrame, reservations: DataFrame, tasks: DataFrame, as_of: Column, usd_per_1k: float,
                   default_limit: int, include_synthetic: bool = False) -> DataFrame:
    """One row: spent and held tokens over principals, the global limit, cost, open escrow and live tasks."""
    named = F.col("scope_id").like("principal:%")
    if not include_synthetic:
        named = named & ~F.col("scope_id").like(r"principal:sim\_%")
    money = budgets.agg(
        F.coalesce(F.sum(F.when(named, F.col("spent"))), F.lit(0)).alias("spent_tokens"),
        F.coalesce(F.sum(F.when(named, F.col("reserved"))), F.lit(0)).alias("reserved_tokens"),
        F.coalesce(F.max(F.when(F.col("scope_id") == "global", F.col("token_limit"))), F.lit(default_limit)).alias("global_limit"),
    )
    open_escrow = reservations.agg(F.count_if(F.col("status") == "uncertain").alias("uncertain_reservations"))
    live = tasks.agg(
        F.count_if((F.col("status") == "active") & ~F.col("synthetic") & (F.col("expires_at") > as_of)).alias("active_tasks")
    )
    one = F.lit(1).alias("_one")
    joined = money.select("*", one).join(open_escrow.select("*", one), "_one").join(live.select("*", one), "_one")
    return joined.select(
        "spent_tokens", "reserved_tokens", "global_limit",
        F.round(F.col("spent_tokens") / 1000 * usd_per_1k, 4).alias("estimated_cost_usd"),
        "uncertain_reservations", "active_tasks",
        F.round(F.col("spent_tokens") * 100.0 / F.col("global_limit"), 3).alias("used_pct"),
        F.round(F.col("reserved_tokens") * 100.0 / F.col("global_limit"), 3).alias("held_pct"),
    )


def memory_list(entries: DataFrame, case_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Entries without their content."""
    if case_id is not None:
        entries = entries.where(F.col("case_id") == case_id)
    return _top(entries.orderBy(F.col("id").desc()), limit).select(
        "id", "case_id", "key", level_name(F.col("classification")).alias("classification"), "source_task", "created_at"
    )


def tool_status(registry: DataFrame) -> DataFrame:
    return registry.select(
        "name", "status", F.substring("definition_hash", 1, 12).alias("hash"),
        F.get_json_object("definition", "$.description").alias("description"),
        F.get_json_object("pending_definition", "$.description").alias("pending_description"),
    )


def document_catalog_upsert(catalog: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply label changes in ``seq`` order: the last label wins, client and title keep their last non-null value."""
    def last(col: str) -> Column:
        return F.max_by(F.col(col), F.when(F.col(col).isNotNull(), F.col("seq")))
    latest = changes.groupBy("path").agg(
        F.max_by("label", "seq").alias("new_label"), last("client").alias("new_client"), last("title").alias("new_title")
    )
    return catalog.join(latest, "path", "full").select(
        "path", F.coalesce("new_client", "client").alias("client"), F.coalesce("new_label", "label").alias("label"),
        F.coalesce("new_title", "title").alias("title"),
    )


def delivered_vs_blocked(log: DataFrame) -> DataFrame:
    return log.groupBy("tool").agg(
        F.count_if("tool_invoked").alias("delivered"),
        F.count_if(~F.col("tool_invoked") & (F.col("action") == "BLOCK")).alias("blocked"),
        F.count(F.lit(1)).alias("calls"),
    )


def workload_report(log: DataFrame, workload: str, value: str = "latency_ms") -> DataFrame:
    """Nearest-rank percentiles and throughput per workload."""
    ranks = nearest_rank(log, [workload], value, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    seconds = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    span = log.groupBy(workload).agg(seconds.alias("_s"), F.count(F.lit(1)).alias("_calls"))
    return ranks.join(span, workload).select(
        workload, "n", "p50", "p95", "p99",
        F.round(F.when(F.col("_s") > 0, F.col("_calls") / F.col("_s")), 6).alias("calls_per_second"),
    )
