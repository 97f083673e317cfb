"""Registered rate, breaker and budget queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from callwarden.operators import ledger as L
from callwarden.operators import tree
from callwarden.plans.registry import query
from callwarden.plans.views import view, with_views

HOUR_LIMITS = {"agent": 3, "principal": 2, "global": 16}
BREAKER = {"blocks": 2, "window_seconds": 21_600}


@query("rate_limit", with_views("""
WITH counted AS (SELECT id, ts, date_trunc('hour', ts) AS h, agent_id, principal FROM calls WHERE NOT synthetic),
n AS (SELECT id, row_number() OVER (PARTITION BY agent_id, h ORDER BY ts, id) AS a, row_number() OVER (PARTITION BY principal, h ORDER BY ts, id) AS p,
             row_number() OVER (PARTITION BY h ORDER BY ts, id) AS g FROM counted)
SELECT c.id, CASE WHEN n.a > 3 THEN 'agent:' || c.agent_id WHEN n.p > 2 THEN 'principal:' || c.principal WHEN n.g > 16 THEN 'global' END AS rate_scope,
       CASE WHEN n.a > 3 THEN n.a WHEN n.p > 2 THEN n.p WHEN n.g > 16 THEN n.g END AS rate_count,
       coalesce(n.a > 3 OR n.p > 2 OR n.g > 16, false) AS rate_refused
FROM calls c LEFT JOIN n ON n.id = c.id""", "calls"))
def rate_limit(spark, sf_dir):
    out = L.rate_limit(view(spark, sf_dir, "calls"), HOUR_LIMITS, bucket_seconds=3600)
    return out.select("id", "rate_scope", "rate_count", "rate_refused")


@query("breaker_observed", with_views("""
SELECT c.id, (SELECT count(*) FROM calls b WHERE b.task_id = c.task_id AND b.action = 'BLOCK' AND b.ts > c.ts - INTERVAL 21600 SECONDS
              AND (b.ts < c.ts OR (b.ts = c.ts AND b.id < c.id))) AS recent_blocks,
       (SELECT count(*) FROM calls b WHERE b.task_id = c.task_id AND b.action = 'BLOCK' AND b.ts > c.ts - INTERVAL 21600 SECONDS
              AND (b.ts < c.ts OR (b.ts = c.ts AND b.id < c.id))) >= 2 AND NOT c.synthetic AS breaker_refused FROM calls c""", "calls"))
def breaker_observed(spark, sf_dir):
    out = L.circuit_breaker(view(spark, sf_dir, "calls"), **BREAKER)
    return out.select("id", "recent_blocks", "breaker_refused")


@query("breaker_feedback", with_views("""
WITH RECURSIVE ordered AS (SELECT id, ts, task_id, action = 'BLOCK' AS blocked, synthetic, row_number() OVER (PARTITION BY task_id ORDER BY ts, id) AS rn FROM calls),
walk AS (
  SELECT id, ts, task_id, blocked, rn, false AS refused, CASE WHEN blocked THEN [ts] ELSE cast([] AS TIMESTAMP[]) END AS seen FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.id, o.ts, o.task_id, o.blocked, o.rn, len(list_filter(w.seen, lambda t: t > o.ts - INTERVAL 21600 SECONDS)) >= 2 AND NOT o.synthetic,
         CASE WHEN o.blocked OR (len(list_filter(w.seen, lambda t: t > o.ts - INTERVAL 21600 SECONDS)) >= 2 AND NOT o.synthetic)
              THEN list_append(list_filter(w.seen, lambda t: t > o.ts - INTERVAL 21600 SECONDS), o.ts)
              ELSE list_filter(w.seen, lambda t: t > o.ts - INTERVAL 21600 SECONDS) END
  FROM walk w JOIN ordered o ON o.task_id = w.task_id AND o.rn = w.rn + 1)
SELECT id, blocked, refused FROM walk""", "calls"))
def breaker_feedback(spark, sf_dir):
    calls = view(spark, sf_dir, "calls").withColumn("blocked", F.col("action") == "BLOCK")
    return L.breaker_feedback(calls, **BREAKER).select("id", "blocked", "refused")


@query("budget_scopes", with_views("""
SELECT c.id, 'task:' || a.ancestor_id AS scope FROM calls c JOIN closure a ON a.task_id = c.task_id
UNION ALL SELECT id, 'principal:' || principal FROM calls
UNION ALL SELECT id, 'global' FROM calls WHERE NOT synthetic""", "calls", "closure"))
def budget_scopes(spark, sf_dir):
    return L.budget_scopes(view(spark, sf_dir, "calls"), tree.ancestry(view(spark, sf_dir, "tasks")))


_EVENTS = """
SELECT l_orderkey AS res_id, l_linenumber AS seq, CASE l_returnflag WHEN 'R' THEN 'uncertain' WHEN 'A' THEN 'reconcile' ELSE 'settle' END AS kind,
       cast(floor(l_extendedprice) AS bigint) AS actual FROM lineitem"""


def _escrow(spark, sf_dir):
    reservations = view(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.array(F.concat(F.lit("principal:p_"), (F.col("o_custkey") % 40).cast("string")), F.concat(F.lit("task:t_"), F.col("o_custkey").cast("string")),
                F.lit("global")).alias("scope_ids"),
        F.floor("o_totalprice").cast("bigint").alias("amount"))
    events = view(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS res_id", "struct(l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq",
        "CASE l_returnflag WHEN 'R' THEN 'uncertain' WHEN 'A' THEN 'reconcile' ELSE 'settle' END AS kind",
        "cast(floor(l_extendedprice) AS bigint) AS actual")
    return reservations, events


_STATE = """
events AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq,
  CASE l_returnflag WHEN 'R' THEN 'uncertain' WHEN 'A' THEN 'reconcile' ELSE 'settle' END AS kind, cast(floor(l_extendedprice) AS bigint) AS actual FROM lineitem),
first AS (SELECT id, min(seq) AS seq FROM events WHERE kind <> 'reconcile' GROUP BY 1),
f AS (SELECT e.* FROM events e JOIN first USING (id, seq)),
fix AS (SELECT e.id, arg_min(e.actual, e.seq) AS actual FROM events e JOIN f ON f.id = e.id AND f.kind = 'uncertain' AND e.kind = 'reconcile' AND e.seq > f.seq GROUP BY 1),
life AS (SELECT o_orderkey AS id, o_custkey, cast(floor(o_totalprice) AS bigint) AS amount,
   CASE WHEN f.id IS NULL THEN 'active' WHEN f.kind = 'settle' OR fix.id IS NOT NULL THEN 'settled' ELSE 'uncertain' END AS state,
   CASE WHEN f.kind = 'settle' THEN f.actual ELSE fix.actual END AS settled_tokens
   FROM orders LEFT JOIN f ON f.id = o_orderkey LEFT JOIN fix ON fix.id = o_orderkey)"""


@query("reservation_states", f"WITH {_STATE.strip()} SELECT id, amount, state, settled_tokens FROM life")
def reservation_states(spark, sf_dir):
    return L.transitions(*_escrow(spark, sf_dir)).select("id", "amount", "state", "settled_tokens")


@query("ledger_state", f"""WITH {_STATE.strip()},
s AS (SELECT unnest(['principal:p_' || cast(o_custkey % 40 AS string), 'task:t_' || cast(o_custkey AS string), 'global']) AS scope_id, * FROM life)
SELECT scope_id, cast(coalesce(sum(settled_tokens), 0) AS bigint) AS spent, cast(coalesce(sum(CASE WHEN state <> 'settled' THEN amount END), 0) AS bigint) AS reserved,
       count(*) AS calls_used, count_if(state = 'active') AS active_calls FROM s GROUP BY 1""")
def ledger_state(spark, sf_dir):
    return L.ledger_state(*_escrow(spark, sf_dir))


def admission_inputs(spark, sf_dir):
    """Calls as requests over task, principal and global scopes with tight limits."""
    calls = view(spark, sf_dir, "calls")
    requests = calls.select(
        "id", "ts", F.col("tokens").cast("bigint").alias("tokens"),
        F.array(F.concat(F.lit("task:"), "task_id"), F.concat(F.lit("principal:"), "principal"), F.lit("global")).alias("scopes"),
        F.when(F.col("tokens") % 11 != 0, F.col("ts") + F.expr("INTERVAL 90 MINUTES")).alias("settle_ts"),
        F.when(F.col("tokens") % 7 != 0, F.expr("cast(tokens div 2 AS bigint)")).alias("actual"),
    )
    scopes = requests.select(F.explode("scopes").alias("scope")).distinct()
    limits = scopes.select(
        "scope",
        F.expr("cast(CASE WHEN scope = 'global' THEN 190000 WHEN scope LIKE 'principal:%' THEN 9000 ELSE 1100 END AS bigint)").alias("token_limit"),
        F.expr("cast(CASE WHEN scope = 'global' THEN 9000 WHEN scope LIKE 'principal:%' THEN 450 ELSE 60 END AS bigint)").alias("calls_limit"),
        F.expr("cast(CASE WHEN scope = 'global' THEN 1500 WHEN scope LIKE 'principal:%' THEN 60 ELSE 9 END AS bigint)").alias("concurrency_limit"),
    )
    return requests, limits


@query("admit_requests")
def admit_requests(spark, sf_dir):
    return L.admit(*admission_inputs(spark, sf_dir)).select("id", "admitted", "scope", "dimension")


@query("exceeded_dimension", with_views("""
SELECT id, CASE WHEN tokens % 10 = 0 THEN 'missing_scope' WHEN tokens * 3 + tokens > 300 THEN 'tokens' WHEN id % 30 + 1 > 20 THEN 'calls'
  WHEN id % 5 >= 4 THEN 'concurrency' END AS dimension FROM calls""", "calls"))
def exceeded_dimension(spark, sf_dir):
    t = F.col("tokens")
    limits = {"tokens": F.when(t % 10 != 0, 300), "calls": F.lit(20), "concurrency": F.lit(4)}
    out = L.exceeded_dimension(t * 2, t, F.col("id") % 30, F.col("id") % 5, limits, t)
    return view(spark, sf_dir, "calls").select("id", out.alias("dimension"))


@query("usage_cost", """
SELECT conv_id, turn, length(text) // 4 + 1 AS prompt_tokens, length(text) // 4 + 1 + CASE WHEN turn % 3 = 0 THEN 1024 ELSE turn * 100 END AS reserved_tokens,
       round((length(text) // 4 + 1) / 1000 * 0.002, 6) AS cost_usd FROM conversations""")
def usage_cost(spark, sf_dir):
    limit = F.when(F.col("turn") % 3 != 0, F.col("turn") * 100)
    return view(spark, sf_dir, "conversations").select(
        "conv_id", "turn", L.estimate_tokens(F.col("text")).alias("prompt_tokens"),
        L.reserve_tokens(F.col("text"), limit).alias("reserved_tokens"), L.usage_cost(L.estimate_tokens(F.col("text"))).alias("cost_usd"),
    )


@query("guard_cost")
def guard_cost(spark, sf_dir):
    texts = view(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text",
        (F.expr("timestamp'2024-01-01 00:00:00'") + F.make_interval(hours=F.col("conv_id").cast("int"), mins=F.col("turn").cast("int"))).alias("ts"))
    return L.guard_cost(texts, limit_tokens=150_000, limit_calls=5_000)


_RUNS = """SELECT o_custkey AS run, CASE o_orderstatus WHEN 'F' THEN 200 WHEN 'O' THEN 429 ELSE 403 END AS status,
  CASE WHEN o_orderstatus = 'P' THEN concat('RULE-', left(o_orderpriority, 1)) END AS rule_id,
  CASE WHEN o_orderstatus = 'F' THEN cast(floor(o_totalprice) AS bigint) ELSE 0 END AS spent,
  CASE WHEN o_orderstatus = 'P' THEN cast(floor(o_totalprice) AS bigint) ELSE 0 END AS reserved FROM {orders}"""


@query("overspend_report", f"""
WITH log AS ({_RUNS.format(orders="orders")}),
fails AS (SELECT run, string_agg(reason || '=' || cast(n AS string), ';' ORDER BY reason || '=' || cast(n AS string)) AS failures FROM
  (SELECT run, concat_ws(' ', cast(status AS string), rule_id) AS reason, count(*) AS n FROM log WHERE status NOT IN (200, 429) GROUP BY 1, 2) GROUP BY 1)
SELECT l.run, count(*) AS agents, 1000000 AS pool_tokens, 90000 AS reserve_per_request, least(count(*), 11) AS fit, count_if(status = 200) AS executed,
  count_if(status = 429) AS prevented, count_if(status NOT IN (200, 429)) AS other, coalesce(any_value(f.failures), '') AS failures,
  cast(sum(spent) AS bigint) AS spent_tokens, cast(sum(reserved) AS bigint) AS reserved_tokens, cast(sum(spent + reserved) AS bigint) AS committed_tokens,
  cast(greatest(0, sum(spent + reserved) - 1000000) AS bigint) AS overspend_tokens
FROM log l LEFT JOIN fails f ON f.run = l.run GROUP BY l.run""")
def overspend_report(spark, sf_dir):
    log = spark.sql(_RUNS, orders=view(spark, sf_dir, "orders"))
    return L.overspend_report(log, F.max(F.lit(1_000_000)), F.max(F.lit(90_000)))


@query("running_balance", with_views("""
WITH b AS (SELECT *, sum(amount) OVER (PARTITION BY scope_id ORDER BY created_at, id) AS balance FROM reservations)
SELECT scope_id, cast(sum(amount) AS bigint) AS committed, count(*) AS moves, arg_min(created_at, struct_pack(t := created_at, i := id)) FILTER (WHERE balance > 1500000) AS breached_at,
  arg_min(id, struct_pack(t := created_at, i := id)) FILTER (WHERE balance > 1500000) AS breach_id,
  cast(arg_min(balance, struct_pack(t := created_at, i := id)) FILTER (WHERE balance > 1500000) AS bigint) AS breach_balance
FROM b GROUP BY 1""", "reservations"))
def running_balance(spark, sf_dir):
    log = view(spark, sf_dir, "reservations").selectExpr("id", "scope_id", "created_at AS ts", "amount AS tokens")
    return L.first_breach(log, 1_500_000)
