"""Registered reports over the derived audit log."""

from __future__ import annotations

from pyspark.sql import functions as F

from callwarden.operators import reporting as R
from callwarden.plans.registry import query
from callwarden.plans.views import view, with_views
from callwarden.rules.policy import BUDGETS
from callwarden.sources.audit import export_rows

_EXPORT = [
    "id", "ts", "kind", "channel", "target", "task_id", "principal", "action", "reason_code", "rule_id", "stage",
    "policy_version", "latency_ms", "tool_invoked", "synthetic",
]


@query("audit_query", with_views("""
SELECT id, ts, task_id, channel, tool, action, rule_id, latency_ms FROM calls
WHERE action = 'BLOCK' AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND NOT synthetic ORDER BY id DESC LIMIT 200""", "calls"))
def audit_query(spark, sf_dir):
    log = R.audit_query(view(spark, sf_dir, "calls"), action="BLOCK", since="2024-01-05 00:00:00", limit=200)
    return log.select("id", "ts", "task_id", "channel", "tool", "action", "rule_id", "latency_ms")


@query("totals", with_views("SELECT action, count(*) AS n FROM calls WHERE NOT synthetic GROUP BY action", "calls"))
def totals(spark, sf_dir):
    return R.totals(view(spark, sf_dir, "calls"))


@query("by_channel", with_views("SELECT channel, action, count(*) AS n FROM calls WHERE NOT synthetic GROUP BY 1, 2", "calls"))
def by_channel(spark, sf_dir):
    return R.by_channel(view(spark, sf_dir, "calls"))


@query("top_rules", with_views("""
SELECT rule_id, reason_code, action, count(*) AS n FROM calls WHERE NOT synthetic AND action <> 'ALLOW'
GROUP BY 1, 2, 3 ORDER BY n DESC, rule_id, reason_code, action LIMIT 10""", "calls"))
def top_rules(spark, sf_dir):
    return R.top_rules(view(spark, sf_dir, "calls"), k=10)


@query("latency", with_views("""
SELECT count(*) AS n, round(quantile_cont(latency_ms, 0.5), 3) AS p50, round(quantile_cont(latency_ms, 0.95), 3) AS p95,
       round(quantile_cont(latency_ms, 0.99), 3) AS p99 FROM calls WHERE NOT synthetic""", "calls"))
def latency(spark, sf_dir):
    return R.latency(view(spark, sf_dir, "calls"))


@query("stage_latency", with_views("""
SELECT stage, count(*) AS n, round(quantile_cont(ms, 0.5), 3) AS p50, round(quantile_cont(ms, 0.95), 3) AS p95
FROM (SELECT unnest(json_keys(timings)) AS stage, timings FROM calls WHERE NOT synthetic) s
CROSS JOIN LATERAL (SELECT cast(json_extract_string(s.timings, '$.' || s.stage) AS double) AS ms) v GROUP BY stage""", "calls"))
def stage_latency(spark, sf_dir):
    return R.stage_latency(view(spark, sf_dir, "calls"))


@query("timeline", with_views("""
SELECT date_trunc('minute', ts) AS minute, count_if(action = 'ALLOW') AS allow, count_if(action = 'REDACT') AS redact,
       count_if(action = 'BLOCK') AS block FROM calls WHERE NOT synthetic GROUP BY 1""", "calls"))
def timeline(spark, sf_dir):
    return R.timeline(view(spark, sf_dir, "calls"))


@query("timeline_last_hour", with_views("""
SELECT date_trunc('minute', ts) AS minute, count_if(action = 'ALLOW') AS allow, count_if(action = 'REDACT') AS redact,
       count_if(action = 'BLOCK') AS block FROM calls
WHERE NOT synthetic AND ts > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 60 MINUTES GROUP BY 1""", "calls"))
def timeline_last_hour(spark, sf_dir):
    return R.timeline(view(spark, sf_dir, "calls"), as_of=F.expr("timestamp_ntz'2024-01-20 12:00:00'"))


@query("task_overview", with_views("""
SELECT t.id AS task_id, t.principal, t.agent_id, t.parent_id, t.status, t.created_at, b.spent, b.reserved, b.token_limit,
       b.calls_used, b.calls_limit
FROM tasks t LEFT JOIN budgets b ON b.scope_id = 'task:' || t.id
WHERE t.status = 'active' AND NOT t.synthetic ORDER BY t.created_at DESC, t.id LIMIT 100""", "tasks", "budgets"))
def task_overview(spark, sf_dir):
    return R.task_overview(view(spark, sf_dir, "tasks"), view(spark, sf_dir, "budgets"), status="active", limit=100)


@query("task_detail", with_views("""
SELECT t.id AS task_id, coalesce(e.page, 1) AS page, t.principal, t.agent_id, t.status, b.spent, b.reserved, b.token_limit,
       coalesce(c.n, 0) AS n_children, coalesce(c.a, 0) AS n_active_children, e.events
FROM tasks t LEFT JOIN budgets b ON b.scope_id = 'task:' || t.id
LEFT JOIN (SELECT parent_id, count(*) AS n, count_if(status = 'active') AS a FROM tasks GROUP BY 1) c ON c.parent_id = t.id
LEFT JOIN (SELECT task_id, (rn - 1) // 20 + 1 AS page, string_agg(cast(id AS string) || ':' || action, ',' ORDER BY ts, id) AS events FROM
           (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, id DESC) AS rn FROM calls)
           GROUP BY 1, 2) e ON e.task_id = t.id""", "tasks", "budgets", "calls"))
def task_detail(spark, sf_dir):
    out = R.task_detail(view(spark, sf_dir, "tasks"), view(spark, sf_dir, "budgets"), view(spark, sf_dir, "calls"), per_page=20)
    line = F.transform("events", lambda e: F.concat(e["id"].cast("string"), F.lit(":"), e["action"]))
    return out.withColumn("events", F.array_join(line, ","))


@query("approval_queue", with_views("""
SELECT a.id, a.task_id, a.tool, a.status, a.created_at, t.principal, t.agent_id, t.profile
FROM approvals a JOIN tasks t ON t.id = a.task_id WHERE a.status = 'pending' ORDER BY a.created_at DESC, a.id LIMIT 100""",
    "approvals", "tasks"))
def approval_queue(spark, sf_dir):
    out = R.approval_queue(view(spark, sf_dir, "approvals"), view(spark, sf_dir, "tasks"), status="pending", limit=100)
    return out.select("id", "task_id", "tool", "status", "created_at", "principal", "agent_id", "profile")


@query("reservation_list", with_views("""
SELECT * FROM reservations WHERE status = 'uncertain' ORDER BY created_at DESC, id DESC LIMIT 100""", "reservations"))
def reservation_list(spark, sf_dir):
    return R.reservation_list(view(spark, sf_dir, "reservations"), status="uncertain", limit=100)


@query("budget_list", with_views(r"SELECT * FROM budgets WHERE scope_id NOT LIKE 'principal:sim\_%' ESCAPE '\'", "budgets"))
def budget_list(spark, sf_dir):
    return R.budget_list(view(spark, sf_dir, "budgets"))


@query("budget_summary", with_views("""
SELECT spent_tokens, reserved_tokens, global_limit, round(spent_tokens / 1000 * 0.002, 4) AS estimated_cost_usd,
       uncertain_reservations, active_tasks, round(spent_tokens * 100.0 / global_limit, 3) AS used_pct,
       round(reserved_tokens * 100.0 / global_limit, 3) AS held_pct
FROM (SELECT cast(sum(spent) AS bigint) AS spent_tokens, cast(sum(reserved) AS bigint) AS reserved_tokens FROM budgets
      WHERE scope_id LIKE 'principal:%' AND NOT starts_with(scope_id, 'principal:sim_'))
CROSS JOIN (SELECT coalesce(max(token_limit), 2000000) AS global_limit FROM budgets WHERE scope_id = 'global')
CROSS JOIN (SELECT count(*) AS uncertain_reservations FROM reservations WHERE status = 'uncertain')
CROSS JOIN (SELECT count(*) AS active_tasks FROM tasks WHERE status = 'active' AND NOT synthetic
            AND expires_at > TIMESTAMP '2024-01-21 00:00:00')""", "budgets", "reservations", "tasks"))
def budget_summary(spark, sf_dir):
    return R.budget_summary(
        view(spark, sf_dir, "budgets"), view(spark, sf_dir, "reservations"), view(spark, sf_dir, "tasks"),
        F.expr("timestamp_ntz'2024-01-21 00:00:00'"), BUDGETS["usd_per_1k_tokens"], BUDGETS["global"]["tokens"],
    )


@query("memory_list", with_views("""
SELECT id, case_id, key, CASE classification WHEN 0 THEN 'PUBLIC' WHEN 1 THEN 'INTERNAL' WHEN 2 THEN 'CONFIDENTIAL'
       ELSE 'SECRET' END AS classification, source_task, created_at
FROM memory_entries WHERE case_id = 'case1' ORDER BY id DESC LIMIT 200""", "memory_entries"))
def memory_list(spark, sf_dir):
    return R.memory_list(view(spark, sf_dir, "memory_entries"), case_id="case1", limit=200)


@query("document_catalog_upsert", """
WITH changes AS (SELECT concat('/', source, '/', cast(doc_id % 50 AS string)) AS path, doc_id AS seq,
                        CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS client, cast(doc_id % 4 AS int) AS label,
                        CASE WHEN doc_id % 5 = 0 THEN NULL ELSE concat('doc ', cast(doc_id AS string)) END AS title FROM documents),
catalog AS (SELECT concat('/src', cast(page_id % 30 AS string), '/', cast(page_id AS string)) AS path,
                   'old' AS client, 3 AS label, 'page' AS title FROM pages),
latest AS (SELECT path, arg_max(label, seq) AS label, arg_max(client, seq) FILTER (WHERE client IS NOT NULL) AS client,
                  arg_max(title, seq) FILTER (WHERE title IS NOT NULL) AS title FROM changes GROUP BY path)
SELECT coalesce(c.path, l.path) AS path, coalesce(l.client, c.client) AS client, coalesce(l.label, c.label) AS label,
       coalesce(l.title, c.title) AS title
FROM catalog c FULL JOIN latest l ON c.path = l.path""")
def document_catalog_upsert(spark, sf_dir):
    changes = view(spark, sf_dir, "documents").selectExpr(
        "concat('/', source, '/', cast(doc_id % 50 AS string)) AS path", "doc_id AS seq",
        "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS client", "cast(doc_id % 4 AS int) AS label",
        "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE concat('doc ', cast(doc_id AS string)) END AS title")
    catalog = view(spark, sf_dir, "pages").selectExpr(
        "concat('/src', cast(page_id % 30 AS string), '/', cast(page_id AS string)) AS path",
        "'old' AS client", "3 AS label", "'page' AS title")
    return R.document_catalog_upsert(catalog, changes)


@query("delivered_vs_blocked", with_views("""
SELECT tool, count_if(tool_invoked) AS delivered, count_if(NOT tool_invoked AND action = 'BLOCK') AS blocked, count(*) AS calls
FROM calls GROUP BY tool""", "calls"))
def delivered_vs_blocked(spark, sf_dir):
    return R.delivered_vs_blocked(view(spark, sf_dir, "calls"))


@query("workload_report", with_views("""
SELECT channel, n, max(CASE WHEN rn = round_even(0.5 * (n - 1), 0) THEN latency_ms END) AS p50,
       max(CASE WHEN rn = round_even(0.95 * (n - 1), 0) THEN latency_ms END) AS p95,
       max(CASE WHEN rn = round_even(0.99 * (n - 1), 0) THEN latency_ms END) AS p99,
       round(n / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) AS calls_per_second
FROM (SELECT channel, latency_ms, ts, count(*) OVER (PARTITION BY channel) AS n,
             row_number() OVER (PARTITION BY channel ORDER BY latency_ms) - 1 AS rn FROM calls)
GROUP BY channel, n""", "calls"))
def workload_report(spark, sf_dir):
    return R.workload_report(view(spark, sf_dir, "calls"), "channel")


@query("export_audit", with_views("""
SELECT id, ts, 'DECISION' AS kind, channel, tool AS target, task_id, principal, action, reason_code, rule_id,
       cast(NULL AS string) AS stage, 'v1' AS policy_version, latency_ms, tool_invoked, synthetic, timings AS evidence
FROM calls""", "calls"))
def export_audit(spark, sf_dir):
    log = view(spark, sf_dir, "calls").selectExpr(
        "*", "'DECISION' AS kind", "tool AS target", "cast(NULL AS string) AS stage", "'v1' AS policy_version",
        "timings AS evidence")
    return export_rows(log)


@query("tool_status", with_views("""
SELECT concat('tool_', cast(p_partkey AS string)) AS name,
       CASE WHEN p_size % 5 = 0 THEN 'quarantined' ELSE 'approved' END AS status, left(sha256(p_name), 12) AS hash,
       p_type AS description, CASE WHEN p_size % 5 = 0 THEN p_brand END AS pending_description FROM part"""))
def tool_status(spark, sf_dir):
    registry = view(spark, sf_dir, "part").selectExpr(
        "concat('tool_', cast(p_partkey AS string)) AS name",
        "CASE WHEN p_size % 5 = 0 THEN 'quarantined' ELSE 'approved' END AS status", "sha2(p_name, 256) AS definition_hash",
        "to_json(named_struct('description', p_type)) AS definition",
        "CASE WHEN p_size % 5 = 0 THEN to_json(named_struct('description', p_brand)) END AS pending_definition")
    return R.tool_status(registry)
