"""Registered authorization and lineage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from callwarden.functions.globs import glob_regexes, hmac_pads
from callwarden.operators import access as A
from callwarden.operators import authorize as Z
from callwarden.operators import flow, tree
from callwarden.operators import ledger as L
from callwarden.operators.decide import collect_findings, is_blocked
from callwarden.plans.registry import query
from callwarden.plans.views import view, with_views
from callwarden.rules.policy import TOOLS
from callwarden.session import cut_lineage
from callwarden.sources.feed import policy_tables

SECRET = b"demo-lease-secret"
HOUR_LIMITS = {"agent": 3, "principal": 2, "global": 16}
LOG_BREAKER = {"blocks": 2, "window_seconds": 21_600}


def _blob(data: bytes) -> str:
    return "'" + "".join(f"\\x{b:02X}" for b in data) + "'::BLOB"


_INNER, _OUTER = (_blob(p) for p in hmac_pads(SECRET))
_SIG = (f"left(sha256({_OUTER} || unhex(sha256({_INNER} || "
        "encode(concat_ws('|', id, agent_id, principal, cast(epoch_us(expires_at) // 1000000 AS VARCHAR)))))), 32)")


def mandates(spark, sf_dir):
    tasks = view(spark, sf_dir, "tasks").withColumn("params", F.create_map(F.lit("client"), F.col("client")))
    return A.resolve_mandates(tasks, policy_tables(spark)["task_profiles"])


def _calls_with_mandate(spark, sf_dir, calls=None):
    m = mandates(spark, sf_dir).select(
        F.col("id").alias("task_id"), "resources", "recipients_allow", "tools", "models", "rejected",
        glob_regexes(F.col("resources")).alias("resource_rx"),
        glob_regexes(F.transform("recipients_allow", F.lower)).alias("recipient_rx"),
    )
    return (view(spark, sf_dir, "requests") if calls is None else calls).join(m, "task_id")


@query("resolve_mandates", with_views("""
SELECT id, profile, rejected, array_to_string(resources, ',') AS resources, array_to_string(recipients_allow, ',') AS recipients,
       array_to_string(tools, ',') AS tools, array_to_string(models, ',') AS models, tokens FROM mandates""", "mandates"))
def resolve_mandates(spark, sf_dir):
    return mandates(spark, sf_dir).select(
        "id", "profile", "rejected", F.array_join("resources", ",").alias("resources"),
        F.array_join("recipients_allow", ",").alias("recipients"), F.array_join("tools", ",").alias("tools"),
        F.array_join("models", ",").alias("models"), "tokens",
    )


_LEASED = f"""
signed AS (SELECT *, {_SIG} AS sig FROM tasks),
leased AS (SELECT r.id, r.ts, r.agent_id, CASE r.id % 9 WHEN 0 THEN NULL WHEN 1 THEN 'nodot'
                  WHEN 2 THEN concat(r.task_id, '.', repeat('0', 32)) WHEN 3 THEN concat('t_none.', s.sig)
                  ELSE concat(r.task_id, '.', s.sig) END AS lease
           FROM requests r JOIN signed s ON s.id = r.task_id)"""


def _leased(spark, sf_dir):
    tasks = view(spark, sf_dir, "tasks")
    sig = A.lease_signature(SECRET, F.col("id"), F.col("agent_id"), F.col("principal"), F.col("expires_at"))
    signed = tasks.select(F.col("id").alias("task_id"), sig.alias("sig"))
    return view(spark, sf_dir, "requests").join(signed, "task_id").select(
        "id", "ts", "agent_id",
        F.expr("""CASE id % 9 WHEN 0 THEN NULL WHEN 1 THEN 'nodot' WHEN 2 THEN concat(task_id, '.', repeat('0', 32))
                  WHEN 3 THEN concat('t_none.', sig) ELSE concat(task_id, '.', sig) END""").alias("lease"),
    )


@query("check_leases", with_views(f"""
WITH {_LEASED.strip()}
SELECT l.id, l.lease, CASE WHEN lease IS NULL OR lease NOT LIKE '%.%' THEN 'LEASE_REQUIRED'
  WHEN s.id IS NULL OR split_part(lease, '.', 2) <> s.sig THEN 'LEASE_INVALID'
  WHEN s.agent_id <> l.agent_id THEN 'LEASE_AGENT_MISMATCH'
  WHEN s.status <> 'active' THEN 'CAPABILITY_' || upper(s.status)
  WHEN s.expires_at <= l.ts THEN 'CAPABILITY_EXPIRED' END AS lease_reason
FROM leased l LEFT JOIN signed s ON s.id = split_part(l.lease, '.', 1)""", "tasks", "requests"))
def check_leases(spark, sf_dir):
    out = A.check_leases(_leased(spark, sf_dir), view(spark, sf_dir, "tasks"), SECRET)
    return out.select("id", "lease", "lease_reason")


@query("check_tool", with_views(f"""
SELECT r.id, r.tool, CASE WHEN r.tool NOT IN ({", ".join(f"'{t}'" for t in TOOLS)}) THEN 'TOOL-UNKNOWN'
  WHEN NOT coalesce(list_contains(m.tools, r.tool), false) THEN 'MANDATE-TOOL' END AS rule_id
FROM requests r JOIN mandates m ON m.id = r.task_id""", "requests", "mandates"))
def check_tool(spark, sf_dir):
    out = _calls_with_mandate(spark, sf_dir)
    return out.select("id", "tool", A.tool_finding(F.col("tool"), F.col("tools"))["rule_id"].alias("rule_id"))


@query("check_resource", with_views("""
SELECT r.id, r.path, NOT contains(r.path, '..') AND coalesce(len(list_filter(m.resources, lambda g: r.path GLOB g)) > 0, false) AS allowed
FROM requests r JOIN mandates m ON m.id = r.task_id""", "requests", "mandates"))
def check_resource(spark, sf_dir):
    out = _calls_with_mandate(spark, sf_dir)
    return out.select("id", "path", A.resource_allowed(F.col("path"), F.col("resource_rx")).alias("allowed"))


@query("check_recipient", with_views("""
SELECT r.id, r.recipient, coalesce(len(list_filter(m.recipients_allow, lambda g: lower(trim(r.recipient)) GLOB lower(g))) > 0, false) AS allowed
FROM requests r JOIN mandates m ON m.id = r.task_id""", "requests", "mandates"))
def check_recipient(spark, sf_dir):
    out = _calls_with_mandate(spark, sf_dir)
    return out.select("id", "recipient", A.recipient_allowed(F.col("recipient"), F.col("recipient_rx")).alias("allowed"))


@query("check_model", with_views("""
SELECT r.id, r.model, CASE WHEN NOT (r.model GLOB 'mock/echo' OR r.model GLOB 'main/*') THEN 'MODEL-001'
  WHEN m.models IS NOT NULL AND NOT list_contains(m.models, r.model) THEN 'MANDATE-MODEL' END AS rule_id
FROM requests r JOIN mandates m ON m.id = r.task_id""", "requests", "mandates"))
def check_model(spark, sf_dir):
    out = _calls_with_mandate(spark, sf_dir)
    return out.select("id", "model", A.model_reason(F.col("model"), F.col("models")).alias("rule_id"))


_SINK = """CASE WHEN tool = 'mail.send' THEN CASE WHEN lower(split_part(recipient, '@', 2)) = 'lawfirm.example'
   THEN 'mail.send:internal' ELSE 'mail.send:external' END ELSE tool END"""


@query("resolve_sink", with_views(f"""
SELECT id, {_SINK} AS sink, CASE WHEN split_part(model, '/', 1) = 'mock' THEN 'llm:local' ELSE 'llm:external' END AS model_sink
FROM requests""", "requests"))
def resolve_sink(spark, sf_dir):
    r = view(spark, sf_dir, "requests")
    return r.select("id", A.resolve_sink(F.col("tool"), F.col("recipient")).alias("sink"),
                    A.resolve_sink(F.col("tool"), F.col("recipient"), F.col("model")).alias("model_sink"))


def _with_clearance(spark, sf_dir):
    r = view(spark, sf_dir, "requests").withColumn("sink", A.resolve_sink(F.col("tool"), F.col("recipient")))
    narrow = F.when(F.col("tokens") % 7 == 0, F.create_map(F.lit("notes.write"), F.lit(1), F.lit("code.run"), F.lit(0)))
    return A.sink_clearance(r.withColumn("narrow", narrow), view(spark, sf_dir, "sinks"), narrowing="narrow")


@query("sink_clearance", with_views(f"""
SELECT r.id, r.sink, least(coalesce(s.clearance, 0), CASE WHEN tokens % 7 = 0 AND r.sink = 'notes.write' THEN 1
       WHEN tokens % 7 = 0 AND r.sink = 'code.run' THEN 0 END) AS clearance
FROM (SELECT *, {_SINK} AS sink FROM requests) r LEFT JOIN sinks s ON s.sink = r.sink""", "requests", "sinks"))
def sink_clearance(spark, sf_dir):
    return _with_clearance(spark, sf_dir).select("id", "sink", "clearance")


_LABEL = "CASE WHEN r.tool = 'legal_db.search' THEN 0 ELSE coalesce(c.label, 2) END"


@query("label_reads", with_views(f"""
SELECT r.id, r.path, {_LABEL} AS label FROM requests r LEFT JOIN catalog c ON c.path = r.path
WHERE r.tool IN ('doc.read', 'legal_db.search')""", "requests", "catalog"))
def label_reads(spark, sf_dir):
    r = view(spark, sf_dir, "requests").where(F.col("tool").isin("doc.read", "legal_db.search"))
    return flow.label_reads(r, view(spark, sf_dir, "catalog")).select("id", "path", "label")


@query("taint_timeline", with_views("""
SELECT id, task_id, coalesce(max(CASE WHEN tool = 'doc.read' THEN coalesce(CASE WHEN id % 9 = 0 THEN NULL ELSE id % 3 END, 2) END)
  OVER (PARTITION BY task_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS level FROM calls""", "calls"))
def taint_timeline(spark, sf_dir):
    out = flow.taint_timeline(view(spark, sf_dir, "calls"), view(spark, sf_dir, "reads"))
    return out.select("id", "task_id", "level")


# what the guard refuses, all findings of mandates, executed reads, and the level of the tree before each call
_GUARD = """
seen AS (SELECT c.id, NOT c.synthetic AND (SELECT count(*) FROM calls b WHERE b.task_id = c.task_id AND b.action = 'BLOCK'
           AND b.ts > c.ts - INTERVAL 21600 SECONDS AND (b.ts < c.ts OR (b.ts = c.ts AND b.id < c.id))) >= 2 AS opened FROM calls c),
counted AS (SELECT c.id, row_number() OVER (PARTITION BY c.agent_id, date_trunc('hour', c.ts) ORDER BY c.ts, c.id) AS a,
    row_number() OVER (PARTITION BY c.principal, date_trunc('hour', c.ts) ORDER BY c.ts, c.id) AS p,
    row_number() OVER (PARTITION BY date_trunc('hour', c.ts) ORDER BY c.ts, c.id) AS g
  FROM calls c JOIN seen s ON s.id = c.id WHERE NOT c.synthetic AND NOT s.opened),
guarded AS (SELECT s.id, CASE WHEN s.opened THEN ['CIRCUIT-001'] WHEN n.a > 3 OR n.p > 2 OR n.g > 16 THEN ['RATE-001'] ELSE cast([] AS VARCHAR[]) END AS guard
  FROM seen s LEFT JOIN counted n ON n.id = s.id)"""
_CHECKED = f"""
checked AS (
  SELECT r.*, {_SINK.replace("tool", "r.tool").replace("recipient", "r.recipient")} AS sink, CASE WHEN len(g.guard) > 0 THEN g.guard
    WHEN r.tool NOT IN ({", ".join(f"'{t}'" for t in TOOLS)}) THEN ['TOOL-UNKNOWN'] ELSE list_filter([
      CASE WHEN NOT coalesce(list_contains(m.tools, r.tool), false) THEN 'MANDATE-TOOL' END,
      CASE WHEN r.tool = 'doc.read' AND (contains(r.path, '..') OR NOT coalesce(len(list_filter(m.resources, lambda g: r.path GLOB g)) > 0, false))
        THEN 'MANDATE-RES' END,
      CASE WHEN r.tool = 'mail.send' AND NOT coalesce(len(list_filter(m.recipients_allow, lambda g: lower(trim(r.recipient)) GLOB lower(g))) > 0, false)
        THEN 'MANDATE-RCPT' END,
      CASE WHEN r.tool = 'code.run' AND r.synthetic THEN 'SBX-001' END,
      CASE WHEN r.tool = 'legal_db.search' THEN 'ATK-MCP-POISON-001' END], lambda x: x IS NOT NULL) END AS early
  FROM requests r JOIN mandates m ON m.id = r.task_id JOIN guarded g ON g.id = r.id),
up AS (SELECT c.ancestor_id AS task_id, x.ts, x.id, coalesce(k.label, 2) AS label FROM checked x LEFT JOIN catalog k ON k.path = x.path
       JOIN closure c ON c.task_id = x.task_id WHERE x.tool = 'doc.read' AND len(x.early) = 0),
seeds AS (SELECT c.task_id, max(u.label) AS seed FROM closure c JOIN tasks v ON v.id = c.via_id
          JOIN up u ON u.task_id = c.ancestor_id AND u.ts < v.created_at GROUP BY 1),
reached AS (SELECT x.id, max(u.label) AS label FROM checked x JOIN up u ON u.task_id = x.task_id AND (u.ts < x.ts OR (u.ts = x.ts AND u.id < x.id)) GROUP BY 1),
leveled AS (SELECT x.*, greatest(coalesce(r.label, 0), coalesce(d.seed, 0)) AS level, coalesce(s.clearance, 0) AS clearance,
    x.tool NOT IN ('doc.read', 'memory.read') AS writes
  FROM checked x LEFT JOIN reached r ON r.id = x.id LEFT JOIN seeds d ON d.task_id = x.task_id LEFT JOIN sinks s ON s.sink = x.sink)"""
_CALL_VIEWS = ("requests", "mandates", "catalog", "sinks", "tasks", "closure", "calls")


def _guarded(spark, sf_dir):
    """What breaker and rate limit say of each call; stored in narrow rows, as the breaker is read several times and the result for reads and calls."""
    log = L.circuit_breaker(view(spark, sf_dir, "calls").select("id", "ts", "task_id", "agent_id", "principal", "synthetic", "action"), **LOG_BREAKER)
    log = cut_lineage(log.drop("task_id", "action"))
    return cut_lineage(L.rate_limit(log, HOUR_LIMITS, bucket_seconds=3600).select(
        "id", "recent_blocks", "breaker_refused", "rate_scope", "rate_count", "rate_refused"))


def _judged_calls(spark, sf_dir, arguments, guard, tool=None):
    """Calls (of one tool) with guard and mandate findings and the sink."""
    args = F.create_map(*[x for k, v in arguments.items() for x in (F.lit(k), v)])
    calls = view(spark, sf_dir, "requests")
    if tool is not None:
        calls = calls.where(F.col("tool") == tool)
    # the guard first: of a part of the guard's calls only these look for their mandate
    calls = _calls_with_mandate(spark, sf_dir, calls.join(guard, "id")).withColumns({
        "args": args, "sink": A.resolve_sink(F.col("tool"), F.col("recipient")),
        "tool_status": F.when(F.col("tool") == "legal_db.search", "quarantined").otherwise("approved")})
    return Z.check_calls(calls, LOG_BREAKER, code_mode=F.when(F.col("synthetic"), "block").otherwise("sandbox"))


def _split_calls(spark, sf_dir):
    """The log in two parts, and when the levels of its tasks rise.

    Calls that guard or mandate refuse: id, ts, task_id, tool, sink, findings; those of the guard need neither mandate nor texts. Calls
    still open: with path, recipient, body and tokens. What the guard lets through is judged once and stored, for both parts and the reads.
    """
    guard = _guarded(spark, sf_dir)
    where = {"path": F.col("path"), "to": F.col("recipient")}
    judged = cut_lineage(_judged_calls(spark, sf_dir, where, guard.where(~Z.guard_refuses())).select(
        "id", "ts", "task_id", "tool", "path", "recipient", "body", "tokens", "sink", "findings"))
    requests = view(spark, sf_dir, "requests").where(F.col("task_id").isNotNull()).select(
        "id", "ts", "task_id", "tool", A.resolve_sink(F.col("tool"), F.col("recipient")).alias("sink"))
    stopped = requests.join(guard.where(Z.guard_refuses()), "id").select(*requests.columns, collect_findings(Z.guard_finding(LOG_BREAKER)).alias("findings"))
    reads = Z.executed_reads(judged.withColumn("args", F.create_map(F.lit("path"), F.col("path"))), view(spark, sf_dir, "catalog"))
    tasks = cut_lineage(view(spark, sf_dir, "tasks"))
    risen = flow.rises(tasks, tree.ancestry(tasks), reads)
    return stopped.unionByName(judged.where(~Z.is_open()).select(stopped.columns)), judged.where(Z.is_open()), risen


def _checked_calls(spark, sf_dir, parts=None):
    """Calls still open after guard and mandate, with arguments, clearance, and the level of their tree."""
    _, calls, risen = parts or _split_calls(spark, sf_dir)
    arguments = {"path": "path", "to": "recipient", "query": "body", "body": "body", "code": "body", "content": "body"}
    fixed = {"title": "note", "subject": "hello", "url": "https://x.example/in", "key": "k1"}
    args = F.create_map(*[x for k, v in arguments.items() for x in (F.lit(k), F.col(v))], *[F.lit(x) for pair in fixed.items() for x in pair])
    return A.sink_clearance(flow.levels_from(calls.withColumn("args", args), risen), view(spark, sf_dir, "sinks"))


@query("flow_violations", with_views(f"""
WITH {_GUARD.strip()}, {_CHECKED.strip()}
SELECT id, task_id, sink, level, clearance FROM leveled WHERE writes AND level > clearance""", *_CALL_VIEWS))
def flow_violations(spark, sf_dir):
    """Writes that would leak, whatever else is wrong with the call: levels come from executed reads in the whole tree."""
    silent = [t for t, spec in TOOLS.items() if spec.get("writes") is False]
    judged = _judged_calls(spark, sf_dir, {"path": F.col("path"), "to": F.col("recipient")}, _guarded(spark, sf_dir))
    # read for the levels and for the writes: stored once, without arguments
    slim = cut_lineage(judged.select("id", "ts", "task_id", "tool", "path", "sink", is_blocked(F.col("findings")).alias("refused")))
    reads = flow.label_reads(slim.where((F.col("tool") == "doc.read") & ~F.col("refused")), view(spark, sf_dir, "catalog"))
    tasks = view(spark, sf_dir, "tasks")
    written = slim.where(~F.col("tool").isin(silent))
    leveled = flow.tree_levels(written, tasks, tree.ancestry(tasks), reads)
    out = flow.flow_violations(A.sink_clearance(leveled, view(spark, sf_dir, "sinks")).withColumn("writes", F.lit(True)))
    return out.select("id", "task_id", "sink", "level", "clearance")


@query("authorize_calls", with_views(f"""
WITH {_GUARD.strip()}, {_CHECKED.strip()},
content AS (SELECT *, CASE WHEN len(early) > 0 THEN early ELSE list_filter([
    CASE WHEN tool = 'code.run' AND body LIKE 'os.system%' THEN 'ATK-EXEC-001' END,
    CASE WHEN body LIKE '%; drop table t%' THEN 'ATK-SQLI-001' END,
    CASE WHEN body LIKE 'key AKIA%' THEN 'SEC-001' END,
    CASE WHEN clearance < 2 AND body LIKE 'card %' THEN 'PII-001' END,
    CASE WHEN level > clearance THEN 'IFC-001' END], lambda x: x IS NOT NULL AND writes) END AS found FROM leveled),
asked AS (SELECT *, CASE WHEN tool = 'http.post' AND (len(found) = 0 OR found = ['PII-001']) THEN list_append(found, 'APPROVAL-001') ELSE found END AS rules FROM content)
SELECT id, tool, sink, level, CASE WHEN len(rules) = 0 THEN 'ALLOW' WHEN rules = ['PII-001'] THEN 'REDACT' ELSE 'BLOCK' END AS action,
  list_filter(rules, lambda x: x <> 'PII-001' OR rules = ['PII-001'])[1] AS rule_id, array_to_string(rules, ',') AS rules FROM asked""", *_CALL_VIEWS))
def authorize_calls(spark, sf_dir):
    """One decision per call of the log; no approval has been given."""
    refused, calls, risen = _split_calls(spark, sf_dir)
    risen = cut_lineage(risen)
    columns = ["id", "tool", "sink", "level", "findings", "decision"]
    decided = Z.authorize(_checked_calls(spark, sf_dir, (refused, calls, risen))).select(columns)
    out = decided.unionByName(Z.settle(flow.levels_from(refused, risen)).select(columns))
    return out.select("id", "tool", "sink", "level", F.col("decision.action").alias("action"), F.col("decision.rule_id").alias("rule_id"),
                      F.array_join(F.transform("findings", lambda f: f["rule_id"]), ",").alias("rules"))


_CONTENT = """
content AS (SELECT *, CASE WHEN len(early) > 0 THEN early ELSE list_filter([
    CASE WHEN tool = 'code.run' AND body LIKE 'os.system%' THEN 'ATK-EXEC-001' END,
    CASE WHEN body LIKE '%; drop table t%' THEN 'ATK-SQLI-001' END,
    CASE WHEN body LIKE 'key AKIA%' THEN 'SEC-001' END,
    CASE WHEN clearance < 2 AND body LIKE 'card %' THEN 'PII-001' END,
    CASE WHEN level > clearance THEN 'IFC-001' END], lambda x: x IS NOT NULL AND writes) END AS found FROM leveled)"""


@query("grant_requests", with_views(f"""
WITH RECURSIVE {_GUARD.strip()}, {_CHECKED.strip()}, {_CONTENT.strip()},
gated AS (SELECT id, ts, task_id, tool, left(body, 4) AS args FROM content WHERE tool = 'http.post' AND (len(found) = 0 OR found = ['PII-001'])),
verdicts AS (SELECT id AS request_id, CASE WHEN tokens % 5 = 0 THEN 'deny' ELSE 'approve' END AS verdict, ts + (tokens % 6) * INTERVAL 1 DAY AS due FROM requests WHERE tokens % 7 <> 0),
later AS (SELECT g.id, arg_min(n.id, struct_pack(a := n.ts, b := n.id)) AS id2 FROM gated g JOIN gated n ON n.task_id = g.task_id AND n.args = g.args
          AND (n.ts > g.ts OR (n.ts = g.ts AND n.id > g.id)) GROUP BY g.id),
met AS (SELECT g.id, any_value(v.verdict) AS verdict, any_value(v.due) AS due, arg_min(n.id, struct_pack(a := n.ts, b := n.id)) AS id2, min(n.ts) AS ts2
        FROM gated g JOIN verdicts v ON v.request_id = g.id JOIN gated n ON n.task_id = g.task_id AND n.args = g.args AND n.ts >= v.due
        AND (n.ts > g.ts OR (n.ts = g.ts AND n.id > g.id)) GROUP BY g.id),
steps AS (SELECT m.id, CASE WHEN verdict = 'approve' AND ts2 < due + INTERVAL 2 DAY THEN m.id2 END AS used,
                 CASE WHEN verdict = 'approve' AND ts2 < due + INTERVAL 2 DAY THEN l.id2 ELSE m.id2 END AS id2 FROM met m LEFT JOIN later l ON l.id = m.id2),
openers AS (SELECT arg_min(id, struct_pack(a := ts, b := id)) AS id FROM gated GROUP BY task_id, args
            UNION ALL SELECT s.id2 FROM openers o JOIN steps s ON s.id = o.id WHERE s.id2 IS NOT NULL),
requested AS (SELECT g.id, arg_max(o.id, struct_pack(a := h.ts, b := h.id)) AS request_id FROM gated g JOIN gated h ON h.task_id = g.task_id AND h.args = g.args
              AND (h.ts < g.ts OR (h.ts = g.ts AND h.id <= g.id)) JOIN openers o ON o.id = h.id GROUP BY g.id),
answered AS (SELECT c.id, c.tool, q.request_id, CASE WHEN q.id IS NULL THEN found WHEN s.used = c.id THEN list_append(found, 'APPROVAL-OK') ELSE list_append(found, 'APPROVAL-001') END AS rules
             FROM content c LEFT JOIN requested q ON q.id = c.id LEFT JOIN steps s ON s.id = q.request_id)
SELECT id, tool, cast(request_id AS VARCHAR) AS request_id, CASE WHEN len(list_filter(rules, lambda x: x NOT IN ('APPROVAL-OK', 'PII-001'))) > 0 THEN 'BLOCK' WHEN list_contains(rules, 'PII-001')
  AND NOT list_contains(rules, 'APPROVAL-001') THEN 'REDACT' ELSE 'ALLOW' END AS action, array_to_string(rules, ',') AS rules FROM answered""", *_CALL_VIEWS))
def grant_requests(spark, sf_dir):
    """One decision per call of the log, with requests that refused calls open and people answer."""
    parts = _split_calls(spark, sf_dir)
    # people answer requests, and only open calls can open one
    verdicts = parts[1].where("tokens % 7 <> 0").selectExpr(
        "id AS request_id", "id AS seq", "CASE WHEN tokens % 5 = 0 THEN 'deny' ELSE 'approve' END AS verdict",
        "ts + make_interval(0, 0, 0, cast(tokens % 6 AS int)) AS ts")
    decided = Z.authorize(_checked_calls(spark, sf_dir, parts)).withColumn("same", F.substring("body", 1, 4))
    granted = Z.grant_requests(decided.select("id", "ts", "task_id", "tool", "same", "findings", "decision"), verdicts, ["task_id", "tool", "same"], 172_800)
    columns = ["id", "tool", "findings", "decision"]
    out = granted.select(*columns, "request_id").unionByName(Z.settle(parts[0].select("id", "tool", "findings")).select(columns), allowMissingColumns=True)
    return out.select("id", "tool", "request_id", F.col("decision.action").alias("action"), F.array_join(F.transform("findings", lambda f: f["rule_id"]), ",").alias("rules"))


@query("ancestry", with_views("SELECT task_id, ancestor_id, depth, via_id FROM closure", "closure"))
def ancestry(spark, sf_dir):
    return tree.ancestry(view(spark, sf_dir, "tasks"))


@query("propagate_taint", with_views("""
WITH up AS (SELECT c.ancestor_id AS id, r.ts, coalesce(r.label, 2) AS label FROM reads r JOIN closure c ON c.task_id = r.task_id),
seeds AS (SELECT c.task_id AS id, max(u.label) AS seed FROM closure c JOIN tasks v ON v.id = c.via_id
          JOIN up u ON u.id = c.ancestor_id AND u.ts < v.created_at GROUP BY 1),
own AS (SELECT id, max(label) AS top, min(ts) FILTER (WHERE label >= 1) AS reached_1, min(ts) FILTER (WHERE label >= 2) AS reached_2,
        min(ts) FILTER (WHERE label >= 3) AS reached_3 FROM up GROUP BY 1)
SELECT t.id, coalesce(s.seed, 0) AS seed_level, greatest(coalesce(s.seed, 0), coalesce(o.top, 0)) AS final_level,
       o.reached_1, o.reached_2, o.reached_3
FROM tasks t LEFT JOIN seeds s ON s.id = t.id LEFT JOIN own o ON o.id = t.id""", "tasks", "closure", "reads"))
def propagate_taint(spark, sf_dir):
    tasks = view(spark, sf_dir, "tasks")
    return flow.propagate_taint(tasks, tree.ancestry(tasks), view(spark, sf_dir, "reads"))


@query("memory_labels", with_views("""
WITH RECURSIVE cells AS (SELECT id, ts, task_id, channel, tool, concat('case', cast(tokens % 3 AS string)) AS case_id, concat('k', cast(tokens % 40 AS string)) AS key FROM calls),
writes AS (SELECT * FROM cells WHERE tool = 'notes.write'), recalls AS (SELECT * FROM cells WHERE channel = 'model'),
bound AS (SELECT r.id, any_value(r.ts) AS ts, any_value(r.task_id) AS task_id, arg_max(w.id, struct_pack(a := w.ts, b := w.id)) AS write_id
  FROM recalls r JOIN writes w ON w.case_id = r.case_id AND w.key = r.key AND (w.ts < r.ts OR (w.ts = r.ts AND w.id < r.id)) GROUP BY r.id),
facts AS (
  SELECT c.ancestor_id AS task_id, r.ts, r.id, coalesce(r.label, 2) AS label FROM reads r JOIN closure c ON c.task_id = r.task_id WHERE coalesce(r.label, 2) > 0
  UNION
  SELECT c.ancestor_id, b.ts, b.id, f.label FROM facts f
  JOIN closure u ON u.ancestor_id = f.task_id LEFT JOIN tasks v ON v.id = u.via_id
  JOIN writes w ON w.task_id = u.task_id AND CASE WHEN u.depth = 0 THEN f.ts < w.ts OR (f.ts = w.ts AND f.id < w.id) ELSE f.ts < v.created_at END
  JOIN bound b ON b.write_id = w.id JOIN closure c ON c.task_id = b.task_id)
SELECT w.id, w.task_id, coalesce(max(f.label), 0) AS level FROM writes w JOIN closure u ON u.task_id = w.task_id LEFT JOIN tasks v ON v.id = u.via_id
LEFT JOIN facts f ON f.task_id = u.ancestor_id AND CASE WHEN u.depth = 0 THEN f.ts < w.ts OR (f.ts = w.ts AND f.id < w.id) ELSE f.ts < v.created_at END
GROUP BY w.id, w.task_id""", "calls", "reads", "tasks", "closure"))
def memory_labels(spark, sf_dir):
    """Level that each memory entry stores, with levels that came through other entries."""
    cells = view(spark, sf_dir, "calls").selectExpr("id", "ts", "task_id", "channel", "tool", "concat('case', cast(tokens % 3 AS string)) AS case_id",
                                                    "concat('k', cast(tokens % 40 AS string)) AS key")
    tasks = view(spark, sf_dir, "tasks")
    stored, _, _ = flow.memory_labels(tasks, tree.ancestry(tasks), view(spark, sf_dir, "reads"), cells.where("tool = 'notes.write'"), cells.where("channel = 'model'"))
    return stored.select("id", "task_id", "level")


@query("check_delegations", with_views("""
WITH links AS (SELECT task_id AS id, count(*) AS links FROM closure GROUP BY 1),
j AS (SELECT c.id, c.parent_id, l.links, list_filter(c.tools, lambda t: NOT list_contains(p.tools, t)) AS extra,
        list_filter(c.resources, lambda r: NOT (list_contains(p.resources, r) OR len(list_filter(p.resources, lambda g: r GLOB g)) > 0)) AS bad,
        c.tokens > p.tokens AS over
      FROM mandates c JOIN mandates p ON p.id = c.parent_id JOIN links l ON l.id = c.parent_id
      WHERE c.rejected IS NULL AND p.rejected IS NULL)
SELECT id, parent_id, links, CASE WHEN links > 1 THEN 'DELEGATION_TOO_DEEP' WHEN len(extra) > 0 OR len(bad) > 0 OR over
  THEN 'DELEGATION_ESCALATION' ELSE 'OK' END AS verdict, array_to_string(list_sort(extra), ',') AS extra_tools,
  array_to_string(bad, ',') AS bad_resources FROM j""", "closure", "mandates"))
def check_delegations(spark, sf_dir):
    m = mandates(spark, sf_dir).where(F.col("rejected").isNull())
    links = tree.chain_lengths(view(spark, sf_dir, "tasks"))
    out = tree.check_delegations(m.where(F.col("parent_id").isNotNull()), m, links, max_depth=1)
    return out.withColumn("extra_tools", F.array_join("extra_tools", ",")).withColumn("bad_resources", F.array_join("bad_resources", ","))


@query("apply_status_events", with_views("""
WITH hits AS (SELECT t.id, e.ts, e.id AS event_id, e.status, e.task_id <> t.id AS by_parent FROM tasks t JOIN status_events e
  ON e.task_id = t.id OR (e.task_id = t.parent_id AND e.ts >= t.created_at)),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, event_id) AS rn FROM hits) WHERE rn = 1)
SELECT t.id, t.parent_id, coalesce(f.status, 'active') AS status, f.ts AS changed_at, coalesce(f.by_parent, false) AS by_parent
FROM tasks t LEFT JOIN first f ON f.id = t.id""", "tasks", "status_events"))
def apply_status_events(spark, sf_dir):
    return tree.apply_status_events(view(spark, sf_dir, "tasks"), view(spark, sf_dir, "status_events"))


@query("visible_tools", with_views("""
WITH registry AS (SELECT DISTINCT tool AS name, CASE WHEN tool = 'code.run' THEN 'quarantined' ELSE 'approved' END AS status FROM requests)
SELECT DISTINCT id, tool FROM (SELECT id, unnest(tools) AS tool FROM mandates) t
WHERE tool IN (SELECT name FROM registry WHERE status = 'approved') OR tool IN ('memory.read', 'memory.write')""",
    "requests", "mandates"))
def visible_tools(spark, sf_dir):
    registry = view(spark, sf_dir, "requests").select(F.col("tool").alias("name")).distinct().withColumn(
        "status", F.when(F.col("name") == "code.run", "quarantined").otherwise("approved"))
    return A.visible_tools(mandates(spark, sf_dir), registry)


@query("check_quarantine", with_views("""
SELECT id, tool, CASE WHEN tool IN ('http.post', 'memory.write', 'shell.exec') AND tool NOT IN ('memory.write', 'memory.read', 'shell.exec')
  THEN 'TOOL_QUARANTINED' END AS reason_code FROM requests""", "requests"))
def check_quarantine(spark, sf_dir):
    r = view(spark, sf_dir, "requests")
    status = r.select("tool").distinct().withColumn(
        "tool_status", F.when(F.col("tool").isin("http.post", "memory.write", "shell.exec"), "quarantined").otherwise("approved"))
    out = r.join(status, "tool", "left")
    return out.select("id", "tool", A.quarantine_finding(F.col("tool"), F.col("tool_status"))["reason_code"].alias("reason_code"))


@query("check_code_calls", with_views("""
SELECT id, tool, CASE WHEN tool = 'code.run' THEN 'SBX-001' END AS strict_rule, cast(NULL AS VARCHAR) AS balanced_rule,
       CASE WHEN tool = 'code.run' THEN 'off' END AS off_mode FROM requests""", "requests"))
def check_code_calls(spark, sf_dir):
    tool = F.col("tool")
    return view(spark, sf_dir, "requests").select(
        "id", "tool", A.code_finding(tool, True, "block")["rule_id"].alias("strict_rule"),
        A.code_finding(tool, True, "sandbox")["rule_id"].alias("balanced_rule"),
        A.code_finding(tool, False, "sandbox")["detail"]["mode"].alias("off_mode"),
    )


@query("match_approvals", None)
def match_approvals(spark, sf_dir):
    calls = view(spark, sf_dir, "calls").where(F.col("tool") == "mail.send").select(
        "id", "ts", "task_id", F.lit("http.post").alias("tool"), F.sha2((F.col("tokens") % 2).cast("string"), 256).alias("args_hash"))
    approvals = view(spark, sf_dir, "approvals").withColumn("args_hash", F.sha2("args", 256))
    return A.match_approvals(calls, approvals, ["task_id", "tool", "args_hash"], ttl_seconds=172_800)


@query("decide_approvals", with_views("""
WITH verdicts AS (SELECT concat('apr_', cast(id - id % 40 AS string)) AS request_id, id AS seq, CASE WHEN tokens % 3 = 0 THEN 'deny' ELSE 'approve' END AS verdict, ts
                  FROM calls WHERE channel = 'model'),
requests AS (SELECT concat('apr_', cast(id AS string)) AS id, task_id, tool FROM calls WHERE id % 40 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY seq) AS rn, count(*) OVER (PARTITION BY request_id) AS n FROM verdicts)
SELECT r.id, r.task_id, r.tool, CASE f.verdict WHEN 'approve' THEN 'approved' WHEN 'deny' THEN 'denied' ELSE 'pending' END AS status,
       f.ts AS decided_at, coalesce(f.n - 1, 0) AS conflicts
FROM requests r LEFT JOIN ranked f ON f.request_id = r.id AND f.rn = 1""", "calls"))
def decide_approvals(spark, sf_dir):
    calls = view(spark, sf_dir, "calls")
    verdicts = calls.where(F.col("channel") == "model").select(
        F.expr("concat('apr_', cast(id - id % 40 AS string))").alias("request_id"), F.col("id").alias("seq"),
        F.when(F.col("tokens") % 3 == 0, "deny").otherwise("approve").alias("verdict"), "ts")
    requests = calls.where(F.col("id") % 40 == 0).select(F.expr("concat('apr_', cast(id AS string))").alias("id"), "task_id", "tool")
    return A.decide_approvals(requests, verdicts)


@query("latest_memory", with_views("""
WITH reads AS (SELECT id, ts, concat('case', cast(tokens % 7 AS string)) AS case_id, concat('k', cast(tokens % 13 AS string)) AS key
               FROM calls WHERE channel = 'model'),
hit AS (SELECT r.id, arg_max(e.content, e.id) AS content, arg_max(e.classification, e.id) AS label FROM reads r JOIN memory_entries e
        ON e.case_id = r.case_id AND e.key = r.key AND e.created_at <= r.ts GROUP BY 1),
seen AS (SELECT r.id FROM reads r JOIN (SELECT key, min(created_at) AS first FROM memory_entries GROUP BY 1) e ON e.key = r.key AND e.first <= r.ts)
SELECT r.id, r.ts, r.case_id, r.key, h.content, h.label, CASE WHEN h.id IS NOT NULL THEN 'OK'
  WHEN r.id IN (SELECT id FROM seen) THEN 'MEMORY_CROSS_CASE' ELSE 'MEMORY_NOT_FOUND' END AS reason
FROM reads r LEFT JOIN hit h ON h.id = r.id""", "calls", "memory_entries"))
def latest_memory(spark, sf_dir):
    reads = view(spark, sf_dir, "calls").where(F.col("channel") == "model").selectExpr(
        "id", "ts", "concat('case', cast(tokens % 7 AS string)) AS case_id", "concat('k', cast(tokens % 13 AS string)) AS key")
    entries = view(spark, sf_dir, "memory_entries").withColumnRenamed("created_at", "ts")
    return A.latest_memory(reads, entries)
