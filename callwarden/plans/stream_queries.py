"""Registered streaming queries: each reads a table as a stream, runs to the end and returns its sink table."""

from __future__ import annotations

from pyspark.sql import functions as F

from callwarden.plans.content_queries import _JUDGED, _VARIANTS
from callwarden.plans.ledger_queries import BREAKER
from callwarden.plans.registry import ORACLES, query
from callwarden.plans.views import VIEWS, _K, with_views
from callwarden.sources.tables import spread
from callwarden.streaming import jobs as J


def _calls(spark, sf_dir):
    return spark.sql(VIEWS["calls"].replace("{K}", _K["spark"]), events=J.read_table_stream(spark, sf_dir, "events"))


def _plain_time(df, *names):
    """Back to the timestamp type of the given tables."""
    for n in names:
        df = df.withColumn(n, F.col(n).cast("timestamp_ntz"))
    return df


@query("stream_scan", with_views(f"WITH {_VARIANTS.strip()}, {_JUDGED.strip()} SELECT doc_id, action, rule_id FROM decided", "corpus"))
def stream_scan(spark, sf_dir):
    corpus = spark.sql(VIEWS["corpus"], documents=spread(J.read_table_stream(spark, sf_dir, "documents"), "doc_id"))
    out = J.stream_scan(corpus)
    return J.run_available(out.select("doc_id", F.col("decision.action").alias("action"), F.col("decision.rule_id").alias("rule_id")), "stream_scan")


@query("stream_timeline", with_views("""
SELECT date_trunc('minute', ts) AS minute, action, count(*) AS n FROM calls GROUP BY 1, 2""", "calls"))
def stream_timeline(spark, sf_dir):
    rows, _ = J.upsert_available(J.stream_timeline(_calls(spark, sf_dir)), "stream_timeline", ["minute", "action"])
    return _plain_time(rows, "minute")


@query("stream_late_rows", with_views("SELECT count(*) AS arrived, count(*) AS counted, cast(0 AS BIGINT) AS late FROM calls", "calls"))
def stream_late_rows(spark, sf_dir):
    rows, observed = J.upsert_available(J.stream_timeline(_calls(spark, sf_dir), 5), "stream_late_rows", ["minute", "action"])
    return J.late_rows(rows, observed)


@query("stream_rates", with_views("""
WITH s AS (SELECT date_trunc('hour', ts) AS bucket, unnest(['agent:' || agent_id, 'principal:' || principal, 'global']) AS scope, unnest([3, 2, 16]) AS m FROM calls WHERE NOT synthetic)
SELECT bucket, scope, count(*) AS n, count(*) > any_value(m) AS over FROM s GROUP BY 1, 2""", "calls"))
def stream_rates(spark, sf_dir):
    out = J.stream_rates(_calls(spark, sf_dir), {"agent": 3, "principal": 2, "global": 16}, "1 hour")
    return _plain_time(J.upsert_available(out, "stream_rates", ["bucket", "scope"])[0], "bucket")


def _replayed(spark, sf_dir, job, name, *columns):
    """A replay of the call log to its end."""
    calls, close = J.closable(_calls(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")))
    return J.run_available(job(calls), name, close).select(*columns)


@query("stream_breaker", ORACLES["breaker_feedback"])
def stream_breaker(spark, sf_dir):
    return _replayed(spark, sf_dir, lambda calls: J.stream_breaker(calls.withColumn("blocked", F.col("action") == "BLOCK"), **BREAKER), "stream_breaker",
                     "id", "blocked", "refused")


@query("stream_taint", ORACLES.get("taint_timeline"))
def stream_taint(spark, sf_dir):
    label = F.when(F.col("tool") == "doc.read", F.when(F.col("id") % 9 == 0, 2).otherwise(F.col("id") % 3))
    return _replayed(spark, sf_dir, lambda calls: J.stream_taint(calls.withColumn("label", label)), "stream_taint", "id", "task_id", "level")


@query("stream_budget", with_views("""
WITH RECURSIVE moves AS (
  SELECT id, ts, principal, CASE channel WHEN 'tool' THEN 'settle' WHEN 'mcp' THEN 'uncertain' ELSE 'reserve' END AS kind, id // 4 AS res_id, cast(tokens AS BIGINT) AS tokens,
         row_number() OVER (PARTITION BY principal ORDER BY ts, id) AS rn FROM calls),
walk AS (
  SELECT DISTINCT principal, cast(0 AS BIGINT) AS rn, cast(NULL AS BIGINT) AS id, '' AS kind, '' AS verdict, cast(0 AS BIGINT) AS spent, cast(0 AS BIGINT) AS held,
         cast(0 AS BIGINT) AS used, cast([] AS STRUCT(r BIGINT, a BIGINT)[]) AS held_by FROM moves
  UNION ALL
  SELECT principal, rn, id, kind, verdict, spent + CASE WHEN verdict = 'settle' THEN tokens ELSE 0 END,
         held + CASE verdict WHEN 'admitted' THEN tokens WHEN 'settle' THEN -amount ELSE 0 END, used + CASE WHEN verdict = 'admitted' THEN 1 ELSE 0 END,
         CASE verdict WHEN 'admitted' THEN list_append(held_by, struct_pack(r := res_id, a := tokens)) WHEN 'settle' THEN others WHEN 'uncertain' THEN others ELSE held_by END
  FROM (SELECT *, CASE WHEN kind = 'reserve' AND amount IS NULL THEN CASE WHEN spent + held + tokens <= 9000 AND used < 400 AND len(held_by) < 60 THEN 'admitted' ELSE 'refused' END
                       WHEN kind <> 'reserve' AND amount IS NOT NULL THEN kind ELSE 'ignored' END AS verdict
        FROM (SELECT w.principal, m.rn, m.id, m.kind, m.res_id, m.tokens, w.spent, w.held, w.used, w.held_by, list_filter(w.held_by, lambda x: x.r <> m.res_id) AS others,
                     list_filter(w.held_by, lambda x: x.r = m.res_id)[1].a AS amount FROM walk w JOIN moves m ON m.principal = w.principal AND m.rn = w.rn + 1)))
SELECT id, principal, kind, verdict, spent, held AS reserved FROM walk WHERE rn > 0""", "calls"))
def stream_budget(spark, sf_dir):
    kind = F.when(F.col("channel") == "tool", "settle").when(F.col("channel") == "mcp", "uncertain").otherwise("reserve")
    moves = ["id", "ts", "principal", kind.alias("kind"), F.col("tokens").cast("bigint").alias("tokens"), F.expr("cast(id div 4 AS bigint)").alias("res_id")]
    return _replayed(spark, sf_dir, lambda calls: J.stream_budget(calls.select(*moves), 9_000, 400, 60), "stream_budget",
                     "id", "principal", "kind", "verdict", "spent", "reserved")


@query("stream_breaker_window", with_views("""
WITH w AS (SELECT task_id, ts, unnest(generate_series(0, 5)) AS i FROM calls WHERE action = 'BLOCK'),
s AS (SELECT task_id, time_bucket(INTERVAL 10 MINUTES, ts) - i * INTERVAL 10 MINUTES AS start FROM w)
SELECT start, task_id, count(*) AS blocks FROM s GROUP BY 1, 2""", "calls"))
def stream_breaker_window(spark, sf_dir):
    out = J.stream_breaker_window(_calls(spark, sf_dir), "60 minutes", "10 minutes")
    return _plain_time(J.upsert_available(out, "stream_breaker_window", ["start", "task_id"])[0], "start")


@query("stream_probe_sessions", with_views("""
WITH b AS (SELECT task_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY task_id ORDER BY ts) < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS first FROM calls WHERE action = 'BLOCK'),
g AS (SELECT *, sum(first) OVER (PARTITION BY task_id ORDER BY ts) AS grp FROM b)
SELECT min(ts) AS start, max(ts) + INTERVAL 2 HOURS AS end, task_id, count(*) AS blocks FROM g GROUP BY task_id, grp""", "calls"))
def stream_probe_sessions(spark, sf_dir):
    calls, close = J.closable(_calls(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")))
    return _plain_time(J.run_available(J.stream_probe_sessions(calls, "2 hours"), "stream_probe_sessions", close), "start", "end")


@query("stream_dedup_score", """
WITH RECURSIVE t AS (SELECT conv_id * 1000 + turn AS id, TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL 10 MINUTE + turn * INTERVAL 1 MINUTE AS ts, sha256(text) AS hash
  FROM conversations WHERE text IS NOT NULL),
picked AS (
  SELECT hash, arg_min(id, struct_pack(a := ts, b := id)) AS id, min(ts) AS ts FROM t GROUP BY hash
  UNION ALL
  SELECT p.hash, arg_min(t.id, struct_pack(a := t.ts, b := t.id)), min(t.ts) FROM picked p JOIN t ON t.hash = p.hash AND t.ts >= p.ts + INTERVAL 1 HOUR GROUP BY p.hash)
SELECT id, ts, hash FROM picked""")
def stream_dedup_score(spark, sf_dir):
    texts = J.read_table_stream(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text",
        (F.expr("timestamp'2024-01-01 00:00:00'") + F.make_interval(mins=(F.col("conv_id") * 10 + F.col("turn")).cast("int"))).alias("ts"))
    stream, close = J.closable(texts)
    return _plain_time(J.run_available(J.stream_dedup_score(stream, 3600), "stream_dedup_score", close).select("id", "ts", "hash"), "ts")
