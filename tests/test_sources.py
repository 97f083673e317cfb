"""Sources and sinks, globs, leases, feeds and plan shape."""

import fnmatch
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from callwarden.functions.globs import glob_to_regex, hmac_sha256
from callwarden.operators import reporting
from callwarden.plans import load
from callwarden.sources import audit, feed, files

SF = "/root/testdata/sf0.001"


def test_globs_and_hmac_match_python(spark):
    globs = ["*", "/a/*", "a?c", "[a-c]x", "[!a]x", "x[", "a.b", "*.p(y)", "a+b"]
    values = ["", "/a/b/c", "abc", "bx", "zx", "x[", "axb", "a.b", "q.p(y)", "a+b", "a\nc"]
    df = spark.createDataFrame([(g, v) for g in globs for v in values], "g string, v string")
    for r in df.select("g", "v", F.rlike("v", glob_to_regex(F.col("g"))).alias("m")).collect():
        assert r["m"] == fnmatch.fnmatchcase(r["v"], r["g"]), (r["g"], r["v"])
    for secret in (b"k", b"x" * 100):
        got = spark.range(1).select(hmac_sha256(secret, F.lit("a|b|c"))).first()[0]
        assert got == hmac.new(secret, b"a|b|c", hashlib.sha256).hexdigest()


def test_feed_is_validated(spark):
    good = feed.builtin_feed(spark)
    assert {r["id"] for r in feed.compile_feed(good)} >= {"ATK-EXEC-003", "ATK-MCP-POISON-001"}
    with pytest.raises(ValueError, match="duplicate id"):
        feed.signature_table(good.unionByName(good))
    off = good.withColumn("enabled", F.col("id") != "ATK-XSS-001")
    assert "ATK-XSS-001" not in {r["id"] for r in feed.compile_feed(off)}
    tables = feed.policy_tables(spark)
    assert feed.sink_problems(tables["sinks"]).count() == 0 and feed.threshold_problems(tables["profiles"], ["profile"]).count() == 0


def test_audit_round_trip_export_and_stream(spark, tmp_path):
    rows = spark.range(50).select(
        "id", F.expr("timestamp_seconds(1700000000 + id * 4000)").alias("ts"), F.lit("t").alias("task_id"), F.lit("p").alias("principal"),
        F.lit("DECISION").alias("kind"), F.lit("tool").alias("channel"), F.lit("x").alias("target"), F.lit("BLOCK").alias("action"),
        F.lit("R").alias("reason_code"), F.lit("R-1").alias("rule_id"), F.lit("s").alias("stage"), F.lit("v1").alias("policy_version"),
        F.lit(1.5).alias("latency_ms"), F.lit(False).alias("tool_invoked"), (F.col("id") % 5 == 0).alias("synthetic"), F.lit('{"a":1}').alias("evidence"))
    path = str(tmp_path / "log")
    audit.append_audit(rows.where("id < 30"), path)
    audit.append_audit(rows.where("id >= 30"), path)
    log = audit.read_audit(spark, path)
    assert log.count() == 50 and reporting.audit_query(log, action="BLOCK", limit=5).first()["id"] == 49
    audit.export_audit(log, str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "csv")).columns == [*audit.EXPORT_COLUMNS, "evidence"]
    from callwarden.streaming.jobs import run_available

    assert run_available(audit.read_decision_stream(spark, path), "feed").count() == 40


def test_files_and_size_limit(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"x" * 10)
    (tmp_path / "b.bin").write_bytes(b"y" * 100)
    assert [r["name"] for r in files.read_files(spark, str(tmp_path), max_bytes=50).collect()] == ["a.txt"]
    assert files.oversized(spark, str(tmp_path), 50).count() == 1


def test_reports_prune_and_push_down(spark):
    from callwarden.plans.views import view

    plan = reporting.audit_query(view(spark, SF, "calls"), since="2024-01-05 00:00:00").select("id", "ts")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-05" in plan and "TakeOrderedAndProject" in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in plan


def test_scan_is_narrow_and_filters_do_not_repeat_it(spark):
    from callwarden.operators import content as C

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    out = C.evaluate(docs).where(F.col("decision.action") == "BLOCK")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") <= 2


def test_every_query_is_registered_with_sql_or_tested():
    registry = load()
    without = set(registry.QUERIES) - set(registry.ORACLES)
    assert without <= {"match_approvals", "admit_requests", "guard_cost", "pii_scan", "evaluate"}
