"""Decisions on single calls, levels over the tree, deep and looping delegation chains, limits of reports."""

import datetime as dt
import random

from pyspark.sql import functions as F

from callwarden.functions.globs import glob_regexes
from callwarden.operators import authorize as Z
from callwarden.operators import access, flow, reporting, tree

START = dt.datetime(2024, 1, 1)
ALL = ["doc.read", "notes.write", "mail.send", "http.post", "code.run", "memory.write"]
# id, tool, args, mandate tools, sink, clearance, level, breaker, rate, registry, approval -> action, rules
CALLS = [
    (1, "notes.write", {"body": "minutes of Monday"}, ALL, "notes.write", 2, 0, False, False, "approved", None, "ALLOW", ""),
    (2, "notes.write", {"body": "x"}, ALL, "notes.write", 2, 0, True, True, "approved", None, "BLOCK", "CIRCUIT-001"),
    (3, "shell.exec", {"body": "x"}, ALL, "shell.exec", 0, 3, False, True, "approved", None, "BLOCK", "RATE-001"),
    (4, "shell.exec", {"body": "rm -rf / # now"}, ALL, "shell.exec", 0, 3, False, False, "approved", None, "BLOCK", "TOOL-UNKNOWN"),
    (5, "doc.read", {"path": "/private/1"}, ["mail.send"], "doc.read", 0, 3, False, False, "quarantined", None, "BLOCK",
     "MANDATE-TOOL,MANDATE-RES,ATK-MCP-POISON-001"),
    (6, "doc.read", {"path": "/public/1"}, ALL, "doc.read", 0, 3, False, False, "approved", None, "ALLOW", ""),
    (7, "mail.send", {"to": "x@evil.example", "body": "rm -rf / # now"}, ALL, "mail.send:external", 0, 0, False, False, "approved", None, "BLOCK", "MANDATE-RCPT"),
    (8, "mail.send", {"to": " Ann@firm.example", "subject": "card", "body": "4111-1111-1111-1111"}, ALL, "mail.send:external", 0, 0, None, None, None, None,
     "REDACT", "PII-001"),
    (9, "mail.send", {"to": "ann@firm.example", "body": "4111-1111-1111-1111"}, ALL, "mail.send:internal", 2, 2, False, False, "approved", None, "ALLOW", ""),
    (10, "mail.send", {"to": "ann@firm.example", "body": "4111-1111-1111-1111"}, ALL, "mail.send:external", 0, 1, False, False, "approved", None, "BLOCK",
     "PII-001,IFC-001"),
    (11, "http.post", {"url": "https://x.example/in", "body": "hello"}, ALL, "http.post", 0, 0, False, False, "approved", None, "BLOCK", "APPROVAL-001"),
    (12, "http.post", {"url": "https://x.example/in", "body": "hello"}, ALL, "http.post", 0, 0, False, False, "approved", "apr_1", "ALLOW", "APPROVAL-OK"),
    (13, "http.post", {"url": "https://x.example/in"}, ALL, "http.post", 0, 2, False, False, "approved", "apr_2", "BLOCK", "IFC-001"),
    (14, "notes.write", None, None, "notes.write", 2, 0, False, False, "approved", None, "BLOCK", "MANDATE-TOOL"),
    (15, "notes.write", {"body": None}, ALL, "notes.write", 2, 0, False, False, "approved", None, "ALLOW", ""),
    (16, "memory.write", {"key": "k", "content": "x"}, ALL, "memory.write", 2, 3, False, False, "quarantined", None, "BLOCK", "IFC-001"),
]
SCHEMA = ("id int, tool string, args map<string,string>, tools array<string>, sink string, clearance int, level int, breaker_refused boolean,"
          " rate_refused boolean, tool_status string, approval_id string, action string, rules string")


def _decided(spark):
    calls = spark.createDataFrame(CALLS, SCHEMA).withColumns({
        "task_id": F.lit("t"), "ts": F.lit(START), "recipients_allow": F.array(F.lit("*@firm.example")), "resource_rx": glob_regexes(F.array(F.lit("/public/*"))),
        "recipient_rx": glob_regexes(F.array(F.lit("*@firm.example"))), "recent_blocks": F.lit(11), "rate_scope": F.lit("global"), "rate_count": F.lit(9)})
    return Z.authorize(Z.check_calls(calls))


def test_decision_of_each_call(spark):
    out = _decided(spark).select("id", "action", "rules", F.col("decision.action").alias("got"),
                                 F.array_join(F.transform("findings", lambda f: f["rule_id"]), ",").alias("found")).collect()
    assert len(out) == len(CALLS)
    for r in out:
        assert (r["got"], r["found"]) == (r["action"], r["rules"]), r["id"]
    assert _decided(spark).where("id < 0").count() == 0


def test_budget_comes_last(spark):
    admission = spark.createDataFrame([(1, False, "task:t", "tokens"), (11, False, "global", "calls"), (12, True, None, None)],
                                      "id int, admitted boolean, scope string, dimension string")
    got = {r["id"]: r["decision"]["rule_id"] for r in Z.refuse_over_budget(_decided(spark), admission).collect()}
    assert (got[1], got[11], got[12], got[6]) == ("BUD-002", "APPROVAL-001", None, None) and len(got) == len(CALLS)


def test_levels_come_from_the_tree(spark):
    at = [START + dt.timedelta(minutes=m) for m in range(10)]
    tasks = spark.createDataFrame([("root", None, at[0]), ("kid", "root", at[2]), ("late", "root", at[6])], "id string, parent_id string, created_at timestamp_ntz")
    reads = spark.createDataFrame([(5, at[4], "kid", 2), (7, at[7], "late", 3)], "id int, ts timestamp_ntz, task_id string, label int")
    calls = spark.createDataFrame([(1, at[3], "root"), (2, at[5], "root"), (3, at[5], "kid"), (4, at[6], "late"), (8, at[8], "kid"), (9, at[8], "root"), (10, at[8], "other")],
                                  "id int, ts timestamp_ntz, task_id string")
    got = {r["id"]: r["level"] for r in flow.tree_levels(calls, tasks, tree.ancestry(tasks), reads).collect()}
    assert got == {1: 0, 2: 2, 3: 2, 4: 2, 8: 2, 9: 3, 10: 0}


def test_labels_travel_through_memory(spark):
    """Against a replay in time order, on a chain of writes and recalls and on random logs."""
    rng = random.Random(4)
    at = [START + dt.timedelta(minutes=m) for m in range(400)]
    parent = {"a": None, "b": None, "c": None, "a1": "a", "a2": "a1", "b1": "b"}
    born = {t: at[rng.randrange(3, 40)] if p else at[0] for t, p in parent.items()}
    ops = [(0, at[1], "c", "read", 3, ""), (1, at[2], "c", "write", None, "k0")]
    for i in range(8):  # c -> a -> b -> a ...: each recall raises the next writer
        ops += [(10 + 2 * i, at[3 + 2 * i], "ab"[i % 2], "recall", None, f"k{i}"), (11 + 2 * i, at[4 + 2 * i], "ab"[i % 2], "write", None, f"k{i + 1}")]
    ops += [(100 + i, at[50 + rng.randrange(300)], rng.choice(list(parent)), rng.choice(["write", "recall", "recall", "read"]), rng.choice([None, 0, 1, 2, 3]), rng.choice("xyz"))
            for i in range(200)]
    for chosen in (ops[:18], ops):
        level, cells, wrote, labels = {}, {}, {}, {}
        for i, ts, task, kind, label, key in sorted(chosen, key=lambda o: (o[1], o[0])):
            for t in sorted((t for t in parent if t not in level and born[t] <= ts), key=lambda t: born[t]):
                level[t] = level.get(parent[t], 0)
            got = None
            if kind == "read":
                got = 2 if label is None else label
            elif kind == "recall" and key in cells:
                got = cells[key]
            elif kind == "write":
                cells[key] = wrote[i] = level.get(task, 0)
            if got is not None:
                labels[i] = got
                while task:
                    level[task] = max(level.get(task, level.get(parent[task], 0)), got)
                    task = parent[task]

        def frame(kind):
            return spark.createDataFrame([(i, ts, t, "case", k, label) for i, ts, t, o, label, k in chosen if o == kind],
                                         "id long, ts timestamp_ntz, task_id string, case_id string, key string, label int")

        tasks = spark.createDataFrame([(t, p, born[t]) for t, p in parent.items()], "id string, parent_id string, created_at timestamp_ntz")
        stored, every, rounds = flow.memory_labels(tasks, tree.ancestry(tasks), frame("read"), frame("write"), frame("recall"))
        assert {r.id: r.level for r in stored.collect()} == wrote and rounds <= 12
        assert {r.id: r.label for r in every.collect() if r.label} == {i: v for i, v in labels.items() if v}


def test_requests_open_and_answer_in_time_order(spark):
    seen = set()
    for span, seed in ((60, 1), (60, 2), (3000, 3)):
        rng = random.Random(seed)
        calls = [(i, START + dt.timedelta(seconds=rng.randrange(span)), rng.choice("xxy")) for i in range(150)]
        verdicts = [(i, n, rng.choice(["approve", "approve", "deny"]), ts + dt.timedelta(seconds=rng.choice([0, 0, 5, 40, 200]))) for i, ts, _ in calls if i % 6
                    for n in range(rng.randrange(1, 3))]
        first = {}
        for r, n, verdict, ts in verdicts:
            first.setdefault(r, (verdict, ts))
        want, pending, approved = {}, {}, {}
        for i, ts, k in sorted(calls, key=lambda c: (c[1], c[0])):
            if k in pending and pending[k] in first and first[pending[k]][1] <= ts:
                verdict, when = first[pending[k]]
                if verdict == "approve":
                    approved[k] = (pending[k], when)
                del pending[k]
            if k in approved and (ts - approved[k][1]).total_seconds() < 100:
                want[i] = (approved.pop(k)[0], False, "APPROVAL-OK")
                continue
            approved.pop(k, None)
            opened = k not in pending
            pending.setdefault(k, i)
            want[i] = (pending[k], opened, "APPROVAL-001")
        c = spark.createDataFrame(calls, "id int, ts timestamp_ntz, k string")
        v = spark.createDataFrame(verdicts, "request_id int, seq int, verdict string, ts timestamp_ntz")
        got = {r.id: (r.request_id, r.opened, r.rule_id) for r in access.request_approvals(c, v, ["k"], 100).collect()}
        assert got == want
        seen |= {w[2] for w in want.values()}
    assert seen == {"APPROVAL-OK", "APPROVAL-001"}
    assert access.request_approvals(c.limit(0), v, ["k"], 100).count() == 0


def test_refused_reads_taint_nobody(spark):
    rows = [(1, "doc.read", "/public/a", []), (2, "doc.read", "/secret/a", [])]
    checked = spark.createDataFrame(rows, "id int, tool string, path string, none array<string>").withColumns({
        "ts": F.lit(START), "task_id": F.lit("t"), "args": F.create_map(F.lit("path"), F.col("path")), "tools": F.array(F.lit("doc.read")),
        "recipients_allow": F.col("none"), "resource_rx": glob_regexes(F.array(F.lit("/public/*"))), "recipient_rx": F.col("none"),
        "tool_status": F.lit("approved"), "recent_blocks": F.lit(0), "breaker_refused": F.lit(False), "rate_scope": F.lit(None).cast("string"),
        "rate_count": F.lit(0), "rate_refused": F.lit(False)})
    catalog = spark.createDataFrame([("/public/a", 1), ("/secret/a", 3)], "path string, label int")
    assert [(r["id"], r["label"]) for r in Z.executed_reads(Z.check_calls(checked), catalog).collect()] == [(1, 1)]


def test_deep_and_looping_chains(spark):
    n = 104  # beyond the 100 levels that recursion allows by default
    tasks = spark.createDataFrame([(f"t{i}", f"t{i - 1}" if i else None) for i in range(n)], "id string, parent_id string").coalesce(1)
    up = tree.ancestry(tasks).groupBy().agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("d")).first()
    assert (up["n"], up["d"]) == (n * (n + 1) // 2, n - 1)
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent_id string")
    assert sorted((r["task_id"], r["ancestor_id"]) for r in tree.ancestry(loop).collect()) == [("a", "a"), ("a", "b"), ("b", "a"), ("b", "b")]


def test_closure_of_trees_with_cycles_above_tasks(spark):
    parent = {f"n{i}": f"n{(i * 7 + 3) % i if i else 0}" for i in range(40)}  # n0 is its own parent
    parent |= {"c0": "c1", "c1": "c2", "c2": "c3", "c3": "c4", "c4": "c0", "top": None, "kid": "top", "lost": "absent"}
    parent |= {f"b{i}": f"b{i - 1}" if i else "c2" for i in range(9)}
    want = set()
    for t in parent:
        at, below, depth, seen = t, None, 0, set()
        while at in parent and at not in seen:
            want.add((t, at, depth, below))
            seen.add(at)
            at, below, depth = parent[at], at, depth + 1
    tasks = spark.createDataFrame(list(parent.items()), "id string, parent_id string")
    got = [tuple(r) for r in tree.ancestry(tasks).select("task_id", "ancestor_id", "depth", "via_id").collect()]
    assert set(got) == want and len(got) == len(want)
    lengths = {r["id"]: (r["links"], r["root_id"]) for r in tree.chain_lengths(tasks).collect()}
    assert lengths["kid"] == (2, "top") and lengths["lost"] == (1, "lost") and lengths["b8"] == lengths["c1"] == (None, None) and len(lengths) == len(parent)
    assert tree.ancestry(tasks.limit(0)).count() == 0 == tree.chain_lengths(tasks.limit(0)).count()


def test_a_chain_of_fifty_thousand_tasks(spark):
    n = 50_000
    tasks = spark.range(n).selectExpr("concat('t', id) AS id", "CASE WHEN id > 0 THEN concat('t', id - 1) END AS parent_id")
    got = tree.chain_lengths(tasks).agg(F.max("links"), F.sum("links"), F.count_distinct("root_id")).first()
    assert tuple(got) == (n, n * (n + 1) // 2, 1)


def test_reports_give_what_is_asked_for(spark):
    log = spark.range(12_000).select("id", F.lit(False).alias("synthetic"), F.lit("BLOCK").alias("action"))
    assert reporting.audit_query(log, limit=None).count() == 12_000 and reporting.audit_query(log, limit=11_000).count() == 11_000


def test_guard_of_the_call_log_is_worked_out_once(spark):
    """Breaker and rate limit were worked out for the reads and again for the calls; reads were judged with all other calls."""
    from callwarden.plans import access_queries as Q

    folder = "/root/testdata/sf0.001"
    checked = Q._checked_calls(spark, folder)
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    guard = Q._guarded(spark, folder)
    path = {"path": F.col("path"), "to": F.col("recipient")}
    reads = Q._judged_calls(spark, folder, path, guard, "doc.read").select("id", "findings").collect()
    every = {r.id: r.findings for r in Q._judged_calls(spark, folder, {**path, "body": F.col("body")}, guard).where("tool = 'doc.read'").collect()}
    assert {r.id: r.findings for r in reads} == every and every


def test_only_open_calls_reach_the_scan(spark):
    """Calls that guard or mandate had refused went through levels and the scan of texts with all others."""
    from callwarden.operators.decide import is_blocked
    from callwarden.plans import access_queries as Q

    folder = "/root/testdata/sf0.001"
    scanned = Q._checked_calls(spark, folder)
    assert scanned.where(is_blocked(F.col("findings"))).count() == 0
    refused, calls, _ = Q._split_calls(spark, folder)
    logged = Q.view(spark, folder, "requests")
    assert 0 < scanned.count() == calls.count() < logged.count()
    both = refused.select("id").unionByName(scanned.select("id"))
    assert both.count() == logged.count() == both.join(logged, "id", "left_semi").distinct().count()
    assert refused.where(~is_blocked(F.col("findings"))).count() == 0
