"""Order-dependent operators against a plain sequential replay on small logs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from callwarden.operators import access, ledger
from callwarden.operators import running as running_module
from callwarden.operators.running import equi_depth, exact_quantiles, running

START = dt.datetime(2024, 1, 1)


def _at(seconds):
    return START + dt.timedelta(seconds=seconds)


def test_running_matches_sequential(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("aab"), _at(rng.randrange(500)), rng.randrange(9)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, k string, ts timestamp_ntz, v int")
    for depth in (1_000_000, 120, 7):
        for reverse in (False, True):
            out = running(df, ["k"], ["ts", "id"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, inclusive=False, reverse=reverse, depth=depth)
            got = {r["id"]: (r["s"], r["m"]) for r in out.collect()}
            assert len(got) == len(rows)
            for key in "ab":
                total, top = 0, None
                for i, _, _, v in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]), reverse=reverse):
                    assert got[i] == (total, top)
                    total, top = total + v, v if top is None else max(top, v)


def test_chunks_of_one_instant_and_of_close_values_are_bounded(spark):
    n, depth = 1_000_000, 100_000
    rows = spark.range(n).select(F.lit("hot").alias("k"), F.lit(START).cast("timestamp").alias("ts"), F.xxhash64("id").alias("id"), F.lit(1).alias("v"))
    sizes = [r["count"] for r in equi_depth(rows, ["k"], ["ts", "id"], n, depth).groupBy("_chunk").count().collect()]
    assert sum(sizes) == n and len(sizes) > 10 and max(sizes) <= depth
    total = running(rows, ["k"], ["ts", "id"], {"at": ("sum", F.col("v"))}, depth=depth).agg(F.min("at"), F.max("at"), F.count_distinct("at")).first()
    assert tuple(total) == (1, n, n)
    values = spark.range(n).select(F.lit("g").alias("g"), (F.pmod(F.xxhash64("id"), F.lit(500_000)) / 500_000).alias("v"))
    got = exact_quantiles(values, ["g"], "v", {"p50": 0.5, "p99": 0.99}, depth=depth).first()
    want = values.selectExpr("percentile(v, 0.5)", "percentile(v, 0.99)").first()
    assert (got.p50, got.p99) == pytest.approx(tuple(want), abs=1e-12)


def test_hot_keys_do_not_change_replays(spark, monkeypatch):
    monkeypatch.setattr(running_module, "DEPTH", 15)
    test_admission_over_overlapping_scopes(spark)
    test_approvals_are_used_once_newest_first(spark)


def test_exact_quantiles_small_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 4.0), ("b", 7.5)], "g string, v double")
    got = {r["g"]: (r["n"], r["p50"], r["p95"]) for r in exact_quantiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    assert got["a"][:2] == (3, 1.0) and abs(got["a"][2] - 3.7) < 1e-9 and got["b"] == (1, 7.5, 7.5)


def test_admission_over_overlapping_scopes(spark):
    rng = random.Random(3)
    reqs = []
    for i in range(120):
        t = rng.randrange(2000)
        settle = t + rng.randrange(1, 300) if rng.random() < 0.8 else None
        actual = rng.randrange(60) if settle is not None and rng.random() < 0.8 else None
        reqs.append((i, _at(t), rng.randrange(1, 50), [f"task:{i % 9}", f"principal:{i % 3}", "global"], _at(settle) if settle else None, actual))
    limits = {f"task:{k}": (150, 8, 2) for k in range(8)} | {f"principal:{k}": (500, 30, 4) for k in range(3)} | {"global": (1200, 70, 7)}
    df = spark.createDataFrame(reqs, "id bigint, ts timestamp_ntz, tokens bigint, scopes array<string>, settle_ts timestamp_ntz, actual bigint")
    lim = spark.createDataFrame([(k, *v) for k, v in limits.items()], "scope string, token_limit bigint, calls_limit bigint, concurrency_limit bigint")
    got = {r["id"]: (r["admitted"], r["scope"], r["dimension"]) for r in ledger.admit(df, lim).collect()}
    moves = [(r[4], 0, r) for r in reqs if r[4]] + [(r[1], 1, r) for r in reqs]
    use, taken = {k: [0, 0, 0] for k in limits}, set()
    for _, kind, r in sorted(moves, key=lambda m: (m[0], m[1], m[2][0])):
        if kind == 0:
            if r[0] in taken:
                for s in r[3]:
                    use[s][0] += (r[5] - r[2]) if r[5] is not None else 0
                    use[s][2] -= 1
            continue
        why = None
        for s in sorted(r[3]):
            if s not in limits:
                why = (s, "missing_scope")
            elif use[s][0] + r[2] > limits[s][0]:
                why = (s, "tokens")
            elif use[s][1] + 1 > limits[s][1]:
                why = (s, "calls")
            elif use[s][2] >= limits[s][2]:
                why = (s, "concurrency")
            if why:
                break
        assert got[r[0]] == (why is None, *(why or (None, None))), r
        if why is None:
            taken.add(r[0])
            for s in r[3]:
                use[s][0], use[s][1], use[s][2] = use[s][0] + r[2], use[s][1] + 1, use[s][2] + 1
    assert 0 < len(taken) < len(reqs)


def test_approvals_are_used_once_newest_first(spark):
    rng = random.Random(5)
    calls = [(i, _at(rng.randrange(3000)), rng.choice("xy")) for i in range(60)]
    approvals = []
    for i in range(40):
        t = rng.randrange(3000)
        status = rng.choice(["approved", "approved", "denied", "pending"])
        approvals.append((f"a{i:02d}", _at(t), None if status == "pending" else _at(t + 40), status, rng.choice("xy")))
    c = spark.createDataFrame(calls, "id int, ts timestamp_ntz, k string")
    a = spark.createDataFrame(approvals, "id string, created_at timestamp_ntz, decided_at timestamp_ntz, status string, k string")
    got = {int(r["call_id"]): (r["approval_id"], r["pending"]) for r in access.match_approvals(c, a, ["k"], 300).collect()}
    used = set()
    for i, ts, k in sorted(calls, key=lambda r: (r[1], str(r[0]))):
        fresh = [x for x in approvals if x[4] == k and x[3] == "approved" and x[0] not in used and x[2] <= ts and (ts - x[2]).total_seconds() < 300]
        best = max(fresh, key=lambda x: (x[2], x[0]))[0] if fresh else None
        if best:
            used.add(best)
        pending = any(x[4] == k and x[1] <= ts and (x[2] is None or x[2] > ts) for x in approvals)
        assert got[i] == (best, pending)
    assert used


def test_breaker_feedback_matches_replay(spark):
    rng = random.Random(7)
    calls = [(i, _at(rng.randrange(1500)), f"t{rng.randrange(2)}", rng.random() < 0.3) for i in range(150)]
    df = spark.createDataFrame(calls, "id int, ts timestamp_ntz, task_id string, blocked boolean")
    got = {r["id"]: r["refused"] for r in ledger.breaker_feedback(df, 3, 60).collect()}
    for task in ("t0", "t1"):
        times = []
        for i, ts, _, blocked in sorted((c for c in calls if c[2] == task), key=lambda c: (c[1], c[0])):
            refused = sum((ts - t).total_seconds() < 60 for t in times) >= 3
            assert got[i] == refused
            if refused or blocked:
                times.append(ts)


def test_guard_budget_matches_replay(spark):
    rng = random.Random(11)
    texts = [(i, _at(i * 10), "x" * rng.randrange(4000)) for i in range(60)]
    df = spark.createDataFrame(texts, "id bigint, ts timestamp_ntz, text string")
    got = {r["id"]: r["rule_id"] for r in ledger.guard_cost(df, limit_tokens=20_000, limit_calls=40).collect()}
    spent = calls = 0
    for i, _, text in texts:
        cost = len(text) // 4 + 1 + 150
        fits = spent + cost <= 20_000 and calls < 40
        assert got[i] == (None if fits else "BUD-GUARD")
        spent, calls = (spent + cost, calls + 1) if fits else (spent, calls)
    assert "BUD-GUARD" in got.values()


def test_admission_in_small_groups(spark, monkeypatch):
    monkeypatch.setattr(ledger, "REPLAY", 16)
    test_admission_over_overlapping_scopes(spark)


def test_admission_chains_settle_in_few_rounds(spark):
    rng = random.Random(5)
    sizes = [rng.randrange(1, 60) for _ in range(400)]
    reqs = [(i, _at(10 * i), n, [f"principal:{i % 4}", "global"], _at(10 * i + 95), n // 2) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(reqs, "id bigint, ts timestamp_ntz, tokens bigint, scopes array<string>, settle_ts timestamp_ntz, actual bigint")
    lim = spark.createDataFrame([(f"principal:{k}", 900, 90, 9) for k in range(4)] + [("global", 3600, 360, 36)],
                                "scope string, token_limit bigint, calls_limit bigint, concurrency_limit bigint")
    got = ledger.admit(df, lim, max_rounds=4).where("admitted").count()
    assert 0 < got < len(reqs)


def _sequential(reqs, limits):
    """Verdict, scope and dimension of each request (id, seconds, tokens, scopes, settle, actual), one after the other."""
    use, stops, out = {k: [0, 0, 0] for k in limits}, [], []
    for i, at, tokens, scopes, settle, actual in sorted(reqs, key=lambda r: (-1 if r[1] is None else r[1], r[0])):
        for stop in [x for x in stops if at is not None and x[0] <= at]:
            stops.remove(stop)
            for s in stop[1]:
                use[s] = [use[s][0] + stop[2], use[s][1], use[s][2] - 1]
        why = None
        for s in sorted(set(scopes), key=lambda x: x or ""):
            if s not in limits:
                why = (s, "missing_scope")
            elif tokens is not None and use[s][0] + tokens > limits[s][0]:
                why = (s, "tokens")
            elif use[s][1] + 1 > limits[s][1]:
                why = (s, "calls")
            elif use[s][2] >= limits[s][2]:
                why = (s, "concurrency")
            if why:
                break
        fits = why is None and tokens is not None
        out.append((i, fits, *(why or (None, None))))
        if fits:
            for s in set(scopes):
                use[s] = [use[s][0] + tokens, use[s][1] + 1, use[s][2] + 1]
            if settle is not None:
                stops.append((settle, set(scopes), 0 if actual is None else actual - tokens))
    return sorted(out, key=str)


def _admission(spark, reqs, limits, **how):
    rows = [(i, None if at is None else _at(at), tokens, scopes, None if settle is None else _at(settle), actual) for i, at, tokens, scopes, settle, actual in reqs]
    df = spark.createDataFrame(rows, "id bigint, ts timestamp_ntz, tokens bigint, scopes array<string>, settle_ts timestamp_ntz, actual bigint")
    lim = spark.createDataFrame([(k, *v) for k, v in limits.items()], "scope string, token_limit bigint, calls_limit bigint, concurrency_limit bigint")
    return sorted([(r.id, r.admitted, r.scope, r.dimension) for r in ledger.admit(df, lim, **how).collect()], key=str)


def test_admission_over_long_logs_settles_in_few_rounds(spark):
    """A guess for each part of a scope admitted what the parts before had used up, and most rounds settled one slice of time."""
    rng = random.Random(9)
    reqs = []
    for i in range(900):
        tokens, at = rng.randrange(40), 7 * i
        reqs.append((i, at, tokens, [f"task:{i % 61}", f"principal:{i % 4}", "global"], None if i % 50 == 0 else at + 200, tokens // 2 if tokens % 3 else None))
    limits = {f"task:{k}": (300, 20, 3) for k in range(61)} | {f"principal:{k}": (1000, 60, 9) for k in range(4)} | {"global": (2500, 240, 30)}
    got = _admission(spark, reqs, limits, depth=30, max_rounds=6)
    assert got == _sequential(reqs, limits)
    assert {g[3] for g in got} == {None, "tokens", "calls", "concurrency"} and sum(g[1] for g in got) > 200


def test_admission_of_odd_requests(spark):
    """Unknown scopes and times, repeated ids, more used than reserved, limits that bind nobody, apart or in one group."""
    rng = random.Random(13)
    reqs = []
    for i in range(160):
        at, tokens = None if i % 31 == 30 else rng.randrange(900), None if i % 37 == 36 else rng.randrange(30)
        principal = None if i % 29 == 28 else f"principal:{i % 5}"
        settle = None if at is None or i % 6 == 0 else at + rng.randrange(0, 200)
        reqs.append((i, at, tokens, [f"task:{i % 15}", principal, "global", "global"], settle, None if i % 7 == 0 else rng.randrange(45)))
    reqs += reqs[5:140:9]
    scopes = {f"task:{k}": (60, 6, 2) for k in range(14)} | {f"principal:{k}": (250, 14, 3) for k in range(5)}
    for limits in (scopes | {"global": (700, 40, 8)}, scopes | {"global": (10**6, 10**6, 10**6)}):
        want = _sequential(reqs, limits)
        assert 20 < sum(w[1] for w in want) < 100
        for depth in (12, 1000):
            assert _admission(spark, reqs, limits, depth=depth) == want


def _shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan.count("Join")


def test_guard_counts_with_one_shuffle_each(spark, monkeypatch):
    """Breaker and rate limit joined their counts back to the calls; a row of the breaker cost as much as its window held."""
    rng = random.Random(21)
    calls = [(i, None if i % 29 == 0 else _at(rng.randrange(900)), rng.choice(["a", "b", None]), rng.choice(["BLOCK", "ALLOW"]),
              rng.choice(["x", "y", None]), rng.choice("pq"), rng.choice([False, False, True])) for i in range(400)]
    log = spark.createDataFrame(calls, "id int, ts timestamp_ntz, task_id string, action string, agent_id string, principal string, synthetic boolean")
    guarded = ledger.circuit_breaker(log, 4, 60)
    seconds = {c[0]: None if c[1] is None else (c[1] - START).total_seconds() for c in calls}

    def counts(b, c):
        at, now = seconds[b[0]], seconds[c[0]]
        if b[2] != c[2] or b[3] != "BLOCK" or (at is None) != (now is None):
            return False
        return b[0] < c[0] if at == now else at is not None and now - 60 < at < now

    recent = {c[0]: sum(counts(b, c) for b in calls) for c in calls}
    opened = {c[0]: recent[c[0]] >= 4 and not c[6] for c in calls}
    assert {r.id: (r.recent_blocks, r.breaker_refused) for r in guarded.collect()} == {i: (n, opened[i]) for i, n in recent.items()}
    assert 0 < sum(opened.values()) < len(calls)

    limits, seen, want = {"agent": 3, "principal": 4, "global": 6}, {}, {c[0]: (None, None, False) for c in calls}
    for i, ts, _, _, agent, principal, synthetic in sorted((c for c in calls if c[1] is not None), key=lambda c: (c[1], c[0])):
        if synthetic or opened[i]:
            continue
        over = []
        for name, scope in (("agent", agent and f"agent:{agent}"), ("principal", f"principal:{principal}"), ("global", "global")):
            n = seen[scope, ts.minute] = seen.get((scope, ts.minute), 0) + 1
            if scope is not None and n > limits[name]:
                over.append((scope, n, True))
        want[i] = over[0] if over else want[i]
    for depth in (1_000_000, 12):  # also when a bucket is too large for one task
        monkeypatch.setattr(running_module, "DEPTH", depth)
        assert {r.id: (r.rate_scope, r.rate_count, r.rate_refused) for r in ledger.rate_limit(guarded, limits).collect()} == want
    monkeypatch.undo()
    assert {w[0] for w in want.values()} >= {None, "agent:x", "principal:p", "global"}
    assert _shuffles(ledger.circuit_breaker(log, 4, 60)) == (1, 0) and _shuffles(ledger.rate_limit(log, limits)) == (1, 0)
