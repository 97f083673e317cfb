"""Streaming replays: any spread of rows over files gives the sequential answer; idle state goes; windows are upserted; late rows are counted."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from callwarden.session import scratch_path
from callwarden.streaming import jobs

START = dt.datetime(2024, 1, 1)
ALL = "400 days"


def _files(spark, rows, schema, files, seed):
    """Rows in random order over so many files, and the folder."""
    rows = rows[:]
    random.Random(seed).shuffle(rows)
    folder = scratch_path(spark, "stream-input")
    size = -(-len(rows) // files)
    for at in range(0, len(rows), size):
        spark.createDataFrame(rows[at:at + size], schema).coalesce(1).write.mode("append").parquet(folder)
    return folder


def _run(spark, rows, schema, files, job, name):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, files // 4)).parquet(_files(spark, rows, schema, files, files))
    stream, close = jobs.closable(stream)
    return jobs.run_available(job(stream), name, close).collect()


def _moves(n=240):
    rng = random.Random(13)
    return [(i, START + dt.timedelta(seconds=5 * i), f"p{rng.randrange(3)}", rng.choice(["reserve", "reserve", "settle", "uncertain"]), rng.randrange(40),
             rng.randrange(1, 60)) for i in range(n)]


def _budget(moves, tokens_max, calls_max, slots):
    state, out = {}, {}
    for i, _, who, kind, res, tokens in moves:
        s, verdict = state.setdefault(who, [0, 0, 0, {}]), "ignored"
        if kind == "reserve" and res not in s[3]:
            verdict = "admitted" if s[0] + s[1] + tokens <= tokens_max and s[2] < calls_max and len(s[3]) < slots else "refused"
            if verdict == "admitted":
                s[1], s[2], s[3][res] = s[1] + tokens, s[2] + 1, tokens
        elif kind != "reserve" and res in s[3]:
            verdict, amount = kind, s[3].pop(res)
            if kind == "settle":
                s[0], s[1] = s[0] + tokens, s[1] - amount
        out[i] = (verdict, s[0], s[1])
    return out


@pytest.mark.parametrize("files", [1, 4, 40])
def test_budget_is_the_same_for_any_spread_of_rows(spark, files):
    schema = "id bigint, ts timestamp, principal string, kind string, res_id bigint, tokens bigint"
    moves = _moves()
    got = _run(spark, moves, schema, files, lambda s: jobs.stream_budget(s, 400, 25, 6, ALL), "budget")
    want = _budget(moves, 400, 25, 6)
    assert {r.id: (r.verdict, r.spent, r.reserved) for r in got} == want and len(got) == len(want)
    assert {"ignored", "admitted", "refused"} <= {v for v, *_ in want.values()}


@pytest.mark.parametrize("files", [1, 12])
def test_breaker_and_level_are_the_same_for_any_spread_of_rows(spark, files):
    rng = random.Random(3)
    rows = [(i, START + dt.timedelta(seconds=rng.randrange(600)), f"t{rng.randrange(2)}", rng.random() < 0.4, i % 11 == 0, rng.choice([None, 0, 1, 2, None, None]))
            for i in range(150)] + [(900, None, "t0", True, False, 3)]
    schema = "id bigint, ts timestamp, task_id string, blocked boolean, synthetic boolean, label int"
    refused, levels = {}, {}
    for task in ("t0", "t1"):
        times, level = [], 0
        for i, ts, _, blocked, exempt, label in sorted((r for r in rows if r[2] == task and r[1]), key=lambda r: (r[1], r[0])):
            refused[i] = sum((ts - t).total_seconds() < 60 for t in times) >= 3 and not exempt
            times += [ts] if refused[i] or blocked else []
            levels[i], level = level, max(level, label or 0)
    got = _run(spark, rows, schema, files, lambda s: jobs.stream_breaker(s, 3, 60, ALL), "breaker")
    assert {r.id: r.refused for r in got} == refused and any(refused.values())
    got = _run(spark, rows, schema, files, lambda s: jobs.stream_taint(s, None, ALL), "level")
    assert {r.id: r.level for r in got} == levels


def test_state_of_idle_keys_is_removed(spark):
    schema = "id bigint, ts timestamp, task_id string, blocked boolean"
    folder, log = scratch_path(spark, "idle-input"), scratch_path(spark, "idle-log")
    rows = [(1, START, "quiet", True), (2, START + dt.timedelta(seconds=1), "quiet", True), (3, START + dt.timedelta(hours=3), "later", True),
            (4, START + dt.timedelta(hours=6), "later", True)]
    for row in rows:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(folder)
    job = jobs.stream_breaker(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder), 2, 60)
    with jobs._rocks(spark):
        job.writeStream.format("memory").queryName("idle").option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()

        def keys(variable):
            return {r.key.task_id for r in spark.read.format("statestore").option("path", log).option("stateVarName", variable).load().collect()}

        assert keys("recent") == set() or keys("recent") == {"later"}
        assert keys("waiting") == {"later"}
    assert {r.id for r in spark.table("idle").collect()} == {1, 2, 3}


def test_open_windows_are_upserted_and_late_rows_counted(spark):
    rng = random.Random(5)
    rows = [(i, START + dt.timedelta(seconds=7 * i), rng.choice(["ALLOW", "BLOCK"])) for i in range(400)]
    schema = "id bigint, ts timestamp, action string"

    def run(files, lateness):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(_files(spark, rows, schema, files, 2))
        table, seen = jobs.upsert_available(jobs.stream_timeline(stream, 1, lateness), "minutes", ["minute", "action"])
        return {(r.minute, r.action): r.n for r in table.collect()}, jobs.late_rows(table, seen).first()

    want = Counter((ts.replace(second=0), action) for _, ts, action in rows)
    for files in (1, 8):
        got, late = run(files, ALL)
        assert got == want and tuple(late) == (400, 400, 0)
    got, late = run(8, "1 minute")
    assert late.arrived == 400 and late.late == 400 - sum(got.values()) > 0
    assert all(n <= want[k] for k, n in got.items())


def test_sessions_end_with_the_input(spark):
    rows = [(1, START, "t", "BLOCK"), (2, START + dt.timedelta(seconds=30), "t", "BLOCK"), (3, START + dt.timedelta(seconds=300), "t", "BLOCK"),
            (4, START + dt.timedelta(seconds=310), "u", "ALLOW")]
    got = _run(spark, rows, "id bigint, ts timestamp, task_id string, action string", 2, lambda s: jobs.stream_probe_sessions(s, "60 seconds", ALL), "sessions")
    assert sorted((r.task_id, r.blocks) for r in got) == [("t", 1), ("t", 2)]


def test_equal_texts_are_scored_once_in_a_span(spark):
    rows = [(i, START + dt.timedelta(minutes=m), t) for i, (m, t) in enumerate([(0, "a"), (10, "a"), (59, "a"), (60, "a"), (5, "b"), (119, "a"), (121, "a"), (1, None)])]
    for files in (1, 4):
        got = _run(spark, rows, "id bigint, ts timestamp, text string", files, lambda s: jobs.stream_dedup_score(s, 3600, ALL), "scores")
        assert sorted(r.id for r in got) == [0, 3, 4, 6]


def test_texts_of_a_group_share_their_state(spark, monkeypatch):
    """Each text had state of its own, null texts too; texts of one group must not hide each other."""
    monkeypatch.setattr(jobs._Rows, "PART", 7)
    schema = "id bigint, ts timestamp, text string"
    rng = random.Random(7)
    rows = [(i, START + dt.timedelta(minutes=rng.randrange(400)), rng.choice(["a", "b", "c", "d", None])) for i in range(200)]
    last, want = {}, []
    for i, ts, text in sorted(rows, key=lambda r: (r[1], r[0])):
        if text is not None and (text not in last or ts >= last[text] + dt.timedelta(hours=1)):
            last[text] = ts
            want.append(i)
    got = _run(spark, rows, schema, 2, lambda s: jobs.stream_dedup_score(s, 3600, ALL, 2), "scores")
    assert sorted(r.id for r in got) == sorted(want)

    folder, log = scratch_path(spark, "group-input"), scratch_path(spark, "group-log")
    first = [(i, START, f"text {i}") for i in range(1500)] + [(1500, START, None)]
    for part in (first, [(2000, START + dt.timedelta(minutes=30), "text 1")], [(2001, START + dt.timedelta(hours=9), "new")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        job = jobs.stream_dedup_score(spark.readStream.schema(schema).parquet(folder), 3600)
        with jobs._rocks(spark):
            job.writeStream.format("parquet").option("path", f"{folder}-out").option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()

        def state(variable):
            return spark.read.format("statestore").option("path", log).option("stateVarName", variable).load()

        if part is first:
            assert state("waiting").count() == 1500 and state("waiting").select("key").distinct().count() <= 1024
    # only the group of the row that still waits keeps what it held until then
    assert state("waiting").select("key").first() and state("last").select("key").distinct().subtract(state("waiting").select("key")).count() == 0
    assert state("waiting").count() == 1
    assert sorted(r.id for r in spark.read.parquet(f"{folder}-out").collect()) == list(range(1500))


def test_waiting_rows_are_held_as_columns_and_read_in_parts(monkeypatch):
    """Rows of one key stood in tuples, and their output in one table."""
    monkeypatch.setattr(jobs._Rows, "PART", 3)
    rows = [(5, 1, "b"), (3, 9, None), (5, 0, "a"), (9, 2, "z"), (3, 9, "later"), (1, 4, ""), (9, 1, "y")]
    kept = jobs._Rows("us long, id long, text string", iter(rows))
    parts = list(kept.parts(kept.until(5)))
    assert max(map(len, parts)) == 3
    assert [r for p in parts for r in p] == [(1, 4, ""), (3, 9, None), (3, 9, "later"), (5, 0, "a"), (5, 1, "b")]
    later = kept.after(5)
    assert kept.time(later[0]) == 9 and [r for p in kept.parts(later) for r in p] == [(9, 1, "y"), (9, 2, "z")]
    assert list(jobs._Rows("us long, id long", iter([])).parts(kept.until(0))) == []
