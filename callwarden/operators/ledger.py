"""Ledgers over call logs: rates, circuit breaker, budgets and their reports."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from callwarden.operators.running import running, time_chunk
from callwarden.rules import policy as P
from callwarden.session import cut_lineage

# ---------------------------------------------------------------- rates


def rate_limit(calls: DataFrame, limits: dict[str, int] | None = None, bucket_seconds: int = 60) -> DataFrame:
    """Add ``rate_scope``, ``rate_count`` and ``rate_refused`` to each call.

    Every call counts in all its scopes, refused or not; synthetic calls and calls the breaker refused do not. A scope or time that
    is not known limits nobody. Counting calls are numbered in one scope after the other and carry their numbers along; every scope
    lies inside a bucket, so one shuffle by bucket serves all three unless a bucket is too large for one task.
    """
    limits = P.RATE_LIMITS if limits is None else limits
    scopes = {
        "agent": F.concat(F.lit("agent:"), "agent_id"),
        "principal": F.concat(F.lit("principal:"), "principal"),
        "global": F.lit("global"),
    }
    counts = ~F.col("synthetic") & time_chunk("ts", bucket_seconds).isNotNull()
    if "breaker_refused" in calls.columns:
        counts = counts & ~F.col("breaker_refused")
    counts = F.coalesce(counts, F.lit(False))
    numbered = calls.where(counts).withColumn("_bucket", F.coalesce(time_chunk("ts", bucket_seconds).cast("string"), F.lit("")))
    for name in reversed(scopes):
        inside = {} if name == "global" else {"_scope": F.coalesce(scopes[name], F.lit(""))}
        numbered = running(numbered.withColumns(inside), ["_bucket", *inside], ["ts", "id"], {f"_n_{name}": ("count", F.lit(1))}).drop(*inside)
    over = {name: F.when(scope.isNotNull() & (F.col(f"_n_{name}") > limits[name]), F.struct(scope.alias("scope"), F.col(f"_n_{name}").alias("n")))
            for name, scope in scopes.items()}
    known = numbered.withColumn("_over", F.coalesce(*over.values()))
    free = calls.where(~counts).withColumn("_over", F.lit(None).cast(known.schema["_over"].dataType))
    return known.select(*calls.columns, "_over").unionByName(free).select(
        *calls.columns, F.col("_over.scope").alias("rate_scope"), F.col("_over.n").alias("rate_count"), F.col("_over").isNotNull().alias("rate_refused"),
    )


# ---------------------------------------------------------------- circuit breaker


def trailing_counts(calls: DataFrame, window_seconds: int, flags: dict[str, Column], key: str = "task_id", keep: list[str] | None = None) -> DataFrame:
    """For each call, how many earlier calls of the key within the window satisfy each flag; ``keep`` names other columns to carry along.

    Time is cut into tiles one window long. A tile also receives the flagged rows of the tile before it, so every
    window lies inside one group and a busy key is spread over its tiles. Rows at the very start of the window
    are outside it; rows of the same instant count if their id is lower. A count is all that came before less what is out of the
    window: both frames begin with the group, so a row costs the same however many calls the window holds, and one sort serves both.
    """
    width = window_seconds * 1_000_000
    names = list(flags)
    any_flag = F.lit(False)
    for c in flags.values():
        any_flag = any_flag | c
    base = calls.select(
        "*", F.unix_micros(F.col("ts").cast("timestamp")).alias("_us"),
        *[F.when(c, 1).otherwise(0).alias(f"_f_{n}") for n, c in flags.items()], any_flag.alias("_any"),
    )
    tile = F.expr(f"_us div {width}")
    copies = F.when(F.col("_any") & tile.isNotNull(), F.array(F.struct(tile.alias("tile"), F.lit(True).alias("own")),
                                           F.struct((tile + 1).alias("tile"), F.lit(False).alias("own")))
                    ).otherwise(F.array(F.struct(tile.alias("tile"), F.lit(True).alias("own"))))
    tiled = base.withColumn("_t", F.explode(copies)).select("*", F.col("_t.tile").alias("_tile"), F.col("_t.own").alias("_own")).drop("_t")
    group = Window.partitionBy(key, "_tile")
    before = group.orderBy("_us", "id").rowsBetween(Window.unboundedPreceding, -1)
    outside = group.orderBy("_us").rangeBetween(Window.unboundedPreceding, -width)
    ranked = tiled.select("*", *[F.sum(f"_f_{n}").over(before).alias(f"_b_{n}") for n in names])
    counted = ranked.select("*", *[F.sum(f"_f_{n}").over(outside).alias(f"_o_{n}") for n in names])
    # rows without a time are all of one instant, and of one tile
    gone = {n: F.when(F.col("_us").isNotNull(), F.coalesce(f"_o_{n}", F.lit(0))).otherwise(0) for n in names}
    columns = [key, "id"] if keep is None else keep
    return counted.where("_own").select(*columns, *[(F.coalesce(f"_b_{n}", F.lit(0)) - gone[n]).alias(n) for n in names])


def _exempt(calls: DataFrame) -> Column:
    """Calls of synthetic tasks; logs without the column hold none."""
    return F.coalesce(F.col("synthetic"), F.lit(False)) if "synthetic" in calls.columns else F.lit(False)


def circuit_breaker(calls: DataFrame, blocks: int, window_seconds: int) -> DataFrame:
    """Observed log: a call is refused when its task already had ``blocks`` BLOCK rows in the last window; synthetic tasks are exempt."""
    columns = ["id", *[c for c in calls.columns if c != "id"]]
    seen = trailing_counts(calls, window_seconds, {"recent_blocks": F.col("action") == "BLOCK"}, keep=columns)
    return seen.withColumn("breaker_refused", (F.col("recent_blocks") >= blocks) & ~_exempt(calls))


def breaker_feedback(calls: DataFrame, blocks: int, window_seconds: int, max_rounds: int = 10_000) -> DataFrame:
    """The breaker replayed with its own refusals counted as blocks.

    Calls: id, ts, task_id, blocked (what the call would be on its own), and synthetic if some tasks are exempt. A refusal depends on earlier refusals only,
    so bounds settle it: refused for certain when the sure blocks in its window reach the threshold, admitted
    for certain when even all undecided calls would not. Each round decides at least the earliest open call of every
    task, for all tasks at once. A busy stretch (every call sees ``blocks`` calls before it) that is refused over a
    whole window stays refused to its end, so long outages settle in one round.
    """
    rows = calls.select("id", "ts", "task_id", "blocked", _exempt(calls).alias("exempt"))
    busy = trailing_counts(rows, window_seconds, {"n_calls": F.lit(True)}).drop("task_id")
    base = running(
        rows.join(busy, "id"), ["task_id"], ["ts", "id"], {"stretch": ("sum", F.when(F.col("n_calls") < blocks, 1).otherwise(0))},
    )
    # refused: null while undecided
    state = cut_lineage(base.withColumn("refused", F.when((F.col("n_calls") < blocks) | F.col("exempt"), F.lit(False))))
    for _ in range(max_rounds):
        if state.where(F.col("refused").isNull()).limit(1).count() == 0:
            return state.select("id", "ts", "task_id", "blocked", "refused")
        sure = F.coalesce(F.col("refused"), F.lit(False)) | F.col("blocked")
        maybe = F.col("refused").isNull() | sure
        counts = trailing_counts(state, window_seconds, {"low": sure, "high": maybe}).drop("task_id")
        bounded = state.join(counts, "id")
        locked = (F.col("low") == F.col("n_calls")) & (F.col("n_calls") >= blocks)
        bounded = running(
            bounded, ["task_id", "stretch"], ["ts", "id"], {"locks": ("sum", F.when(locked, 1).otherwise(0))},
        )
        decided = F.when(F.col("refused").isNotNull(), F.col("refused")).when(
            (F.col("low") >= blocks) | (F.col("locks") > 0), True
        ).when(F.col("high") < blocks, False)
        state = cut_lineage(bounded.withColumn("refused", decided).drop("low", "high", "locks"))
    raise RuntimeError("breaker replay did not settle")


# ---------------------------------------------------------------- budgets


def estimate_tokens(text: Column) -> Column:
    return (F.floor(F.length(text) / 4) + 1).cast("bigint")


def reserve_tokens(prompt: Column, max_tokens: Column | None = None, default: int = P.BUDGETS["default_max_tokens"]) -> Column:
    """Estimated prompt plus the answer limit; an absent or zero limit means the default."""
    limit = F.lit(default) if max_tokens is None else F.coalesce(F.when(max_tokens != 0, max_tokens), F.lit(default))
    return estimate_tokens(prompt) + limit


def usage_cost(used: Column, usd_per_1k: float = P.BUDGETS["usd_per_1k_tokens"]) -> Column:
    return F.round(used / 1000 * usd_per_1k, 6)


def budget_scopes(calls: DataFrame, closure: DataFrame) -> DataFrame:
    """(id, scope): task and all ancestors, principal, and the global scope unless synthetic."""
    tasks = calls.join(closure.select("task_id", "ancestor_id"), "task_id").select(
        "id", F.concat(F.lit("task:"), "ancestor_id").alias("scope")
    )
    own = F.array(F.concat(F.lit("principal:"), "principal"), F.when(~F.col("synthetic"), "global"))
    others = calls.select("id", F.explode(F.filter(own, lambda s: s.isNotNull())).alias("scope"))
    return tasks.unionByName(others)


def exceeded_dimension(spent: Column, reserved: Column, calls_used: Column, active: Column, limits: dict[str, Column],
                       tokens: Column, calls: Column | int = 1) -> Column:
    """First dimension without room, or null: missing_scope, tokens, calls, concurrency."""
    n = F.lit(calls) if isinstance(calls, int) else calls
    return (
        F.when(limits["tokens"].isNull(), "missing_scope")
        .when(spent + reserved + tokens > limits["tokens"], "tokens")
        .when(calls_used + n > limits["calls"], "calls")
        .when(active >= limits["concurrency"], "concurrency")
    )


def transitions(reservations: DataFrame, events: DataFrame) -> DataFrame:
    """The valid life of each reservation: its first settle or uncertain, and after uncertain the first reconcile.

    Events: res_id, seq, kind (settle, uncertain, reconcile), actual. Repeats and late events change nothing.
    Both steps are aggregations with map-side combination.
    """
    first = events.where(F.col("kind").isin("settle", "uncertain")).groupBy("res_id").agg(
        F.min(F.struct("seq", "kind", "actual")).alias("first")
    )
    later = events.where(F.col("kind") == "reconcile").join(
        first.where(F.col("first.kind") == "uncertain").select("res_id", F.col("first.seq").alias("_after")), "res_id"
    ).where(F.col("seq") > F.col("_after")).groupBy("res_id").agg(F.min(F.struct("seq", "actual")).alias("fix"))
    return reservations.join(first.withColumnRenamed("res_id", "id"), "id", "left").join(
        later.withColumnRenamed("res_id", "id"), "id", "left"
    ).select(
        *reservations.columns,
        F.when(F.col("first").isNull(), "active").when(F.col("first.kind") == "settle", "settled")
        .when(F.col("fix").isNotNull(), "settled").otherwise("uncertain").alias("state"),
        F.when(F.col("first.kind") == "settle", F.col("first.actual")).otherwise(F.col("fix.actual")).alias("settled_tokens"),
    )


def ledger_state(reservations: DataFrame, events: DataFrame) -> DataFrame:
    """Per scope: spent and reserved tokens, calls and open slots. Reservations: id, scope_ids, amount."""
    rows = transitions(reservations, events).select(F.explode("scope_ids").alias("scope_id"), "amount", "state", "settled_tokens")
    return rows.groupBy("scope_id").agg(
        F.coalesce(F.sum("settled_tokens"), F.lit(0)).alias("spent"),
        F.coalesce(F.sum(F.when(F.col("state") != "settled", F.col("amount"))), F.lit(0)).alias("reserved"),
        F.count(F.lit(1)).alias("calls_used"),
        F.count_if(F.col("state") == "active").alias("active_calls"),
    )


#: Requests that the first round of an admission replays; each further round may replay twice as many.
REPLAY = 1_000_000

#: Requests of one slice of time, when there are more than a few for each core.
SLICE = 1_000_000

#: Scopes, or different sets of scopes, that are looked at in the driver and sent to every task.
SCREEN = 1_000_000

_NO_ROOM = -(1 << 62)
_NO_TIME, _NEVER = -(1 << 63), (1 << 63) - 1


def _codes(scopes: pa.ListArray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different scopes of a column of lists, the place of each element among them, and where each list begins and ends."""
    found = scopes.flatten().dictionary_encode()
    ends = np.concatenate([[0], np.cumsum(scopes.value_lengths().to_numpy(zero_copy_only=False).astype("int64"))])
    return found.dictionary.to_pylist(), found.indices.to_numpy(zero_copy_only=False), ends


def _screen(scopes: list[str], most: np.ndarray, loose: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Takes the scopes that cannot limit from the requests and adds what is certain: refused above the ``most`` tokens that a scope may
    still have, admitted without a scope that could limit."""
    place = {s: i for i, s in enumerate(scopes)}
    most, loose = np.append(most, 1 << 62), np.append(loose, False)

    def screened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, codes, ends = _codes(batch["scopes"])
            at = np.array([place.get(s, -1) for s in names], dtype="int64")[codes]
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            refused = np.zeros(batch.num_rows, dtype=bool)
            refused[row[batch["need"].to_numpy()[row] > most[at]]] = True
            held = ~loose[at]
            sizes = np.bincount(row[held], minlength=batch.num_rows)
            kept = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), batch["scopes"].flatten().filter(pa.array(held)))
            verdict = pa.array(~refused, mask=~refused & (sizes > 0))
            yield pa.RecordBatch.from_arrays([kept if n == "scopes" else batch[n] for n in batch.schema.names] + [verdict], [*batch.schema.names, "verdict"])

    return screened


_REPLAYED = ("group", "kind", "us", "n", "need", "settle_us", "back", "t", "c", "a")


def _replay(batches: Iterator[pa.RecordBatch], carry: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    """Numbers of the requests admitted or, with columns to ``carry``, these of all requests with verdict and what was lacking.

    In order come, for each group: the room of each scope (tokens, calls, slots), then what earlier requests give back (``kind`` 0) and the
    requests (1; 2 if refused in any case). Only the rooms and the requests still running are held.
    """
    group, rooms, stops = None, {}, []
    for batch in batches:
        names, codes, ends = _codes(batch["scopes"])
        held: list[list[int] | None] = [None] * len(names)
        columns = [batch[c].fill_null({"settle_us": _NEVER, "need": _NO_TIME}.get(c, 0)).to_numpy().tolist() for c in _REPLAYED]
        codes, admitted, at, lacking = codes.tolist(), [], [], []
        for row, (g, kind, us, n, need, settle, back, t, c, a, start, end) in enumerate(zip(*columns, ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            if g != group:
                group, rooms, stops, held = g, {}, [], [None] * len(names)
            if kind < 0:
                rooms[names[codes[start]]] = [t, c, a]
                continue
            while stops and stops[0][0] <= us:
                _, _, over, returned = heapq.heappop(stops)
                for r in over:
                    r[0] += returned
                    r[2] += 1
            uses, fits = [], kind == 1
            for i in codes[start:end]:
                r = held[i]
                if r is None:
                    r = held[i] = rooms.get(names[i])
                if kind:
                    fits = fits and r[0] >= need and r[1] >= 1 and r[2] >= 1
                    if not fits:
                        break
                    uses.append(r)
                elif r is not None:
                    r[0] += back
                    r[2] += 1
            if fits:
                for r in uses:
                    r[0] -= need
                    r[1] -= 1
                    r[2] -= 1
                if settle < _NEVER:
                    heapq.heappush(stops, (settle, n, uses, back))
            if fits and not carry:
                admitted.append(n)
            if kind and carry:
                at.append(row)
                admitted.append(fits)
                lacking.append((None, None) if fits else min(
                    ((names[i], d) for i in codes[start:end] if (d := _lacking(held[i] or rooms[names[i]], need))), default=(None, None)))
        if carry:
            kept = [batch[c].take(pa.array(at, pa.int64())) for c in carry]
            said = [pa.array([x[i] for x in lacking], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(admitted, pa.bool_()), *said], [*carry, "admitted", "scope", "dimension"])
        else:
            yield pa.RecordBatch.from_pydict({"n": pa.array(admitted, pa.int64())})


def _lacking(room: list[int], need: int) -> str | None:
    """``exceeded_dimension`` of what a scope has left; an unknown need or limit exceeds nothing."""
    if room[0] == _NO_ROOM:
        return "missing_scope"
    if room[0] < need:
        return "tokens"
    if _NO_ROOM < room[1] < 1:
        return "calls"
    return "concurrency" if _NO_ROOM < room[2] < 1 else None


def _connected(sets: list[list[str]]) -> dict[str, str]:
    """For each scope one scope of all that are connected by common sets."""
    top: dict[str, str] = {}

    def find(s: str) -> str:
        while top.setdefault(s, s) != s:
            top[s] = s = top[top[s]]
        return s

    for first, *others in sets:
        for s in others:
            top[find(s)] = find(first)
    return {s: find(s) for x in sets for s in x}


def _admitted(base: DataFrame, limit: DataFrame, depth: int, max_rounds: int) -> DataFrame:
    """Numbers of the admitted requests (n, id, us, need, settle_us, back, scopes).

    All requests up to the frontier are decided. A round first bounds the usage of every scope at any later time, from what is admitted
    and what is open: a request is refused for certain if a scope never again has room for it, and a scope that has room even for all open
    requests is left out. Calls are never given back and of tokens only a part, so used up scopes settle all the rest of their requests
    at once. Then the first open requests are replayed in order, apart for scopes that no request connects.
    """
    spark = base.sparkSession
    open_, taken, sure = base, None, []
    frontier = _NO_TIME
    for turn in range(max_rounds):
        used = spark.createDataFrame([], "scope string, t bigint, c bigint, a bigint, t_low bigint, t_high bigint, a_low bigint")
        if taken is not None:
            ended = F.coalesce(F.col("settle_us") <= frontier, F.lit(False))
            now, later = F.when(ended, F.col("need") - F.col("back")).otherwise(F.col("need")), F.col("need") - F.col("back")
            used = taken.select("*", F.explode("scopes").alias("scope")).groupBy("scope").agg(
                F.sum(now).alias("t"), F.count(F.lit(1)).alias("c"), F.count_if(~ended).alias("a"),
                F.sum(F.when(F.col("settle_us").isNull(), F.col("need")).otherwise(F.least(now, later))).alias("t_low"),
                F.sum(F.when(F.col("settle_us").isNull(), F.col("need")).otherwise(F.greatest(now, later))).alias("t_high"),
                F.count_if(F.col("settle_us").isNull()).alias("a_low"))
        after = F.when(F.col("settle_us").isNull(), F.col("need")).otherwise(F.col("need") - F.col("back"))
        wanted = open_.select("need", after.alias("after"), F.explode("scopes").alias("scope")).groupBy("scope").agg(
            F.count(F.lit(1)).alias("rows"), F.max("need").alias("largest"),
            F.sum(F.greatest(F.lit(0), "need", "after")).alias("high"), F.sum(F.least(F.lit(0), "need", "after")).alias("low"))
        table = cut_lineage(wanted.join(limit, "scope", "left").join(used, "scope", "left").fillna(0, ["t", "c", "a", "t_low", "t_high", "a_low"]))
        tokens, calls, slots = F.col("token_limit"), F.col("calls_limit"), F.col("concurrency_limit")
        has_room = tokens.isNotNull() & (F.col("c") + 1 <= calls) & (F.col("a_low") + 1 <= slots)
        most = F.when(has_room, tokens - F.col("t_low") - F.col("low")).otherwise(_NO_ROOM)
        loose = (F.col("t_high") + F.col("high") <= tokens) & (F.col("c") + F.col("rows") <= calls) & (F.col("a") + F.col("rows") <= slots)
        told = table.select("scope", "rows", "largest", F.coalesce(most, F.lit(_NO_ROOM)).alias("most"), F.coalesce(loose, F.lit(False)).alias("loose")).where(
            F.col("loose") | (F.col("most") < F.col("largest"))).orderBy(F.desc("rows"), "scope").limit(SCREEN).toArrow()
        if told.num_rows:
            screened = _screen(told["scope"].to_pylist(), told["most"].to_numpy(), told["loose"].to_numpy())
            seen = cut_lineage(open_.mapInArrow(screened, StructType([*open_.schema.fields, StructField("verdict", BooleanType())])))
            sure.append(seen.where("verdict").select("n"))
            open_ = seen.where(F.col("verdict").isNull()).drop("verdict")
        n_open = open_.count()
        if n_open == 0:
            break
        groups = _open_groups(open_, n_open)
        grouped = open_.withColumn("group", F.lit(0)) if groups is None else open_.join(
            groups.select(F.col("scope").alias("_first"), "group"), F.element_at("scopes", 1) == F.col("_first")).drop("_first")
        largest = grouped.groupBy("group").count().orderBy(F.desc("count")).first()
        size = depth << turn
        until = None if largest["count"] <= size else grouped.where(F.col("group") == largest["group"]).agg(
            F.percentile_approx("us", size / largest["count"])).first()[0]
        head = grouped if until is None else grouped.where(F.col("us") <= until)
        rooms = head.select("group", F.explode("scopes").alias("scope")).distinct().join(table, "scope")
        left = [F.coalesce(x - F.col(u), F.lit(_NO_ROOM)).alias(u) for x, u in ((tokens, "t"), (calls, "c"), (slots, "a"))]
        kinds = rooms.select("group", F.lit(-1).alias("kind"), F.lit(_NO_TIME).alias("us"), F.array("scope").alias("scopes"), *left)
        if taken is not None:
            running_on = taken.where(F.col("settle_us") > frontier).select(F.explode("scopes").alias("scope"), F.col("settle_us").alias("us"), "back")
            kinds = kinds.unionByName(running_on.join(rooms.select("group", "scope"), "scope").select(
                "group", F.lit(0).alias("kind"), "us", F.array("scope").alias("scopes"), "back"), allowMissingColumns=True)
        kinds = kinds.unionByName(head.withColumn("kind", F.lit(1)), allowMissingColumns=True)
        in_order = kinds.repartition("group").sortWithinPartitions("group", F.col("kind") >= 0, "us", "kind", "id", "n")
        admitted = cut_lineage(in_order.select(*_REPLAYED, "scopes").mapInArrow(_replay, "n bigint"))
        sure.append(admitted)
        if until is None:
            break
        now_taken = _those(base, admitted)
        taken = cut_lineage(now_taken if taken is None else taken.unionByName(now_taken))
        open_, frontier = open_.where(F.col("us") > until), until
    else:
        raise RuntimeError("admission did not settle")
    return reduce(DataFrame.unionByName, sure) if sure else base.select("n").limit(0)


def _open_groups(requests: DataFrame, n_open: int) -> DataFrame | None:
    """(scope, group): scopes that open requests connect; None if they are one group, or mostly, or too many to look at."""
    largest = requests.select(F.explode("scopes").alias("scope")).groupBy("scope").count().agg(F.max("count")).first()[0]
    if 2 * largest >= n_open:
        return None
    sets = requests.select("scopes").distinct().limit(SCREEN + 1).toArrow()["scopes"].to_pylist()
    if len(sets) > SCREEN:
        return None
    group = _connected(sets)
    numbers = {top: i for i, top in enumerate(dict.fromkeys(group.values()))}
    return requests.sparkSession.createDataFrame(pa.table({"scope": list(group), "group": [numbers[top] for top in group.values()]}))


def admit(requests: DataFrame, limits: DataFrame, max_rounds: int = 10_000, depth: int | None = None) -> DataFrame:
    """All-or-nothing admission in (ts, id) order over overlapping scopes.

    Requests: id, ts, tokens, scopes, settle_ts, actual (no settle_ts: still running; no actual: outcome unknown,
    tokens stay held). Limits: scope, token_limit, calls_limit, concurrency_limit. A request holds tokens, one
    call and one slot in each scope, only if all scopes have room. Requests without an id or a scope are left out.

    ``_admitted`` finds the requests that the sequential log admits; ``depth`` is the number its first round replays. What a refused
    request met is then replayed in slices of time, all at once, each from the usage that the admitted ones leave at its start.
    """
    depth = REPLAY if depth is None else depth
    limit = limits.groupBy("scope").agg(*[F.min(c).cast("bigint").alias(c) for c in ("token_limit", "calls_limit", "concurrency_limit")])
    us = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(_NO_TIME))
    need = F.col("tokens").cast("bigint")
    settle = F.unix_micros(F.col("settle_ts").cast("timestamp"))
    parts = max(2 * requests.sparkSession.sparkContext.defaultParallelism, requests.count() // SLICE)
    base = cut_lineage(requests.where(F.col("id").isNotNull() & (F.size("scopes") > 0)).select(
        "id", "ts", "tokens", us.alias("us"), need.alias("need"), F.when(settle.isNotNull(), F.greatest(settle, us)).alias("settle_us"),
        (need - F.coalesce(F.col("actual").cast("bigint"), need)).alias("back"), F.array_distinct("scopes").alias("scopes"),
    ).repartitionByRange(parts, "us", "id").select("*", F.spark_partition_id().alias("slice"), F.monotonically_increasing_id().alias("n")))
    unnamed = F.exists("scopes", lambda s: s.isNull())
    known = base.where(F.col("need").isNotNull() & ~unnamed)
    admitted = _admitted(known.drop("ts", "tokens"), limit, depth, max_rounds)
    ends = base.groupBy("slice").agg(F.max("us").alias("end")).orderBy("slice").toPandas()

    @F.pandas_udf("int")
    def slice_at(at: pd.Series) -> pd.Series:
        return pd.Series(np.append(ends["slice"].to_numpy(), -1)[np.searchsorted(ends["end"].to_numpy(), at.to_numpy())])

    # the slice that gives a request back, if there is one
    taken = _those(known, admitted).withColumn("until", slice_at(F.coalesce("settle_us", F.lit(_NEVER))))
    taken = cut_lineage(taken.withColumn("until", F.when(F.col("settle_us").isNotNull() & (F.col("until") >= 0), F.greatest("until", "slice"))))
    begun = taken.select(F.explode("scopes").alias("scope"), "slice", F.col("need").alias("t"), F.lit(1).alias("c"), F.lit(1).alias("a"), F.lit(False).alias("wanted"))
    ended = taken.where(F.col("until").isNotNull()).select(
        F.explode("scopes").alias("scope"), F.col("until").alias("slice"), (-F.col("back")).alias("t"), F.lit(0).alias("c"), F.lit(-1).alias("a"), F.lit(False).alias("wanted"))
    looked = base.where(~unnamed).select(
        F.explode("scopes").alias("scope"), "slice", F.lit(0).cast("bigint").alias("t"), F.lit(0).alias("c"), F.lit(0).alias("a"), F.lit(True).alias("wanted"))
    moved = looked.unionByName(begun).unionByName(ended).groupBy("scope", "slice").agg(
        *[F.sum(x).alias(x) for x in ("t", "c", "a")], F.max("wanted").alias("wanted"))
    before = Window.partitionBy("scope").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    at_start = moved.select("scope", "slice", "wanted", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(x) for x in ("t", "c", "a")])
    left = [F.coalesce(F.col(x) - F.col(u), F.lit(_NO_ROOM)).alias(u) for x, u in (("token_limit", "t"), ("calls_limit", "c"), ("concurrency_limit", "a"))]
    rooms = at_start.where("wanted").join(limit, "scope", "left").select(
        F.col("slice").alias("group"), F.lit(-1).alias("kind"), F.lit(_NO_TIME).alias("us"), F.array("scope").alias("scopes"), *left)
    stops = taken.where(F.col("until") > F.col("slice")).select(
        F.col("until").alias("group"), F.lit(0).alias("kind"), F.col("settle_us").alias("us"), "scopes", "back")
    rows = base.where(~unnamed).withColumns({"group": F.col("slice"), "kind": F.when(F.col("need").isNull(), 2).otherwise(1)}).drop("slice")
    in_order = rows.unionByName(rooms, allowMissingColumns=True).unionByName(stops, allowMissingColumns=True).repartitionById(parts, "group").sortWithinPartitions(
        "group", F.col("kind") >= 0, "us", F.col("kind") > 0, "id", "n")
    carry, kinds = ("id", "ts", "tokens"), dict(requests.dtypes)
    told = in_order.select(*_REPLAYED, "scopes", *carry).mapInArrow(
        lambda batches: _replay(batches, carry), ", ".join(f"{c} {kinds[c]}" for c in carry) + ", admitted boolean, scope string, dimension string")
    return told.unionByName(base.where(unnamed).select(
        *carry, F.lit(False).alias("admitted"), F.lit(None).cast("string").alias("scope"), F.lit("missing_scope").alias("dimension")))


def _those(requests: DataFrame, numbers: DataFrame) -> DataFrame:
    return requests.join(F.broadcast(numbers) if numbers.count() <= SCREEN else numbers, "n", "left_semi")


def guard_cost(texts: DataFrame, limit_tokens: int = P.BUDGETS["guard"]["tokens"], limit_calls: int = P.BUDGETS["guard"]["calls"]) -> DataFrame:
    """Cost of risk scoring itself (id, ts, text): its own budget of estimate + 150 tokens per text; BUD-GUARD beyond it."""
    cost = estimate_tokens(F.col("text")) + 150
    requests = texts.select(
        "id", "ts", cost.alias("tokens"), F.array(F.lit("guard")).alias("scopes"), F.col("ts").alias("settle_ts"), cost.alias("actual")
    )
    limits = texts.sparkSession.createDataFrame(
        [("guard", limit_tokens, limit_calls, 1_000_000_000)], "scope string, token_limit bigint, calls_limit bigint, concurrency_limit bigint"
    )
    # a scored text settles before the next one starts, so the slot never limits; only held tokens matter
    out = admit(requests.withColumn("settle_ts", F.lit(None).cast(dict(texts.dtypes)["ts"])), limits)
    return out.select("id", "tokens", F.when(~F.col("admitted"), "BUD-GUARD").alias("rule_id"))


# ---------------------------------------------------------------- reports


def overspend_report(log: DataFrame, pool_tokens: Column, reserve: Column) -> DataFrame:
    """Per run: how many requests fit, ran, were prevented or failed, and tokens beyond the pool.

    Log: run, status (HTTP status), rule_id, spent, reserved.
    """
    counted = log.groupBy("run").agg(
        F.count(F.lit(1)).alias("agents"), pool_tokens.alias("pool_tokens"), reserve.alias("reserve_per_request"),
        F.count_if(F.col("status") == 200).alias("executed"), F.count_if(F.col("status") == 429).alias("prevented"),
        F.count_if(~F.col("status").isin(200, 429)).alias("other"),
        F.coalesce(F.sum("spent"), F.lit(0)).alias("spent_tokens"), F.coalesce(F.sum("reserved"), F.lit(0)).alias("reserved_tokens"),
    )
    reasons = log.where(~F.col("status").isin(200, 429)).groupBy("run", F.concat_ws(" ", "status", "rule_id").alias("reason")).agg(
        F.count(F.lit(1)).alias("n")
    ).groupBy("run").agg(F.array_sort(F.collect_list(F.concat_ws("=", "reason", "n"))).alias("failures"))
    committed = F.col("spent_tokens") + F.col("reserved_tokens")
    return counted.join(reasons, "run", "left").select(
        "run", "agents", "pool_tokens", "reserve_per_request",
        F.least("agents", F.expr("pool_tokens div reserve_per_request")).alias("fit"),
        "executed", "prevented", "other", F.coalesce(F.array_join("failures", ";"), F.lit("")).alias("failures"),
        "spent_tokens", "reserved_tokens", committed.alias("committed_tokens"),
        F.greatest(F.lit(0), committed - F.col("pool_tokens")).alias("overspend_tokens"),
    )


def running_balance(log: DataFrame) -> DataFrame:
    """Add the committed tokens of each scope after every move (scope_id, ts, id, tokens)."""
    return running(log, ["scope_id"], ["ts", "id"], {"balance": ("sum", F.col("tokens"))})


def first_breach(log: DataFrame, limit: Column | int) -> DataFrame:
    """Per scope: final balance and the first move that went above the limit."""
    top = F.lit(limit) if isinstance(limit, int) else limit
    rows = running_balance(log)
    return rows.groupBy("scope_id").agg(
        F.sum("tokens").alias("committed"), F.count(F.lit(1)).alias("moves"),
        F.min(F.when(F.col("balance") > top, F.struct("ts", "id", "balance"))).alias("_b"),
    ).select("scope_id", "committed", "moves", F.col("_b.ts").alias("breached_at"), F.col("_b.id").alias("breach_id"),
             F.col("_b.balance").alias("breach_balance"))
