"""The governance checks as Structured Streaming jobs.

Event time with a two-minute watermark by default; later rows are dropped and counted. Windowed counts run in update mode into an
upserted table (one folder a batch, so a repeated batch replaces itself), so windows that are still open are in the table too. Sessions
and replays are appended when the watermark has passed them; :func:`run_available` ends a bounded input with a closing row, so that
nothing stays behind.

Replays (:class:`InEventOrder`) hold rows back until the watermark has passed them and then read them in event order, so the answer
does not depend on how rows are spread over files and batches. Event-time timers wake a key when its next row is due, and remove the
state of keys that have been idle for as long as their state can matter. Rows without a time are dropped, as they have no place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from callwarden.operators import content as C
from callwarden.session import scratch_path
from callwarden.sources.tables import CORPUS, is_folder

LATENESS = "2 minutes"
#: Event time of the row that ends a bounded input.
CLOSING = "9000-01-01 00:00:00"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def read_table_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 1000) -> DataFrame:
    """A table's files as a stream, whether the table is one file or a folder of files."""
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(CORPUS[name]).option("maxFilesPerTrigger", files_per_trigger)
    if is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def event_time(df: DataFrame, where: Column | None = None, lateness: str = LATENESS, ts: str = "ts") -> DataFrame:
    """Rows with a time-zone timestamp and a watermark; the watermark follows all rows, the result holds those that fulfil ``where``.

    The condition depends on the event time (a closing row never passes), so it is not pushed below the watermark.
    """
    timed = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    return timed.where(F.when(F.col(ts) < F.lit(CLOSING).cast("timestamp"), F.lit(True) if where is None else where))


def closable(stream: DataFrame, ts: str = "ts") -> tuple[DataFrame, Callable[[], None]]:
    """The stream together with a stream of closing rows, and a function that writes the closing row."""
    spark = stream.sparkSession
    folder = scratch_path(spark, "closing")
    schema = stream.schema
    nothing = spark.createDataFrame([], schema)
    nothing.write.parquet(folder)

    def close() -> None:
        row = spark.range(1).select(*[F.lit(CLOSING if f.name == ts else None).cast(f.dataType).alias(f.name) for f in schema])
        row.write.mode("append").parquet(folder)

    return stream.unionByName(spark.readStream.schema(schema).parquet(folder)), close


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """Stateful processors need the RocksDB state store; a query keeps the setting of its start."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _finish(query: StreamingQuery) -> dict[int, dict]:
    """Wait for the end; progress of every batch, read as it goes because a query remembers the newest 100 only."""
    seen = {}
    while True:
        done = query.awaitTermination(1)
        for p in query.recentProgress:
            seen[p["batchId"]] = p if isinstance(p, dict) else {"observedMetrics": p.observedMetrics, "stateOperators": p.stateOperators}
        if done:
            return seen


def run_available(stream: DataFrame, name: str, close: Callable[[], None] | None = None) -> DataFrame:
    """Process all available input, append it to a new table in the shared folder, and return that table.

    With ``close`` (see :func:`closable`) the query is started once more from its log after the closing row, which moves the watermark
    past everything: windows, sessions and held-back rows that were still open are appended too.
    """
    spark = stream.sparkSession
    path, log = scratch_path(spark, name), scratch_path(spark, f"{name}-log")
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True)
    with _rocks(spark):
        writer.start().awaitTermination()
        if close is not None:
            close()
            writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def upsert_available(stream: DataFrame, name: str, keys: list[str]) -> tuple[DataFrame, dict[str, int]]:
    """Process all available input in update mode; the newest row of each key, and the sums of the stream's observed counts.

    Every batch writes the keys it changed into a folder of its own number, replacing what an earlier attempt of the same batch left.
    Reading takes each key from its highest batch, so nothing is rewritten and a repeated batch changes nothing.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, name)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (stream.writeStream.foreachBatch(save).option("checkpointLocation", scratch_path(spark, f"{name}-log"))
             .outputMode("update").trigger(availableNow=True).start())
    observed: dict[str, int] = {}
    for progress in _finish(query).values():
        for metrics in (progress["observedMetrics"] or {}).values():
            for metric, value in (metrics.asDict() if isinstance(metrics, Row) else metrics).items():
                observed[metric] = observed.get(metric, 0) + value
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(path)
    values = [c for c in stream.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_row"))
    return newest.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in stream.columns]), observed


def late_rows(table: DataFrame, observed: dict[str, int], count: str = "n", windows: int = 1) -> DataFrame:
    """One row: rows that arrived, rows counted in windows (each in ``windows`` of them), and rows or their windows that came too late."""
    arrived = F.lit(observed.get("arrived", 0) * windows)
    return table.agg(F.coalesce(F.sum(count), F.lit(0)).alias("counted")).select(arrived.alias("arrived"), "counted", (arrived - F.col("counted")).alias("late"))


def _arrived(df: DataFrame) -> DataFrame:
    return df.observe("input", F.count(F.lit(1)).alias("arrived"))


# ---------------------------------------------------------------- stateless and windowed jobs


def stream_scan(texts: DataFrame, controls: C.Controls = C.BALANCED, **kw) -> DataFrame:
    """Dry-run decisions on arriving texts."""
    return C.evaluate(texts, controls, **kw)


def stream_timeline(calls: DataFrame, minutes: int = 1, lateness: str = LATENESS) -> DataFrame:
    """Decisions per minute and action."""
    w = F.window("ts", f"{minutes} minutes")
    counted = _arrived(event_time(calls, lateness=lateness)).groupBy(w, "action").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("minute"), "action", "n")


def stream_rates(calls: DataFrame, limits: dict[str, int], bucket: str = "1 minute", lateness: str = LATENESS) -> DataFrame:
    """Calls per scope and bucket with a flag for buckets above the limit."""
    scopes = F.array(
        F.struct(F.concat(F.lit("agent:"), "agent_id").alias("scope"), F.lit(limits["agent"]).alias("max_n")),
        F.struct(F.concat(F.lit("principal:"), "principal").alias("scope"), F.lit(limits["principal"]).alias("max_n")),
        F.struct(F.lit("global").alias("scope"), F.lit(limits["global"]).alias("max_n")),
    )
    rows = event_time(calls, ~F.col("synthetic"), lateness).select("ts", F.explode(scopes).alias("s")).select("ts", "s.*")
    out = _arrived(rows).groupBy(F.window("ts", bucket), "scope", "max_n").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("bucket"), "scope", "n", (F.col("n") > F.col("max_n")).alias("over"))


def stream_breaker_window(calls: DataFrame, window: str = "60 seconds", slide: str = "10 seconds", lateness: str = LATENESS) -> DataFrame:
    """Observed blocks per task in sliding windows."""
    blocked = _arrived(event_time(calls, F.col("action") == "BLOCK", lateness))
    out = blocked.groupBy(F.window("ts", window, slide), "task_id").agg(F.count(F.lit(1)).alias("blocks"))
    return out.select(F.col("window.start").alias("start"), "task_id", "blocks")


def stream_probe_sessions(calls: DataFrame, gap: str = "60 seconds", lateness: str = LATENESS) -> DataFrame:
    """Bursts of refused calls per task: a session ends when the task has been quiet for the gap."""
    blocked = event_time(calls, F.col("action") == "BLOCK", lateness)
    out = blocked.groupBy(F.session_window("ts", gap), "task_id").agg(F.count(F.lit(1)).alias("blocks"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "task_id", "blocks")


# ---------------------------------------------------------------- stateful replays

_MS = 1000


class InEventOrder(StatefulProcessor):
    """Replay of each key's rows in (ts, id) order. Subclasses declare their state in ``open`` and consume due rows in ``replay``.

    ``waiting`` lists the rows the watermark has not passed; one timer per key wakes it at its earliest waiting row or, when none
    waits, at the time from which its state no longer matters.
    """

    #: Columns of a row, the first two being the event time in microseconds and the id.
    COLUMNS = "us long, id long"
    OUTPUT = ""

    def open(self) -> None:
        raise NotImplementedError

    def replay(self, key: tuple, rows: list[tuple]) -> list[tuple]:
        """Output of due rows, in order; many rows come in several calls."""
        raise NotImplementedError

    def idle_from(self) -> int | None:
        """Event time in microseconds from which the state is as good as none; None keeps it."""
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.COLUMNS)
        self.alarm = handle.getValueState("alarm", "ms long")
        self.open()

    def _wake_at(self, us: int | None) -> None:
        old = self.alarm.get()
        at = None if us is None else -(-us // _MS)
        if old is not None:
            if old[0] == at:
                return
            self.handle.deleteTimer(old[0])
            self.alarm.clear()
        if at is not None:
            self.handle.registerTimer(at)
            self.alarm.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for part in rows:
            new = list(zip(*[_plain(part[name], kind) for name, kind in (c.split() for c in self.COLUMNS.split(", "))]))
            if new:
                self.waiting.appendList(new)
                least = min(r[0] for r in new)
                earliest = least if earliest is None else min(earliest, least)
        if earliest is not None:
            old = self.alarm.get()
            if old is None or -(-earliest // _MS) < old[0]:
                self._wake_at(earliest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.alarm.clear()
        passed = timerValues.getCurrentWatermarkInMs() * _MS
        kept = _Rows(self.COLUMNS, self.waiting.get())
        for rows in kept.parts(kept.until(passed)):
            yield pd.DataFrame(self.replay(key, rows), columns=[c.split()[0] for c in self.OUTPUT.split(", ")])
        self.waiting.clear()
        later = kept.after(passed)
        if len(later):
            for rows in kept.parts(later):
                self.waiting.appendList(rows)
            self._wake_at(kept.time(later[0]))
        else:
            idle = self.idle_from()
            if idle is not None and idle <= passed:
                self.forget()
            elif idle is not None:
                self._wake_at(idle)

    def close(self) -> None:
        pass


class _Rows:
    """Rows as Arrow columns, about a tenth of what tuples take, ordered by their first two columns and then as they came."""

    PART = 10_000
    _TYPES = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.large_string()}

    def __init__(self, columns: str, rows: Iterator[tuple]):
        types = [self._TYPES[c.split()[1]] for c in columns.split(", ")]
        rows, batches = iter(rows), []
        while part := list(islice(rows, self.PART)):
            batches.append(pa.RecordBatch.from_arrays([pa.array(values, t) for values, t in zip(zip(*part), types)], names=[str(i) for i in range(len(types))]))
        self.table = pa.Table.from_batches(batches, pa.schema([(str(i), t) for i, t in enumerate(types)]))
        first, second = (self.table.column(i).to_numpy() for i in (0, 1))
        self.order = np.lexsort((second, first))
        self.times = first[self.order]

    def until(self, us: int) -> np.ndarray:
        return self.order[:np.searchsorted(self.times, us, "right")]

    def after(self, us: int) -> np.ndarray:
        return self.order[np.searchsorted(self.times, us, "right"):]

    def time(self, row: int) -> int:
        return self.table.column(0)[int(row)].as_py()

    def parts(self, rows: np.ndarray) -> Iterator[list[tuple]]:
        for at in range(0, len(rows), self.PART):
            yield list(zip(*[c.to_pylist() for c in self.table.take(pa.array(rows[at:at + self.PART])).columns]))


def _plain(values: pd.Series, kind: str) -> list:
    """Python values with None for missing ones; pandas turns whole numbers with gaps into floats."""
    convert = int if kind in ("int", "long") else bool if kind == "boolean" else str
    return [None if gone else convert(v) for v, gone in zip(values, values.isna())]


def replay_stream(rows: DataFrame, key: str, processor: InEventOrder, lateness: str = LATENESS, where: Column | None = None) -> DataFrame:
    """``processor`` over the rows of each key (columns: ts, the key, and what the processor reads) that fulfil ``where``."""
    names = [c.split()[0] for c in processor.COLUMNS.split(", ")]
    wanted = F.col("ts").isNotNull() if where is None else F.col("ts").isNotNull() & where
    timed = event_time(rows, wanted, lateness).withColumn("us", F.unix_micros("ts"))
    return timed.select("ts", key, *names).groupBy(key).transformWithStateInPandas(processor, processor.OUTPUT, "append", "EventTime")


class _Breaker(InEventOrder):
    COLUMNS = "us long, id long, blocked boolean, exempt boolean"
    OUTPUT = "id bigint, task_id string, blocked boolean, refused boolean"

    def __init__(self, blocks: int, window_us: int):
        self.blocks, self.window_us = blocks, window_us

    def open(self) -> None:
        self.recent = self.handle.getListState("recent", "us long")

    def replay(self, key, rows):
        recent = sorted(r[0] for r in self.recent.get())
        out = []
        for us, number, blocked, exempt in rows:
            recent = [t for t in recent if t > us - self.window_us]
            refused = len(recent) >= self.blocks and not exempt
            if blocked or refused:
                recent = [*recent, us][-self.blocks:]
            out.append((number, key[0], blocked, refused))
        if recent:
            self.recent.put([(t,) for t in recent])
        else:
            self.recent.clear()
        return out

    def idle_from(self):
        recent = [r[0] for r in self.recent.get()]
        return max(recent) + self.window_us if recent else None

    def forget(self):
        self.recent.clear()


def stream_breaker(calls: DataFrame, blocks: int, window_seconds: int, lateness: str = LATENESS) -> DataFrame:
    """The breaker with its own refusals fed back. State: the newest ``blocks`` block times, removed one window after the last of them.

    Calls: id, ts, task_id, blocked, and synthetic if some tasks are exempt.
    """
    exempt = F.coalesce(F.col("synthetic"), F.lit(False)) if "synthetic" in calls.columns else F.lit(False)
    rows = calls.select("id", "ts", "task_id", F.coalesce("blocked", F.lit(False)).alias("blocked"), exempt.alias("exempt"))
    return replay_stream(rows, "task_id", _Breaker(blocks, window_seconds * 1_000_000), lateness)


class _Budget(InEventOrder):
    COLUMNS = "us long, id long, kind string, res_id long, tokens long"
    OUTPUT = "id bigint, principal string, kind string, verdict string, spent bigint, reserved bigint"

    def __init__(self, token_limit: int, calls_limit: int, concurrency: int):
        self.token_limit, self.calls_limit, self.concurrency = token_limit, calls_limit, concurrency

    def open(self) -> None:
        self.totals = self.handle.getValueState("totals", "spent long, held long, used long")
        self.reservations = self.handle.getMapState("reservations", "res_id long", "tokens long")

    def replay(self, key, rows):
        spent, held, used = self.totals.get() or (0, 0, 0)
        before = {k[0]: v[0] for k, v in self.reservations.iterator()}
        is_open, out = dict(before), []
        for _, number, kind, res_id, tokens in rows:
            verdict = "ignored"
            if kind == "reserve" and res_id not in is_open:
                fits = spent + held + tokens <= self.token_limit and used < self.calls_limit and len(is_open) < self.concurrency
                verdict = "admitted" if fits else "refused"
                if fits:
                    held, used, is_open[res_id] = held + tokens, used + 1, tokens
            elif kind != "reserve" and res_id in is_open:
                amount = is_open.pop(res_id)
                verdict = kind
                if kind == "settle":
                    held, spent = held - amount, spent + tokens
            out.append((number, key[0], kind, verdict, spent, held))
        self.totals.update((spent, held, used))
        for res_id in before.keys() - is_open.keys():
            self.reservations.removeKey((res_id,))
        for res_id, tokens in is_open.items():
            if before.get(res_id) != tokens:
                self.reservations.updateValue((res_id,), (tokens,))
        return out

    def idle_from(self):
        return None

    def forget(self):
        pass


def stream_budget(moves: DataFrame, token_limit: int, calls_limit: int, concurrency: int, lateness: str = LATENESS) -> DataFrame:
    """Reserve, settle and uncertain moves of each principal (id, ts, principal, kind, res_id, tokens).

    State: spent, held and used totals, and a map of the open reservations, at most ``concurrency``. A reservation is taken only if all
    three limits leave room; settling frees the slot and charges actual tokens, an unknown outcome frees the slot only. A reservation of
    an id that is still open is a repeated message and changes nothing. Totals are the ledger itself and never expire.
    """
    rows = moves.select("id", "ts", "principal", "kind", F.col("res_id").cast("long").alias("res_id"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"))
    return replay_stream(rows, "principal", _Budget(token_limit, calls_limit, concurrency), lateness)


class _Taint(InEventOrder):
    COLUMNS = "us long, id long, label int"
    OUTPUT = "id bigint, task_id string, level int"

    def __init__(self, forget_us: int | None):
        self.forget_us = forget_us

    def open(self) -> None:
        self.level = self.handle.getValueState("level", "level int, us long")

    def replay(self, key, rows):
        level, last = self.level.get() or (0, None)
        out = []
        for us, number, label in rows:
            if last is not None and self.forget_us is not None and us >= last + self.forget_us:
                level = 0
            out.append((number, key[0], level))
            level, last = max(level, label or 0), us
        self.level.update((level, last))
        return out

    def idle_from(self):
        return None if self.forget_us is None or not self.level.exists() else self.level.get()[1] + self.forget_us

    def forget(self):
        self.level.clear()


def stream_taint(calls: DataFrame, forget_seconds: int | None = None, lateness: str = LATENESS) -> DataFrame:
    """Level of each task before each call (id, ts, task_id, label: null unless the call reads).

    State: one number a task, removed ``forget_seconds`` after its last call if given (tasks that expire need no level afterwards).
    """
    rows = calls.select("id", "ts", "task_id", F.col("label").cast("int").alias("label"))
    return replay_stream(rows, "task_id", _Taint(None if forget_seconds is None else forget_seconds * 1_000_000), lateness)


class _FirstInSpan(InEventOrder):
    """The key is a group of texts, as each call to the state store costs more than a text does."""

    COLUMNS = "us long, id long, hash string, text string"
    OUTPUT = "id bigint, ts timestamp, hash string, text string"

    def __init__(self, span_us: int):
        self.span_us = span_us

    def open(self) -> None:
        self.last = self.handle.getListState("last", "hash string, us long")

    def replay(self, key, rows):
        # rows come in order: what the first of them no longer falls under matters to none
        last = {h: us for h, us in self.last.get() if us + self.span_us > rows[0][0]}
        out = []
        for us, number, text_hash, text in rows:
            if text_hash not in last or us >= last[text_hash] + self.span_us:
                last[text_hash] = us
                out.append((number, pd.Timestamp(us, unit="us"), text_hash, text))
        if last:
            self.last.put([*last.items()])
        else:
            self.last.clear()
        return out

    def idle_from(self):
        newest = max((us for _, us in self.last.get()), default=None)
        return None if newest is None else newest + self.span_us

    def forget(self):
        self.last.clear()


def stream_dedup_score(texts: DataFrame, within_seconds: int = 3600, lateness: str = LATENESS, groups: int = 1024) -> DataFrame:
    """Risk of texts (id, ts, text): the first of equal texts is scored, and again only once the time span has passed since the last score.

    State: one time for each text of the newest span, and the texts that wait for the watermark, in ``groups`` groups by hash (fixed for
    the life of a checkpoint). Null texts are not scored.
    """
    hashed = texts.withColumn("hash", F.sha2("text", 256)).withColumn("group", F.pmod(F.xxhash64("hash"), F.lit(groups)))
    fresh = replay_stream(hashed.select("id", "ts", "text", "hash", "group"), "group", _FirstInSpan(within_seconds * 1_000_000), lateness,
                          F.col("text").isNotNull())
    return C.scan(fresh, "text", "user_input", parts=("injection", "risk")).select("id", "ts", "hash", "risk")
