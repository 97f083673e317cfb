"""Removal of repeated byte passages with bucket-pointer refinement.

Equal passages of ``length`` bytes hold equal q-grams at equal offsets, so the initial buckets are made of chosen q-grams only: the
smallest hashes of each window, which every copy of a passage chooses alike. Buckets of one position are dropped. The remaining
ones are refined inside tasks: positions of one bucket carry a pointer to their class of equal strings, sorting on the pointers
of two offsets makes the classes of strings twice as long, and the updated pointers are used again for the next step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callwarden.llm.common import mix, store

QGRAM = 40
#: Distinct contexts of one bucket that a task refines; larger buckets are refined by hashes over all executors.
BUCKET = 50_000
_CHUNK = 1 << 18
_REFINE_BYTES = 1 << 21


def _sliding(values: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over every run of ``width`` values, by doubling."""
    span, out = 1, values
    while span * 2 <= width:
        out = op(out[:-span], out[span:])
        span *= 2
    return op(out[:len(values) - width + 1], out[width - span:width - span + len(values) - width + 1]) if span < width else out


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the QGRAM bytes at every position (the last ones read zero bytes behind the end)."""
    padded = np.concatenate([data, np.zeros(QGRAM + 8, np.uint8)])
    n = len(data)
    h8 = np.ndarray((n + QGRAM,), "<u8", padded, strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
    h8 ^= h8 >> np.uint64(29)
    h16 = h8[:-8] * np.uint64(0xBF58476D1CE4E5B9)
    h16 += h8[8:]
    h32 = h16[:n] * np.uint64(0x94D049BB133111EB)
    h32 += h16[16:n + 16]
    h32 *= np.uint64(0xC2B2AE3D27D4EB4F)
    h32 += h8[32:n + 32]
    h32 ^= h32 >> np.uint64(32)
    h32 *= np.uint64(0xD6E8FEB86659FD93)
    h32 ^= h32 >> np.uint64(32)
    return h32


def _anchors(texts: list[bytes], length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(text number, positions, q-gram hashes)``: in every window of ``length`` bytes all q-grams of the smallest hash."""
    window = length - QGRAM + 1
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return
    grams = _grams(data)
    rank = (grams >> np.uint64(33)).astype(np.uint32) + np.uint32(1)
    low = _sliding(rank, window, np.minimum)
    inside = np.zeros(len(data) + 1, np.int8)  # starts of whole windows: not so near to a text's end that they'd cross it
    long = sizes >= length
    np.add.at(inside, (ends - sizes)[long], 1)
    np.add.at(inside, (ends - length + 1)[long], -1)
    low = np.where(np.cumsum(inside, dtype=np.int8)[:len(low)] > 0, low, np.uint32(0))  # 0: no window
    fringe = np.zeros(window - 1, np.uint32)
    best = _sliding(np.concatenate([fringe, low, fringe]), window, np.maximum)
    at = np.flatnonzero(best == rank[:len(best)])
    owner = np.searchsorted(ends, at, side="right")
    starts = ends - sizes
    keep = at + QGRAM <= ends[owner]
    at, owner = at[keep], owner[keep]
    for first, last in _runs(owner):
        k = int(owner[first])
        yield k, at[first:last] - starts[k], grams[at[first:last]]


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    starts = np.flatnonzero(np.diff(values, prepend=-1)) if len(values) else np.empty(0, int)
    yield from zip(starts, [*starts[1:], len(values)], strict=True)


def _context(at: int, size: int, length: int) -> tuple[int, int]:
    """Bytes that passages around the q-gram at ``at`` can reach."""
    return max(0, at + QGRAM - length), min(size, at + length)


def _packs(texts: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if texts:
        yield start, len(texts)


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
            ids, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, last in _packs(texts, _CHUNK):
                out: tuple[list, list, list, list] = ([], [], [], [])
                for k, at, grams in _anchors(texts[first:last], length):
                    text = texts[first + k]
                    view = memoryview(text)
                    out[0].append(grams)
                    out[1].extend(xxhash.xxh3_64_intdigest(view[slice(*_context(p, len(text), length))], p if p < length - QGRAM else length)
                                  for p in at.tolist())
                    out[2].append(np.full(len(at), ids[first + k], np.int64))
                    out[3].append((at.astype(np.int64) << 32) | marks[first + k])
                if out[0]:
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.concatenate(out[0]).view(np.int64)), pa.array(np.array(out[1], np.uint64).view(np.int64)),
                        pa.array(np.concatenate(out[2])), pa.array(np.concatenate(out[3]))], names=["q", "c", "doc_id", "loc"])
    return run


def _context_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            d = batch.to_pydict()
            out: tuple[list, list, list, list] = ([], [], [], [])
            for packed, anchors in zip(d["packed"], d["anchors"], strict=True):
                text = unpack.decompress(packed)
                for a in anchors:
                    lo, hi = _context(a["at"], len(text), length)
                    for column, value in zip(out, (a["q"], a["c"], a["at"] - lo, text[lo:hi]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()),
                                              pa.array(out[3], pa.binary())], names=["q", "c", "lead", "bytes"])
    return run


def _classes(keys: np.ndarray) -> np.ndarray:
    """A number for each class of equal keys; -1 for keys that occur once."""
    _, names, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return np.where(counts[names] > 1, names, -1).astype(np.int32)


def _refine(bucket: np.ndarray, lead: np.ndarray, data: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last offset of a repeated passage in each context; -1 if there is none.

    Contexts of a bucket are laid over each other with the q-gram in one column. A pointer names the class of strings that are
    equal from a column on; a passage that is repeated elsewhere meets its copy in the bucket of its own q-gram. Sorting one
    column by its own pointers and those of a later column gives the pointers of longer strings.
    """
    n, sizes = len(data), np.array([len(d) for d in data])
    span = 2 * length - QGRAM
    shift = length - QGRAM - lead
    grams = np.zeros((span, n), np.uint64)
    full = np.zeros((span, n), bool)
    for at in range(0, n, 2000):
        part = sizes[at:at + 2000]
        row = np.repeat(np.arange(len(part)), part)
        col = np.arange(len(row)) - (np.cumsum(part) - part)[row]
        whole = col + QGRAM <= part[row]
        row, col, values = row[whole], col[whole], _grams(np.frombuffer(b"".join(data[at:at + 2000]), np.uint8))[whole]
        col = col + shift[at + row]
        grams[col, at + row], full[col, at + row] = values, True
    own = mix(bucket.astype(np.uint64) + np.uint64(1))
    pointer = np.full((span, n), -1, np.int32)
    for c in range(span - QGRAM + 1):
        there = np.flatnonzero(full[c])
        pointer[c, there] = _classes(grams[c, there] ^ own[there])
    del grams, full
    depth = QGRAM
    while depth < length:
        step = min(depth, length - depth)
        for c in range(span - depth - step + 1):  # the later column still holds pointers of this depth
            there = np.flatnonzero((pointer[c] >= 0) & (pointer[c + step] >= 0))
            names = _classes((pointer[c, there].astype(np.int64) << 32) | pointer[c + step, there])
            pointer[c] = -1
            pointer[c, there] = names
        depth += step
    repeated = pointer[:length - QGRAM + 1].T >= 0
    some = repeated.any(axis=1)
    last = repeated.shape[1] - 1 - repeated[:, ::-1].argmax(axis=1)
    return np.where(some, repeated.argmax(axis=1) - shift, -1), np.where(some, last - shift, -1)


def _refined(length: int):
    """Rows sorted by bucket; whole buckets are refined together."""
    def result(q: list[int], c: list[int], lead: list[int], data: list[bytes]) -> pa.RecordBatch:
        first, last = _refine(np.unique(q, return_inverse=True)[1], np.array(lead, np.int64), data, length)
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(c, pa.int64()), pa.array(first.astype(np.int32)),
                                           pa.array(last.astype(np.int32))], names=["q", "c", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        size = 0
        for batch in batches:
            d = batch.to_pydict()
            for row in zip(d["q"], d["c"], d["lead"], d["bytes"], strict=True):
                if size > _REFINE_BYTES and row[0] != held[0][-1]:
                    yield result(*held)
                    held, size = ([], [], [], []), 0
                for column, value in zip(held, row, strict=True):
                    column.append(value)
                size += len(row[3])
        if held[0]:
            yield result(*held)
    return run


def _windows(length: int):
    """Every passage of a context by its hash, for buckets that no task should hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                d = whole.slice(at, 500).to_pydict()
                out: tuple[list, list, list, list, list] = ([], [], [], [], [])
                for q, c, lead, data in zip(d["q"], d["c"], d["lead"], d["bytes"], strict=True):
                    view = memoryview(data)
                    for start in range(len(data) - length + 1):
                        for column, value in zip(out, (q, c, start, start - lead, xxhash.xxh3_64_intdigest(view[start:start + length])), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()),
                                                  pa.array(out[3], pa.int32()), pa.array(np.array(out[4], np.uint64).view(np.int64))],
                                                 names=["q", "c", "start", "place", "h"])
    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = [squeeze.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["doc_id", "mark", "packed"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            d = whole.slice(at, 1000).to_pydict()
            out: tuple[list, list, list, list, list] = ([], [], [], [], [])
            for doc, packed, spans in zip(d["doc_id"], d["packed"], d["spans"], strict=True):
                text = unpack.decompress(packed)
                kept, end, removed, runs = [], 0, 0, 0
                for s in sorted(spans or (), key=lambda s: s["start"]):
                    lo, hi = s["start"], min(s["stop"], len(text))
                    if lo > end or not runs:
                        kept.append(text[end:lo])
                        runs += 1
                        end = lo
                    removed += max(0, hi - end)
                    end = max(end, hi)
                kept.append(text[end:])
                rest = b"".join(kept)
                for column, value in zip(out, (doc, len(text), removed, runs, rest), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*[pa.array(o, pa.int64()) for o in out[:4]], pa.array(out[4], pa.binary())],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` for every row; ``kept`` is the text's bytes without repeated passages.

    A byte goes if it lies in a string of ``length`` bytes that starts at another place too, in the same or another document;
    overlapping copies count, and all strings are judged on the input. The result is exact up to 64-bit hashes inside a bucket.

    Null or empty texts and texts shorter than ``length`` keep everything. Null ids are allowed. Rows that repeat an id and a text
    are copies of each other; rows that repeat an id with other texts are told apart by a hash of the text. Extra columns are
    ignored; an empty table gives an empty result.
    """
    if length < 2 * QGRAM:
        raise ValueError(f"length must be at least {2 * QGRAM}")
    nothing = -(1 << 63)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(nothing)).alias("doc_id"),
                        F.pmod(F.hash(F.coalesce("text", F.lit(""))), F.lit((1 << 31) - 1)).cast("long").alias("mark"),
                        F.coalesce("text", F.lit("")).alias("text"))
    anchors = texts.mapInArrow(_anchor_rows(length), "q long, c long, doc_id long, loc long")
    shared = anchors.groupBy("q").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("q")
    anchors = store(anchors.join(shared, "q"), "anchors")
    classes = store(anchors.groupBy("q", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "loc")).alias("rep")), "anchor-classes")
    buckets = classes.groupBy("q").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).where("m > 1 AND least = 1")
    wanted = classes.join(buckets.select("q", "m"), "q").select(
        F.col("rep.doc_id").alias("doc_id"), F.expr("rep.loc & 4294967295").alias("mark"),
        F.struct(F.shiftright("rep.loc", 32).alias("at"), "q", "c").alias("anchor"))
    wanted = wanted.groupBy("doc_id", "mark").agg(F.collect_list("anchor").alias("anchors"))
    packed = texts.mapInArrow(_pack, "doc_id long, mark long, packed binary")
    once = packed.join(wanted, ["doc_id", "mark"]).select("packed", "anchors")
    contexts = once.mapInArrow(_context_rows(length), "q long, c long, lead int, bytes binary").dropDuplicates(["q", "c"])
    contexts = store(contexts.repartition("q").sortWithinPartitions("q"), "contexts")
    sizes = contexts.groupBy("q").agg(F.count(F.lit(1)).alias("m"))
    large = sizes.where(F.col("m") > BUCKET).select("q")
    small = contexts.join(large, "q", "left_anti").repartition("q").sortWithinPartitions("q")
    found = small.mapInArrow(_refined(length), "q long, c long, first int, last int").where("first >= 0")
    passages = contexts.join(large, "q", "left_semi").mapInArrow(_windows(length), "q long, c long, start int, place int, h long")
    twice = passages.groupBy("q", "place", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    spread = passages.join(twice, ["q", "place", "h"]).groupBy("q", "c").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    judged = classes.select("q", "c", "n").join(found.union(spread), ["q", "c"], "left").where("n > 1 OR first IS NOT NULL")
    at = F.shiftright("loc", 32)
    lead = F.least(at, F.lit(length - QGRAM))
    start = F.when(F.col("n") > 1, at - lead).otherwise(at - lead + F.col("first"))
    stop = F.when(F.col("n") > 1, at + length).otherwise(at - lead + F.col("last") + length)
    spans = (anchors.join(judged, ["q", "c"]).select("doc_id", F.expr("loc & 4294967295").alias("mark"), F.struct(start.alias("start"), stop.alias("stop")).alias("span"))
             .groupBy("doc_id", "mark").agg(F.collect_set("span").alias("spans")))
    out = packed.join(spans, ["doc_id", "mark"], "left").select("doc_id", "packed", "spans")
    out = out.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != nothing, F.col("doc_id")))
