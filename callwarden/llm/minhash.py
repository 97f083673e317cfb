"""Near-duplicate documents by min-max hashing.

Each permutation of the shingle hashes gives two values, its minimum and its maximum, so a signature of 2n values costs n
evaluations per shingle. Both agree with probability equal to the Jaccard similarity, and together they vary less than n
minima. The values are banded; documents that share a band are candidates, and every reported link is confirmed on the full
shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callwarden.llm.common import WordHashes, documents, mix, shingles, store
from callwarden.llm.components import components

PERMUTATIONS = 128
ROWS = 6
BANDS = 2 * PERMUTATIONS // ROWS
#: Sketch bits that may differ in a candidate pair. At similarity 0.8 one bit in ten differs (standard deviation 4.8 of 256).
MAX_BITS = 48
#: Rounds that compare one member of a bucket with the others, before the pairs that are still apart are compared one by one.
TURNS = 8
_BLOCK = 8192
_SIDE = 512
_FEATURES = "doc_id long, n_shingles long, k1 long, k2 long, s0 long, s1 long, s2 long, s3 long, bands array<long>"


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_24)
    return (rng.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1),
            rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32))


def _signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    high = np.zeros(PERMUTATIONS, np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(x), _BLOCK):
        v = a[:, None] * x[None, start:start + _BLOCK]
        v += b[:, None]
        np.minimum(low, v.min(axis=1), out=low)
        np.maximum(high, v.max(axis=1), out=high)
    return np.stack([low, high], axis=1).ravel()


def _features(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        a, b = _multipliers()
        salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                sizes, keys, signatures = [], [], []
                for text in batch.column(1).to_pylist():
                    got = shingles((text or "").encode("utf-8", "surrogatepass").lower().split(), width, known)
                    sizes.append(len(got))
                    keys.append(xxhash.xxh3_128_intdigest(got.tobytes()))
                    signatures.append(_signature(got, a, b))
                values = np.array(signatures, np.uint32).astype(np.uint64).reshape(len(sizes), -1)
                acc = np.repeat(salt[None, :], len(sizes), axis=0)
                for r in range(ROWS):
                    acc = mix(acc + values[:, r:ROWS * BANDS:ROWS] * np.uint64(0x9E3779B97F4A7C15))
                bits = ((mix(values + np.uint64(1)) >> np.uint64(17)) & np.uint64(1)).astype(np.uint8)
                packed = np.packbits(bits, axis=1).view(np.int64)
                offsets = np.arange(0, BANDS * len(sizes) + 1, BANDS, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array(sizes, pa.int64()),
                    pa.array(np.array([k >> 64 for k in keys], np.uint64).view(np.int64)),
                    pa.array(np.array([k & 0xFFFFFFFFFFFFFFFF for k in keys], np.uint64).view(np.int64)),
                    *[pa.array(np.ascontiguousarray(packed[:, i])) for i in range(4)],
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(acc.ravel().view(np.int64))),
                ], names=["doc_id", "n_shingles", "k1", "k2", "s0", "s1", "s2", "s3", "bands"])
    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sets = [shingles((t or "").encode("utf-8", "surrogatepass").lower().split(), width, known) for t in batch.column(1).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                                                 names=["node", "shingles"])
    return run


_NEAR = (f"bit_count(x.s0 ^ y.s0) + bit_count(x.s1 ^ y.s1) + bit_count(x.s2 ^ y.s2) + bit_count(x.s3 ^ y.s3) <= {MAX_BITS}"
         " AND {den} * least(x.n, y.n) >= {num} * greatest(x.n, y.n)")


def _blocks(alive: DataFrame) -> DataFrame:
    """Deal the members of each bucket to a grid of blocks: those outside its largest component (role 0) meet all members (role 1)."""
    sizes = alive.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("band").agg(F.max_by("comp", "m").alias("main"), F.sum("m").alias("m"), F.max("m").alias("top"))
    cut = sizes.select("band", "main", F.ceil(F.col("m") / _SIDE).cast("int").alias("ny"), F.ceil((F.col("m") - F.col("top")) / _SIDE).cast("int").alias("nx"))
    rows = alive.join(cut, "band")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    outside = rows.where("comp <> main").withColumn("role", F.lit(0)).withColumn("bx", own("nx", 1)).withColumn("by", F.explode(every("ny")))
    members = rows.withColumn("role", F.lit(1)).withColumn("by", own("ny", 2)).withColumn("bx", F.explode(every("nx")))
    return outside.unionByName(members).drop("main", "nx", "ny")


def _compare(num: int, den: int):
    """Links between different components within one block; a pair is looked at in the first of the bands it shares."""
    def matrix(d: dict, part: slice) -> tuple:
        return (np.array([[d[f"s{i}"][k] for i in range(4)] for k in range(part.start, part.stop)], np.int64).view(np.uint64), np.array(d["n"][part]),
                np.array(d["comp"][part]), d["node"][part], np.array(d["bands"][part]), [np.array(s, np.int64) for s in d["shingles"][part]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, left = None, []
        for whole in batches:
            for at in range(0, whole.num_rows, _SIDE):
                d = whole.slice(at, _SIDE).to_pydict()
                keys, start, found = list(zip(d["band"], d["bx"], d["by"], strict=True)), 0, []
                while start < len(keys):
                    if keys[start] != key:
                        key, left = keys[start], []
                    stop = start
                    while stop < len(keys) and keys[stop] == key and d["role"][stop] == d["role"][start]:
                        stop += 1
                    side = matrix(d, slice(start, stop))
                    if d["role"][start] == 0:
                        left.append(side)
                        start = stop
                        continue
                    start = stop
                    for x in left:
                        bits = np.bitwise_count(x[0][:, None, :] ^ side[0][None, :, :]).sum(axis=2, dtype=np.int64)
                        small, large = np.minimum(x[1][:, None], side[1][None, :]), np.maximum(x[1][:, None], side[1][None, :])
                        for i, j in zip(*np.nonzero((bits <= MAX_BITS) & (den * small >= num * large) & (x[2][:, None] != side[2][None, :])), strict=True):
                            first = int((x[4][i] == side[4][j]).argmax())
                            if x[4][i][first] != key[0]:
                                continue
                            common = len(np.intersect1d(x[5][i], side[5][j], assume_unique=True))
                            if den * common >= num * (int(x[1][i]) + int(side[1][j]) - common):
                                found.append((x[3][i], side[3][j]))
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])
    return run


def near_duplicates(docs: DataFrame, shingle_words: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Words are split at ASCII white space and ASCII letters are folded. Two documents are linked if the Jaccard similarity of
    their shingle sets is at least ``similarity`` (numerator, denominator). ``component_id`` is the smallest id reachable.

    Equal sets are one class before anything is compared, so groups of copies cost one signature. In each band bucket every
    class is compared with the smallest id, then in a few rounds with another member each; pairs of a bucket that are still in
    different components after that and whose sketches are near are compared in blocks inside tasks, which hand on links only. Candidates share a band of
    six values out of 42 bands: a pair of similarity 0.8 is missed with probability 3e-6.

    Null or empty text, or no words: an empty set, linked with nothing. Null ids join the component of equal texts but never
    name one. Rows that repeat an id are the same node; extra columns are ignored; an empty table gives an empty result.
    """
    num, den = similarity
    texts = documents(docs)
    feats = store(texts.mapInArrow(_features(shingle_words), _FEATURES), "minmax")
    classes = (feats.where("n_shingles > 0").groupBy("k1", "k2")
               .agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("n_shingles", "s0", "s1", "s2", "s3", "bands"), "doc_id").alias("f")))
    classes = store(classes, "minmax-classes")
    nodes = classes.where("rep IS NOT NULL").select(F.col("rep").alias("node"), F.col("f.n_shingles").alias("n"),
                                                    *[F.col(f"f.s{i}").alias(f"s{i}") for i in range(4)], F.col("f.bands").alias("bands"))
    banded = classes.where("rep IS NOT NULL").select(F.col("rep").alias("node"), F.explode("f.bands").alias("band"))
    centers = banded.groupBy("band").agg(F.min("node").alias("center"), F.max("node").alias("last")).where("center < last").drop("last")
    members = store(banded.join(centers, "band"), "minmax-members")

    def near(pairs: DataFrame) -> DataFrame:
        slim = nodes.drop("bands")
        x, y = slim.alias("x"), slim.alias("y")
        return (pairs.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node"))
                .where(_NEAR.format(num=num, den=den)).select("a", "b").distinct())

    stars = store(near(members.where("node <> center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct()), "minmax-stars")
    needed = members.select("node").distinct()
    sets = store(texts.join(needed, texts.doc_id == needed.node, "left_semi").mapInArrow(_sets(shingle_words), "node long, shingles array<long>"),
                 "minmax-sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        left, right = sets.toDF("a", "sa"), sets.toDF("b", "sb")
        both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"),
                                                             F.size(F.array_intersect("sa", "sb")).alias("common"))
        return both.where(f"{den} * common >= {num} * (na + nb - common)").select("a", "b")

    def merged(place: DataFrame, links: DataFrame) -> DataFrame:
        """Components after more links: only the components that the links join are looked at."""
        ends = place.toDF("a", "ca"), place.toDF("b", "cb")
        joins = links.join(ends[0], "a").join(ends[1], "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        groups = components(joins).toDF("comp", "into")
        return store(place.join(groups, "comp", "left").select("node", F.coalesce("into", "comp").alias("comp")), "minmax-place")

    def unsettled(place: DataFrame) -> DataFrame:
        """Members of the buckets that still hold several components."""
        placed = members.select("node", "band").join(place, "node")
        mixed = placed.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo < hi AND m > 2")
        return store(placed.join(mixed.select("band"), "band"), "minmax-open")

    place = merged(needed.withColumn("comp", F.col("node")), store(confirmed(stars), "minmax-links"))
    rest = unsettled(place)
    for turn in range(1, TURNS + 1):
        # another member of each bucket is compared with all the others that are not yet in its component
        drawn = rest.groupBy("band").agg(F.min_by(F.struct("node", "comp"), F.xxhash64("node", F.lit(turn))).alias("c"))
        tries = rest.join(drawn, "band").where("comp <> c.comp").select(F.greatest("node", F.col("c.node")).alias("a"), F.least("node", F.col("c.node")).alias("b"))
        links = store(confirmed(near(tries.distinct())), "minmax-links")
        found = links.count()
        if found:
            place = merged(place, links)
            rest = unsettled(place)
        if found * 50 < rest.count():
            break
    rest = store(rest.join(nodes.drop("bands"), "node").select("band", "comp", "node", "n", "s0", "s1", "s2", "s3"), "minmax-open")
    apart = F.expr("x.band = y.band AND x.comp <> y.comp AND " + _NEAR.format(num=num, den=den))
    alive = store(rest.alias("x").join(rest.alias("y"), apart, "left_semi"), "minmax-alive")
    pairs = _blocks(alive).join(sets, "node").join(nodes.select("node", "bands"), "node")
    pairs = pairs.repartition("band", "bx", "by").sortWithinPartitions("band", "bx", "by", "role", "node")
    pairs = pairs.select("band", "bx", "by", "role", "node", "comp", "n", "s0", "s1", "s2", "s3", "bands", "shingles").mapInArrow(_compare(num, den), "a long, b long")
    final = merged(place, pairs).toDF("node", "component")
    joined = feats.select("doc_id", "n_shingles", "k1", "k2").join(classes.select("k1", "k2", "rep"), ["k1", "k2"], "left")
    joined = joined.join(final.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
