"""Embedding near-duplicates by dual traversal of cover trees.

The upper levels of the tree are Spark rounds: a cell that holds too many vectors gets pivots of a net with halving radii, every
vector moves to its nearest pivot's cell (its home) and visits the other cells that may hold vectors within reach. The lower levels
are built inside tasks: node pairs are dropped when the distance of their centers exceeds both covering radii plus the reach.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callwarden.llm.common import store
from callwarden.llm.components import components

#: Homes of a cell, visitors of a task, pivots of a cell and sampled candidates per pivot. They size tasks; results don't depend on them.
HOMES = 2000
VISITORS = 20_000
PIVOTS = 32
CANDIDATES = 16
LEVELS = 12
_LEAF = 4096  # pairs of a leaf
_ROWS = "cell string, node long, w long, vec binary, home boolean"
_SLACK = 1e-9


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors in double precision."""
    for batch in batches:
        vecs = []
        for values in batch.column(3).to_pylist():
            v = np.array(values, np.float64)
            v /= np.abs(v).max()
            vecs.append((v / math.sqrt(float(v @ v))).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(vecs, pa.binary()),
                                          pa.array([True] * len(vecs))], names=["cell", "node", "w", "vec", "home"])


def _matrix(vecs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), np.float64).reshape(len(vecs), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def _net(points: np.ndarray, most: int) -> np.ndarray:
    """Indices of a net: nested levels, each covering what is left with half the radius, until ``most`` centers are found."""
    chosen = [0]
    near = _distances(points, points[:1])[:, 0]
    radius = 2.0
    while len(chosen) < most and near.max() > 1e-6:
        far = int(near.argmax())
        if near[far] <= radius:
            radius /= 2
            continue
        chosen.append(far)
        near = np.minimum(near, _distances(points, points[far:far + 1])[:, 0])
    return np.array(chosen)


def _route(reach: float):
    """Rows of one (cell, salt): the pivot candidates first, then the vectors to be moved."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, pool, pivots, count = None, [], None, 0
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                d = whole.slice(at, 4096).to_pydict()
                out: tuple[list, list, list, list, list] = ([], [], [], [], [])
                cells, start = d["cell"], 0
                while start < len(cells):
                    if cells[start] != cell:
                        cell, pool, pivots = cells[start], [], None
                    stop = start
                    while stop < len(cells) and cells[stop] == cell and d["data"][stop] == d["data"][start]:
                        stop += 1
                    part = slice(start, stop)
                    start = stop
                    if not d["data"][part.start]:
                        pool += d["vec"][part]
                        count = d["w"][part.start]
                        continue
                    if pivots is None:
                        points = _matrix(pool)
                        pivots = points[_net(points, max(2, min(PIVOTS, -(-count * 2 // HOMES))))]
                        apart = _distances(pivots, pivots)
                    x = _matrix(d["vec"][part])
                    far = _distances(x, pivots)
                    own = far.argmin(axis=1)
                    least = far[np.arange(len(x)), own]
                    # y in cell j is nearer to pivot j than to the own pivot: x is at most `reach` beyond their bisector
                    visit = far ** 2 <= (least ** 2)[:, None] + 2 * reach * apart[own] + _SLACK
                    for i, j in zip(*np.nonzero(visit), strict=True):
                        k = part.start + int(i)
                        for column, value in zip(out, (f"{cell}/{j}", d["node"][k], d["w"][k], d["vec"][k],
                                                       bool(d["home"][k] and own[i] == j)), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()),
                                                  pa.array(out[3], pa.binary()), pa.array(out[4], pa.bool_())],
                                                 names=["cell", "node", "w", "vec", "home"])
    return run


def _children(x: np.ndarray, members: np.ndarray, radius: float) -> list[tuple[int, np.ndarray, float]]:
    """Cover ``members`` with balls of ``radius`` around some of them: (center, members, covering radius)."""
    made, left = [], members
    while len(left):
        d = _distances(x[left], x[left[:1]])[:, 0]
        inside = d <= radius
        inside[0] = True
        made.append((int(left[0]), left[inside], float(d[inside].max())))
        left = left[~inside]
    return made


def _dual(x: np.ndarray, y: np.ndarray, reach: float, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (of x, of y) with cosine at least ``cosine``, by traversing both trees together."""
    def leaf(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(a), 512):
            i, j = np.nonzero(x[a[at:at + 512]] @ y[b].T >= cosine)
            if len(i):
                yield a[at + i], b[j]

    todo = [(np.arange(len(x)), np.arange(len(y)), 2.0)]
    while todo:
        a, b, radius = todo.pop()
        if len(a) * len(b) <= _LEAF or radius < reach / 4:
            yield from leaf(a, b)
            continue
        ca, cb = _children(x, a, radius / 2), _children(y, b, radius / 2)
        bound = np.array([c[2] for c in ca])[:, None] + np.array([c[2] for c in cb])[None, :] + reach + _SLACK
        near = _distances(x[[c[0] for c in ca]], y[[c[0] for c in cb]]) <= bound
        if near.mean() > 0.25 and near.size > 1:  # nothing left to prune: one product is cheaper than its parts
            yield from leaf(a, b)
            continue
        for i in np.flatnonzero(near.any(axis=1)):
            single = [j for j in np.flatnonzero(near[i]) if len(ca[i][1]) * len(cb[j][1]) <= _LEAF]
            if single:
                yield from leaf(ca[i][1], np.concatenate([cb[j][1] for j in single]))
            todo += [(ca[i][1], cb[j][1], radius / 2) for j in np.flatnonzero(near[i]) if len(ca[i][1]) * len(cb[j][1]) > _LEAF]


class _Cell:
    """Homes of one (cell, salt), and what they were linked with."""

    def __init__(self, cosine: float, reach: float, salt: int):
        self.cosine, self.reach, self.salt = cosine, reach, salt
        self.nodes: list[int] = []
        self.weights: list[int] = []
        self.vecs: list[bytes] = []
        self.ready = False

    def start(self) -> None:
        self.x = _matrix(self.vecs) if self.vecs else np.empty((0, 0))
        self.w = np.array(self.weights, np.int64)
        self.links = np.zeros(len(self.w), np.int64)
        self.label = np.arange(len(self.w))
        self.edges: set[tuple[int, int]] = set()
        self.ready = True
        if self.salt == 0 and len(self.w):
            self.links += self.w - 1
            for i, j in _dual(self.x, self.x, self.reach, self.cosine):
                differ = i != j
                self.count(i[differ], self.w[j[differ]])
                self.merge(i[differ], j[differ])

    def merge(self, i: np.ndarray, j: np.ndarray) -> None:
        """Join the groups of linked homes; one edge for each group that joins another."""
        if not len(i):
            return
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        starts = np.flatnonzero(np.diff(i, prepend=-1))
        for start, stop in zip(starts, [*starts[1:], len(i)], strict=True):
            a = i[start]
            groups, first = np.unique(self.label[j[start:stop]], return_index=True)
            for group, k in zip(groups, first, strict=True):
                if group != self.label[a]:
                    self.edges.add((self.nodes[a], self.nodes[j[start + k]]))
                    self.label[self.label == group] = self.label[a]

    def count(self, at: np.ndarray, weights: np.ndarray) -> None:
        self.links += np.bincount(at, weights=weights, minlength=len(self.links)).astype(np.int64)

    def visit(self, nodes: list[int], weights: list[int], vecs: list[bytes]) -> None:
        if not len(self.w):
            return
        w = np.array(weights, np.int64)
        for i, j in _dual(self.x, _matrix(vecs), self.reach, self.cosine):
            self.count(i, w[j])
            _, once = np.unique(self.label[i] * len(nodes) + j, return_index=True)  # one edge for each visitor and group of homes
            self.edges.update((self.nodes[a], nodes[b]) for a, b in zip(i[once], j[once], strict=True))


def _join(cosine: float, reach: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cell = None, None

        def done() -> Iterator[pa.RecordBatch]:
            if cell is None:
                return
            if not cell.ready:
                cell.start()
            pairs = sorted(cell.edges)
            yield pa.RecordBatch.from_arrays([
                pa.array([*cell.nodes, *[a for a, _ in pairs]], pa.int64()), pa.array([*cell.links.tolist(), *[0] * len(pairs)], pa.int64()),
                pa.array([*[None] * len(cell.nodes), *[b for _, b in pairs]], pa.int64())], names=["node", "links", "peer"])

        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                d = whole.slice(at, 4096).to_pydict()
                keys, start = list(zip(d["cell"], d["salt"], strict=True)), 0
                while start < len(keys):
                    if keys[start] != key:
                        yield from done()
                        key, cell = keys[start], _Cell(cosine, reach, keys[start][1])
                    stop = start
                    while stop < len(keys) and keys[stop] == key and d["home"][stop] == d["home"][start]:
                        stop += 1
                    part = slice(start, stop)
                    start = stop
                    if d["home"][part.start]:
                        cell.nodes += d["node"][part]
                        cell.weights += d["w"][part]
                        cell.vecs += d["vec"][part]
                    else:
                        if not cell.ready:
                            cell.start()
                        cell.visit(d["node"][part], d["w"][part], d["vec"][part])
        yield from done()
    return run


def _split(rows: DataFrame, sizes: DataFrame, reach: float) -> DataFrame:
    """One level: cells with too many homes get pivots, and their rows are dealt to the pivots' cells."""
    salts = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / VISITORS)).cast("int")
    big = sizes.where(F.col("n_homes") > HOMES).select("cell", "n_homes", salts.alias("salts"))
    rows = rows.join(big, "cell")
    share = F.least(F.lit(1.0), F.lit(2.0 * PIVOTS * CANDIDATES) / F.col("n_homes"))
    drawn = (F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1_000_000)) < share * 1_000_000)
    pool = rows.where("home").where(drawn).select("cell", F.col("n_homes").alias("w"), "node", "vec", "home", F.lit(False).alias("data"),
                                                  F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    moved = rows.select("cell", "w", "node", "vec", "home", F.lit(True).alias("data"),
                        F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"))
    dealt = pool.union(moved).repartition("cell", "salt").sortWithinPartitions("cell", "salt", "data", "node")
    return dealt.mapInArrow(_route(reach), _ROWS)


def _blocks(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Cells that no net can part: their homes are dealt to blocks, and every row of the cell visits every block."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("n_homes") / HOMES)).cast("int")
    rows = rows.join(sizes.select("cell", parts.alias("parts")), "cell")
    own = F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"))
    return rows.select(F.concat("cell", F.lit("/b"), "block").alias("cell"), "node", "w", "vec", (F.col("home") & (own == F.col("block"))).alias("home"))


def _sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cell").agg(F.sum(F.col("home").cast("long")).alias("n_homes"), F.count(F.lit(1)).alias("n_rows"))


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row: links are pairs of one label with at least ``cosine``.

    Equal vectors of a label are one weighted class, so copies are counted, not compared. Links are counted in the home cell of
    a vector; only edges that join groups leave a task. The result is exact: every bound that drops a pair is a proven one.

    Null labels, null, empty or zero vectors, and vectors that hold null or non-finite components link with nothing. Vectors of
    different lengths never link. Rows without an id link with nothing and keep a null component. Rows that repeat an id are
    separate vectors: their links are summed and the smallest component is reported. Extra columns are ignored; an empty table gives an empty result.
    """
    reach = math.sqrt(2 - 2 * cosine) + _SLACK
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                          F.col(vec_col).cast("array<double>").alias("v"))
    usable = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND forall(v, e -> e IS NOT NULL AND NOT isnan(e) AND abs(e) < double('infinity'))"
                        " AND exists(v, e -> e <> 0)")
    classes = store(usable.groupBy("label", "v").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("w")), "cover-classes")
    units = classes.select(F.concat_ws("/", "label", F.size("v").cast("string")).alias("cell"), "node", "w", "v").mapInArrow(_unit, _ROWS)
    now, finished = store(units, "cover"), []
    for level in range(LEVELS):
        sizes = store(_sizes(now), "cover-sizes")
        finished.append(now.join(sizes.where(F.col("n_homes").between(1, HOMES)).select("cell"), "cell", "left_semi"))
        if sizes.where(F.col("n_homes") > HOMES).isEmpty():
            now = None
            break
        now = store(_split(now, sizes, reach), "cover")
    if now is not None:
        sizes = store(_sizes(now), "cover-sizes")
        finished.append(now.join(sizes.where(F.col("n_homes").between(1, HOMES)).select("cell"), "cell", "left_semi"))
        finished.append(_blocks(now, sizes.where(F.col("n_homes") > HOMES)))
    cells = finished[0].select("cell", "node", "w", "vec", "home")
    for part in finished[1:]:
        cells = cells.union(part.select("cell", "node", "w", "vec", "home"))
    salts = F.greatest(F.lit(1), F.ceil(F.sum((~F.col("home")).cast("long")) / VISITORS)).cast("int")
    cells = cells.join(cells.groupBy("cell").agg(salts.alias("salts")), "cell")
    every = F.when(F.col("home"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")))
    dealt = (cells.select("cell", F.explode(every).alias("salt"), "node", "w", "vec", "home")
             .repartition("cell", "salt").sortWithinPartitions("cell", "salt", F.desc("home"), "node"))
    found = store(dealt.mapInArrow(_join(cosine, reach), "node long, links long, peer long"), "cover-links")
    counts = found.where("peer IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.where("peer IS NOT NULL").select(F.col("node").alias("a"), F.col("peer").alias("b")))
    judged = classes.join(counts, "node").join(groups, "node", "left").select("label", "v", "links", F.coalesce("component", "node").alias("component"))
    placed = (usable.select("vec_id", "label", "v").join(judged, ["label", "v"])
              .groupBy("vec_id").agg(F.sum("links").alias("links"), F.min("component").alias("component")))
    out = rows.select("vec_id").join(placed, "vec_id", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
