"""Ranked lexical search of many queries at once: term sets shared by items are accumulated once per document.

The scores of a block of items are linear sums over the same term accumulators. Pairs of nodes that several items hold are replaced by one
new node, again and again, until no pair is shared: a DAG whose inner nodes are partial document accumulators. Each document evaluates
every node once, level by level, and an item adds up the few nodes that are left of it. All arithmetic is in 64-bit integers, so the DAG
changes no score.

Documents are tokenised once per block of items into slim rows (id, length, the block's terms and their counts); corpus counts come from
these rows, and so do the scores.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callwarden.llm.common import slices, store

#: Different terms (with their repeats) of the items that are searched in one pass; an item alone may hold more.
BLOCK_TERMS = 50_000
#: Nodes of an item among which shared pairs are counted together.
CHUNK = 32
#: Cells of the accumulator matrix of one slice of documents.
CELLS = 2_000_000
#: Groups of partial results that are cut to the best ones before an item's last ranking.
SALTS = 64
_NO_ID = np.iinfo(np.int64).max
_TERM_BYTES = bytes((c + 32 if 65 <= c <= 90 else c) if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def terms_of(text: str | bytes | None) -> list[bytes]:
    """Maximal runs of digits, ASCII letters (lower-cased) and non-ASCII characters, as UTF-8."""
    data = text.encode() if isinstance(text, str) else text or b""
    return data.translate(_TERM_BYTES).split()


class SharedPlan:
    """DAG over the items' leaves (a term with its repeats): ``levels`` of node pairs, and the nodes each item adds up."""

    def __init__(self, items: list[list[bytes]]):
        self.terms = sorted({t for words in items for t in words})
        place = {t: i for i, t in enumerate(self.terms)}
        counted = [Counter(place[t] for t in words) for words in items]
        leaves = sorted({leaf for c in counted for leaf in c.items()})
        number = {leaf: i for i, leaf in enumerate(leaves)}
        self.leaf_term = np.array([t for t, _ in leaves], np.int64)
        self.leaf_count = np.array([n for _, n in leaves], np.int64)
        held = [{number[leaf] for leaf in c.items()} for c in counted]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.nodes = len(leaves)
        while made := self._share(held):
            left, right = (np.array(side, np.int64) for side in zip(*made))
            self.levels.append((left, right))
        self.parts = [np.array(sorted(nodes), np.int64) for nodes in held]

    def _share(self, held: list[set[int]]) -> list[tuple[int, int]]:
        """One round: the most shared pairs first, each node of an item used once. Items' sets are changed in place."""
        owners = defaultdict(set)
        for item, nodes in enumerate(held):
            for node in nodes:
                owners[node].add(item)
        pairs = Counter()
        for nodes in held:
            shared = sorted((n for n in nodes if len(owners[n]) > 1), key=lambda n: (-len(owners[n]), n))
            for at in range(0, len(shared), CHUNK):
                pairs.update(combinations(sorted(shared[at:at + CHUNK]), 2))
        made = []
        for (a, b), n in sorted(pairs.items(), key=lambda p: (-p[1], p[0])):
            if n < 2:
                break
            both = owners[a] & owners[b]
            if len(both) < 2:
                continue
            for item in both:
                held[item] -= {a, b}
                held[item].add(self.nodes)
            owners[a] -= both
            owners[b] -= both
            made.append((a, b))
            self.nodes += 1
        return made

    def scores(self, gains: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Scores (items x documents) from each term's gain in each document (terms x documents)."""
        acc = np.empty((self.nodes, gains.shape[1]), np.int64)
        at = len(self.leaf_term)
        np.multiply(gains[self.leaf_term], (self.leaf_count * weights[self.leaf_term])[:, None], out=acc[:at])
        for left, right in self.levels:
            np.add(acc[left], acc[right], out=acc[at:at + len(left)])
            at += len(left)
        return np.stack([acc[nodes].sum(axis=0) for nodes in self.parts])


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Items in blocks of at most BLOCK_TERMS different terms (more only if one item has more); the driver holds one block at a time."""
    block, size = [], 0
    named = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    for row in named.orderBy("item_id", "text").toLocalIterator():
        words = terms_of(row.text)
        if not words:
            continue
        own = len(set(words))
        if block and size + own > BLOCK_TERMS:
            yield block
            block, size = [], 0
        block.append((row.item_id, words))
        size += own
    if block:
        yield block


def _count(docs: DataFrame, shared) -> DataFrame:
    """``doc_id, n, terms, counts``: length of each document and the block's terms in it (numbers and counts as little-endian bytes)."""

    def run(batches):
        place = {t: i for i, t in enumerate(shared.value[0].terms)}
        look = place.get
        for whole in batches:
            for batch in slices(whole, 1):
                lengths, terms, counts = [], [], []
                for value in batch.column(1):
                    words = terms_of(value.as_buffer().to_pybytes() if value.is_valid else None)
                    found = Counter(map(look, words))
                    found.pop(None, None)
                    lengths.append(len(words))
                    terms.append(np.fromiter(found.keys(), "<i4", len(found)).tobytes())
                    counts.append(np.fromiter(found.values(), "<i4", len(found)).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())],
                                                 names=["doc_id", "n", "terms", "counts"])

    return docs.mapInArrow(run, "doc_id long, n long, terms binary, counts binary")


def _holders(counted: DataFrame, terms: int) -> DataFrame:
    """``term, df`` in partial sums: one row per task and term."""

    def run(batches):
        df = np.zeros(terms, np.int64)
        for batch in batches:
            for value in batch.column(0):
                df[np.frombuffer(value.as_buffer(), "<i4")] += 1
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(df[seen])], names=["term", "df"])

    return counted.select("terms").mapInArrow(run, "term long, df long")


def _best(counted: DataFrame, shared, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``item, doc_id, score``: each task's best ``k`` documents of each item."""

    def run(batches):
        plan = shared.value[0]
        width = max(1, CELLS // (plan.nodes + len(plan.terms)))
        top_score = np.zeros((len(plan.parts), k), np.int64)
        top_id = np.full((len(plan.parts), k), _NO_ID, np.int64)
        for whole in batches:
            for start in range(0, whole.num_rows, width):
                batch = whole.slice(start, width)
                ids = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
                n = batch.column(1).to_numpy(zero_copy_only=False)
                terms = [np.frombuffer(v.as_buffer(), "<i4") for v in batch.column(2)]
                tf = np.concatenate([np.frombuffer(v.as_buffer(), "<i4") for v in batch.column(3)]).astype(np.int64)
                doc = np.repeat(np.arange(len(n)), [len(t) for t in terms])
                m = 25 + (75 * n * n_docs) // n_terms
                gains = np.zeros((len(plan.terms), len(n)), np.int64)
                gains[np.concatenate(terms), doc] = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
                scores = plan.scores(gains, weights)
                near = (scores > 0) & (scores >= top_score[:, -1:])
                for item in np.flatnonzero(near.any(axis=1)):
                    at = np.flatnonzero(near[item])
                    s, i = np.concatenate([top_score[item], scores[item, at]]), np.concatenate([top_id[item], ids[at]])
                    order = np.lexsort((i, -s))[:k]
                    top_score[item], top_id[item] = s[order], i[order]
        item, at = np.nonzero(top_score)
        ids = top_id[item, at]
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(ids, mask=ids == _NO_ID), pa.array(top_score[item, at])],
                                         names=["item", "doc_id", "score"])

    return counted.mapInArrow(run, "item int, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` best documents with a score above 0, ties by ascending doc_id.

    Null and empty texts hold no term: such documents are not counted, such items have no row. A repeated item row counts once; texts
    that share an id are ranked apart. Repeated document rows are documents of their own. A null doc_id counts like any document and
    comes last among ties. Other columns are not read; without documents or items there is no row. A block of items is broadcast as
    plan and term list: BLOCK_TERMS terms, unless one item alone has more.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    done = []
    for block in _blocks(items):
        plan = SharedPlan([words for _, words in block])
        shared = spark.sparkContext.broadcast((plan,))
        counted = store(_count(plain, shared), "ranking-terms")
        n_docs, n_terms = counted.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            continue
        df = np.zeros(len(plan.terms), np.int64)
        for term, held in _holders(counted, len(plan.terms)).groupBy("term").agg(F.sum("df")).collect():
            df[term] = held
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        best = _best(counted, shared, weights, n_docs, n_terms, k).withColumn("salt", F.spark_partition_id() % SALTS)
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        some = best.withColumn("r", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("r") <= k)
        ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        names = F.array(*[F.lit(i).cast("long") for i, _ in block])
        done.append(store(ranked.select(names[F.col("item")].alias("item_id"), "rank", "doc_id", "score"), "ranking-best"))
    if not done:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out
