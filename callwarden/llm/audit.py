"""Filter interaction audit: what each filter removes in every order of application, from counts on the lattice of filter subsets.

A state is the set of filters applied so far; an edge applies one more filter. How many documents an edge removes depends on its state
only, not on the order in which the state was reached. So one count of documents per (part, set of failing filters) gives every edge,
each order is a path whose steps are read from the edges, and a filter's Shapley sum weighs its edges by the number of paths through
them: the orders that reach the state (forward) times the orders that leave the edge's end (backward).
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callwarden.llm.common import WORD

MOST_FILTERS = 7
SALTS = 1024
_SPACES = r"[\x20\x09-\x0D]+"


def text_filters(text: Column) -> dict[str, Column]:
    """The four failure conditions that look at one text: too short, repetitive, shouting, markup."""
    words = F.filter(F.split(text, _SPACES), lambda w: w != "")
    n = F.regexp_count(text, F.lit(WORD))
    distinct = F.size(F.array_distinct(words))
    return {
        "A": n < 50,
        "B": 100 * distinct < 65 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


class Lattice:
    """Subsets of ``names`` with the number of allowed orders through each; ``before`` lists pairs (earlier, later) that every order keeps.

    ``forward[s]`` counts the orders of the filters in ``s`` that reach ``s``; ``backward[s]`` those of the others that leave it.
    """

    def __init__(self, names: str | list[str], before: list[tuple[str, str]] = ()):
        self.names = list(names)
        if len(self.names) > MOST_FILTERS:
            raise ValueError(f"{len(self.names)} filters have too many orders to list; at most {MOST_FILTERS}")
        place = {f: i for i, f in enumerate(self.names)}
        self.needs = [sum(1 << place[a] for a, b in before if b == f) for f in self.names]
        full = (1 << len(self.names)) - 1
        self.edges = [(s, i) for s in range(full + 1) for i in range(len(self.names)) if not s >> i & 1 and s & self.needs[i] == self.needs[i]]
        self.forward, self.backward = [0] * (full + 1), [0] * (full + 1)
        self.forward[0] = self.backward[full] = 1
        for s, i in self.edges:
            self.forward[s | 1 << i] += self.forward[s]
        for s, i in reversed(self.edges):
            self.backward[s] += self.backward[s | 1 << i]

    def paths(self, state: int, i: int) -> int:
        """Number of allowed orders that apply filter ``i`` in ``state``."""
        return self.forward[state] * self.backward[state | 1 << i]

    def steps(self) -> list[tuple[str, int, str, int]]:
        """(order, step, filter, state before the step) of every allowed order."""
        out = []
        for order in permutations(range(len(self.names))):
            state, rows = 0, []
            for at, i in enumerate(order):
                if state & self.needs[i] != self.needs[i]:
                    break
                rows.append(("".join(self.names[j] for j in order), at + 1, self.names[i], state))
                state |= 1 << i
            else:
                out += rows
        return out


def failures(docs: DataFrame, labels: DataFrame, part: str = "source", filters=text_filters, copies: str = "E") -> DataFrame:
    """``part, mask, good, toxic, n``: documents by the set of filters they fail (bit i: i-th filter, ``copies`` is the last bit).

    A document fails ``copies`` if its text equals that of a smaller doc_id anywhere in the table; the text travels as a 128-bit and a 64-bit hash.
    Null texts are empty. A null doc_id is no smaller id, fails no ``copies`` and has no labels; repeated rows of one id and text fail or pass together.
    Several labels of one id: 1 wins. Only slim rows are shuffled; equal rows are counted before each shuffle, so a text or source that
    holds a third of all rows is a few counts.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    failing = filters(F.col("text"))
    mask = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(False)).cast("int") * (1 << i) for i, c in enumerate(failing.values())])
    last = 1 << len(failing)
    slim = base.select("doc_id", "part", F.md5("text").alias("h"), F.xxhash64("text").alias("g"), mask.alias("own"))
    salt = F.when(F.col("doc_id").isNull(), F.pmod("g", F.lit(SALTS))).otherwise(F.lit(0))
    slim = slim.withColumn("salt", salt).groupBy("doc_id", "salt", "part", "h", "g", "own").agg(F.count(F.lit(1)).alias("c"))
    marks = (labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    named = slim.join(marks.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left")
    rows = named.select("doc_id", "part", "h", "g", "own", "c", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    grouped = rows.groupBy("h", "g", "part", "own", "good", "toxic", F.col("doc_id").isNull().alias("nameless")).agg(
        F.sum("c").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "c"))).alias("least"))
    first = F.min("least.doc_id").over(Window.partitionBy("h", "g"))
    firsts = F.when(F.col("nameless"), F.col("n")).when(F.col("least.doc_id") == F.col("first"), F.col("least.c")).otherwise(F.lit(0))
    split = grouped.withColumn("first", first).withColumn("firsts", firsts)
    both = F.array(F.struct(F.col("own").alias("mask"), F.col("firsts").alias("k")), F.struct((F.col("own") + last).alias("mask"), (F.col("n") - F.col("firsts")).alias("k")))
    return (split.select("part", "good", "toxic", F.explode(both).alias("s")).where("s.k > 0")
            .groupBy("part", F.col("s.mask").alias("mask"), "good", "toxic").agg(F.sum("s.k").alias("n")))


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", filters=text_filters, copies: str = "E", before=()) -> DataFrame:
    """Every step of every order for each value of ``part`` (null: the empty string): one row per part, order and step, zeros included.

    ``kept`` after the step, ``removed`` by it, ``redundant`` (fails the step's filter, removed earlier), ``unique_fails`` (fails nothing
    else), ``good_lost`` and ``toxic_lost`` (removed documents with these labels), ``shapley`` (the filter's removals summed over all
    orders). Nulls, repeated rows and labels: see :func:`failures`. An empty table has no part and gives no row; other columns of the
    tables are not read. The frames that are broadcast hold one row per step of an order: at most 7 x 7! rows.
    """
    spark = docs.sparkSession
    names = [*filters(F.lit("")), copies]
    lattice = Lattice(names, before)
    counts = failures(docs, labels, part, filters, copies)
    edges = spark.createDataFrame([(s, i, names[i], lattice.paths(s, i)) for s, i in lattice.edges], "state int, i int, filter string, paths long")
    bit = F.expr("shiftleft(1, i)")
    passed = F.col("mask").bitwiseAND(F.col("state")) == 0
    fails = F.col("mask").bitwiseAND(bit) != 0
    every = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(i).alias("i")) for s, i in lattice.edges])

    def total(condition: Column, weight: Column = F.col("n")) -> Column:
        return F.sum(F.when(condition, weight).otherwise(F.lit(0)))

    read = counts.withColumn("e", F.explode(every)).select("part", "mask", "good", "toxic", "n", "e.*").groupBy("part", "state", "i").agg(
        total(passed & fails).alias("removed"), total(passed & ~fails).alias("kept"), total(~passed & fails).alias("redundant"),
        total(F.col("mask") == bit).alias("unique_fails"), total(passed & fails & (F.col("good") == 1)).alias("good_lost"),
        total(passed & fails & (F.col("toxic") == 1)).alias("toxic_lost"))
    weighed = read.join(F.broadcast(edges), ["state", "i"])
    shapley = weighed.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("paths")).alias("shapley"))
    steps = spark.createDataFrame(lattice.steps(), "filter_order string, step int, filter string, state int")
    return (weighed.join(shapley, ["part", "filter"]).join(F.broadcast(steps), ["state", "filter"])
            .select("part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
