"""URL filters by a cascade of Bloom filters, in Spark expressions only.

The first level encodes the listed keys. The keys of the corpus that it lets through by mistake are encoded by the second level, the
listed keys that the second lets through by the third, and so on until a level makes no mistake. All keys of the corpus are known
when the levels are built, so the answer is exact for them. Keys are dealt to many small filters, so no filter grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callwarden.llm.common import store

#: Listed keys of one filter, bits for each key, and probes.
SHARD_KEYS = 512
BITS = 10
PROBES = 4


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII letters folded) and path; both empty if the url is null or has no ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def winning_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """``(rule, verdict)`` of the longest of the rules ``(verdict, host, path)`` that fits; null if none does.

    A rule fits its host and all subdomains if the path starts with the rule's. Of rules of equal length the first wins. Rules are
    configuration: their number does not grow with the data.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(reversed(rules), key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _position(key: Column, level: int, probe: int, words: int) -> Column:
    # 40 bits of each hash: sums of whole ones would overflow
    return F.pmod(F.pmod(F.xxhash64(key, F.lit(level)), F.lit(1 << 40)) + F.lit(probe) * F.pmod(F.xxhash64(key, F.lit(-level)), F.lit(1 << 40)), F.lit(words * 64))


def _passes(key: Column, filter_words: Column, level: int, words: int) -> Column:
    test = F.lit(True)
    for probe in range(PROBES):
        at = _position(key, level, probe, words)
        word = F.get(filter_words, F.shiftright(at, 6).cast("int"))
        test = test & (F.getbit(word, F.pmod(at, F.lit(64)).cast("int")) == 1)
    return test


def _level(keys: DataFrame, level: int, shards: int, words: int) -> DataFrame:
    """``shard, f<level>``: the filter of the keys of each shard, zero words where it has none."""
    at = F.explode(F.array(*[_position(F.col("key"), level, p, words) for p in range(PROBES)]))
    bits = (keys.select("shard", at.alias("at")).select((F.col("shard") * words + F.shiftright("at", 6)).alias("slot"), F.pmod("at", F.lit(64)).cast("int").alias("bit"))
            .groupBy("slot").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")))
    every = keys.sparkSession.range(shards * words).withColumnRenamed("id", "slot")
    dense = every.join(bits, "slot", "left").select((F.col("slot") / words).cast("long").alias("shard"), F.struct("slot", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("w"))
    return dense.groupBy("shard").agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["bits"]).alias(f"f{level}"))


class Cascade:
    """Filters of all levels, a row for each shard, and how to ask them."""

    def __init__(self, filters: DataFrame, shards: int, words: list[int]):
        self.filters, self.shards, self.words = filters, shards, words

    def shard_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.shards))

    def mark(self, rows: DataFrame, key: str, into: str) -> DataFrame:
        """Add the boolean ``into``: whether ``key``, a key of the universe, is listed."""
        answer = F.lit(len(self.words) % 2 == 1)
        for level in range(len(self.words), 0, -1):
            answer = F.when(_passes(F.col(key), F.col(f"f{level}"), level, self.words[level - 1]), answer).otherwise(F.lit(level % 2 == 0))
        asked = rows.withColumn("shard", self.shard_of(F.col(key))).join(self.filters, "shard", "left")
        return asked.withColumn(into, F.coalesce(answer, F.lit(False))).select(*rows.columns, into)


def build_cascade(universe: DataFrame) -> Cascade:
    """The cascade for ``universe(key, listed)``; keys may repeat, and one listed row makes its key listed.

    Null keys are ignored (and are never listed). An empty list gives a cascade that lists nothing.
    """
    keys = universe.where("key IS NOT NULL").groupBy("key").agg(F.max("listed").alias("listed"))
    keys = store(keys, "cascade-keys")
    n = keys.where("listed").count()
    shards = max(1, -(-n // SHARD_KEYS))
    keys = keys.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    inside, outside, count, level = keys.where("listed"), keys.where("NOT listed"), n, 0
    filters, words = keys.sparkSession.range(shards).withColumnRenamed("id", "shard"), []
    while level == 0 or count:
        level += 1
        words.append(max(1, -(-count * BITS // (64 * shards))))
        made = store(_level(inside, level, shards, words[-1]), "cascade-level")
        filters = filters.join(made, "shard", "left")
        wrong = outside.join(made, "shard").where(_passes(F.col("key"), F.col(f"f{level}"), level, words[-1])).select(*keys.columns)
        wrong = store(wrong, "cascade-wrong")
        inside, outside, count = wrong, inside, wrong.count()
    return Cascade(store(filters, "cascade"), shards, words)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``page_id, host, path, rule, verdict, listed`` for every row.

    The list is every url (host and path) of the corpus whose winning rule blocks it; the cascade answers for all urls, and its answer is
    the verdict where no rule fits. Null urls and urls without ``://`` have an empty host and path. Rows may repeat; null ids stay;
    extra columns are ignored; an empty table gives an empty result.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = winning_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"), F.concat("host", "path").alias("key"))
    cascade = build_cascade(rows.select("key", (F.coalesce("ruled", F.lit("allow")) == "block").alias("listed")))
    marked = cascade.mark(rows, "key", "listed")
    decided = F.coalesce("ruled", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return marked.select("page_id", "host", "path", "rule", decided.alias("verdict"), "listed")
