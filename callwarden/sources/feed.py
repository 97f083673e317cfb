"""Signature feeds and policy tables: read, validate, and hand over as bounded configuration."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callwarden.rules import policy as P
from callwarden.rules.feed import FEED_SCHEMA, KINDS, SEVERITIES, SIGNATURES, TARGETS
from callwarden.rules.patterns import java

#: Characters of all patterns of a feed that is handed over as configuration.
MAX_CHARACTERS = 64 << 20


def builtin_feed(spark: SparkSession) -> DataFrame:
    rows = []
    for row in SIGNATURES:
        full = {"severity": "high", "enabled": True, "ordinal": 0, "flags": "", **row}
        rows.append(tuple(full.get(f.split()[0]) for f in FEED_SCHEMA.split(", ")))
    return spark.createDataFrame(rows, FEED_SCHEMA)


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """A feed as JSON lines, one matcher per line."""
    return spark.read.schema(FEED_SCHEMA).json(path)


def feed_problems(feed: DataFrame) -> DataFrame:
    """(id, problem) for every invalid row: repeated matchers, unknown kinds, severities or targets."""
    repeated = feed.groupBy("id", F.coalesce("ordinal", F.lit(0)).alias("ordinal")).agg(F.count(F.lit(1)).alias("n"))
    unknown_targets = F.size(F.array_except(F.coalesce("targets", F.array().cast("array<string>")), F.array(*map(F.lit, TARGETS))))
    checks = feed.select(
        "id",
        F.explode(
            F.filter(
                F.array(
                    F.when(~F.col("kind").isin(KINDS) | F.col("kind").isNull(), "unknown kind"),
                    F.when(~F.col("severity").isin(SEVERITIES), "unknown severity"),
                    F.when(unknown_targets > 0, "unknown target"),
                    F.when(F.col("kind").isin("regex", "gguf_template") & F.col("pattern").isNull(), "pattern missing"),
                    F.when((F.col("kind") == "component") & (F.col("package").isNull() | F.col("version_lt").isNull()),
                           "package or version missing"),
                ),
                lambda p: p.isNotNull(),
            )
        ).alias("problem"),
    )
    return repeated.where("n > 1").select("id", F.lit("duplicate id").alias("problem")).union(checks).distinct()


def signature_table(feed: DataFrame, shown: int = 20) -> DataFrame:
    """The enabled signatures of a valid feed; an invalid feed is refused as a whole, with the number of problems and the first ``shown``."""
    problems = feed_problems(feed)
    n = problems.count()
    if n:
        first = [f"{r['id']}: {r['problem']}" for r in problems.orderBy("id", "problem").limit(shown).collect()]
        raise ValueError(f"feed rejected, {n} problems: " + "; ".join(first))
    return feed.where(F.coalesce("enabled", F.lit(True)))


def compile_feed(feed: DataFrame) -> list[dict]:
    """The signatures as plain configuration for ``scan``. The size is checked before anything is collected, and every pattern is compiled by
    the engine that runs it."""
    valid = signature_table(feed)
    flags = F.concat(F.lit("s"), F.when(F.contains(F.coalesce("flags", F.lit("")), F.lit("i")), "i").otherwise(""))
    pattern = F.concat(F.lit(java("").removesuffix(")")), flags, F.lit(")"), F.col("pattern"))
    size = valid.agg(F.sum(F.length("pattern"))).first()[0] or 0
    if size > MAX_CHARACTERS:
        raise ValueError(f"patterns of the feed hold {size} characters, more than {MAX_CHARACTERS}")
    try:
        valid.where("pattern IS NOT NULL").agg(F.max(F.rlike(F.lit(""), pattern))).collect()
    except (PySparkException, Py4JJavaError) as e:
        if "PatternSyntaxException" not in str(e):
            raise
        raise ValueError("feed rejected: a pattern is no regular expression of the engine") from e
    return [r.asDict(recursive=True) for r in valid.orderBy("id", "ordinal").collect()]


# ---------------------------------------------------------------- policy


def policy_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """The built-in policy as long-form tables: sinks, control defaults, profiles, explicit settings, task profiles."""
    return {
        "sinks": spark.createDataFrame(list(P.SINKS.items()), "sink string, clearance string"),
        "control_defaults": spark.createDataFrame(P.CONTROL_DEFAULTS, "control string, field string, value string"),
        "profiles": spark.createDataFrame(P.PROFILES, "profile string, control string, field string, value string"),
        "explicit": spark.createDataFrame(P.EXPLICIT, "control string, field string, value string"),
        "task_profiles": spark.createDataFrame(
            [tuple(p[f.split()[0]] for f in P.TASK_PROFILE_SCHEMA.split(", ")) for p in P.TASK_PROFILES],
            P.TASK_PROFILE_SCHEMA,
        ),
    }


def sink_problems(sinks: DataFrame) -> DataFrame:
    """Sinks whose clearance is not a known level."""
    return sinks.where(~F.upper("clearance").isin(list(P.LEVELS)) | F.col("clearance").isNull())


def threshold_problems(settings: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of settings whose redact threshold lies above the block threshold or outside 0..1."""
    def at(name):
        return F.max(F.when((F.col("control") == "semantic") & (F.col("field") == name), F.col("value").cast("double")))
    wide = settings.groupBy(*keys).agg(at("block_at_risk").alias("block_at"), at("redact_at_risk").alias("redact_at"))
    return wide.where((F.col("redact_at") > F.col("block_at")) | ~F.col("block_at").between(0, 1)
                      | ~F.col("redact_at").between(0, 1))
