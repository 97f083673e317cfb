"""Policies as data: effective settings, replay under other settings, history, and validation of labelled cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callwarden.operators import content as C
from callwarden.operators.decide import severity
from callwarden.operators.running import running
from callwarden.rules import policy as P

SWITCHES = {
    "pii": "pii_on", "secrets": "secrets_on", "attack_signatures": "signatures_on", "injection_heuristics": "injection_on",
    "semantic": "semantic_on", "ifc_taint": "ifc_on",
}


def effective_controls(defaults: DataFrame, profiles: DataFrame, explicit: DataFrame) -> DataFrame:
    """(profile, control, field, value): an explicit setting wins over the profile, the profile over the default.

    All three are long-form tables. Explicit settings carry a ``profile`` column when they belong to one policy.
    """
    on = ["control", "field"]
    names = profiles.select("profile").distinct()
    keys = defaults.select(*on).unionByName(profiles.select(*on)).unionByName(explicit.select(*on)).distinct()
    grid = keys.withColumn("_j", F.lit(1)).join(names.withColumn("_j", F.lit(1)), "_j").drop("_j")
    scoped = [*on, "profile"] if "profile" in explicit.columns else on
    return (
        grid.join(profiles.withColumnRenamed("value", "_p"), ["profile", *on], "left")
        .join(explicit.withColumnRenamed("value", "_e"), scoped, "left")
        .join(defaults.withColumnRenamed("value", "_d"), on, "left")
        .select("profile", *on, F.coalesce("_e", "_p", "_d").alias("value"))
    )


def _controls_struct(name: str, controls: C.Controls) -> Column:
    return F.struct(
        F.lit(name).alias("name"), *[F.lit(getattr(controls, attr)).alias(attr) for attr in C.Controls.FIELDS]
    )


def replay(scanned: DataFrame, variants: dict[str, C.Controls], text: str = "text", target: Column | str = "user_input",
           sink: Column | None = None, level: Column | None = None) -> DataFrame:
    """Decide one scan under several policies: a row per input row and variant. Texts are scanned only once."""
    options = F.array(*[_controls_struct(n, c) for n, c in variants.items()])
    spread = scanned.withColumn("variant", F.explode(options))
    return C.judge(spread, C.Controls.from_struct("variant"), text, target, sink, level)


def replay_profiles(scanned: DataFrame, key: str, profiles: tuple[str, ...] = ("strict", "balanced", "permissive"), **kw) -> DataFrame:
    """One row per input row with the action under each profile."""
    out = replay(scanned, {p: C.Controls.preset(p) for p in profiles}, **kw)
    return out.groupBy(key).pivot("variant.name", list(profiles)).agg(F.first("decision.action"))


def ablate_controls(scanned: DataFrame, base: C.Controls = C.BALANCED, **kw) -> DataFrame:
    """Decisions with everything on (``none``) and with one control off at a time."""
    variants = {"none": base} | {name: base.but(**{attr: False}) for name, attr in SWITCHES.items()}
    return replay(scanned, variants, **kw)


def policy_history(versions: DataFrame) -> DataFrame:
    """Versions with the content a rollback restored and the flag of the active one (the last accepted).

    Only rollbacks are joined with what they restored: the others have no key, and a join would send them all to one task.
    """
    target = F.when(F.col("source").startswith("rollback:"), F.substring_index("source", ":", -1).cast("bigint"))
    origin = versions.where("accepted").select(F.col("seq").alias("_from"), F.col("content_hash").alias("_hash"))
    with_target = versions.withColumn("_from", target)
    last = versions.where("accepted").agg(F.max("seq").alias("active_seq")).withColumn("_j", F.lit(1))
    rollbacks = with_target.where(F.col("_from").isNotNull()).join(origin, "_from", "left")
    others = with_target.where(F.col("_from").isNull()).withColumn("_hash", F.lit(None).cast("string"))
    return (
        rollbacks.unionByName(others).withColumn("_j", F.lit(1)).join(F.broadcast(last), "_j", "left")
        .select("seq", "source", "accepted", "content_hash", F.col("_from").alias("restores"),
                (F.col("_hash") == F.col("content_hash")).alias("restored_exactly"),
                F.coalesce(F.col("seq") == F.col("active_seq"), F.lit(False)).alias("active"))
    )


def version_at(decisions: DataFrame, versions: DataFrame) -> DataFrame:
    """Policy version in force at each decision: the last one accepted before it (as-of join as a running maximum)."""
    changes = versions.where("accepted").select(F.col("created_at").alias("ts"), F.lit(0).alias("kind"), F.col("seq").alias("id"), "seq")
    asked = decisions.select("ts", F.lit(1).alias("kind"), "id", F.lit(None).cast("bigint").alias("seq"))
    both = running(changes.unionByName(asked), [], ["ts", "kind", "id"], {"version": ("max", F.col("seq"))})
    return both.where(F.col("kind") == 1).select("id", "ts", "version")


def disabled_controls(settings: DataFrame, keys: list[str]) -> DataFrame:
    """Controls that a policy switches off, per policy."""
    off = settings.where((F.col("field") == "enabled") & (F.lower("value") == "false"))
    return off.groupBy(*keys).agg(F.array_sort(F.collect_set("control")).alias("disabled"))


def case_passed(action: Column, expect: Column, rule: Column, findings: Column, minimum: bool = False) -> Column:
    """Did a labelled case come out as expected? ALLOW is exact; with ``minimum`` others may be stricter."""
    met = action == expect
    if minimum:
        met = F.when(expect == "ALLOW", met).otherwise(severity(action) >= severity(expect))
    fired = rule.isNull() | F.exists(findings, lambda f: f["rule_id"] == rule)
    return met & fired


def validate_corpus(judged: DataFrame, group: str, minimum: bool = False) -> DataFrame:
    """Pass rate per group of labelled cases (columns: expect, rule, decision, findings)."""
    ok = case_passed(F.col("decision.action"), F.col("expect"), F.col("rule"), F.col("findings"), minimum)
    return judged.groupBy(group, "expect").agg(F.count(F.lit(1)).alias("cases"), F.count_if(ok).alias("passed"))


DEFAULT_PROFILE = "balanced"
PROFILE_NAMES = list(dict.fromkeys(p for p, *_ in P.PROFILES))
