"""Findings and the fold that turns them into one decision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callwarden.functions.spans import SPANS_TYPE

FINDING_TYPE = (
    "struct<action:string,rule_id:string,reason_code:string,stage:string,"
    f"detail:map<string,string>,spans:{SPANS_TYPE}>"
)
FINDINGS_TYPE = f"array<{FINDING_TYPE}>"


def _text(value: Column | str | None) -> Column:
    if isinstance(value, Column):
        return value
    return F.lit(value).cast("string")


def finding(action, rule_id, reason_code, stage, detail: dict | None = None, spans: Column | None = None) -> Column:
    pairs = [x for k, v in (detail or {}).items() for x in (F.lit(k), _text(v).cast("string"))]
    made = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return F.struct(
        _text(action).alias("action"),
        _text(rule_id).alias("rule_id"),
        _text(reason_code).alias("reason_code"),
        _text(stage).alias("stage"),
        made.alias("detail"),
        (spans if spans is not None else F.array().cast(SPANS_TYPE)).alias("spans"),
    )


def collect_findings(*parts: Column) -> Column:
    """One array from single findings (null = none), in the given order."""
    return F.filter(F.array(*parts), lambda f: f.isNotNull())


def severity(action: Column) -> Column:
    return F.when(action == "BLOCK", 2).when(action == "REDACT", 1).otherwise(0)


def decide(findings: Column) -> Column:
    """The first finding of the highest severity above ALLOW sets action, rule, reason and stage."""
    first_block = F.try_element_at(F.filter(findings, lambda f: f["action"] == "BLOCK"), F.lit(1))
    first_redact = F.try_element_at(F.filter(findings, lambda f: f["action"] == "REDACT"), F.lit(1))
    top = F.coalesce(first_block, first_redact)
    return F.struct(
        F.coalesce(top["action"], F.lit("ALLOW")).alias("action"),
        F.coalesce(top["reason_code"], F.lit("OK")).alias("reason_code"),
        top["rule_id"].alias("rule_id"),
        top["stage"].alias("stage"),
    )


def is_blocked(findings: Column) -> Column:
    return F.exists(findings, lambda f: f["action"] == "BLOCK")


def public_findings(findings: Column) -> Column:
    """Findings without spans: safe to log, since no text can be recovered from them."""
    return F.transform(
        findings,
        lambda f: F.struct(f["action"].alias("action"), f["rule_id"].alias("rule_id"),
                           f["reason_code"].alias("reason_code"), f["stage"].alias("stage"),
                           f["detail"].alias("detail")),
    )


def decide_rows(df, keys: list[str], ord_col: str = "ord"):
    """Row form: one finding per row in, one decision per key out, with map-side combination only.

    The winner is the minimum of (descending severity, position), so no group is ever collected.
    """
    sev = severity(F.col("action"))
    ranked = F.when(sev > 0, F.struct((-sev).alias("s"), F.col(ord_col).alias("o"), "action", "rule_id",
                                      "reason_code", "stage"))
    out = df.groupBy(*keys).agg(F.min(ranked).alias("_top"))
    return out.select(
        *keys,
        F.coalesce(F.col("_top.action"), F.lit("ALLOW")).alias("action"),
        F.coalesce(F.col("_top.reason_code"), F.lit("OK")).alias("reason_code"),
        F.col("_top.rule_id").alias("rule_id"),
        F.col("_top.stage").alias("stage"),
    )
