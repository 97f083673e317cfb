"""The audit log: append, export, and follow as a stream. Rows are never changed or removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callwarden.operators.decide import public_findings
from callwarden.sources.tables import STORE

EXPORT_COLUMNS = [
    "id", "ts", "kind", "channel", "target", "task_id", "principal", "action", "reason_code", "rule_id", "stage",
    "policy_version", "latency_ms", "tool_invoked", "synthetic",
]


def evidence_json(findings: str = "findings", **extra: str) -> F.col:
    """Evidence without any text of the checked content: findings lose their spans."""
    fields = [public_findings(F.col(findings)).alias("findings")]
    fields += [F.col(c).alias(n) for n, c in extra.items()]
    return F.to_json(F.struct(*fields))


def append_audit(df: DataFrame, path: str) -> None:
    """Append rows, one folder per day; small days are not scattered over many files."""
    dated = df.withColumn("dt", F.to_date("ts"))
    dated.repartition("dt", F.pmod(F.hash("id"), F.lit(64))).write.mode("append").partitionBy("dt").parquet(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORE["audit_events"]).parquet(path)


def export_rows(df: DataFrame) -> DataFrame:
    """Fixed column order, with the evidence as JSON text."""
    evidence = F.col("evidence")
    if dict(df.dtypes)["evidence"] != "string":
        evidence = F.to_json(evidence)
    return df.select(*EXPORT_COLUMNS, evidence.alias("evidence"))


def export_audit(df: DataFrame, path: str, fmt: str = "jsonl") -> None:
    rows = export_rows(df)
    if fmt == "csv":
        rows.write.mode("errorifexists").option("header", "true").option("escape", '"').csv(path)
    elif fmt == "jsonl":
        rows.write.mode("errorifexists").json(path)
    else:
        raise ValueError("format must be jsonl or csv")


def read_decision_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Decisions as they are appended; synthetic rows stay out, as in the live feed."""
    return (
        spark.readStream.schema(STORE["audit_events"]).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
        .where(~F.col("synthetic"))
    )
