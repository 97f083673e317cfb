"""Typed table sources. Schemas are explicit, so a scan reads no file footers to infer them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

# The governance store.
STORE = {
    "tasks": (
        "id string, principal string, agent_id string, parent_id string, profile string, purpose string, "
        "mandate struct<case:string,resources:array<string>,tools:array<string>,recipients_allow:array<string>,"
        "sinks:map<string,string>,models:array<string>,budget:struct<tokens:bigint,calls:bigint,concurrency:int>>, "
        "classification tinyint, status string, synthetic boolean, created_at timestamp, expires_at timestamp"
    ),
    "budgets": (
        "scope_id string, token_limit bigint, spent bigint, reserved bigint, calls_limit bigint, calls_used bigint, "
        "concurrency_limit int, active_calls int"
    ),
    "reservations": (
        "id string, task_id string, scope_ids array<string>, amount bigint, actual bigint, status string, "
        "created_at timestamp, settled_at timestamp"
    ),
    "audit_events": (
        "id bigint, ts timestamp, task_id string, principal string, kind string, channel string, target string, "
        "action string, reason_code string, rule_id string, stage string, policy_version string, latency_ms double, "
        "tool_invoked boolean, synthetic boolean, evidence string, dt date"
    ),
    "policy_versions": (
        "seq bigint, content_hash string, content string, source string, accepted boolean, error string, created_at timestamp"
    ),
    "tool_registry": (
        "name string, definition string, definition_hash string, status string, pending_definition string, "
        "approved_at timestamp, updated_at timestamp"
    ),
    "memory_entries": (
        "id bigint, case_id string, key string, classification tinyint, source_task string, content string, created_at timestamp"
    ),
    "documents": "path string, client string, label tinyint, title string",
    "approvals": (
        "id string, task_id string, tool string, sink string, args_hash string, args_preview string, status string, "
        "created_at timestamp, decided_at timestamp, decided_by string"
    ),
    "rate_counters": "scope string, bucket timestamp, n int",
}

# Corpora and logs the operators also read.
CORPUS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
        "o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def read_table(spark: SparkSession, folder: str, name: str, schemas: dict[str, str] = CORPUS) -> DataFrame:
    return spark.read.schema(schemas[name]).parquet(os.path.join(folder, f"{name}.parquet"))


def is_folder(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal the rows of a table to all cores.

    A file often is one row group and then one task, and a folder can hold fewer row groups than there are cores. Checking a text costs far
    more than this one shuffle of it.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def load_tables(spark: SparkSession, folder: str, names: list[str] | None = None,
                schemas: dict[str, str] = CORPUS) -> dict[str, DataFrame]:
    """Lazy readers by table name; only tables a query touches are scanned."""
    return {n: read_table(spark, folder, n, schemas) for n in (names or list(schemas))}


def load_store(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The governance tables written below ``folder``."""
    return load_tables(spark, folder, names, STORE)
