"""Time the headline queries once each on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

from callwarden.plans import load
from callwarden.session import build_session

HEADLINE = [
    "evaluate", "decisions_by_source", "pii_scan", "secret_scan", "signature_scan", "split_injection", "totals", "latency",
    "stage_latency", "timeline", "check_resource", "check_leases", "taint_timeline", "flow_violations", "propagate_taint",
    "match_approvals", "rate_limit", "breaker_observed", "ledger_state", "running_balance", "extract_ooxml", "stream_timeline",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": "12g", "spark.log.level": "ERROR", "spark.sql.files.maxPartitionBytes": "4m"})
    queries = load().QUERIES
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": float(scale.group(1)) if scale else folder}), flush=True)


if __name__ == "__main__":
    main()
