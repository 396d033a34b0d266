"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR  folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_RUNS    timed runs per query after one warm-up; the median counts (default 3)
BENCH_ALL     set to time every registered query
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

from weir.catalog import QUERIES
from weir.session import clear_scratch, local_session

HEADLINE = (
    "demo_flow", "filter_comparisons", "filter_regex", "project_expressions", "join_inner", "join_full_null_keys", "join_multiway",
    "join_estimate", "agg_measures", "agg_first_last", "agg_having", "topk", "keyset_second_page", "infer_schema_events", "profile_orders",
    "quality_fused_lineitem", "quality_unique_lineitem", "quality_gates", "quarantine_split", "publish_with_quarantine", "csv_round_trip",
    "landed_pages", "upsert_merge", "lineage_from_definitions", "lineage_downstream", "run_totals", "run_daily_series", "incident_repeated_failure",
    "incident_duration_spike", "failure_evidence", "redact_documents", "backfill_missing", "stream_incremental",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else [n for n in HEADLINE if n in QUERIES]
    names = sys.argv[1:] or names
    spark = local_session("weir-bench", cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        elapsed = time.perf_counter() - start
        clear_scratch(spark)
        return elapsed

    seconds = {}
    for name in names:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, seconds[name], file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                "sf": float(scale.group(1)) if scale else folder,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
