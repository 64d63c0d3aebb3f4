"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one warm-up, then the median of three runs.

Every run computes the full result and throws it away. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "scan_date_range", "resample_global", "resample_grouped", "group_agg_dict", "ptd_cards", "ptd_hierarchy",
    "period_over_period", "period_columns", "multi_lag", "hashrate", "box_summary", "correlation_table",
    "mann_whitney", "kruskal", "warehouse_join", "share_of_total", "tier2", "flow_links", "timeline_spans",
    "upsert_range", "forecast_by_key", "kmeans_gap",
]
RUNS = 3


def main() -> None:
    from periodica.plans import QUERIES
    from periodica.session import build_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "8g"))
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in sys.argv[1:] or HEADLINE:
        runs = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        timings[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
        "sf": os.path.basename(sf.rstrip("/")), "cpus": int(cpus), "runs": RUNS,
    }))


if __name__ == "__main__":
    main()
