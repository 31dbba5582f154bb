"""Headline queries, one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the cores. Every query runs once
to warm up and then BENCH_RUNS times; its figure is the median wall time in seconds of
building the plan, any tables it stores on the way, and producing every result row.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from skyweave.plans.catalogue import REGISTRY
from skyweave.session import local_session

QUERIES = [
    "worst_days",
    "aqi_index",
    "tail_clip",
    "station_grid",
    "linear_gaps",
    "seasonal_gaps",
    "savgol_smooth",
    "lags_and_rolls",
    "event_labels",
    "event_validation",
    "event_log",
    "pixel_daily",
    "source_priority",
    "daily_momentum",
    "classical_residual",
    "monthly_pattern",
    "correlation",
    "key_figures",
    "reading_scores",
    "classification_report",
    "roc_auc",
    "stl_residual",
    "isolation_forest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    seconds = {}
    for name in QUERIES:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf, "cores": cores}))


if __name__ == "__main__":
    main()
