"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores, ``BENCH_RUNS`` the
timed runs after one warm-up (the median counts), ``BENCH_ONLY`` a comma
separated choice of queries. The whole result of a query is computed and thrown away.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from callcause.catalog.queries import QUERIES  # noqa: E402

HEADLINE = [
    "failure_windows", "window_rows_left", "window_rows_inner", "window_rows_linear",
    "radio_condition", "roaming", "event_a3_config", "handover_success", "handover_failure",
    "rach_failure", "pingpong_handover", "high_bler", "diagnosis_v2", "diagnosis_v1",
    "relation_success", "suspected_missing_relations",
]


def session(cores: str) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("callcause-bench")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="callcause-bench-"))
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate())


def run(spark: SparkSession, name: str, folder: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n] or HEADLINE
    spark = session(cores)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in chosen:
        run(spark, name, folder)
        seconds[name] = round(statistics.median(run(spark, name, folder) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "total seconds of the headline queries, warm median", "unit": "sec",
        "value": round(sum(seconds.values()), 3), "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
