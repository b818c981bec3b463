"""Time the headline queries and print one JSON line.

$BENCH_SF_DIR (default /root/testdata/sf0.1) is the data, $BENCH_CPUS (default 8) the threads.
Every query runs once to warm up, then `BENCH_RUNS` (default 2) times; the best time counts. A
time covers everything from building the plan to the last row; rows go to a sink that drops them.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

from bandwatch.plans import checks
from registry import data, queries


def windowed(plan, window_s: float, slice_s: float | None = None):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plan(data.readings(spark, sf_dir), data.config(spark), window_s, slice_s)

    return query


QUERIES = {
    "decode": queries.numeric_cast,
    "combined_readings": queries.combined_readings,
    "simple_alarms": queries.simple_alarms,
    "simple_alarms_600s": windowed(checks.simple_alarms, 600),
    "simple_alarms_short_slices": queries.simple_alarms_halo,
    "pid_alarms": queries.pid_alarms,
    "pid_alarms_600s": windowed(checks.pid_alarms, 600),
    "pid_alarms_short_slices": queries.pid_alarms_halo,
    "time_since_alarms": queries.time_since_alarms,
    "time_since_alarms_600s": windowed(checks.time_since_alarms, 600),
    "alarm_union": queries.alarm_union,
    "alarm_messages": queries.alarm_messages,
    "batch_run": queries.batch_run,
    "stream_alarms": queries.stream_alarms,
}
# Whole runs write many tables: once is enough.
ONCE = {"batch_run", "stream_alarms"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bandwatch-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        # Small data: keep the partitions apart, or one thread would sort everything.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.driver.memory", "16g")
        # Without a call site for every column: half of the calls that build a plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bandwatch-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or list(QUERIES)
    seconds = {}
    for name in chosen:
        times = []
        for _ in range(1 if name in ONCE else 1 + runs):
            start = time.perf_counter()
            result = QUERIES[name](spark, sf_dir)
            result.write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total time of the headline queries", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
