"""Output tables: stored points, alarms, alarm history, diagnostics.

Batch and stream write the same layout: by day where rows have a time, and by the run that wrote
them innermost. A micro-batch owns its number (0 and up) and overwrites it, so a replay leaves no
duplicates; a reader of some days lists those days only.

A batch run writes all its tables under a fresh negative number, which no reader sees until the run
is committed: one empty file, created last, that binds the run's name to the number. A run that
broke off leaves files that nobody reads, and its repetition under the same name gives each row
once, whatever the first try had written.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from bandwatch.plans.staging import hadoop
from bandwatch.schemas import ALARM, DIAGNOSTIC, HISTORY, POINT
from bandwatch.sources.records import HOST_CHANNEL

# Host metrics of all experiments share one database.
COMMON_DATABASE = "common"
DAY_MS = 86_400_000
TABLES = {"readings": POINT, "alarms": ALARM, "history": HISTORY, "diagnostics": DIAGNOSTIC}


def storage_points(readings: DataFrame, experiment: str) -> DataFrame:
    """Readings as time-series points; the host is a tag, '' where there is none."""
    return readings.select(
        F.when(F.col("channel") == HOST_CHANNEL, COMMON_DATABASE).otherwise(experiment)
        .alias("database"),
        F.col("channel").alias("measurement"), "host", "reading_name", "ts", "value",
    )


def history_rows(messages: DataFrame) -> DataFrame:
    return messages.select(
        F.timestamp_millis("ts").alias("when"), F.col("severity").alias("howbad"), "msg"
    )


def day_of(ts: Column) -> Column:
    return F.date_from_unix_date(F.floor(ts / DAY_MS).cast("int"))


def new_run_number() -> int:
    """A number for one try of a batch run, below 0; 62 random bits."""
    return -1 - (uuid.uuid4().int >> 66)


def _marks(spark: SparkSession, out: str, run_id: str | None = None) -> dict[str, int]:
    """Per committed run (digest of its name) the number of the try that counts."""
    digest = "*" if run_id is None else hashlib.sha256(run_id.encode()).hexdigest()
    files, path = hadoop(spark, f"{out}/_runs/{digest}.*")
    found: dict[str, int] = {}
    for status in files.globStatus(path) or []:
        name, number = str(status.getPath().getName()).split(".")
        # Two tries of one run may have ended at the same time: the same one counts for everybody.
        found[name] = max(found.get(name, -int(number)), -int(number))
    return found


def is_committed(spark: SparkSession, out: str, run_id: str) -> bool:
    return bool(_marks(spark, out, run_id))


def commit_run(spark: SparkSession, out: str, run_id: str, number: int) -> None:
    """From now on readers see what was written under the number."""
    digest = hashlib.sha256(run_id.encode()).hexdigest()
    files, path = hadoop(spark, f"{out}/_runs/{digest}.{-number}")
    files.create(path, True).close()


def remove_broken_runs(spark: SparkSession, out: str) -> int:
    """Remove what runs without a commit have left; how many folders. Not while a run goes on."""
    kept, removed = set(_marks(spark, out).values()), 0
    for below in ("readings/day=*/database=*/measurement=*", "alarms/day=*", "history/day=*",
                  "diagnostics"):
        files, path = hadoop(spark, f"{out}/{below}/batch=-*")
        for status in files.globStatus(path) or []:
            if int(str(status.getPath().getName()).split("=")[1]) not in kept:
                files.delete(status.getPath(), True)
                removed += 1
    return removed


def read_table(spark: SparkSession, out: str, name: str) -> DataFrame:
    """One of the tables under `out`, with `batch` and, where rows have a time, `day`; may be empty.

    Rows of micro-batches and of committed batch runs.
    """
    parts = [T.StructField("batch", T.LongType())]
    if name != "diagnostics":
        parts.append(T.StructField("day", T.DateType()))
    rows = spark.read.schema(T.StructType([*TABLES[name], *parts])).parquet(f"{out}/{name}")
    runs = sorted(_marks(spark, out).values())
    visible = F.col("batch") >= 0
    return rows.where(visible | F.col("batch").isin(runs) if runs else visible)


def _write(df: DataFrame, path: str, number: int, partitions: list[str] = ()) -> None:
    if not partitions:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")
        return
    df.withColumn("batch", F.lit(number).cast("bigint")).write.partitionBy(
        *partitions, "batch"
    ).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_readings(readings: DataFrame, experiment: str, path: str, number: int) -> None:
    """Store points under day / database / measurement.

    Rows are brought together by partition first; AQE evens out sizes and splits large days.
    """
    keys = ["day", "database", "measurement"]
    points = storage_points(readings, experiment).withColumn("day", day_of(F.col("ts")))
    _write(points.hint("rebalance", *keys), path, number, keys)


def write_alarm_history(messages: DataFrame, path: str, number: int) -> None:
    rows = history_rows(messages).withColumn(
        "day", day_of(F.unix_millis("when"))
    )
    _write(rows.hint("rebalance", "day"), path, number, ["day"])


def write_diagnostics(diagnostics: DataFrame, path: str, number: int) -> None:
    """Diagnostics have no time of their own; they lie by the run that found them."""
    _write(diagnostics, path, number)


def write_alarms(alarms: DataFrame, path: str, number: int) -> None:
    rows = alarms.withColumn("day", day_of(F.col("ts")))
    _write(rows.hint("rebalance", "day"), path, number, ["day"])
