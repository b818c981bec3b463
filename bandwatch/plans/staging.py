"""Written tables that cut a plan where several consumers read one result.

They lie in the folder the cluster names in `spark.checkpoint.dir`, so they outlive executors.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate tables; a folder of this machine only on a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = shared or tempfile.mkdtemp(prefix="bandwatch-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, path: str) -> DataFrame:
    """Write a table and go on from what was written."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Parts:
    """A table written in parts, one folder per `tag`; with `bucket_ms`, below it by time buckets."""

    def __init__(self, spark: SparkSession, path: str, bucket_ms: int | None = None):
        self.spark, self.path, self.bucket_ms = spark, path, bucket_ms

    def write(self, rows: DataFrame) -> T.StructType:
        """Write rows by their `tag`: all parts there are so far. The schema of a part's rows."""
        self._save(rows, ["tag"], self.path)
        return T.StructType([f for f in rows.schema if f.name != "tag"])

    def add(self, tag: str, rows: DataFrame) -> None:
        """Write one more part."""
        self._save(rows, [], self.folder(tag))

    def _save(self, rows: DataFrame, keys: list[str], path: str) -> None:
        if self.bucket_ms:
            # Buckets may be many: rows are brought together first.
            rows, keys = by_bucket(rows, self.bucket_ms), [*keys, "bucket"]
        rows.write.mode("overwrite").partitionBy(*keys).parquet(path)

    def folder(self, tag: str) -> str:
        return f"{self.path}/tag={tag}"

    def holds(self, tag: str) -> bool:
        files, path = hadoop(self.spark, self.folder(tag))
        return files.exists(path)

    def read(self, schema: T.StructType, *tags: str) -> DataFrame:
        """The rows of those of these parts that there are."""
        folders = [self.folder(tag) for tag in tags if self.holds(tag)]
        if not folders:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema).option("basePath", self.path)
        return reader.parquet(*folders).select(*schema.names)


def by_bucket(rows: DataFrame, bucket_ms: int) -> DataFrame:
    """With the number of the time `bucket` of `ts`, rows of a bucket together."""
    bucket = F.floor(F.col("ts") / bucket_ms).cast("bigint")
    return rows.withColumn("bucket", bucket).hint("rebalance", "bucket")


def hadoop(spark: SparkSession, folder: str):
    """The file system of a folder, and the folder in its terms."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def dropped(spark: SparkSession, path: str) -> None:
    """Remove a table that is no longer read."""
    files, folder = hadoop(spark, path)
    files.delete(folder, True)


def at_once(spark: SparkSession, *actions: Callable[[], object]) -> None:
    """Run independent writes side by side, so that small ones do not wait for each other."""
    inherits = inheritable_thread_target(spark)
    with ThreadPoolExecutor(len(actions)) as pool:
        for running in [pool.submit(inherits(action)) for action in actions]:
            running.result()
