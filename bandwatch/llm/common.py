"""Helpers that the operators share: ids, words, tables that outlive an executor."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a data folder."""
    reach_workers(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package wherever the session was started."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="bandwatch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/llm-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read back: cuts lineage, survives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once; a plain reference could be computed anew for each array element."""
    return F.transform(F.array(value), body)[0]


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def ascii_words(text: str | None) -> list[bytes]:
    """UTF-8 words between white space (space, \\t to \\r) with A-Z lower-cased; other letters stay."""
    return text.encode().lower().split() if text else []


def by_batch(rows: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: rows() on each batch that has rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield rows(batch)

    return run
