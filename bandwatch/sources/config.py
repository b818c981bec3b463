"""Config documents: alarm rules per reading, names of combined readings, alarm groups.

Each loader takes a path of JSON documents (one per line); the `*_from` twins take documents as
Python values, for notebooks and tests. Both give the same table.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from bandwatch.schemas import ALARM_GROUP_DOC, READINGS_CONFIG, SENSOR_DOC


def _inline(spark: SparkSession, documents: list[dict], schema: T.StructType) -> DataFrame:
    text = F.lit(json.dumps(documents))
    # One partition: lookups over a few documents then need no exchange.
    one = spark.range(0, 1, 1, 1)
    return one.select(F.inline(F.from_json(text, T.ArrayType(schema))))


def load_readings_config(spark: SparkSession, path: str) -> DataFrame:
    """Rule documents per reading. `doc_order` is the document's place where not given."""
    docs = spark.read.schema(READINGS_CONFIG).json(path)
    return docs.withColumn(
        "doc_order", F.coalesce("doc_order", F.monotonically_increasing_id())
    )


def readings_config_from(spark: SparkSession, documents: list[dict]) -> DataFrame:
    numbered = [{"doc_order": i, **doc} for i, doc in enumerate(documents)]
    return _inline(spark, numbered, READINGS_CONFIG)


def _combined(docs: DataFrame, experiment: str) -> DataFrame:
    return (
        docs.where(F.col("name") == f"storm_{experiment}")
        .select(F.explode(F.map_keys("readings")).alias("reading_name"))
        .distinct()
    )


def load_combined(spark: SparkSession, path: str, experiment: str) -> DataFrame:
    """Names of the readings computed by formula, from the experiment's own sensor document."""
    return _combined(spark.read.schema(SENSOR_DOC).json(path), experiment)


def combined_from(spark: SparkSession, names: list[str]) -> DataFrame:
    docs = [{"name": "storm_inline", "readings": {n: "" for n in names}}]
    return _combined(_inline(spark, docs, SENSOR_DOC), "inline")


def _groups(docs: DataFrame) -> DataFrame:
    # A group without an id of its own is known by what it says.
    own_id = F.coalesce(
        "group_id", F.md5(F.to_json(F.struct("names", "operation", "time_window")))
    )
    return docs.withColumn("group_id", own_id)


def load_alarm_groups(spark: SparkSession, path: str) -> DataFrame:
    """AND/OR groups of alarms."""
    return _groups(spark.read.schema(ALARM_GROUP_DOC).json(path))


def alarm_groups_from(spark: SparkSession, documents: list[dict]) -> DataFrame:
    return _groups(_inline(spark, documents, ALARM_GROUP_DOC))
