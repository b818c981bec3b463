"""Raw records of the message bus and their decoding."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from bandwatch.schemas import LEVEL_DATA, RAW_RECORD

# Host metrics arrive on this channel, with the host as a leading field.
HOST_CHANNEL = "sysmon"


def read_raw(
    spark: SparkSession,
    experiment: str,
    options: dict | None = None,
    streaming: bool = True,
    fmt: str = "kafka",
    path: str | None = None,
) -> DataFrame:
    """All topics of an experiment, from the bus or from files of the same columns.

    For the bus, `options` must hold `kafka.bootstrap.servers`. A stream starts at the newest
    offsets, a batch read at the oldest, unless `options` say otherwise. How much a trigger takes
    is not limited unless `options` has `maxOffsetsPerTrigger`.
    """
    reader = spark.readStream if streaming else spark.read
    reader = reader.format(fmt)
    pattern = f"^{re.escape(experiment)}_.*$"
    if fmt == "kafka":
        reader = reader.option("subscribePattern", pattern)
        reader = reader.option("startingOffsets", "latest" if streaming else "earliest")
        raw = reader.options(**(options or {})).load()
    else:
        raw = reader.schema(RAW_RECORD).options(**(options or {})).load(path)
        raw = raw.where(F.col("topic").rlike(pattern))
    return raw.select(
        "topic", "timestamp", F.col("value").cast("string").alias("value"), "partition", "offset"
    )


def split_records(raw: DataFrame, experiment: str) -> DataFrame:
    """Each record's text split into its fields, and `whole`: whether it has them all.

    Plain topics carry `reading_name,value`, the host-metrics topic `host,reading_name,value`;
    the last field keeps further commas. Records with too few fields, or whose topic has no
    channel segment, are not whole.
    """
    from_host = F.col("topic") == f"{experiment}_{HOST_CHANNEL}"
    # Trailing separators make no segment of their own.
    topic = F.rtrim(F.col("topic"), F.lit("_"))
    split = raw.select(
        "topic", "timestamp", "value", "partition", "offset",
        F.get(F.split(topic, "_", 3), F.lit(1)).alias("channel"),
        from_host.alias("_hosted"),
        F.when(from_host, F.split("value", ",", 3)).otherwise(F.split("value", ",", 2))
        .alias("_parts"),
    )
    hosted, part = F.col("_hosted"), [F.get("_parts", F.lit(i)) for i in range(3)]
    parts = split.select(
        "topic",
        F.col("value").alias("record"),
        "channel",
        F.unix_millis("timestamp").alias("ts"),
        F.when(hosted, part[0]).otherwise("").alias("host"),
        F.when(hosted, part[1]).otherwise(part[0]).alias("reading_name"),
        F.when(hosted, part[2]).otherwise(part[1]).alias("raw_value"),
        (F.shiftleft(F.col("partition").cast("bigint"), 40) + F.col("offset")).alias("seq"),
    )
    whole = F.col("raw_value").isNotNull() & F.col("channel").isNotNull() & F.col("ts").isNotNull()
    return parts.withColumn("whole", whole)


def record_problem():
    return F.format_string("Can't decode record '%s' of topic %s.", "record", "topic")


def decode_records(raw: DataFrame, experiment: str) -> tuple[DataFrame, DataFrame]:
    """(decoded readings, diagnostics of the records that are not whole)."""
    parts = split_records(raw, experiment)
    decoded = parts.where("whole").select(
        "channel", "ts", "host", "reading_name", "raw_value", "seq"
    )
    diagnostics = parts.where("not whole").select(
        record_problem().alias("msg"), F.lit(LEVEL_DATA).alias("level"),
        F.lit("decode_records").alias("operator"),
    )
    return decoded, diagnostics
