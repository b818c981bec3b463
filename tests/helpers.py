import json
import math

from bandwatch.schemas import ALARM, DECODED, RAW_RECORD, READING
from bandwatch.sources.config import readings_config_from

START = 1_700_000_000_000


def readings(spark, rows):
    """Rows of (seconds, value[, name[, host]]) as numeric readings, in order of arrival."""
    full = [(*r, *("T1", "")[len(r) - 2:]) for r in rows]
    data = [
        ("x", START + int(round(t * 1000)), host, name, float(v), i)
        for i, (t, v, name, host) in enumerate(full)
    ]
    return spark.createDataFrame(data, READING)


def rule_doc(*alarms, name="T1", **extra):
    docs = []
    for alarm in alarms:
        alarm = {"enabled": "true", **alarm}
        docs.append(alarm)
    return {"name": name, "runmode": "default", "alarms": docs, **extra}


def config(spark, *docs):
    return readings_config_from(spark, list(docs))


def by_second(df, *columns):
    """{second: value(s)} of a result."""
    out = {}
    for row in df.select("ts", *columns).collect():
        values = tuple(row[c] for c in columns)
        out[(row["ts"] - START) / 1000] = values[0] if len(values) == 1 else values
    return out


def raw_records(spark, rows):
    """Rows of (topic, seconds, text) as raw records, offsets in order."""
    from pyspark.sql import functions as F
    data = [(topic, START + int(round(t * 1000)), text, 0, i)
            for i, (topic, t, text) in enumerate(rows)]
    df = spark.createDataFrame(data, "topic string, ms bigint, value string, "
                                     "partition int, offset bigint")
    return df.select("topic", F.timestamp_millis("ms").alias("timestamp"), "value", "partition",
                     "offset")


def decoded(spark, rows):
    """Rows of (seconds, name, text[, host])."""
    data = [("x", START + int(round(r[0] * 1000)), (*r, "")[3], r[1], r[2], i)
            for i, r in enumerate(rows)]
    return spark.createDataFrame(data, DECODED)


def alarms(spark, rows):
    """Rows of (seconds, host, name, type, severity)."""
    data = [("x", START + int(round(t * 1000)), host, name, kind, float(severity),
             [1.0, 2.0, 3.0, 4.0], 0, i)
            for i, (t, host, name, kind, severity) in enumerate(rows)]
    return spark.createDataFrame(data, ALARM)
