"""The given `events` table seen as a stream of sensor readings, and the rules put to it.

reading_name = event_type, ts = event time in ms, seq = event_id. At these scales a frame of 600 s
holds one or two rows, so the registered queries look back six hours.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from bandwatch.sources.config import (
    alarm_groups_from, combined_from, load_alarm_groups, load_combined, load_readings_config,
    readings_config_from,
)

WINDOW_S = 21_600
LOOKBACK_S = 21_600
EXPERIMENT = "exp"
COMBINED = ["signup"]

SIMPLE_CLICK = {"type": "simple", "enabled": "true", "setpoint": 35, "levels": [[-30, 40], [-34, 110]],
                "recurrence": 2}
SIMPLE_VIEW = {"type": "simple", "enabled": "true", "setpoint": 30, "levels": [-25, 45],
               "recurrence": 3}
SIMPLE_PURCHASE = {"type": "simple", "enabled": "true", "setpoint": 20,
                   "levels": [[-15, 20], [-18, 60], [-19, 120]], "recurrence": 1}
PID_CLICK = {"type": "pid", "enabled": "true", "a": 1, "b": 0.001, "c": 2, "setpoint": 35,
             "dt_int": 7200, "dt_diff": 14400, "levels": [[-60, 90], [-100, 150]], "recurrence": 2}
PID_PURCHASE = {"type": "pid", "enabled": "true", "a": 0.5, "b": -0.0005, "c": 10, "setpoint": 40,
                "dt_int": 50000, "dt_diff": 3600, "levels": [-40, 60], "recurrence": 1}
SINCE_CLICK = {"type": "time_since", "enabled": "true", "lower_threshold": 5, "upper_threshold": 75,
               "max_duration": [1000, 3600]}
SINCE_PURCHASE = {"type": "time_since", "enabled": "true", "lower_threshold": 10,
                  "upper_threshold": 60, "max_duration": 7200}

# `view` has two documents (without a host the first is found), `signup` is in test mode, the
# first rule of `purchase` is switched off, `error` has no document.
DOCUMENTS = [
    {"name": "click", "runmode": "default", "alarms": [SIMPLE_CLICK, PID_CLICK, SINCE_CLICK]},
    {"name": "view", "host": "h3", "runmode": "default", "alarms": [SIMPLE_VIEW]},
    {"name": "view", "host": "h4", "runmode": "default", "alarms": [SIMPLE_CLICK]},
    {"name": "signup", "runmode": "testing", "alarms": [SIMPLE_CLICK]},
    {"name": "purchase", "runmode": "default",
     "alarms": [{**SIMPLE_PURCHASE, "enabled": "false"}, SIMPLE_PURCHASE, PID_PURCHASE,
                SINCE_PURCHASE]},
]

GROUPS = [
    {"group_id": "g_and", "names": ["click,simple", "purchase,pid", "purchase,timesince"],
     "operation": "and", "time_window": 7200},
    {"group_id": "g_or", "names": ["view,simple", "click,pid"], "operation": "or",
     "time_window": 60},
]

# Formulas the `signup` records carry, by event_id % 4.
FORMULAS = [
    "click + view * 2",
    "(click - error) / (view - 35.5)",
    "Math.max(click,purchase,h3) - Math.sqrt(abs(view))",
    "missing_one + 1",
]


def config_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same documents through files: (readings config, combined names, alarm groups)."""
    sensors = [{"name": f"storm_{EXPERIMENT}", "readings": dict.fromkeys(COMBINED, "")},
               {"name": "storm_other", "readings": {"click": ""}}]
    for name, documents in (("readings", DOCUMENTS), ("sensors", sensors), ("groups", GROUPS)):
        lines = F.explode(F.array(*(F.lit(json.dumps(d)) for d in documents)))
        spark.range(0, 1, 1, 1).select(lines.alias("value")).write.text(f"{folder}/{name}")
    return load_config(spark, folder)


def load_config(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents from the files of a folder."""
    return (load_readings_config(spark, f"{folder}/readings"),
            load_combined(spark, f"{folder}/sensors", EXPERIMENT),
            load_alarm_groups(spark, f"{folder}/groups"))


def config(spark: SparkSession) -> DataFrame:
    return readings_config_from(spark, DOCUMENTS)


def combined(spark: SparkSession) -> DataFrame:
    return combined_from(spark, COMBINED)


def groups(spark: SparkSession) -> DataFrame:
    return alarm_groups_from(spark, GROUPS)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with `ms`, the event time as epoch ms, whatever the session's time zone."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    if dict(table.dtypes)["ts"] == "timestamp":
        return table.withColumn("ms", F.unix_millis("ts"))
    second = F.extract(F.lit("SECOND"), F.col("ts"))
    return table.withColumn(
        "ms",
        F.unix_date(F.col("ts").cast("date")).cast("bigint") * 86_400_000
        + F.hour("ts") * 3_600_000 + F.minute("ts") * 60_000
        + F.floor(second * 1000).cast("bigint"),
    )


def readings(spark: SparkSession, sf_dir: str, hosted: bool = False) -> DataFrame:
    """Numeric readings; `hosted` spreads them over ten hosts of the host-metrics channel."""
    # Without a host '', but read from the row: a stored table's host is no constant of the plan.
    none = F.substring("event_type", 1, 0)
    host = F.concat(F.lit("h"), F.col("user_id") % 10) if hosted else none
    return events(spark, sf_dir).select(
        F.lit("sysmon" if hosted else "phys").alias("channel"), F.col("ms").alias("ts"),
        host.alias("host"), F.col("event_type").alias("reading_name"), "value",
        F.col("event_id").alias("seq"),
    )


def _record(events_: DataFrame, topic, text) -> DataFrame:
    return events_.select(
        topic.alias("topic"), F.timestamp_millis("ms").alias("timestamp"), text.alias("value"),
        F.lit(0).alias("partition"), F.col("event_id").alias("offset"),
    )


def _number():
    """The value as text with its two decimals."""
    return F.col("value").cast("decimal(18,2)").cast("string")


def plain_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a well-formed record `event_type,value` on one topic."""
    text = F.concat_ws(",", "event_type", _number())
    return _record(events(spark, sf_dir), F.lit("exp_phys"), text)


def mixed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all sorts.

    `purchase` comes as host metrics, `signup` carries formulas, some of `error` lack the value
    and some of `view` have a text that is no number.
    """
    kind, user = F.col("event_type"), F.col("user_id")
    formula = F.get(F.array(*map(F.lit, FORMULAS)), (F.col("event_id") % 4).cast("int"))
    text = (
        F.when(kind == "purchase", F.concat(F.lit("h"), user % 10, F.lit(",purchase,"), _number()))
        .when(kind == "signup", F.concat(F.lit("signup,"), formula))
        .when((kind == "error") & (user % 7 == 0), F.lit("error"))
        .when((kind == "view") & (user % 11 == 0), F.lit("view,n/a"))
        .otherwise(F.concat_ws(",", "event_type", _number()))
    )
    topic = F.when(kind == "purchase", F.lit("exp_sysmon")).otherwise("exp_phys")
    return _record(events(spark, sf_dir), topic, text)


# Formulas over names with dashes and digits; there is no host `node-2`, so the second has no value.
NAMED = ["cpu-1,node-02 * 2 - cpu-2,node-03", "cpu-1,node-2 + 1"]


def named_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host metrics `cpu-<n>` of hosts `node-0<n>` (from `click`), and formulas over them (`signup`)."""
    kind, user = F.col("event_type"), F.col("user_id")
    metric = F.concat(F.lit("node-0"), user % 4, F.lit(",cpu-"), user % 3, F.lit(","), _number())
    formula = F.get(F.array(*map(F.lit, NAMED)), (F.col("event_id") % 2).cast("int"))
    rows = events(spark, sf_dir).where(kind.isin("click", "signup"))
    text = F.when(kind == "click", metric).otherwise(F.concat(F.lit("signup,"), formula))
    return _record(rows, F.when(kind == "click", F.lit("exp_sysmon")).otherwise("exp_phys"), text)
