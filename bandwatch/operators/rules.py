"""Alarm rules: which are active, and which apply to a reading.

No join here is hinted. The rule table is small as a rule, and then Spark broadcasts it by its
own size check; a rule table beyond `spark.sql.autoBroadcastJoinThreshold` is shuffled instead,
with AQE splitting the partitions of frequent readings.
"""

from pyspark.sql import DataFrame, functions as F

from bandwatch.functions.bands import bands, normalise_durations, normalise_levels
from bandwatch.schemas import LEVEL_CONFIG

# Rule type in the config document -> type shown on the alarm.
ALARM_TYPE = {"simple": "simple", "pid": "pid", "time_since": "timesince"}

# What each kind of rule contributes to a reading's row.
RULE_FIELDS = {
    "simple": ["setpoint", "bands", "recurrence"],
    "pid": ["a", "b", "c", "setpoint", "dt_int", "dt_diff", "bands", "recurrence"],
    "time_since": ["lower", "upper", "max_duration"],
}


def lookup_documents(config: DataFrame) -> DataFrame:
    """The document a reading finds, keyed by (reading_name, host).

    A reading without host finds the first document of its name, whatever that one's host; a
    reading with host only the first document of both.
    """
    first = F.min_by(F.struct("runmode", "alarms"), F.col("doc_order")).alias("doc")
    named = config.where(F.col("name").isNotNull()).withColumnRenamed("name", "reading_name")
    by_name = named.groupBy("reading_name").agg(first).withColumn("host", F.lit(""))
    by_both = named.where(F.col("host") != "").groupBy("reading_name", "host").agg(first)
    return by_name.unionByName(by_both).select("reading_name", "host", "doc.*")


def _is_active(rule_type: str):
    return (
        (F.col("alarm.type") == rule_type)
        & (F.col("alarm.enabled") == "true")
        & (F.col("runmode") == "default")
    )


def active_rules(config: DataFrame, rule_type: str) -> DataFrame:
    """One row per enabled rule of a type, keyed by (reading_name, host, rule_id)."""
    return _active_of(lookup_documents(config), rule_type)


def _active_of(documents: DataFrame, rule_type: str) -> DataFrame:
    rules = (
        documents.select(
            "reading_name", "host", "runmode", F.posexplode("alarms").alias("rule_id", "alarm")
        )
        .where(_is_active(rule_type))
        .select("reading_name", "host", "rule_id", "alarm.*")
    )
    if rule_type == "time_since":
        rules = rules.select(
            "*",
            F.col("lower_threshold").alias("lower"),
            F.col("upper_threshold").alias("upper"),
            normalise_durations(F.col("max_duration")).alias("durations"),
        ).drop("max_duration").withColumnRenamed("durations", "max_duration")
    else:
        base = F.col("setpoint") if rule_type == "simple" else 0.0
        rules = rules.withColumn("bands", bands(normalise_levels(F.col("levels")), base))
    return rules.select("reading_name", "host", "rule_id", *RULE_FIELDS[rule_type])


def max_levels(rules: DataFrame) -> int:
    """Most levels any of these active rules has: how many level columns its check needs."""
    return rules.agg(F.max(F.size("bands"))).first()[0] or 0


def attach_rules(
    readings: DataFrame, config: DataFrame, rule_type: str
) -> tuple[DataFrame, DataFrame]:
    """(one row per reading and active rule, diagnostics of readings without a usable document).

    Only readings without host leave a diagnostic.
    """
    rows = readings.join(active_rules(config, rule_type), ["reading_name", "host"])
    return rows, rule_misses(readings, config, rule_type)


def rule_misses(readings: DataFrame, config: DataFrame, rule_type: str) -> DataFrame:
    """Diagnostics of host-less readings that have no document, or one that cannot be used."""
    usable = F.col("alarms").isNotNull() & (
        F.col("runmode").isNotNull()
        | ~F.exists(
            "alarms", lambda a: F.coalesce((a.type == rule_type) & (a.enabled == "true"),
                                           F.lit(False))
        )
    )
    known = lookup_documents(config).where((F.col("host") == "") & usable).select("reading_name")
    return (
        readings.where(F.col("host") == "")
        .join(known, "reading_name", "left_anti")
        .select(
            F.concat(F.lit("Can't access alarm config for "), "reading_name").alias("msg"),
            F.lit(LEVEL_CONFIG).alias("level"),
            F.lit(f"attach_rules:{rule_type}").alias("operator"),
        )
    )


def rule_problems(config: DataFrame) -> DataFrame:
    """Diagnostics of rules that can never take effect, once each: without a type or a switch, or
    switched on and with limits that cannot be read.
    """
    kind, on = F.col("alarm.type"), F.col("alarm.enabled") == "true"

    def unreadable(values):
        return F.coalesce(~F.exists(values, lambda v: v.isNull()), F.lit(False)) == F.lit(False)

    pairs = F.flatten(F.transform(
        normalise_levels(F.col("alarm.levels")),
        lambda p: F.array(F.get(p, F.lit(0)), F.get(p, F.lit(1)))))
    banded = on & kind.isin("simple", "pid")
    problem = (
        F.when(kind.isNull(), "no type")
        .when(F.col("alarm.enabled").isNull(), "not said whether it is enabled")
        .when(banded & unreadable(pairs), "levels cannot be read")
        .when(banded & F.col("alarm.recurrence").isNull(), "recurrence cannot be read")
        .when(on & (kind == "time_since")
              & unreadable(normalise_durations(F.col("alarm.max_duration"))),
              "durations cannot be read")
    )
    rules = config.select("name", F.posexplode("alarms").alias("rule_id", "alarm"))
    return rules.withColumn("problem", problem).where(F.col("problem").isNotNull()).select(
        F.format_string("Can't use alarm rule %d of %s: %s.", "rule_id", "name", "problem")
        .alias("msg"),
        F.lit(LEVEL_CONFIG).alias("level"), F.lit("rule_problems").alias("operator"),
    )
