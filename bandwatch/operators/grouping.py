"""AND/OR groups of alarms inside a time window.

Every alarm makes all groups be looked at, so the result has one row per alarm and group that is
satisfied at its time. To get there without pairing alarms with groups or with each other:

1. Member alarms become *pieces*: intervals in which a slot of a group is on with one severity. A
   slot is a listed name for `and`, a severity for `or`. For `and` the severity is that of the
   name's oldest alarm still in the window, which one look at the previous alarm tells; pieces that
   follow each other with the same severity are joined. For `or` only the first and last alarm of a
   severity in a cell of time count, which partial aggregates find wherever the alarms lie.
2. A sweep over the begins and ends of a group's pieces, a time slice at a time, counts the slots
   that are on and notes the highest severity: the group's *satisfied intervals*.
3. An alarm meets the satisfied intervals of its cell, merged by time: of each group the one last
   begun. Cells with very many alarms are split by a salt before alarms and intervals meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bandwatch.functions.messages import alarm_key
from bandwatch.operators.slices import floor_to, millis, not_before_own, slice_millis, with_halo

WINDOW_S = 600
CELL_S = 60
# Alarms of one cell that one task should see at most; beyond that the cell is split.
ALARMS_PER_TASK = 1_000_000

ALARM_ID = ["host", "reading_name", "ts", "seq", "alarm_type", "rule_id"]


def key_of_alarm() -> Column:
    return alarm_key(F.col("host"), F.col("reading_name"), F.col("alarm_type"))


def listed_names(groups: DataFrame) -> DataFrame:
    """All alarm keys that occur in any group."""
    return groups.select(F.explode("names").alias("name")).distinct()


def group_members(alarms: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per alarm and group that lists it."""
    listed = groups.select(
        "group_id", "operation", "time_window",
        F.size(F.array_distinct("names")).alias("n_names"),
        F.explode(F.array_distinct("names")).alias("name"),
    ).where(F.col("operation").isin("and", "or"))
    return alarms.withColumn("name", key_of_alarm()).join(listed, "name")


def ungrouped_alarms(alarms: DataFrame, groups: DataFrame) -> DataFrame:
    """Alarms that no group lists."""
    return (
        alarms.withColumn("name", key_of_alarm())
        .join(listed_names(groups), "name", "left_anti")
        .select(*alarms.columns)
    )


def _and_pieces(members: DataFrame, window_ms: int, slice_ms: int) -> DataFrame:
    """When each name of an `and` group is on, with the severity of its oldest alarm in the window."""
    span = F.least(F.floor(F.col("time_window") * 1000), F.lit(window_ms - 1)).cast("bigint")
    # Of alarms of one time the first to arrive counts; there are no more times than milliseconds.
    arrival = F.struct("seq", "host", "reading_name", "alarm_type", "rule_id")
    first = members.withColumn("span", span).groupBy(
        "group_id", F.col("n_names").alias("need"), F.col("name").alias("slot"), "span", "ts"
    ).agg(F.min_by("severity", arrival).alias("severity"))
    by_time = Window.partitionBy("group_id", "slot", "slice").orderBy("ts")
    # The slot is taken over when the previous alarm has left the window.
    freed = F.lag(F.col("ts") + F.col("span") + 1).over(by_time)
    taken = (
        with_halo(first, slice_ms, window_ms - 1)
        .withColumn("since", F.greatest("ts", freed))
        .withColumn("until", F.col("ts") + F.col("span"))
    )
    goes_on = (F.lag("until").over(by_time) + 1 == F.col("since")) & (
        F.lag("severity").over(by_time) == F.col("severity"))
    begins = F.when(goes_on & not_before_own(), 0).otherwise(1)
    runs = taken.withColumn("begins", begins).where(not_before_own()).withColumn(
        "run", F.sum("begins").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("group_id", "slot", "slice", "run", "need", "severity").agg(
        F.min("since").alias("since"), F.max("until").alias("until")
    ).select("group_id", "need", "since", "until", "severity")


def _or_pieces(members: DataFrame, window_ms: int, cell_ms: int) -> DataFrame:
    """When each severity of an `or` group is on; pieces of one severity may overlap.

    Alarms of a cell no longer than the window leave no gap between them, so the first and the
    last say all.
    """
    cell = F.lit(min(cell_ms, window_ms)).cast("bigint")
    ends = members.groupBy("group_id", "severity", floor_to(F.col("ts"), cell).alias("cell")).agg(
        F.min("ts").alias("since"), (F.max("ts") + (window_ms - 1)).alias("until"))
    return ends.select("group_id", F.lit(1).alias("need"), "since", "until", "severity")


def slot_pieces(
    alarms: DataFrame, groups: DataFrame, window_s: float = WINDOW_S, cell_s: float = CELL_S
) -> DataFrame:
    """Intervals [since, until] (ms, closed) in which a slot of a group is on, of one severity each."""
    window_ms = millis(window_s)
    members = group_members(alarms, groups)
    of = lambda operation: members.where(F.col("operation") == operation)
    return _and_pieces(of("and"), window_ms, slice_millis(window_s, None)).unionByName(
        _or_pieces(of("or"), window_ms, millis(cell_s)))


def satisfied_intervals(pieces: DataFrame, slice_ms: int) -> DataFrame:
    """Intervals [since, until] in which enough slots of a group are on, and the highest severity.

    Disjoint per group, cut at slices. One exchange by (group, slice); a slice of a group has at
    most as many events as its slots have begins and ends in it.
    """
    step = F.lit(slice_ms).cast("bigint")
    cut = pieces.withColumn("slice", F.explode(F.sequence(
        floor_to(F.col("since"), step), floor_to(F.col("until"), step), step)))
    end = F.col("slice") + step
    event = lambda at, change: F.struct(at.alias("at"), F.lit(change).alias("change"))
    events = cut.withColumn("event", F.explode(F.array(
        event(F.greatest("since", "slice"), 1), event(F.least(F.col("until") + 1, end), -1)
    ))).select("group_id", "need", "slice", "severity", "event.*")
    key = ["group_id", "need", "slice"]
    changes = events.repartition("group_id", "slice").groupBy(*key, "severity", "at").agg(
        F.sum("change").alias("change"))
    # Every severity of the slice is looked at whenever one of them changes.
    levels = F.collect_set("severity").over(Window.partitionBy("group_id", "slice"))
    at_all = changes.withColumn("levels", levels).withColumn("level", F.explode("levels")).groupBy(*key, "level", "at").agg(
        F.sum(F.when(F.col("severity") == F.col("level"), F.col("change")).otherwise(0)).alias("change"))
    so_far = Window.partitionBy("group_id", "slice", "level").orderBy("at").rowsBetween(
        Window.unboundedPreceding, 0)
    counted = at_all.withColumn("on", F.sum("change").over(so_far)).groupBy(*key, "at").agg(
        F.sum("on").alias("n_on"), F.max(F.when(F.col("on") > 0, F.col("level"))).alias("severity"))
    following = F.lead("at").over(Window.partitionBy("group_id", "slice").orderBy("at"))
    return (
        counted.withColumn("until", following - 1)
        .where((F.col("n_on") >= F.col("need")) & F.col("until").isNotNull())
        .select("group_id", F.col("at").alias("since"), "until", "severity")
    )


def evaluate_groups(
    alarms: DataFrame,
    groups: DataFrame,
    window_s: float = WINDOW_S,
    cell_s: float = CELL_S,
    alarms_per_task: int = ALARMS_PER_TASK,
) -> DataFrame:
    """One row per alarm and group satisfied at its time: alarm identity, group_id, severity.

    `and`: all names have an alarm in [t - time_window, t]; severity is the highest over the
    names of each name's oldest such alarm. `or`: any name has one in (t - window, t]; the
    highest severity of all of them. Alarms of equal time count for each other.
    With a boolean column `is_new`, only alarms that have it set trigger.
    """
    cell_ms = F.lit(millis(cell_s)).cast("bigint")
    triggers = alarms.where("is_new") if "is_new" in alarms.columns else alarms
    # Equal alarms (delivered again, or from two topics) ask once; each has its own result.
    triggers = triggers.groupBy(*ALARM_ID).agg(F.count(F.lit(1)).cast("int").alias("_copies"))
    triggers = triggers.withColumn("cell", floor_to(F.col("ts"), cell_ms))
    # Each of these stands for more alarms than one task should see, so they are few.
    hot = triggers.groupBy("cell").agg(
        F.ceil(F.count(F.lit(1)) / alarms_per_task).cast("int").alias("splits")
    ).where("splits > 1")
    salted = triggers.join(F.broadcast(hot), "cell", "left").withColumn(
        "salt", F.pmod(F.xxhash64(*ALARM_ID), F.coalesce("splits", F.lit(1))).cast("int"))
    pieces = slot_pieces(alarms, groups, window_s, cell_s)
    satisfied = satisfied_intervals(pieces, slice_millis(window_s, None))
    spans = (
        satisfied.withColumn("cell", F.explode(F.sequence(
            floor_to(F.col("since"), cell_ms), floor_to(F.col("until"), cell_ms), cell_ms)))
        .join(F.broadcast(hot), "cell", "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("splits", F.lit(1)) - 1)))
        .select("cell", "salt", "group_id", "since", "until", "severity")
    )
    there = spans.select("cell", "salt", "group_id").distinct()
    asking = salted.join(there, ["cell", "salt"]).select(
        "group_id", "cell", "salt", F.col("ts").alias("at"), F.lit(1).alias("_asks"),
        F.struct(*ALARM_ID, "_copies").alias("alarm"),
    )
    telling = spans.select(
        "group_id", "cell", "salt", F.col("since").alias("at"), F.lit(0).alias("_asks"),
        F.struct("until", "severity").alias("on"),
    )
    by_time = (
        Window.partitionBy("group_id", "cell", "salt").orderBy("at", "_asks")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    met = asking.unionByName(telling, allowMissingColumns=True).withColumn(
        "last_on", F.last("on", True).over(by_time)
    ).where((F.col("_asks") == 1) & (F.col("last_on.until") >= F.col("at")))
    return (
        met.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("alarm._copies"))))
        .select(*(F.col(f"alarm.{c}").alias(c) for c in ALARM_ID), "group_id",
                F.col("last_on.severity").alias("severity"))
    )
