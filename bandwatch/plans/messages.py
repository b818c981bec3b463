"""From alarms to messages: groups, then the alarms that belong to none."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bandwatch.functions.messages import group_text, single_text
from bandwatch.operators.grouping import WINDOW_S, evaluate_groups, ungrouped_alarms

SINGLE = "single"


def single_message(alarms: DataFrame) -> DataFrame:
    """Message of each alarm by itself."""
    text = single_text(*(F.col(c) for c in
                         ("alarm_type", "channel", "reading_name", "host", "params")))
    return alarms.select("ts", "severity", text.alias("msg"), F.lit(SINGLE).alias("source"))


def group_message(satisfied: DataFrame, groups: DataFrame) -> DataFrame:
    """Message per satisfied group; the text is made once per group, then joined."""
    texts = groups.select(
        "group_id", group_text(F.col("operation"), F.col("names")).alias("msg")
    )
    return satisfied.join(texts, "group_id").select(
        "ts", "severity", "msg", F.col("group_id").alias("source")
    )


def alarm_messages(
    alarms: DataFrame, groups: DataFrame, window_s: float = WINDOW_S, **grouping
) -> DataFrame:
    """All messages. Reads `alarms` several times: hand over a table, not a long plan.

    With a boolean column `is_new`, only alarms that have it set give messages.
    """
    grouped = group_message(evaluate_groups(alarms, groups, window_s, **grouping), groups)
    fresh = alarms.where("is_new") if "is_new" in alarms.columns else alarms
    return grouped.unionByName(single_message(ungrouped_alarms(fresh, groups)))
