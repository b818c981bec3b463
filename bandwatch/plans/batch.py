"""The whole flow over a bounded set of records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from bandwatch.operators.latest import LOOKBACK_S
from bandwatch.operators.rules import ALARM_TYPE, rule_misses, rule_problems
from bandwatch.plans.checks import WINDOW_S, all_alarms
from bandwatch.plans.messages import alarm_messages
from bandwatch.plans.readings import bad, good, write_rows
from bandwatch.plans.staging import Parts, at_once, staged, work_folder
from bandwatch.sinks.tables import (
    commit_run, is_committed, new_run_number, write_alarm_history, write_alarms, write_diagnostics,
    write_readings,
)

TABLES = ["readings", "alarms", "history", "diagnostics"]


def config_diagnostics(readings: DataFrame, config: DataFrame) -> DataFrame:
    """Readings without usable rules, once per kind of rule, and rules that cannot be used."""
    simple, pid, since = (rule_misses(readings, config, kind) for kind in ALARM_TYPE)
    return simple.unionByName(pid).unionByName(since).unionByName(rule_problems(config))


def run_batch(
    raw: DataFrame,
    experiment: str,
    config: DataFrame,
    combined: DataFrame,
    groups: DataFrame,
    out: str,
    window_s: float = WINDOW_S,
    lookback_s: float = LOOKBACK_S,
    slice_s: float | None = None,
    run_id: str | None = None,
) -> dict[str, DataFrame] | None:
    """Append stored points, alarms, alarm history and diagnostics to the tables under `out`.

    All of it becomes visible at once, at the end. `run_id` names the run: repeat one that broke
    off under the same name. Of a run that is already there nothing is done, and None returned.
    Returns the numeric readings, alarms, messages and diagnostics of this run. What has several
    consumers is written once in between: the rows of the records (the source is read once, so
    that all steps see the same), the alarms and the messages, which serve what is returned.
    """
    spark, run_id = raw.sparkSession, run_id or uuid.uuid4().hex
    if is_committed(spark, out, run_id):
        return None
    number = new_run_number()
    work = work_folder(spark, "batch")
    rows = write_rows(raw, experiment, combined, Parts(spark, f"{work}/rows"), lookback_s)
    readings = good(rows)
    alarms = staged(all_alarms(readings, config, window_s, slice_s), f"{work}/alarms")
    messages = staged(alarm_messages(alarms, groups, window_s), f"{work}/messages")
    diagnostics = bad(rows).unionByName(config_diagnostics(readings, config))

    at_once(
        spark,
        lambda: write_readings(readings, experiment, f"{out}/readings", number),
        lambda: write_alarms(alarms, f"{out}/alarms", number),
        lambda: write_alarm_history(messages, f"{out}/history", number),
        lambda: write_diagnostics(diagnostics, f"{out}/diagnostics", number),
    )
    commit_run(spark, out, run_id, number)
    return {"readings": readings, "alarms": alarms, "messages": messages,
            "diagnostics": diagnostics}
