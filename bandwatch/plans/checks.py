"""The three alarm pipelines: readings and config in, alarms out.

Each costs one shuffle of the readings that have such a rule, on (series, rule, slice); all three
together share one, on (series, slice), which the later steps need not repeat. Readings are counted
first, so that the number of tasks grows with them. If the readings have a boolean column `is_new`, rows without it set only serve as history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from bandwatch.operators.band_check import band_params, check_band, scanned_runs, to_alarm
from bandwatch.operators.pid_terms import pid_value
from bandwatch.operators.rules import ALARM_TYPE, active_rules, max_levels
from bandwatch.operators.slices import (
    SERIES, dealt, millis, not_before_own, slice_millis, with_halo,
)
from bandwatch.operators.time_since import check_time_since, time_since, time_since_params

WINDOW_S = 600
READING_KEYS = ["reading_name", "host"]


def sliced_rows(
    readings: DataFrame, rules: DataFrame, window_ms: int, slice_ms: int, look_backs: int = 1
) -> DataFrame:
    """Readings with their rules, cut into slices that hold all rows `look_backs` deep.

    They are shuffled once by (series, rule, slice); all windows partition by that or more, so
    they only sort in place. Readings that have a column `slice` are cut already, maybe with a deeper halo than this check looks back.
    """
    reach_ms = look_backs * (window_ms - 1)
    if "slice" in readings.columns:
        return readings.where(not_before_own(reach_ms)).join(rules, READING_KEYS)
    return dealt(with_halo(readings.join(rules, READING_KEYS), slice_ms, reach_ms), readings.count())


def shared_slices(readings: DataFrame, rules: list[DataFrame], window_ms: int, slice_ms: int
                  ) -> DataFrame:
    """Readings that have any rule, cut with the deepest halo of all checks and shuffled once."""
    keys = rules[0].select(*READING_KEYS)
    for more in rules[1:]:
        keys = keys.unionByName(more.select(*READING_KEYS))
    ruled = readings.join(keys.distinct(), READING_KEYS, "left_semi").select(*readings.columns)
    return dealt(with_halo(ruled, slice_ms, 2 * (window_ms - 1)), readings.count(), [*READING_KEYS, "slice"])


def own_rows(checked: DataFrame) -> DataFrame:
    """Without halo copies and, where a column `is_new` tells, without rows of the past."""
    rows = checked.where(not_before_own())
    return rows.where("is_new") if "is_new" in checked.columns else rows


def simple_checked(
    readings: DataFrame, config: DataFrame, window_s: float = WINDOW_S,
    slice_s: float | None = None,
) -> DataFrame:
    """Every reading with a simple rule, and its `severity` (-1 for none).

    With slices shorter than the window, rows are not copied from slice to slice: what lies before
    a slice comes as a summary. For series so dense that a window of them is too much for a task.
    """
    rules = active_rules(config, "simple")
    window_ms, slice_ms = millis(window_s), slice_millis(window_s, slice_s)
    if slice_s and millis(slice_s) < window_ms and "slice" not in readings.columns:
        rows = with_halo(readings.join(rules, READING_KEYS), millis(slice_s), 0)
        return own_rows(check_band(rows, "value", window_ms, max_levels(rules), scanned_runs))
    rows = sliced_rows(readings, rules, window_ms, slice_ms)
    checked = check_band(rows, "value", window_ms, max_levels(rules))
    return own_rows(checked)


def simple_alarms(
    readings: DataFrame, config: DataFrame, window_s: float = WINDOW_S,
    slice_s: float | None = None,
) -> DataFrame:
    """Alarms of values out of band `recurrence` times in a row, or throughout the window."""
    checked = simple_checked(readings, config, window_s, slice_s)
    return to_alarm(checked, ALARM_TYPE["simple"], band_params("value"))


def pid_values(
    readings: DataFrame, config: DataFrame, window_s: float = WINDOW_S,
    slice_s: float | None = None,
) -> DataFrame:
    """Every reading with a PID rule, with its `integral`, `slope` and `pid`."""
    rules = active_rules(config, "pid")
    window_ms, slice_ms = millis(window_s), slice_millis(window_s, slice_s)
    rows = sliced_rows(readings, rules, window_ms, slice_ms)
    return own_rows(pid_value(rows, window_ms))


def pid_checked(
    readings: DataFrame, config: DataFrame, window_s: float = WINDOW_S,
    slice_s: float | None = None,
) -> DataFrame:
    """Every reading with a PID rule, its `pid`, and the `severity` of the history of pids.

    The history reaches one window back, and each pid in it another; the halo holds both, so
    that one shuffle serves the two passes. What only the check needs of a rule joins after the
    terms, to keep the rows slim while they are sorted.
    """
    rules = active_rules(config, "pid")
    window_ms, slice_ms = millis(window_s), slice_millis(window_s, slice_s)
    slim = rules.drop("bands", "recurrence")
    rows = sliced_rows(readings, slim, window_ms, slice_ms, look_backs=2)
    # Values more than one window before the slice only served the pids of the halo.
    pids = pid_value(rows, window_ms).where(not_before_own(window_ms - 1))
    pids = pids.drop(*(c for c in slim.columns if c not in SERIES), "integral", "slope")
    limits = rules.select(*SERIES, "bands", "recurrence")
    checked = check_band(pids.join(limits, SERIES), "pid", window_ms, max_levels(rules))
    return own_rows(checked)


def pid_alarms(
    readings: DataFrame, config: DataFrame, window_s: float = WINDOW_S,
    slice_s: float | None = None,
) -> DataFrame:
    """Alarms of the PID combination out of its bands."""
    checked = pid_checked(readings, config, window_s, slice_s)
    return to_alarm(checked, ALARM_TYPE["pid"], band_params("pid"))


def time_since_checked(
    readings: DataFrame, config: DataFrame, window_s: float = WINDOW_S,
    slice_s: float | None = None,
) -> DataFrame:
    """Every reading with a time-since rule, its `time_since` and `severity`."""
    rules = active_rules(config, "time_since")
    window_ms, slice_ms = millis(window_s), slice_millis(window_s, slice_s)
    rows = sliced_rows(readings, rules, window_ms, slice_ms)
    return own_rows(check_time_since(time_since(rows, window_ms)))


def time_since_alarms(
    readings: DataFrame, config: DataFrame, window_s: float = WINDOW_S,
    slice_s: float | None = None,
) -> DataFrame:
    """Alarms of values out of band for longer than the rule allows."""
    checked = time_since_checked(readings, config, window_s, slice_s)
    return to_alarm(checked, ALARM_TYPE["time_since"], time_since_params())


def all_alarms(
    readings: DataFrame, config: DataFrame, window_s: float = WINDOW_S,
    slice_s: float | None = None,
) -> DataFrame:
    """The alarms of all three kinds (a bag)."""
    rules = [active_rules(config, kind) for kind in ALARM_TYPE]
    cut = shared_slices(readings, rules, millis(window_s), slice_millis(window_s, slice_s))
    kinds = [simple_alarms, pid_alarms, time_since_alarms]
    simple, pid, since = (k(cut, config, window_s, slice_s) for k in kinds)
    return simple.unionByName(pid).unionByName(since)
