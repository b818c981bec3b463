"""The check shared by simple and PID rules: a trailing run of values out of band, per level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from bandwatch.functions.bands import out_of_band
from bandwatch.operators.slices import SERIES, SLICED, arrival_order, up_to_here

ALARM_KEYS = ["channel", "ts", "host", "reading_name"]


def level_is_out(measure: Column, level: int) -> Column:
    """The measure is out of the band of a level; false where the rule has no such level."""
    band = F.get("bands", F.lit(level))
    return F.coalesce(
        out_of_band(measure, band.getField("lo"), band.getField("hi")), F.lit(False)
    )


def _last_in_band(df: DataFrame, measure: str, n_levels: int) -> DataFrame:
    """Add `_nth`, the row's place in its slice, and for each level j `out_<j>` and, of the last row
    in band so far, the place `_in_nth_<j>` and the time `_in_ts_<j>`."""
    so_far = up_to_here()
    value = F.col(measure)
    levels = range(n_levels)
    rows = df.withColumns(
        {f"out_{j}": level_is_out(value, j) for j in levels}
        | {"_nth": F.row_number().over(arrival_order())}
    )
    return rows.withColumns(
        {f"_in_nth_{j}": F.max(F.when(~F.col(f"out_{j}"), F.col("_nth"))).over(so_far)
         for j in levels}
        | {f"_in_ts_{j}": F.max(F.when(~F.col(f"out_{j}"), F.col("ts"))).over(so_far)
           for j in levels}
    )


def _runs(last_in: DataFrame, window_ms: int, n_levels: int) -> DataFrame:
    levels = range(n_levels)
    return last_in.withColumns(
        {f"run_{j}": F.col("_nth") - F.coalesce(f"_in_nth_{j}", F.lit(0)) for j in levels}
        | {f"all_out_{j}": F.coalesce(F.col(f"_in_ts_{j}") <= F.col("ts") - F.lit(window_ms),
                                      F.lit(True)) for j in levels}
    ).drop("_nth", *(f"_in_nth_{j}" for j in levels), *(f"_in_ts_{j}" for j in levels))


def trailing_runs(df: DataFrame, measure: str, window_ms: int, n_levels: int) -> DataFrame:
    """Add `out_<j>`, `run_<j>` and `all_out_<j>` for each level j.

    `run` counts the rows out of band from the newest back to the last one in band, as far as
    the slice goes; `all_out` says that the window holds no row in band. All levels share one
    sort, as columns: rules with fewer levels have false in the rest.
    """
    return _runs(_last_in_band(df, measure, n_levels), window_ms, n_levels)


def scanned_runs(df: DataFrame, measure: str, window_ms: int, n_levels: int) -> DataFrame:
    """The same from slices of any length without a halo; `run` goes back to the series' begin.

    A slice is summed up by its number of rows and its last row in band, per level. Such summaries
    combine: a scan over those of a series, in order of time, gives what lies before each slice.
    Only summaries of a series meet in one task, rows of a slice at most.
    """
    levels = range(n_levels)
    last_in = _last_in_band(df, measure, n_levels)
    summaries = last_in.groupBy(*SLICED).agg(
        F.max("_nth").alias("_rows"),
        *(F.max(f"_in_{what}_{j}").alias(f"_in_{what}_{j}") for what in ("nth", "ts") for j in levels),
    )
    before = Window.partitionBy(*SERIES).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    numbered = summaries.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    carried = numbered.select(
        *SLICED, "_offset",
        *(F.max(F.col("_offset") + F.col(f"_in_nth_{j}")).over(before).alias(f"_old_nth_{j}")
          for j in levels),
        *(F.max(f"_in_ts_{j}").over(before).alias(f"_old_ts_{j}") for j in levels),
    )
    joined = last_in.join(carried, SLICED)
    whole = joined.withColumns(
        {f"_in_nth_{j}": F.coalesce(F.col("_offset") + F.col(f"_in_nth_{j}"), F.col(f"_old_nth_{j}"))
         for j in levels}
        | {f"_in_ts_{j}": F.coalesce(f"_in_ts_{j}", f"_old_ts_{j}") for j in levels}
        | {"_nth": F.col("_offset") + F.col("_nth")}
    ).drop("_offset", *(f"_old_{what}_{j}" for what in ("nth", "ts") for j in levels))
    return _runs(whole, window_ms, n_levels)


def level_fires(level: int) -> Column:
    """Out of band, and either `recurrence` times in a row or throughout the window.

    The second half makes up for a run cut short by the start of window or slice: if the cut
    run falls short of `recurrence`, the window holds no row in band.
    """
    enough = F.coalesce(F.col(f"run_{level}") >= F.col("recurrence"), F.lit(False))
    return F.col(f"out_{level}") & (enough | F.col(f"all_out_{level}"))


def severity(fired: list[Column]) -> Column:
    """Number of firing levels, less one."""
    return reduce(lambda n, f: n + f.cast("double"), fired, F.lit(-1.0))


def check_band(
    df: DataFrame, measure: str, window_ms: int, n_levels: int, runs=trailing_runs
) -> DataFrame:
    """Add `severity`: how many levels the series breaks at each row, less one."""
    checked = runs(df, measure, window_ms, n_levels)
    checked = checked.withColumn("severity", severity([level_fires(j) for j in range(n_levels)]))
    return checked.select(*df.columns, "severity")


def to_alarm(df: DataFrame, alarm_type: str, params: Column) -> DataFrame:
    """Alarm rows of those that reached a level."""
    return df.where(F.col("severity") > -1).select(
        *ALARM_KEYS, F.lit(alarm_type).alias("alarm_type"), "severity", params.alias("params"),
        "rule_id", "seq",
    )


def band_params(measure: str) -> Column:
    """The measure and the band at the severity's place in the list of levels."""
    band = F.get("bands", F.col("severity").cast("int"))
    return F.array(F.col(measure), band.getField("lo"), band.getField("hi"))
