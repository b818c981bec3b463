"""How long a series has been out of band, and which duration levels that breaks."""

from pyspark.sql import DataFrame, Window, functions as F

from bandwatch.functions.bands import in_band
from bandwatch.operators.slices import frame_aggregates, tile_order, with_tiles


def time_since(df: DataFrame, window_ms: int) -> DataFrame:
    """Add `time_since`: seconds since the newest row in band within the window.

    Without such a row, seconds since the oldest row of the window.
    """
    inside = in_band(F.col("value"), F.col("lower"), F.col("upper"))
    so_far = tile_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = with_tiles(df, F.lit(window_ms - 1)).withColumn(
        "_last_in", F.max(F.when(inside, F.col("ts"))).over(so_far)
    )
    framed = frame_aggregates(rows, {}, {"_first_ts": F.col("ts")})
    recent = F.col("_last_in") > F.col("ts") - F.lit(window_ms)
    since = F.when(recent, F.col("_last_in")).otherwise(F.col("_first_ts"))
    return framed.withColumn("time_since", (F.col("ts") - since) / 1000).select(
        *df.columns, "time_since"
    )


def check_time_since(df: DataFrame) -> DataFrame:
    """Add `severity`: how many of the rule's durations are exceeded, less one."""
    exceeded = F.filter("max_duration", lambda limit: F.col("time_since") > limit)
    return df.withColumn("severity", F.coalesce(F.size(exceeded), F.lit(0)) - F.lit(1.0))


def time_since_params():
    limit = F.get("max_duration", F.col("severity").cast("int"))
    return F.array("time_since", "lower", "upper", limit)
