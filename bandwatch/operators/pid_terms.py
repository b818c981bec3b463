"""The three terms of a PID combination, per reading and rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bandwatch.operators.slices import frame_aggregates, tile_order, with_tiles

HALF_BITS = 30
# Where rows x look-back stay below it, so does the square in a long.
SAFE_SPAN = (1 << 31) - 1


def proportional_term(df: DataFrame) -> DataFrame:
    """Add `p_term` = a * (value - setpoint)."""
    return df.withColumn("p_term", F.col("a") * (F.col("value") - F.col("setpoint")))


def frame_width(seconds: Column, window_ms: int) -> Column:
    """Look-back in whole ms, at most what the window holds."""
    whole = F.floor(seconds * 1000).cast("bigint")
    return F.least(F.greatest(whole, F.lit(0)), F.lit(window_ms - 1)).cast("bigint")


def integral_term(df: DataFrame, window_ms: int) -> DataFrame:
    """Add `integral` of (value - setpoint) over the last `dt_int` seconds.

    The first value in the frame is held back to the frame's start, trapezoids follow. Each
    trapezoid belongs to its older end, so the sum over a frame without its newest row never
    touches a value outside the frame.
    """
    ordered = tile_order()
    y = F.col("value") - F.col("setpoint")
    step_s = (F.lead("ts").over(ordered) - F.col("ts")) / 1000
    rows = with_tiles(df, frame_width(F.col("dt_int"), window_ms)).withColumn("_y", y)
    rows = rows.withColumn("_area", 0.5 * step_s * (F.col("_y") + F.lead("_y").over(ordered)))
    framed = frame_aggregates(
        rows, {"_areas": F.col("_area")}, {"_first_ts": F.col("ts"), "_first_y": F.col("_y")}
    )
    start = F.col("ts") - F.col("dt_int") * 1000
    held = (F.col("_first_ts") - start) / 1000 * F.col("_first_y")
    return framed.withColumn("integral", held + F.col("_areas")).select(*df.columns, "integral")


def slope_term(df: DataFrame, window_ms: int, include_latest: bool = False) -> DataFrame:
    """Add `slope`: least-squares slope per second of the value over the last `dt_diff` seconds.

    The newest row does not take part unless asked for. Without two distinct times the slope
    is 0. Times are whole ms since the frame's tile, and what is summed of times alone stays
    whole: squares in two halves, so that no sum of a frame leaves the range of a long. Only
    frames with very many rows need decimals for their products.
    """
    t = F.col("ts") - F.col("tile")
    square = t * t
    measures = {
        "_n": F.lit(1).cast("bigint"), "_t": t,
        "_high": F.shiftright(square, HALF_BITS), "_low": square.bitwiseAND((1 << HALF_BITS) - 1),
        "_y": F.col("value"), "_ty": t.cast("double") * F.col("value"),
    }
    tiled = with_tiles(df, frame_width(F.col("dt_diff"), window_ms))
    framed = frame_aggregates(tiled, measures, {"_first_ts": F.col("ts")})
    if include_latest:
        framed = framed.withColumns({n: F.col(n) + now for n, now in measures.items()})
    shift = F.col("_first_ts") - F.col("tile")
    n, y = F.col("_n"), F.col("_y")
    whole = lambda c: c.cast("decimal(27,0)")  # noqa: E731  its products fit into 38 digits
    squares = whole(F.col("_high")) * (1 << HALF_BITS) + F.col("_low")
    # n * sum of squares - square of the sum: the same from any origin, and exact
    large = (n.cast("decimal(10,0)") * squares.cast("decimal(27,0)")
             - F.col("_t").cast("decimal(19,0)") * F.col("_t").cast("decimal(19,0)"))
    small = n * (F.shiftleft(F.col("_high"), HALF_BITS) + F.col("_low")) - F.col("_t") * F.col("_t")
    framed = framed.withColumns({
        "_from_first": F.col("_t") - n * shift,
        "_under": F.when(n <= SAFE_SPAN // window_ms, small.cast("double"))
        .otherwise(large.cast("double")),
    })
    over = n * (F.col("_ty") - shift * y) - y * F.col("_from_first")
    # The sum of the times since the first is 0 only if all times are equal.
    spread = (F.col("_from_first") > 0) & (F.col("_under") != 0)
    return framed.withColumn(
        "slope",
        F.when(spread, 1000 * F.try_divide(over, F.col("_under"))).otherwise(0.0),
    ).select(*df.columns, "slope")


def pid_value(df: DataFrame, window_ms: int) -> DataFrame:
    """Add `integral`, `slope` and their combination `pid`.

    A negative look-back holds not even the current row; such rows take no further part.
    """
    rows = df.where(F.coalesce(F.col("dt_int") >= 0, F.lit(True)))
    termed = slope_term(integral_term(proportional_term(rows), window_ms), window_ms)
    pid = F.col("p_term") + F.col("b") * F.col("integral") + F.col("c") * F.col("slope")
    return termed.withColumn("pid", pid).drop("p_term")
