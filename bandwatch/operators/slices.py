"""Bounded look-backs over series of any length and density.

Two devices keep every look-back linear in the rows and free of single-task series:

* *Slices with a halo.* No look-back reaches further than a fixed span, so a series can be cut
  into time slices. A row goes to its own slice and, if later rows of the next slice may look
  back to it, to that one too. One series thus spreads over as many tasks as it has slices, and
  the slice is part of the one shuffle key.

* *Tiles.* Inside a slice, a frame [ts - width, ts] is the tail of one tile of that width plus
  the head of the next. Both parts are running aggregates (one sorted from the new end, one from
  the old), so no frame is ever rescanned, nothing is subtracted, and `width` may differ from
  row to row: each rule brings its own. Window frames with literal bounds would need one plan
  per distinct width and work that grows with rows x frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SERIES = ["host", "reading_name", "rule_id"]
SLICED = [*SERIES, "slice"]

# Slice length in look-back spans: the halo then adds one row in six to the shuffle.
SLICE_SPANS = 6
# Rows a task should get: the checks sort them several times over, at some 2 KB a row in all.
ROWS_PER_TASK = 20_000


def millis(seconds: float) -> int:
    return int(seconds * 1000)


def slice_millis(window_s: float, slice_s: float | None) -> int:
    """Slice length; a slice shorter than the look-back would copy rows more than once."""
    window_ms = millis(window_s)
    return max(window_ms, millis(slice_s) if slice_s else SLICE_SPANS * window_ms)


def floor_to(ts: Column, step: Column) -> Column:
    """Largest multiple of `step` not above `ts` (integers; also for negative `ts`)."""
    return ts - F.pmod(ts, step)


def with_halo(df: DataFrame, slice_ms: int, reach_ms: int) -> DataFrame:
    """Copy each row to every slice with rows up to `reach_ms` later; `slice` is its start."""
    step = F.lit(slice_ms).cast("bigint")
    ts = F.col("ts")
    starts = F.sequence(floor_to(ts, step), floor_to(ts + F.lit(reach_ms), step), step)
    return df.withColumn("slice", F.explode(starts))


def dealt(df: DataFrame, n_rows: int, keys: list[str] = SLICED) -> DataFrame:
    """Rows of a slice together, in tasks of about `ROWS_PER_TASK` of `n_rows` rows, a slice at least.

    Told by their number: sizes of shuffled bytes say little of what the sorts of a check hold, so
    partitions must not be merged by them. By range, since hashes put several full slices in one task.
    """
    return df.repartitionByRange(max(1, -(-n_rows // ROWS_PER_TASK)), *keys)


def not_before_own(margin_ms: int = 0) -> Column:
    """At or after the slice's start, less a margin: without margin, no halo copy."""
    return F.col("ts") >= F.col("slice") - F.lit(margin_ms)


def arrival_order(keys: list[str] = SLICED):
    """Rows of a series slice in order of time, then arrival."""
    return Window.partitionBy(*keys).orderBy("ts", "seq")


def up_to_here(keys: list[str] = SLICED):
    return arrival_order(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def with_tiles(df: DataFrame, width: Column) -> DataFrame:
    """Add `_width`, the frame's reach in ms (not negative), and `tile`, where its tile starts."""
    return df.withColumn("_width", width.cast("bigint")).withColumn(
        "tile", floor_to(F.col("ts"), _tile_step())
    )


def _tile_step() -> Column:
    return F.greatest(F.col("_width"), F.lit(1).cast("bigint"))


def tile_order(keys: list[str] = SLICED):
    """Order of time and arrival that also is the order inside tiles: one sort serves both."""
    return Window.partitionBy(*keys).orderBy("tile", "ts", "seq")


def frame_aggregates(
    df: DataFrame,
    sums: dict[str, Column],
    firsts: dict[str, Column],
    keys: list[str] = SLICED,
) -> DataFrame:
    """Aggregates over each row's frame [ts - width, ts] of its series slice.

    `df` comes from `with_tiles`. Adds one column per entry of `sums`, the sum over the frame
    **without** the current row (0 if there is no other), and one per entry of `firsts`, its
    value at the frame's oldest row. `sums` may use `tile`: a time common to all rows of one
    frame and at most a width away from each.
    """
    in_tile = Window.partitionBy(*keys, "tile").orderBy("ts", "seq")
    before = in_tile.rowsBetween(Window.unboundedPreceding, -1)
    so_far = in_tile.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heads = df.withColumns(
        {f"_m_{n}": measure for n, measure in sums.items()}
        | {f"_f_{n}": value for n, value in firsts.items()}
    ).withColumns(
        {f"_head_{n}": F.sum(f"_m_{n}").over(before) for n in sums}
        | {f"_head_{n}": F.first(f"_f_{n}", True).over(so_far) for n in firsts}
    ).drop(*(f"_m_{n}" for n in sums))

    # A row counts twice: as itself, and in the tail of the tile it lies in, for rows of the next
    # tile until `width` after its own time. The second copy carries nothing but its measures.
    row = F.struct(F.lit(0).alias("_tail"), F.col("tile"), F.col("ts").alias("_at"))
    copy = F.struct(
        F.lit(1).alias("_tail"), (F.col("tile") + _tile_step()).alias("tile"),
        (F.col("ts") + F.col("_width")).alias("_at"),
    )
    rest = [c for c in heads.columns if c not in (*keys, "tile") and not c.startswith("_f_")]
    is_tail = F.col("_tail") == 1
    parts = heads.withColumn("_part", F.explode(F.array(row, copy))).select(
        *keys, *(c for c in heads.columns if c not in (*keys, "tile")), "_part.*"
    ).select(
        *keys, "tile", "_at", "_tail", F.col("seq").alias("_seq"),
        *(F.when(is_tail, measure).alias(f"_m_{n}") for n, measure in sums.items()),
        *(F.when(is_tail, F.col(f"_f_{n}")).alias(f"_f_{n}") for n in firsts),
        F.when(~is_tail, F.struct(*rest)).alias("_row"),
    )
    from_new_end = Window.partitionBy(*keys, "tile").orderBy(
        F.desc("_at"), F.desc("_tail"), F.desc("_seq")
    ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = parts.withColumns(
        {f"_tail_{n}": F.sum(f"_m_{n}").over(from_new_end) for n in sums}
        | {f"_tail_{n}": F.last(f"_f_{n}", True).over(from_new_end) for n in firsts}
    ).where(~is_tail)

    def total(name: str) -> Column:
        zero = F.lit(0)
        return (F.coalesce(f"_tail_{name}", zero) + F.coalesce(f"_row._head_{name}", zero))

    own = [c for c in df.columns if c not in ("tile", "_width")]
    return met.select(
        *(c if c in keys else F.col(f"_row.{c}").alias(c) for c in own), "tile",
        *(total(n).alias(n) for n in sums),
        *(F.coalesce(f"_tail_{n}", f"_row._head_{n}").alias(n) for n in firsts),
    )
