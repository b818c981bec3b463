"""Column functions on threshold bands and alarm levels."""

from pyspark.sql import Column, functions as F

_PAIR = "array<double>"
_PAIRS = "array<array<double>>"


def normalise_levels(levels: Column) -> Column:
    """Levels as a list of pairs, from the JSON text of one pair or of a list of pairs."""
    return F.when(levels.rlike(r"^\s*\[\s*\["), F.from_json(levels, _PAIRS)).otherwise(
        F.array(F.from_json(levels, _PAIR))
    )


def normalise_durations(durations: Column) -> Column:
    """Durations as a list, from the JSON text of a number or of a list of numbers."""
    return F.when(durations.rlike(r"^\s*\["), F.from_json(durations, _PAIR)).otherwise(
        F.array(durations.try_cast("double"))
    )


def bands(levels: Column, setpoint: Column | float = 0.0) -> Column:
    """Absolute (lo, hi) band of each level; `levels` are offsets from the setpoint."""
    base = setpoint if isinstance(setpoint, Column) else F.lit(float(setpoint))
    return F.transform(
        levels,
        lambda pair: F.struct(
            (base + F.get(pair, F.lit(0))).alias("lo"), (base + F.get(pair, F.lit(1))).alias("hi")
        ),
    )


def out_of_band(value: Column, lo: Column, hi: Column) -> Column:
    """Strictly outside [lo, hi]. NaN is not outside (Spark alone would order it above `hi`)."""
    return ~F.isnan(value) & ((value < lo) | (value > hi))


def in_band(value: Column, lo: Column, hi: Column) -> Column:
    """Inside the closed band [lo, hi]; NaN is not inside."""
    return ~F.isnan(value) & (value >= lo) & (value <= hi)
