"""From raw records to numeric readings.

Records are read once. Each becomes one row with a tag that says what it is, and these rows are
written by tag: plain readings with their number, formulas, and broken records. Only formulas need
more: they are read back, evaluated over the plain readings, and the results are written beside
them. Readings and diagnostics are parts of that one table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from bandwatch.operators.combined import evaluated_formulas, formula_problem
from bandwatch.operators.latest import LOOKBACK_S
from bandwatch.operators.numeric import UNREADABLE, parsed_number
from bandwatch.plans.staging import Parts, work_folder
from bandwatch.schemas import LEVEL_DATA
from bandwatch.sources.records import record_problem, split_records

PLAIN, FORMULA, BROKEN, COMPUTED = "plain", "formula", "broken", "computed"
_COLUMNS = ["channel", "ts", "host", "reading_name", "value", "seq"]


def routed(raw: DataFrame, experiment: str, combined: DataFrame) -> DataFrame:
    """Every record as one row: its fields, a `tag`, the number of a plain reading in `value`, or
    else a `msg` of what is wrong with it; `raw_value` where it is a formula."""
    # A name listed twice must not double its records.
    virtual = combined.select("reading_name").distinct().withColumn("_virtual", F.lit(True))
    rows = split_records(raw, experiment).join(virtual, "reading_name", "left")
    tag = F.when(~F.col("whole"), BROKEN).when(F.col("_virtual"), FORMULA).otherwise(PLAIN)
    is_plain = F.col("tag") == PLAIN
    numbers = rows.withColumn("tag", tag).withColumn(
        "value", F.when(is_plain, parsed_number(F.col("raw_value"))))
    unreadable = F.format_string(UNREADABLE, "raw_value", "reading_name")
    return numbers.select(
        *_COLUMNS, F.when(F.col("tag") == FORMULA, F.col("raw_value")).alias("raw_value"),
        F.when(is_plain & F.col("value").isNull(), unreadable)
        .when(F.col("tag") == BROKEN, record_problem()).alias("msg"),
        F.when(is_plain, "to_numeric").when(F.col("tag") == BROKEN, "decode_records")
        .alias("operator"),
        "tag",
    )


def computed(
    formulas: DataFrame, plain: DataFrame, lookback_s: float = LOOKBACK_S,
    names: DataFrame | None = None,
) -> DataFrame:
    """Formula rows with their number in `value`, or else a `msg`; columns as of `routed`."""
    rows = evaluated_formulas(formulas, plain, lookback_s, names)
    return rows.select(
        *_COLUMNS, F.lit(None).cast("string").alias("raw_value"),
        F.when(F.col("value").isNull(), formula_problem()).alias("msg"),
        F.lit("combined_readings").alias("operator"),
    )


def write_rows(
    raw: DataFrame, experiment: str, combined: DataFrame, parts: Parts,
    lookback_s: float = LOOKBACK_S,
    earlier: Callable[[], tuple[DataFrame | None, DataFrame | None]] | None = None,
) -> DataFrame:
    """Write all rows of some records to `parts`, read from the source once; what was written.

    `earlier()` is asked only if there are formulas: plain rows that they may look back to besides
    these, or None, and the names (reading_name, host) of all rows so far, or None.
    """
    schema = parts.write(routed(raw, experiment, combined))
    if parts.holds(FORMULA):
        plain = parts.read(schema, PLAIN)
        history, names = earlier() if earlier else (None, None)
        visible = plain if history is None else plain.unionByName(history, allowMissingColumns=True)
        parts.add(COMPUTED, computed(parts.read(schema, FORMULA), visible, lookback_s, names))
    return parts.read(schema, PLAIN, BROKEN, COMPUTED)


def good(rows: DataFrame) -> DataFrame:
    """The numeric readings."""
    return rows.where(F.col("msg").isNull()).select(*_COLUMNS)


def bad(rows: DataFrame) -> DataFrame:
    """Diagnostics of the rows without a number."""
    return rows.where(F.col("msg").isNotNull()).select(
        "msg", F.lit(LEVEL_DATA).alias("level"), "operator"
    )


def prepare_readings(
    raw: DataFrame, experiment: str, combined: DataFrame, lookback_s: float = LOOKBACK_S
) -> tuple[DataFrame, DataFrame]:
    """(numeric and combined readings, diagnostics). Writes the rows to the work folder."""
    parts = Parts(raw.sparkSession, work_folder(raw.sparkSession, "rows"))
    rows = write_rows(raw, experiment, combined, parts, lookback_s)
    return good(rows), bad(rows)
