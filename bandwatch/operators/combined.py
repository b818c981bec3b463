"""Combined readings: virtual sensors computed by formula over the newest values of others."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bandwatch.functions.formula import evaluate
from bandwatch.operators.latest import ASKER, LOOKBACK_S, REQUEST, asked_values, formulas_of
from bandwatch.plans.staging import staged, work_folder
from bandwatch.schemas import LEVEL_DATA


def evaluated_formulas(
    requests: DataFrame, readings: DataFrame, lookback_s: float = LOOKBACK_S,
    names: DataFrame | None = None,
) -> DataFrame:
    """Formula records with their `value`, null where there is none. The host becomes ''.

    `names` (reading_name, host) are all that exist, if `readings` do not hold them all. Equal
    records (delivered again) have a value each. Hand over tables: both are read several times.
    """
    # A row per distinct text, asked for several times below.
    spark = requests.sparkSession
    formulas = staged(formulas_of(requests, readings if names is None else names),
                      work_folder(spark, "formulas"))
    found = asked_values(requests, readings, formulas, lookback_s)
    # A record bears as many entries as its own text has names, in their order; equal records as
    # many of each as there are of them.
    entries = F.collect_set(F.struct("at", "value"))
    gathered = found.groupBy(*ASKER).agg(F.count("*").alias("n"), entries.alias("entries"))
    copies = F.sequence(F.lit(1), (F.col("n") / F.size("entries")).cast("int"))
    naming = gathered.select(
        *ASKER, F.transform(F.array_sort("entries"), lambda e: e["value"]).alias("values"),
        F.explode(copies).alias("_copy"),
    ).drop("_copy")
    nameless = formulas.where(F.size("keys") == 0).select("formula")
    constant = requests.withColumn("formula", F.md5("raw_value")).join(nameless, "formula")
    constant = constant.select(*ASKER, F.array().cast("array<double>").alias("values"))
    rows = naming.unionByName(constant).join(formulas, "formula")
    value = evaluate("raw_value", "keys", "values")
    return rows.select(*REQUEST, value.alias("value")).withColumn("host", F.lit(""))


def combined_readings(
    requests: DataFrame, readings: DataFrame, lookback_s: float = LOOKBACK_S
) -> tuple[DataFrame, DataFrame]:
    """(combined readings, diagnostics of the formulas without a value)."""
    rows = evaluated_formulas(requests, readings, lookback_s)
    ok = rows.where(F.col("value").isNotNull()).select(
        "channel", "ts", "host", "reading_name", "value", "seq"
    )
    diagnostics = rows.where(F.col("value").isNull()).select(
        formula_problem().alias("msg"), F.lit(LEVEL_DATA).alias("level"),
        F.lit("combined_readings").alias("operator"),
    )
    return ok, diagnostics


def formula_problem():
    return F.format_string(
        "Can't calculate combined reading %s: %s", F.col("reading_name"), F.col("raw_value")
    )
