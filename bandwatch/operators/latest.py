"""As-of lookup: the newest value of a series at or before a time, within a look-back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bandwatch.functions.names import names_in_texts
from bandwatch.operators.slices import floor_to, millis, slice_millis, with_halo

LOOKBACK_S = 60

REQUEST = ["channel", "ts", "host", "reading_name", "raw_value", "seq"]
# What tells requests of one formula apart; the text itself stays out of the sorted rows.
ASKER = ["channel", "ts", "host", "reading_name", "seq", "formula"]


def name_key() -> Column:
    """`reading[,host]` of a row, as formulas write it."""
    return F.concat_ws(",", "reading_name", F.nullif("host", F.lit("")))


def formulas_of(requests: DataFrame, names: DataFrame) -> DataFrame:
    """Per distinct text of the formula records (`raw_value`, and its digest `formula`): the `keys`
    in it, that is, the names among `names` (reading_name, host) that stand there."""
    found = names_in_texts(requests, names.select(name_key().alias("key")))
    return found.withColumn("formula", F.md5("raw_value"))


def asked_values(
    requests: DataFrame, readings: DataFrame, formulas: DataFrame, lookback_s: float = LOOKBACK_S,
) -> DataFrame:
    """Per formula record and key in its text: the newest `value` in (ts - lookback, ts], or null,
    and the key's place `at` among the keys of its formula (see `formulas_of`).

    `readings` are plain readings; one whose `value` is null (text that is no number) hides
    older values of its series, as any newer record does. Records and readings are merged by
    key and time slice and sorted once; there is no pairing of the two.
    """
    lookback_ms = millis(lookback_s)
    slice_ms = slice_millis(lookback_s, None)
    asked = requests.withColumn("formula", F.md5("raw_value")).join(
        formulas.select("formula", F.posexplode("keys").alias("at", "key")), "formula"
    ).withColumn("slice", floor_to(F.col("ts"), F.lit(slice_ms).cast("bigint")))
    # Only series some formula names are worth a shuffle.
    keys = formulas.select(F.explode("keys").alias("key")).distinct()
    points = readings.select(name_key().alias("key"), "ts", "seq", "value")
    named = points.join(keys, "key", "left_semi")
    merged = asked.select(
        "key", "slice", "ts", "seq", F.lit(1).alias("_asks"),
        F.struct(*ASKER, "at").alias("request"),
    ).unionByName(
        with_halo(named, slice_ms, lookback_ms - 1).select(
            "key", "slice", "ts", "seq", F.lit(0).alias("_asks"),
            F.struct("ts", "value").alias("point"),
        ),
        allowMissingColumns=True,
    )
    so_far = (
        Window.partitionBy("key", "slice").orderBy("ts", "_asks", "seq")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    in_time = F.col("newest.ts") > F.col("ts") - F.lit(lookback_ms)
    return (
        merged.withColumn("newest", F.last("point", True).over(so_far))
        .where(F.col("_asks") == 1)
        .select("request.*", "key", F.when(in_time, F.col("newest.value")).alias("value"))
    )


def latest_values(
    requests: DataFrame, readings: DataFrame, lookback_s: float = LOOKBACK_S
) -> DataFrame:
    """Per formula record and key that has one: the newest value in (ts - lookback, ts]."""
    formulas = formulas_of(requests, readings)
    found = asked_values(requests, readings, formulas, lookback_s).where(F.col("value").isNotNull())
    texts = formulas.select("formula", "raw_value")
    return found.join(texts, "formula").select(*REQUEST, "key", "value")
