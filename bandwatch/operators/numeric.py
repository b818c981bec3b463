"""From decoded text to numbers."""

from pyspark.sql import Column, DataFrame, functions as F

from bandwatch.schemas import LEVEL_DATA

# The texts a double parser takes (blanks around, sign, decimal or hexadecimal
# digits with exponent, type suffix, the two special words in this spelling only). Testing first
# keeps the cast from raising and catching an error per bad row, and from taking more words.
NUMBER = (
    r"^[\x00-\x20]*[+-]?(NaN|Infinity|("
    r"([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
    r"|0[xX]([0-9a-fA-F]+\.?|[0-9a-fA-F]*\.[0-9a-fA-F]+)[pP][+-]?[0-9]+"
    r")[fFdD]?)[\x00-\x20]*$"
)
# Fixed value: the text reported for a value that is no number.
UNREADABLE = "Can't convert input '%s' of %s into a floating point number."


def parsed_number(text: Column) -> Column:
    """Text as double, null where it is no number."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def parsed_readings(decoded: DataFrame) -> DataFrame:
    """Decoded rows with `value`, null where the text is no number (and `raw_value` kept)."""
    return decoded.withColumn("value", parsed_number(F.col("raw_value")))


def to_numeric(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(numeric readings, diagnostics of the rows whose text is no number)."""
    parsed = parsed_readings(decoded)
    ok = parsed.where(F.col("value").isNotNull()).select(
        "channel", "ts", "host", "reading_name", "value", "seq"
    )
    diagnostics = parsed.where(F.col("value").isNull()).select(
        F.format_string(UNREADABLE, "raw_value", "reading_name").alias("msg"),
        F.lit(LEVEL_DATA).alias("level"),
        F.lit("to_numeric").alias("operator"),
    )
    return ok, diagnostics


def split_combined(decoded: DataFrame, combined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plain rows, formula rows): a row is a formula if its name is a combined reading's."""
    return (
        decoded.join(combined, "reading_name", "left_anti").select(decoded.columns),
        decoded.join(combined, "reading_name", "left_semi").select(decoded.columns),
    )
