"""Schemas of every table the library reads or writes.

The same schemas hold for batch tables and for micro-batches of a stream.
"""

from pyspark.sql import types as T

# One record of the message bus, as the built-in Kafka source delivers it (value as text).
RAW_RECORD = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("value", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
])

# A record split into its parts; `seq` breaks ties between records of equal `ts` (epoch ms).
DECODED = T.StructType([
    T.StructField("channel", T.StringType()),
    T.StructField("ts", T.LongType()),
    T.StructField("host", T.StringType()),
    T.StructField("reading_name", T.StringType()),
    T.StructField("raw_value", T.StringType()),
    T.StructField("seq", T.LongType()),
])

READING = T.StructType([
    T.StructField("channel", T.StringType()),
    T.StructField("ts", T.LongType()),
    T.StructField("host", T.StringType()),
    T.StructField("reading_name", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("seq", T.LongType()),
])

# A record after it has been read: a number, or a text of what is wrong, or a formula.
ROW = T.StructType([
    *READING,
    T.StructField("raw_value", T.StringType()),
    T.StructField("msg", T.StringType()),
    T.StructField("operator", T.StringType()),
])

# `levels` is a pair or a list of pairs and `max_duration` a number or a list; declared as
# text, the JSON reader hands both over unparsed and `functions.bands` settles the shape.
ALARM_RULE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("enabled", T.StringType()),
    T.StructField("setpoint", T.DoubleType()),
    T.StructField("levels", T.StringType()),
    T.StructField("recurrence", T.DoubleType()),
    T.StructField("a", T.DoubleType()),
    T.StructField("b", T.DoubleType()),
    T.StructField("c", T.DoubleType()),
    T.StructField("dt_int", T.DoubleType()),
    T.StructField("dt_diff", T.DoubleType()),
    T.StructField("lower_threshold", T.DoubleType()),
    T.StructField("upper_threshold", T.DoubleType()),
    T.StructField("max_duration", T.StringType()),
])

READINGS_CONFIG = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("host", T.StringType()),
    T.StructField("runmode", T.StringType()),
    T.StructField("alarms", T.ArrayType(ALARM_RULE)),
    T.StructField("doc_order", T.LongType()),
])

SENSOR_DOC = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("readings", T.MapType(T.StringType(), T.StringType())),
])

ALARM_GROUP_DOC = T.StructType([
    T.StructField("group_id", T.StringType()),
    T.StructField("names", T.ArrayType(T.StringType())),
    T.StructField("operation", T.StringType()),
    T.StructField("time_window", T.DoubleType()),
])

ALARM = T.StructType([
    T.StructField("channel", T.StringType()),
    T.StructField("ts", T.LongType()),
    T.StructField("host", T.StringType()),
    T.StructField("reading_name", T.StringType()),
    T.StructField("alarm_type", T.StringType()),
    T.StructField("severity", T.DoubleType()),
    T.StructField("params", T.ArrayType(T.DoubleType())),
    T.StructField("rule_id", T.IntegerType()),
    T.StructField("seq", T.LongType()),
])

MESSAGE = T.StructType([
    T.StructField("ts", T.LongType()),
    T.StructField("severity", T.DoubleType()),
    T.StructField("msg", T.StringType()),
    T.StructField("source", T.StringType()),
])

POINT = T.StructType([
    T.StructField("database", T.StringType()),
    T.StructField("measurement", T.StringType()),
    T.StructField("host", T.StringType()),
    T.StructField("reading_name", T.StringType()),
    T.StructField("ts", T.LongType()),
    T.StructField("value", T.DoubleType()),
])

HISTORY = T.StructType([
    T.StructField("when", T.TimestampType()),
    T.StructField("howbad", T.DoubleType()),
    T.StructField("msg", T.StringType()),
])

DIAGNOSTIC = T.StructType([
    T.StructField("msg", T.StringType()),
    T.StructField("level", T.IntegerType()),
    T.StructField("operator", T.StringType()),
])

# Severity of a diagnostics row: trouble with the configuration, trouble with the data.
LEVEL_CONFIG = 10
LEVEL_DATA = 20
