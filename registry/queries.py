"""One query per operator and pipeline, over the whole `events` table."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from bandwatch.functions.bands import in_band, out_of_band
from bandwatch.operators.band_check import trailing_runs
from bandwatch.operators.combined import combined_readings as combine
from bandwatch.operators.grouping import evaluate_groups, group_members, key_of_alarm
from bandwatch.operators.grouping import ungrouped_alarms as ungrouped
from bandwatch.operators.latest import latest_values as newest_values
from bandwatch.operators.numeric import split_combined, to_numeric
from bandwatch.operators.pid_terms import proportional_term, slope_term
from bandwatch.operators.rules import (
    active_rules, attach_rules, max_levels, rule_misses as misses,
)
from bandwatch.operators.slices import millis, slice_millis
from bandwatch.plans import checks
from bandwatch.plans.batch import config_diagnostics, run_batch
from bandwatch.plans.messages import alarm_messages as messages_of, group_message, single_message
from bandwatch.plans.readings import FORMULA, PLAIN, prepare_readings as prepare, routed
from bandwatch.plans.staging import Parts, staged, work_folder
from bandwatch.sinks.tables import history_rows, read_table, storage_points as points_of
from bandwatch.sources.records import decode_records, read_raw
from bandwatch.streaming.stream import StreamJob, run_stream
from registry import data
from registry.data import EXPERIMENT, LOOKBACK_S, WINDOW_S

WINDOW_MS = millis(WINDOW_S)


def rounded(name: str, places: int = 6):
    """A double to compare; NaN and -0.0 come out as plain values."""
    return (F.round(F.col(name), places) + F.lit(0.0)).alias(name)


def param(i: int, places: int = 4):
    return (F.round(F.get("params", F.lit(i)), places) + F.lit(0.0)).alias(f"p{i}")


def flat(alarms: DataFrame) -> DataFrame:
    """Alarms with their parameters as columns."""
    return alarms.select(
        "channel", "ts", "host", "reading_name", "alarm_type", "severity",
        F.col("rule_id").cast("bigint").alias("rule_id"), "seq", *(param(i) for i in range(4)),
    )


# --- decoding ---------------------------------------------------------------------------------

def decode_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded, _ = decode_records(data.plain_records(spark, sf_dir), EXPERIMENT)
    return decoded


def decode_sysmon(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded, _ = decode_records(data.mixed_records(spark, sf_dir), EXPERIMENT)
    return decoded


def decode_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, diagnostics = decode_records(data.mixed_records(spark, sf_dir), EXPERIMENT)
    return diagnostics


def channel_and_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded, _ = decode_records(data.mixed_records(spark, sf_dir), EXPERIMENT)
    return decoded.groupBy("channel").agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_records(data.mixed_records(spark, sf_dir), EXPERIMENT)[0]


def numeric_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_numeric(_decoded(spark, sf_dir))[0]


def numeric_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_numeric(_decoded(spark, sf_dir))[1]


def combined_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain, formulas = split_combined(_decoded(spark, sf_dir), data.combined(spark))
    counted = [
        part.groupBy("reading_name").agg(F.count("*").alias("n"))
        .withColumn("kind", F.lit(kind))
        for part, kind in ((plain, "plain"), (formulas, "combined"))
    ]
    return counted[0].unionByName(counted[1])


def _formulas(spark: SparkSession, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(formula records, plain readings) of some records, read once and written by kind."""
    parts = Parts(spark, work_folder(spark, "rows"))
    schema = parts.write(routed(records, EXPERIMENT, data.combined(spark)))
    return parts.read(schema, FORMULA), parts.read(schema, PLAIN)


def latest_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = newest_values(*_formulas(spark, data.mixed_records(spark, sf_dir)), LOOKBACK_S)
    return found.select("ts", "seq", "key", "value")


def combined_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, _ = combine(*_formulas(spark, data.mixed_records(spark, sf_dir)), LOOKBACK_S)
    return ok.select("channel", "ts", "host", "reading_name", rounded("value"), "seq")


def combined_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combine(*_formulas(spark, data.mixed_records(spark, sf_dir)), LOOKBACK_S)[1]


def combined_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas over readings and hosts whose names hold dashes and digits."""
    ok, _ = combine(*_formulas(spark, data.named_records(spark, sf_dir)), LOOKBACK_S)
    return ok.select("ts", rounded("value"), "seq")


def prepare_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, _ = prepare(data.mixed_records(spark, sf_dir), EXPERIMENT, data.combined(spark),
                    LOOKBACK_S)
    return ok.select("channel", "ts", "host", "reading_name", rounded("value"), "seq")


# --- rules ------------------------------------------------------------------------------------

def rules_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings per active rule of each kind."""
    rows = data.readings(spark, sf_dir)
    kinds = [
        rows.join(active_rules(data.config(spark), kind), ["reading_name", "host"])
        .groupBy("reading_name", F.col("rule_id").cast("bigint").alias("rule_id"))
        .agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
        for kind in ("simple", "pid", "time_since")
    ]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


def levels_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute bands of each reading's simple rule, one row per level, and how it stands."""
    rows, _ = attach_rules(data.readings(spark, sf_dir), data.config(spark), "simple")
    band = F.posexplode("bands").alias("level", "band")
    return rows.select("reading_name", "seq", "value", band).select(
        "reading_name", "seq", F.col("level").cast("bigint").alias("level"),
        F.col("band.lo").alias("lo"), F.col("band.hi").alias("hi"),
        out_of_band(F.col("value"), F.col("band.lo"), F.col("band.hi")).alias("is_out"),
    )


def durations_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = attach_rules(data.readings(spark, sf_dir), data.config(spark), "time_since")
    return rows.select(
        "reading_name", "seq", in_band(F.col("value"), F.col("lower"), F.col("upper"))
        .alias("is_in"), F.posexplode("max_duration").alias("level", "max_duration"),
    ).withColumn("level", F.col("level").cast("bigint"))


def rule_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = attach_rules(data.readings(spark, sf_dir), data.config(spark), "simple")
    return rows.select("reading_name", "host", "seq", F.col("rule_id").cast("bigint")
                       .alias("rule_id"), "setpoint", "recurrence")


def rule_lookup_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = attach_rules(data.readings(spark, sf_dir, hosted=True), data.config(spark), "simple")
    return rows.select("reading_name", "host", "seq", F.col("rule_id").cast("bigint")
                       .alias("rule_id"), "setpoint", "recurrence")


def rule_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return misses(data.readings(spark, sf_dir), data.config(spark), "simple")


# --- simple alarms ----------------------------------------------------------------------------

def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = data.config(spark)
    rules = active_rules(config, "simple")
    rows = checks.sliced_rows(
        data.readings(spark, sf_dir), rules, WINDOW_MS, slice_millis(WINDOW_S, None),
    )
    runs = checks.own_rows(trailing_runs(rows, "value", WINDOW_MS, max_levels(rules)))
    return runs.where(F.size("bands") > 0)


def trailing_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows out of band in a row at the first level, as far as the window counts them."""
    in_window = F.when(F.col("out_0") & ~F.col("all_out_0"), F.col("run_0").cast("bigint"))
    return _runs(spark, sf_dir).select("reading_name", "seq", in_window.alias("run"))


def all_out_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select("reading_name", "seq", F.col("all_out_0").alias("all_out"))


def severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = checks.simple_checked(data.readings(spark, sf_dir), data.config(spark), WINDOW_S)
    return checked.select("reading_name", "seq", "severity")


def simple_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(checks.simple_alarms(data.readings(spark, sf_dir), data.config(spark), WINDOW_S))


def simple_alarms_halo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the shortest slices there are."""
    return flat(checks.simple_alarms(
        data.readings(spark, sf_dir), data.config(spark), WINDOW_S, slice_s=WINDOW_S))


def simple_alarms_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from slices an eighth as long as the window, which know each other by summaries."""
    return flat(checks.simple_alarms(
        data.readings(spark, sf_dir), data.config(spark), WINDOW_S, slice_s=WINDOW_S / 8))


def simple_alarms_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(checks.simple_alarms(
        data.readings(spark, sf_dir, hosted=True), data.config(spark), WINDOW_S))


# --- PID alarms -------------------------------------------------------------------------------

def proportional(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = attach_rules(data.readings(spark, sf_dir), data.config(spark), "pid")
    return proportional_term(rows).select("reading_name", "seq", rounded("p_term"))


def _pid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.pid_values(data.readings(spark, sf_dir), data.config(spark), WINDOW_S)


def integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pid(spark, sf_dir).select("reading_name", "seq", rounded("integral"))


def integral_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The integral where many rows share a time: times are cut to minutes."""
    coarse = data.readings(spark, sf_dir).withColumn("ts", F.col("ts") - F.pmod("ts", F.lit(60_000)))
    rows = checks.pid_values(coarse, data.config(spark), WINDOW_S)
    return rows.select("reading_name", "seq", rounded("integral"))


def slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pid(spark, sf_dir).select("reading_name", "seq", rounded("slope"))


def slope_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fit with the newest row taking part."""
    rows = checks.sliced_rows(
        data.readings(spark, sf_dir), active_rules(data.config(spark), "pid"), WINDOW_MS,
        slice_millis(WINDOW_S, None),
    )
    fitted = checks.own_rows(slope_term(rows, WINDOW_MS, include_latest=True))
    return fitted.select("reading_name", "seq", rounded("slope"))


def pid_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pid(spark, sf_dir).select("reading_name", "seq", rounded("pid", 4))


def pid_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(checks.pid_alarms(data.readings(spark, sf_dir), data.config(spark), WINDOW_S))


def pid_alarms_halo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(checks.pid_alarms(
        data.readings(spark, sf_dir), data.config(spark), WINDOW_S, slice_s=WINDOW_S))


# --- time-since alarms ------------------------------------------------------------------------

def time_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = checks.time_since_checked(data.readings(spark, sf_dir), data.config(spark), WINDOW_S)
    return checked.select("reading_name", "seq", rounded("time_since"), "severity")


def time_since_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(checks.time_since_alarms(
        data.readings(spark, sf_dir), data.config(spark), WINDOW_S))


# --- alarms, groups, messages -----------------------------------------------------------------

def _alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All alarms of the table, written once for the several readers of the queries below."""
    alarms = checks.all_alarms(data.readings(spark, sf_dir), data.config(spark), WINDOW_S)
    return staged(alarms, work_folder(spark, "alarms"))


def alarm_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(checks.all_alarms(data.readings(spark, sf_dir), data.config(spark), WINDOW_S))


def alarm_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    alarms = checks.all_alarms(data.readings(spark, sf_dir), data.config(spark), WINDOW_S)
    return alarms.groupBy(key_of_alarm().alias("alarm_key")).agg(F.count("*").alias("n"))


def group_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = group_members(_alarms(spark, sf_dir), data.groups(spark))
    return members.select("group_id", "name", "ts", "seq", "severity")


def _group(spark: SparkSession, sf_dir: str, operation: str) -> DataFrame:
    alarms = _alarms(spark, sf_dir)
    groups = data.groups(spark).where(F.col("operation") == operation)
    return evaluate_groups(alarms, groups, WINDOW_S).select(
        "group_id", "reading_name", "alarm_type", "ts", "seq", "severity")


def group_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _group(spark, sf_dir, "and")


def group_and_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every alarm delivered twice: a name still counts once, and each alarm has its result."""
    alarms = _alarms(spark, sf_dir)
    groups = data.groups(spark).where(F.col("operation") == "and")
    return evaluate_groups(alarms.unionByName(alarms), groups, WINDOW_S).select(
        "group_id", "reading_name", "alarm_type", "ts", "seq", "severity")


def group_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _group(spark, sf_dir, "or")


def ungrouped_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(ungrouped(_alarms(spark, sf_dir), data.groups(spark)))


def single_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each alarm of all three kinds as if it were in no group."""
    return single_message(_alarms(spark, sf_dir))


def group_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = data.groups(spark)
    return group_message(evaluate_groups(_alarms(spark, sf_dir), groups, WINDOW_S), groups)


def alarm_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_of(_alarms(spark, sf_dir), data.groups(spark), WINDOW_S)


# --- sinks and whole runs ---------------------------------------------------------------------

def storage_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings, _ = to_numeric(_decoded(spark, sf_dir))
    return points_of(readings, EXPERIMENT)


def _history(messages: DataFrame) -> DataFrame:
    return messages.select(F.unix_millis("when").alias("when_ms"), "howbad", "msg")


def alarm_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = messages_of(_alarms(spark, sf_dir), data.groups(spark), WINDOW_S)
    return _history(history_rows(messages))


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, bad = prepare(data.mixed_records(spark, sf_dir), EXPERIMENT, data.combined(spark),
                      LOOKBACK_S)
    every = bad.unionByName(config_diagnostics(ok, data.config(spark)))
    return every.groupBy("operator", "level", "msg").agg(F.count("*").alias("n")).withColumn(
        "level", F.col("level").cast("bigint"))


def batch_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole flow from records to the alarm history table."""
    out = work_folder(spark, "run")
    run_batch(data.plain_records(spark, sf_dir), EXPERIMENT, data.config(spark),
              data.combined(spark).where("false"), data.groups(spark), out, WINDOW_S, LOOKBACK_S)
    return _history(read_table(spark, out, "history"))


def batch_run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same run with its config read from files of documents."""
    out = work_folder(spark, "run")
    config = data.config_files(spark, f"{out}/config")
    run_batch(data.plain_records(spark, sf_dir), EXPERIMENT, *config, out, WINDOW_S, LOOKBACK_S)
    return _history(read_table(spark, out, "history"))


def stored_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of points that a run over records of all sorts has written."""
    out = work_folder(spark, "stored")
    run_batch(data.mixed_records(spark, sf_dir), EXPERIMENT, data.config(spark),
              data.combined(spark), data.groups(spark), out, WINDOW_S, LOOKBACK_S)
    return read_table(spark, out, "readings").select(
        "database", "measurement", "host", "reading_name", "ts", rounded("value"))


def _streamed(spark: SparkSession, parts: list[DataFrame]) -> str:
    """Run the stream over the parts, one micro-batch each; the folder of its tables."""
    work = work_folder(spark, "stream")
    for i, part in enumerate(parts):
        part.write.mode("append").parquet(f"{work}/part={i}/records")
        stream = read_raw(spark, EXPERIMENT, fmt="parquet", path=f"{work}/part=[0-{i}]/records")
        query = run_stream(
            stream, EXPERIMENT,
            lambda: (data.config(spark), data.combined(spark).where("false"), data.groups(spark)),
            f"{work}/out", f"{work}/checkpoint", WINDOW_S, LOOKBACK_S,
            trigger={"availableNow": True},
        )
        query.awaitTermination()
    return f"{work}/out"


def stream_alarms(spark: SparkSession, sf_dir: str, n_parts: int = 3) -> DataFrame:
    """The whole flow as a stream over the table, cut into parts by time; the alarms it wrote."""
    records = data.plain_records(spark, sf_dir)
    first, last = records.agg(F.min("timestamp"), F.max("timestamp")).first()
    step = (last - first) / n_parts
    number = sum(((F.col("timestamp") >= F.lit(first + i * step)).cast("int")
                  for i in range(1, n_parts)), F.lit(0))
    out = _streamed(spark, [records.where(number == i) for i in range(n_parts)])
    return flat(read_table(spark, out, "alarms"))


def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of a stream whose times arrive in any order, with a clock ten years ahead."""
    records = data.plain_records(spark, sf_dir)
    ahead = records.where("offset = 0").withColumns({
        "value": F.regexp_replace("value", "^[^,]*", "ahead"),
        "timestamp": F.timestamp_millis(F.unix_millis("timestamp") + 315_360_000_000),
    })
    parts = [records.where("offset % 2 = 0").unionByName(ahead), records.where("offset % 2 = 1")]
    points = read_table(spark, _streamed(spark, parts), "readings")
    return points.select("reading_name", "ts", "value")


@lru_cache(maxsize=4)
def _mixed_stream(spark: SparkSession, sf_dir: str) -> str:
    """One stream over records of all sorts, for the queries that read its tables; their folder.

    Two micro-batches, each with its config read anew from files; the second is delivered twice, as
    after a failure.
    """
    work = work_folder(spark, "mixed")
    data.config_files(spark, f"{work}/config")
    records = staged(data.mixed_records(spark, sf_dir), f"{work}/records")
    first, last = records.agg(F.min("timestamp"), F.max("timestamp")).first()
    is_late = F.col("timestamp") >= F.lit(first + (last - first) / 2)
    job = StreamJob(EXPERIMENT, lambda: data.load_config(spark, f"{work}/config"), f"{work}/out",
                    WINDOW_S, LOOKBACK_S)
    for number, part in ((0, ~is_late), (1, is_late), (1, is_late)):
        job.process(records.where(part), number)
    return f"{work}/out"


def stream_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points that a stream over records of all sorts has stored."""
    points = read_table(spark, _mixed_stream(spark, sf_dir), "readings")
    return points.select("database", "measurement", "host", "reading_name", "ts", rounded("value"))


def stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alarm history of that stream."""
    return _history(read_table(spark, _mixed_stream(spark, sf_dir), "history"))


def stream_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diagnostics of that stream, counted."""
    every = read_table(spark, _mixed_stream(spark, sf_dir), "diagnostics")
    return every.groupBy("operator", "level", "msg").agg(F.count("*").alias("n")).withColumn(
        "level", F.col("level").cast("bigint"))


QUERIES = [
    decode_default, decode_sysmon, decode_rejects, channel_and_time, numeric_cast,
    numeric_rejects, combined_split, latest_values, combined_readings, combined_rejects,
    combined_names,
    prepare_readings, rules_active, levels_normalised, durations_normalised, rule_lookup,
    rule_lookup_host, rule_misses, trailing_run, all_out_in_window, severities, simple_alarms,
    simple_alarms_halo, simple_alarms_split, simple_alarms_hosts, proportional, integral, integral_ties, slope, slope_latest,
    pid_value, pid_alarms, pid_alarms_halo, time_since, time_since_alarms, alarm_union, alarm_keys,
    group_membership, group_and, group_and_repeated, group_or, ungrouped_alarms, single_messages, group_messages,
    alarm_messages, storage_points, alarm_history, diagnostics, batch_run, batch_run_files, stored_readings,
    stream_alarms, stream_late, stream_readings, stream_history, stream_diagnostics,
]
