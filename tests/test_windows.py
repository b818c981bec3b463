"""The window formulas against the brute-force model on random series."""

import math
import random

import pytest
from pyspark.sql import functions as F

from bandwatch.operators import slices
from bandwatch.operators.pid_terms import slope_term
from bandwatch.operators.rules import active_rules
from bandwatch.operators.slices import with_halo
from bandwatch.plans.checks import (
    all_alarms, pid_checked, pid_values, shared_slices, simple_checked, sliced_rows, time_since_checked,
)
from tests import model
from tests.helpers import START, config, readings, rule_doc

WINDOW_S = 60
SLICES = [None, 60, 100, 100_000]

SIMPLE = [
    {"type": "simple", "setpoint": 1.0, "levels": [[-1, 1], [-2, 2], [-3.5, 3]], "recurrence": 3},
    {"type": "simple", "setpoint": 0.0, "levels": [[-1.5, 2.5]], "recurrence": 1},
]
PID = [
    {"type": "pid", "a": 1, "b": 0.1, "c": 0.5, "setpoint": 1.0, "dt_int": 10, "dt_diff": 25,
     "levels": [[-2, 2], [-4, 4]], "recurrence": 2},
    {"type": "pid", "a": 0.5, "b": -0.02, "c": 3, "setpoint": 0.0, "dt_int": 500, "dt_diff": 0,
     "levels": [-3, 3], "recurrence": 4},
    {"type": "pid", "a": 0.1, "b": 0.2, "c": 1, "setpoint": 2.0, "dt_int": 0.0005, "dt_diff": 90,
     "levels": [[-1, 1], [-2, 2], [-3, 3]], "recurrence": 1},
]
SINCE = [
    {"type": "time_since", "lower_threshold": 0, "upper_threshold": 2, "max_duration": [3, 12, 30]},
    {"type": "time_since", "lower_threshold": 5, "upper_threshold": 6, "max_duration": 59},
]


def series(seed, n=120):
    """Random walk in time with bursts, gaps and equal times, 3 % NaN."""
    rng = random.Random(seed)
    t, rows = 0.0, []
    for _ in range(n):
        t += rng.choice([0, 0, 0.001, 0.5, 1, 1, 2, 5, 40, 130])
        value = math.nan if rng.random() < 0.03 else round(rng.gauss(1, 2), 2)
        rows.append((round(t, 3), value))
    return rows


@pytest.fixture(scope="module")
def data(spark):
    """(readings, {name: model rows})."""
    rows, by_name = [], {}
    for seed in range(3):
        name = f"S{seed}"
        rows += [(t, v, name) for t, v in series(seed)]
    random.Random(0).shuffle(rows)
    for name in {name for _, _, name in rows}:
        mine = [{"ts": START + int(round(t * 1000)), "value": v, "seq": i}
                for i, (t, v, n) in enumerate(rows) if n == name]
        by_name[name] = sorted(mine, key=lambda r: (r["ts"], r["seq"]))
    df = readings(spark, rows).repartition(4).persist()
    return df, by_name


def cfg(spark, rules):
    return config(spark, *(rule_doc(*rules, name=f"S{i}") for i in range(3)))


def compare(df, columns, expected):
    """`expected(rows, rule)` gives one tuple per row of a series."""
    got = {}
    for r in df.select("reading_name", "rule_id", "seq", *columns).collect():
        key = (r.reading_name, r.rule_id, r.seq)
        assert key not in got
        got[key] = tuple(r[c] for c in columns)
    count = 0
    for (name, rule_id), (rows, values) in expected.items():
        for row, want in zip(rows, values):
            have = got[name, rule_id, row["seq"]]
            count += 1
            assert all(map(model.same, have, want)), (name, rule_id, row, have, want)
    assert count == len(got)


def normal(rule):
    out = dict(rule)
    if "levels" in rule and not isinstance(rule["levels"][0], list):
        out["levels"] = [rule["levels"]]
    if rule["type"] == "time_since":
        d = rule["max_duration"]
        out |= {"lower": rule["lower_threshold"], "upper": rule["upper_threshold"],
                "max_duration": d if isinstance(d, list) else [d]}
    return out


def expected(by_name, rules, values):
    return {
        (name, i): (rows, values(rows, normal(rule), WINDOW_S * 1000))
        for name, rows in by_name.items() for i, rule in enumerate(rules)
    }


@pytest.mark.parametrize("slice_s", [*SLICES, 7, 0.5])
def test_simple(spark, data, slice_s):
    df, by_name = data
    checked = simple_checked(df, cfg(spark, SIMPLE), WINDOW_S, slice_s)
    compare(checked, ["severity"],
            expected(by_name, SIMPLE, lambda *a: [(s,) for s in model.simple(*a)]))


@pytest.mark.parametrize("slice_s", SLICES)
def test_pid(spark, data, slice_s):
    df, by_name = data
    config_ = cfg(spark, PID)
    compare(pid_values(df, config_, WINDOW_S, slice_s), ["integral", "slope", "pid"],
            expected(by_name, PID, model.pid_terms))
    compare(pid_checked(df, config_, WINDOW_S, slice_s), ["pid", "severity"],
            expected(by_name, PID, model.pid))


@pytest.mark.parametrize("slice_s", SLICES)
def test_time_since(spark, data, slice_s):
    df, by_name = data
    compare(time_since_checked(df, cfg(spark, SINCE), WINDOW_S, slice_s),
            ["time_since", "severity"], expected(by_name, SINCE, model.time_since))


def test_slope_with_the_newest_row(spark, data):
    from pyspark.sql import functions as F
    df, by_name = data
    rows = with_halo(df.withColumns({"rule_id": F.lit(0), "dt_diff": F.lit(25.0)}), 120_000, 60_000)
    framed = slope_term(rows, WINDOW_S * 1000, include_latest=True).where("ts >= slice")
    want = {}
    for name, mine in by_name.items():
        buffers = (model.buffer_at(mine, i, WINDOW_S * 1000) for i in range(len(mine)))
        want[name, 0] = (mine, [(model.slope(b, 25, True),) for b in buffers])
    compare(framed, ["slope"], want)


def test_slope_of_close_points_far_from_the_tile_start(spark):
    rows = [(599.990, 1.0), (599.991, 1.5), (599.993, 2.0), (599.999, 9.0)]
    df = readings(spark, rows)
    rule = {**PID[0], "a": 0, "b": 0, "c": 1, "setpoint": 0, "dt_diff": 600}
    got = pid_values(df, config(spark, rule_doc(rule)), 600).orderBy("ts").collect()
    buffer = [{"ts": START + int(round(t * 1000)), "value": v} for t, v in rows]
    assert got[3].slope == pytest.approx(model.slope(buffer, 600), rel=1e-9)


def test_slope_of_a_dense_burst_at_the_end_of_a_wide_tile(spark):
    """Squares of times since the tile's start are beyond a double's whole numbers here."""
    window_s = 21_600
    rng = random.Random(4)
    late = window_s - 1 - START / 1000 % window_s
    rows = [(round(late + i / 1000, 3), rng.gauss(100, 1)) for i in range(300)]
    rule = {**PID[0], "a": 0, "b": 0, "c": 1, "setpoint": 0, "dt_diff": window_s}
    got = pid_values(readings(spark, rows), config(spark, rule_doc(rule)), window_s)
    buffer = [{"ts": START + int(round(t * 1000)), "value": v} for t, v in rows]
    for i, row in enumerate(got.orderBy("seq").collect()):
        assert row.slope == pytest.approx(model.slope(buffer[: i + 1], window_s), rel=1e-6, abs=1e-6)


def test_slope_in_longs_and_in_decimals(spark, data, monkeypatch):
    """Both ways to multiply give the same slopes, to the last bit."""
    from bandwatch.operators import pid_terms
    df, _ = data
    slopes = []
    for safe in (pid_terms.SAFE_SPAN, 5 * WINDOW_S * 1000, 0):
        monkeypatch.setattr(pid_terms, "SAFE_SPAN", safe)
        rows = pid_values(df, cfg(spark, PID), WINDOW_S).select("reading_name", "rule_id", "seq", "slope")
        slopes.append(sorted(str(tuple(r)) for r in rows.collect()))
    assert slopes[0] == slopes[1] == slopes[2] and len(slopes[0]) > 100


@pytest.mark.parametrize("slice_s", SLICES)
def test_integral_of_equal_times(spark, slice_s):
    """The oldest of the rows of one time is the first of a frame, wherever the tile's edge falls."""
    rule = {**PID[0], "a": 0, "b": 1, "c": 0, "setpoint": 0, "dt_int": 10}
    for start in range(0, 12):
        rows = [(start, 1.0), (start, 100.0), (start + 8, 3.0)]
        got = pid_values(readings(spark, rows), config(spark, rule_doc(rule)), WINDOW_S, slice_s)
        assert got.orderBy("seq").collect()[2].integral == pytest.approx(414)


def test_all_checks_share_one_shuffle(spark, data):
    df, _ = data
    plan = all_alarms(df, cfg(spark, SIMPLE + PID + SINCE), WINDOW_S)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    shuffles = text.count("Exchange hashpartitioning(reading_name") - text.count("ReusedExchange")
    assert text.count("rule_id#") and shuffles <= 1, text


def test_one_dense_slice_is_many_tasks(spark):
    """A burst of one series within the window, cut into slices of seconds: the same result."""
    from pyspark.sql import functions as F

    from bandwatch.schemas import READING

    rows = spark.range(20_000).select(
        F.lit("x").alias("channel"), (F.lit(START) + F.col("id") * 3 + F.pmod(F.hash("id"), F.lit(900))).alias("ts"),
        F.lit("").alias("host"), F.lit("S0").alias("reading_name"),
        F.when(F.pmod(F.hash("id"), F.lit(97)) == 0, 0.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(9)) - 4.5).alias("value"),
        F.col("id").alias("seq")).select(READING.names)
    cfg_ = cfg(spark, SIMPLE)
    whole = simple_checked(rows, cfg_, WINDOW_S)
    split = simple_checked(rows, cfg_, WINDOW_S, slice_s=2)
    assert split.select("slice").distinct().count() > 20
    told = lambda df: sorted((r.rule_id, r.seq, r.severity) for r in df.select("rule_id", "seq", "severity").collect())
    assert told(whole) == told(split) and len({r[2] for r in told(split)}) > 2


def test_no_task_holds_more_than_a_few_slices(spark, monkeypatch):
    """The number of tasks follows the rows, however few bytes they are when shuffled."""
    monkeypatch.setattr(slices, "ROWS_PER_TASK", 10)
    rows = readings(spark, [(t, t % 7) for t in range(400)])
    rules = active_rules(config(spark, rule_doc(*PID[:1])), "pid")
    shared = shared_slices(rows, [rules], 10_000, 20_000)
    own = sliced_rows(rows, rules, 10_000, 20_000)
    for cut in (shared, own):
        placed = cut.groupBy("slice", F.spark_partition_id().alias("task")).count().collect()
        assert len({r["slice"] for r in placed}) == len(placed) >= 20  # a slice in one task
        assert len({r["task"] for r in placed}) == len(placed)  # and no other with it
