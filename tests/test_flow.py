"""The whole flow: batch, stream with restarts, replays, late rows and changing config."""

import json
import random

import pytest
from pyspark.sql import functions as F

from bandwatch.plans.batch import run_batch
from bandwatch.sinks.tables import read_table
from bandwatch.sources.config import (
    alarm_groups_from, combined_from, load_alarm_groups, load_combined, load_readings_config,
    readings_config_from,
)
from bandwatch.sources.records import read_raw
from bandwatch.streaming.state import LostState
from bandwatch.streaming.stream import StreamJob, run_stream
from tests.helpers import raw_records, rule_doc

WINDOW_S = 120
RULES = [
    {"type": "simple", "setpoint": 1.0, "levels": [[-1, 1], [-2, 2]], "recurrence": 2},
    {"type": "pid", "a": 1, "b": 0.1, "c": 0.5, "setpoint": 1.0, "dt_int": 30, "dt_diff": 40,
     "levels": [[-2, 2], [-4, 4]], "recurrence": 2},
    {"type": "time_since", "lower_threshold": 0, "upper_threshold": 2, "max_duration": [10, 40]},
]
GROUPS = [
    {"group_id": "both", "names": ["T1,simple", "h1,T2,pid"], "operation": "and",
     "time_window": 60.0},
    {"group_id": "any", "names": ["C1,timesince", "h1,T2,simple"], "operation": "or",
     "time_window": 60.0},
]


def records(n=240, seed=5):
    rng = random.Random(seed)
    t, rows = 0.0, []
    for _ in range(n):
        t += rng.choice([0.25, 1, 3, 10])
        value = f"{rng.gauss(1, 1.5):.2f}"
        kind = rng.randrange(10)
        if kind < 4:
            rows.append(("exp_x", t, f"T1,{value}"))
        elif kind < 7:
            rows.append(("exp_sysmon", t, f"h1,T2,{value}"))
        elif kind < 9:
            rows.append(("exp_x", t, "C1,T1 + T2,h1 / 2"))
        else:
            rows.append(("exp_x", t, rng.choice(["T1,?", "X,1", "odd"])))
    return rows


def documents(spark):
    return (
        readings_config_from(spark, [rule_doc(*RULES, name=n) for n in ("T1", "C1")]
                             + [rule_doc(*RULES, name="T2", host="h1")]),
        combined_from(spark, ["C1"]),
        alarm_groups_from(spark, GROUPS),
    )


def contents(df):
    columns = sorted(set(df.columns) - {"batch"})
    return sorted(map(str, df.select(*columns).collect()))


def tables(spark, out):
    return {name: contents(read_table(spark, out, name))
            for name in ("readings", "alarms", "history", "diagnostics")}


@pytest.fixture(scope="module")
def batch_tables(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("batch"))
    raw = raw_records(spark, records())
    result = run_batch(raw, "exp", *documents(spark), out, WINDOW_S, slice_s=300)
    got = tables(spark, out)
    assert len(got["alarms"]) == result["alarms"].count() > 50
    assert len(got["history"]) == result["messages"].count() > 50
    assert result["messages"].select("source").distinct().count() == 3
    return got


def write_files(spark, folder, rows, n_files):
    size = -(-len(rows) // n_files)
    for i in range(0, len(rows), size):
        raw_records(spark, rows).where(
            (F.col("offset") >= i) & (F.col("offset") < i + size)
        ).coalesce(1).write.mode("append").parquet(folder)


def run_once(spark, source, out, loader, **options):
    stream = read_raw(spark, "exp", {"maxFilesPerTrigger": 1}, fmt="parquet", path=source)
    query = run_stream(stream, "exp", loader, out, f"{out}/checkpoint", WINDOW_S,
                       trigger={"availableNow": True}, **options)
    query.awaitTermination()


def test_stored_points(spark, batch_tables):
    assert all(("database='common'" in r) == ("measurement='sysmon'" in r)
               for r in batch_tables["readings"])
    assert all("day=datetime" in r for r in batch_tables["readings"])


def test_stream_with_a_restart_equals_batch(spark, batch_tables, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = records()
    half = len(rows) // 2
    write_files(spark, source, rows[:half], 2)
    run_once(spark, source, out, lambda: documents(spark))
    rest = raw_records(spark, rows).where(F.col("offset") >= half)
    rest.coalesce(1).write.mode("append").parquet(source)
    run_once(spark, source, out, lambda: documents(spark))
    assert tables(spark, out) == batch_tables


def test_replayed_batch_leaves_no_duplicates_and_keeps_its_config(spark, batch_tables, tmp_path):
    out = str(tmp_path / "out")
    raw = raw_records(spark, records())
    parts = [raw.where((F.col("offset") >= a) & (F.col("offset") < b))
             for a, b in ((0, 100), (100, 240))]
    job = StreamJob("exp", lambda: documents(spark), out, WINDOW_S)
    job.process(parts[0], 0)
    job.process(parts[1], 1)
    # The config has changed since; a replay still uses what the first try saw.
    nothing = (readings_config_from(spark, []), combined_from(spark, []),
               alarm_groups_from(spark, []))
    StreamJob("exp", lambda: nothing, out, WINDOW_S).process(parts[1], 1)
    assert tables(spark, out) == batch_tables


def test_config_change_takes_effect_and_newest_rule_judges_the_tail(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = raw_records(spark, [("exp_x", t, "T1,5") for t in range(6)])
    rule = {"type": "simple", "setpoint": 0, "levels": [-1, 1], "recurrence": 3}
    none = (readings_config_from(spark, []), combined_from(spark, []), alarm_groups_from(spark, []))
    some = (readings_config_from(spark, [rule_doc(rule)]), *none[1:])
    current = [none]
    job = StreamJob("exp", lambda: current[0], out, WINDOW_S)
    job.process(rows.where("offset < 3"), 0)
    current[0] = some
    job.process(rows.where("offset >= 3"), 1)
    assert read_table(spark, out, "alarms").count() == 3
    assert read_table(spark, out, "diagnostics").count() == 9


def test_late_rows(spark, tmp_path):
    """No row is dropped: late ones are stored, and checked against what lies before them."""
    out = str(tmp_path / "out")
    rule = {"type": "simple", "setpoint": 0, "levels": [-1, 1], "recurrence": 2}
    docs = (readings_config_from(spark, [rule_doc(rule)]), combined_from(spark, []),
            alarm_groups_from(spark, []))
    job = StreamJob("exp", lambda: docs, out, WINDOW_S)
    job.process(raw_records(spark, [("exp_x", 0, "T1,0"), ("exp_x", 90, "T1,5"),
                                    ("exp_x", 20_000, "T1,0")]), 0)
    job.process(raw_records(spark, [("exp_x", 99.9, "T1,5"), ("exp_x", -9_000, "T1,5")]), 1)
    assert read_table(spark, out, "readings").count() == 5
    assert read_table(spark, out, "diagnostics").count() == 0
    # The late row finds the 90 s value before it: twice in a row. The other is alone: all are out.
    late = read_table(spark, out, "alarms").where("batch = 1").collect()
    assert len(late) == 2


def test_record_from_the_future(spark, tmp_path):
    """A clock that runs ahead harms no other series, and no later batch."""
    out = str(tmp_path / "out")
    rows = [("exp_x", 0, "T1,5"), ("exp_x", 86_400, "T9,1"), ("exp_x", 1, "T1,5"),
            ("exp_x", 2, "T1,5"), ("exp_x", 3, "T1,5")]
    rule = {"type": "simple", "setpoint": 0, "levels": [-1, 1], "recurrence": 2}
    docs = (readings_config_from(spark, [rule_doc(rule)]), combined_from(spark, []),
            alarm_groups_from(spark, []))
    raw = raw_records(spark, rows)
    job = StreamJob("exp", lambda: docs, out, WINDOW_S)
    job.process(raw.where("offset < 2"), 0)
    job.process(raw.where("offset >= 2"), 1)
    run_batch(raw, "exp", *docs, f"{out}-batch", WINDOW_S)
    assert tables(spark, out) == tables(spark, f"{out}-batch")
    assert read_table(spark, out, "alarms").count() == 4


def test_silent_name_in_a_formula(spark, tmp_path):
    """A longer name that has been silent for hours is still no difference of a shorter one."""
    hour = 3600
    rows = [("exp_sysmon", 0, "node-1,cpu,7"), ("exp_sysmon", 1, "node,cpu,9"),
            ("exp_x", 2, "C1,cpu,node-1 * 2"),
            ("exp_sysmon", 2 * hour, "node,cpu,9"), ("exp_x", 2 * hour + 1, "C1,cpu,node + 1"),
            ("exp_sysmon", 5 * hour, "node,cpu,9"), ("exp_x", 5 * hour + 1, "C1,cpu,node-1 * 2"),
            ("exp_sysmon", 5 * hour + 2, "node-1,cpu,8"),
            ("exp_x", 5 * hour + 3, "C1,cpu,node-1 * 2")]
    docs = (readings_config_from(spark, []), combined_from(spark, ["C1"]),
            alarm_groups_from(spark, []))
    raw, out = raw_records(spark, rows), str(tmp_path / "out")
    job = StreamJob("exp", lambda: docs, out, WINDOW_S)
    for i, (a, b) in enumerate(((0, 3), (3, 5), (5, 7), (7, 9))):
        job.process(raw.where((F.col("offset") >= a) & (F.col("offset") < b)), i)
    run_batch(raw, "exp", *docs, f"{out}-batch", WINDOW_S)
    got = tables(spark, out)
    assert got["readings"] == tables(spark, f"{out}-batch")["readings"]
    values = read_table(spark, out, "readings").where("reading_name = 'C1'").select("value")
    assert sorted(r.value for r in values.collect()) == [10, 14, 16]
    assert sum("cpu,node-1 * 2" in r for r in got["diagnostics"]) == 1


def test_batch_and_stream_share_a_folder(spark, tmp_path):
    out = str(tmp_path / "out")
    raw = raw_records(spark, records())
    StreamJob("exp", lambda: documents(spark), out, WINDOW_S).process(raw, 0)
    run_batch(raw, "exp", *documents(spark), out, WINDOW_S)
    for name in ("readings", "alarms", "history", "diagnostics"):
        counts = {r.batch: r["count"] for r in
                  read_table(spark, out, name).groupBy("batch").count().collect()}
        assert counts.pop(0) == counts.popitem()[1] > 0 and not counts


@pytest.mark.parametrize("broken", ["write_readings", "write_alarm_history"])
def test_broken_run_repeated_gives_each_row_once(spark, batch_tables, tmp_path, monkeypatch, broken):
    """One of four writes fails; others are done by then. Readers see all of a run or nothing."""
    from bandwatch.plans import batch as plan
    from bandwatch.sinks.tables import remove_broken_runs

    out, raw = str(tmp_path / "out"), raw_records(spark, records())
    run = lambda: run_batch(raw, "exp", *documents(spark), out, WINDOW_S, slice_s=300, run_id="2026-01")
    with monkeypatch.context() as patched:
        def fails(*args):
            raise OSError("disk")
        patched.setattr(plan, broken, fails)
        with pytest.raises(OSError):
            run()
    assert read_table(spark, out, "alarms").count() == read_table(spark, out, "diagnostics").count() == 0
    assert run() is not None
    assert tables(spark, out) == batch_tables
    assert run() is None  # it is there already
    assert remove_broken_runs(spark, out) > 0 and remove_broken_runs(spark, out) == 0
    assert tables(spark, out) == batch_tables
    assert {r.batch < 0 for r in read_table(spark, out, "history").collect()} == {True}


def test_lost_state_is_an_error(spark, tmp_path):
    out = str(tmp_path / "out")
    job = StreamJob("exp", lambda: documents(spark), out, WINDOW_S)
    job.process(raw_records(spark, records(20)), 0)
    with pytest.raises(LostState):
        StreamJob("exp", lambda: documents(spark), f"{out}-moved", WINDOW_S).process(
            raw_records(spark, records(20)), 1)


def test_config_files(spark, tmp_path):
    def write(name, *lines):
        path = tmp_path / name
        path.write_text("\n".join(lines))
        return str(path)

    readings = write(
        "readings.json",
        '{"name": "T1", "runmode": "default", "alarms": [{"type": "simple", "enabled": "true", '
        '"setpoint": 0.0, "levels": [[-1.0, 1.0], [-2.0, 2.0]], "recurrence": 3.0}]}',
        '{"name": "cpu", "host": "h1", "runmode": "default", "alarms": [{"type": "time_since", '
        '"enabled": "true", "lower_threshold": 0, "upper_threshold": 90.0, "max_duration": 30.0}]}')
    sensors = write("sensors.json", '{"name": "storm_exp", "readings": {"C1": "x", "C2": "y"}}',
                    '{"name": "storm_other", "readings": {"C3": "x"}}')
    groups = write("groups.json",
                   '{"names": ["T1,simple", "h1,cpu,timesince"], "operation": "and", '
                   '"time_window": 60.0}')
    rows = load_readings_config(spark, readings).orderBy("doc_order").collect()
    assert [r.name for r in rows] == ["T1", "cpu"]
    assert json.loads(rows[0].alarms[0].levels) == [[-1.0, 1.0], [-2.0, 2.0]]
    assert sorted(r.reading_name for r in load_combined(spark, sensors, "exp").collect()) == [
        "C1", "C2"]
    group = load_alarm_groups(spark, groups).collect()[0]
    assert group.group_id and group.time_window == 60.0
