import random
from bisect import bisect_left

import pytest
from pyspark.sql import functions as F

from bandwatch.operators.grouping import evaluate_groups, satisfied_intervals, slot_pieces, ungrouped_alarms
from bandwatch.plans.messages import alarm_messages
from bandwatch.sources.config import alarm_groups_from
from tests.helpers import START, alarms, by_second

GROUPS = [
    {"group_id": "A", "names": ["T1,simple", "h1,cpu,timesince"], "operation": "and",
     "time_window": 60.0},
    {"group_id": "O", "names": ["T1,pid", "T2,pid"], "operation": "or", "time_window": 60.0},
]
CASE = [(0, "", "T1", "simple", 1), (50, "h1", "cpu", "timesince", 0), (100, "", "T9", "simple", 2),
        (110, "", "T2", "pid", 0), (130, "", "T9", "simple", 0)]


def test_groups_and_single_messages(spark):
    data, groups = alarms(spark, CASE), alarm_groups_from(spark, GROUPS)
    got = sorted(((r.ts - START) // 1000, r.source, r.severity)
                 for r in alarm_messages(data, groups).collect())
    assert got == [(50, "A", 1.0), (100, "single", 2.0), (110, "O", 0.0), (130, "O", 0.0),
                   (130, "single", 0.0)]


def test_message_texts(spark):
    data, groups = alarms(spark, CASE), alarm_groups_from(spark, GROUPS)
    texts = {r.source: r.msg for r in alarm_messages(data, groups).collect()}
    assert texts["A"] == ("Following alarms are all active: \nsimple alarm of T1 \n"
                          "timesince alarm of cpu of h1 \n ")
    assert texts["O"] == ("At least one of the following alarms is active: \npid alarm of T1 \n"
                          "pid alarm of T2 \n")
    assert texts["single"] == ("Simple alarm for x measurement T9: 1.000 is outside alarm range "
                               "(2.000, 3.000)")
    none = alarm_groups_from(spark, [])
    rows = [(0, "h1", "A", "timesince", 0), (1, "h1", "B", "pid", 0)]
    texts = by_second(alarm_messages(alarms(spark, rows), none), "msg")
    assert texts[0] == ("TimeSince alarm for x measurement A of h1: 1.000 is outside alarm range "
                        "(2.000, 3.000) for more than 4 seconds")
    assert texts[1] == ("Pid alarm for x measurement B of h1: 1.000 is outside alarm range "
                        "(2.000, 3.000)")


def test_member_of_an_unsatisfied_group_is_not_reported_alone(spark):
    data, groups = alarms(spark, CASE[:1]), alarm_groups_from(spark, GROUPS)
    assert ungrouped_alarms(data, groups).count() == 0
    assert alarm_messages(data, groups).count() == 0


def brute_force(rows, groups, window_s):
    out = []
    for i, (t, *_ ) in enumerate(rows):
        buffer = [r for r in rows if t - window_s < r[0] <= t]
        for g in groups:
            worst, count = -1, 0
            names = list(dict.fromkeys(g["names"]))
            for name in names:
                mine = [r for r in buffer
                        if ",".join(filter(None, [r[1], r[2], r[3]])) == name]
                if g["operation"] == "and":
                    mine = [r for r in mine if r[0] >= t - g["time_window"]][:1]
                count += bool(mine)
                worst = max([worst, *(r[4] for r in mine)])
            if count == len(names) if g["operation"] == "and" else count:
                out.append((i, g["group_id"], float(worst)))
    return sorted(out)


def test_repeated_alarms_count_once(spark):
    """An `and` group counts names: one alarm delivered twice, or on two topics, does not fill two."""
    groups = alarm_groups_from(spark, [{"group_id": "A", "names": ["T1,simple", "T2,simple"],
                                        "operation": "and", "time_window": 60.0}])
    once = alarms(spark, [(0, "", "T1", "simple", 1)])
    assert evaluate_groups(once.union(once), groups).count() == 0
    both = alarms(spark, [(0, "", "T1", "simple", 1), (5, "", "T2", "simple", 0)])
    other_topic = both.withColumn("channel", F.lit("other"))
    got = evaluate_groups(both.union(other_topic), groups).collect()
    assert [(r.reading_name, r.severity) for r in got] == [("T2", 1.0)] * 2


@pytest.mark.parametrize("seed,alarms_per_task", [(1, 10**6), (2, 3), (3, 10**6)])
def test_groups_against_brute_force(spark, seed, alarms_per_task):
    rng = random.Random(seed)
    span = {1: 3000, 2: 1500, 3: 300}[seed]
    rows = sorted(
        ((rng.randrange(span * 4) / 4 if seed < 3 else rng.randrange(span),
          rng.choice(["", "h1"]), rng.choice("ABC"),
          rng.choice(["simple", "pid"]), rng.randrange(3)) for _ in range(250)),
        key=lambda r: r[0])
    groups = [
        {"group_id": "g1", "names": ["A,simple", "h1,B,pid", "C,pid"], "operation": "and",
         "time_window": 40.0},
        {"group_id": "g2", "names": ["A,simple", "A,simple", "h1,A,pid"], "operation": "and",
         "time_window": 5000.0},
        {"group_id": "g3", "names": ["h1,C,simple", "B,simple"], "operation": "or",
         "time_window": 1.0},
        {"group_id": "g4", "names": ["Z,simple"], "operation": "or", "time_window": 1.0},
    ]
    got = evaluate_groups(alarms(spark, rows), alarm_groups_from(spark, groups), 200,
                          cell_s=30, alarms_per_task=alarms_per_task)
    assert sorted((r.seq, r.group_id, r.severity) for r in got.collect()) == brute_force(
        rows, groups, 200)


def test_storm(spark):
    """4,000 alarms in half a minute: few pieces, whole results, one split per 500 alarms."""
    rng = random.Random(9)
    rows = sorted((rng.randrange(30_000) / 1000, "", rng.choice("AB"), "simple", rng.randrange(3)) for _ in range(4000))
    groups = alarm_groups_from(spark, [
        {"group_id": "o", "names": ["A,simple", "B,simple"], "operation": "or", "time_window": 1.0},
        {"group_id": "a", "names": ["A,simple", "B,simple"], "operation": "and", "time_window": 5.0}])
    data = alarms(spark, rows).persist()
    pieces = slot_pieces(data, groups, 20, cell_s=10).persist()
    assert pieces.where("group_id = 'o'").count() <= 3 * 4  # severities x cells, whatever the number of alarms
    times = [r[0] for r in rows]
    first = {n: [(t, s) for t, _, m, _, s in rows if m == n] for n in "AB"}
    want = []
    for i, t in enumerate(times):
        lo = bisect_left(times, round(t - 20 + 0.001, 3))
        hi = next((j for j in range(i, len(times)) if times[j] > t), len(times))
        want.append((i, "o", float(max(r[4] for r in rows[lo:hi]))))
        oldest = [next(((u, s) for u, s in first[n] if u >= round(t - 5, 3)), None) for n in "AB"]
        if all(o and o[0] <= t for o in oldest):
            want.append((i, "a", float(max(o[1] for o in oldest))))
    got = evaluate_groups(data, groups, 20, cell_s=10, alarms_per_task=500)
    assert sorted((r.seq, r.group_id, r.severity) for r in got.collect()) == sorted(want)
    spans = satisfied_intervals(pieces, 60_000).collect()
    for g in "oa":  # disjoint
        mine = sorted((r.since, r.until) for r in spans if r.group_id == g)
        assert all(a[1] < b[0] for a, b in zip(mine, mine[1:]))
