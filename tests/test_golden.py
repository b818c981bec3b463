"""Small worked cases, one per rule and per odd corner of the rules."""

import math

import pytest

from bandwatch.plans.checks import (
    pid_alarms, pid_checked, pid_values, simple_alarms, simple_checked, time_since_alarms,
    time_since_checked,
)
from tests.helpers import by_second, config, readings, rule_doc

SIMPLE = {"type": "simple", "setpoint": 0, "levels": [[-1.0, 1], [-2.0, 2.0]], "recurrence": 3}
PID = {"type": "pid", "a": 1, "b": 0.5, "c": 2, "setpoint": 10, "dt_int": 10, "dt_diff": 10,
       "levels": [-5.0, 5.0], "recurrence": 1}
SINCE = {"type": "time_since", "lower_threshold": 0, "upper_threshold": 1,
         "max_duration": [5.0, 20.0]}


def test_recurrence_counts_back_to_the_last_value_in_band(spark):
    data = readings(spark, [(0, 0), (10, 1.5), (20, 1.5), (30, 2.5), (40, math.nan), (50, 3)])
    cfg = config(spark, rule_doc(SIMPLE))
    assert by_second(simple_checked(data, cfg), "severity") == {
        0: -1, 10: -1, 20: -1, 30: 0, 40: -1, 50: -1}
    assert by_second(simple_alarms(data, cfg), "params") == {30: [2.5, -1.0, 1.0]}


def test_whole_window_out_of_band_fires_below_recurrence(spark):
    data = readings(spark, [(0, 5), (700, 0), (1300, 1.5), (1310, 3)])
    cfg = config(spark, rule_doc(SIMPLE))
    assert by_second(simple_checked(data, cfg), "severity") == {0: 1, 700: -1, 1300: 0, 1310: 0}
    assert by_second(simple_alarms(data, cfg), "params")[0] == [5.0, -2.0, 2.0]


@pytest.mark.parametrize("lead_in", [[], [(-20, math.nan)]])
def test_pid_terms(spark, lead_in):
    data = readings(spark, [*lead_in, (0, 10), (5, 11), (10, 12), (15, 12)])
    terms = by_second(pid_values(data, config(spark, rule_doc(PID))), "integral", "slope", "pid")
    expected = {0: (0, 0, 0), 5: (2.5, 0, 2.25), 10: (10, 0.2, 7.4), 15: (17.5, 0.2, 11.15)}
    for second, values in expected.items():
        assert terms[second] == pytest.approx(values)


def test_pid_alarm_params_are_absolute_bands(spark):
    data = readings(spark, [(0, 10), (5, 11), (10, 12), (15, 12)])
    params = by_second(pid_alarms(data, config(spark, rule_doc(PID))), "params")
    assert set(params) == {10, 15}
    assert params[10] == pytest.approx([7.4, -5, 5])


def test_negative_look_back_drops_the_row(spark):
    data = readings(spark, [(0, 10), (5, 99)])
    cfg = config(spark, rule_doc({**PID, "dt_int": -1}))
    assert pid_checked(data, cfg).count() == 0


def test_time_since(spark):
    data = readings(spark, [(0, 0.5), (10, 2), (25, 2), (30, 1), (900, 9), (910, 9), (935, 9)])
    cfg = config(spark, rule_doc(SINCE))
    assert by_second(time_since_checked(data, cfg), "time_since", "severity") == {
        0: (0, -1), 10: (10, 0), 25: (25, 1), 30: (0, -1), 900: (0, -1), 910: (10, 0),
        935: (35, 1)}
    assert by_second(time_since_alarms(data, cfg), "params")[25] == [25, 0, 1, 20]


def test_time_since_takes_nan_as_out_of_band_and_is_strict(spark):
    data = readings(spark, [(0, 0.5), (5, math.nan), (6, math.nan)])
    cfg = config(spark, rule_doc({**SINCE, "max_duration": 5}))
    assert by_second(time_since_checked(data, cfg), "severity") == {0: -1, 5: -1, 6: 0}


def test_params_are_those_at_the_severity_index_not_of_the_level_that_fired(spark):
    # Only the second, narrower level fires: severity 0, so the first level's band is shown.
    rule = {**SIMPLE, "levels": [[-5, 5], [-1, 1]], "recurrence": 1}
    data = readings(spark, [(0, 2)])
    alarms = by_second(simple_alarms(data, config(spark, rule_doc(rule))), "severity", "params")
    assert alarms == {0: (0.0, [2.0, -5.0, 5.0])}


def test_single_pair_of_levels(spark):
    rule = {**SIMPLE, "levels": [-1, 1], "recurrence": 1, "setpoint": 10}
    data = readings(spark, [(0, 10), (1, 11), (2, 11.5)])
    assert by_second(simple_alarms(data, config(spark, rule_doc(rule))), "params") == {
        2: [11.5, 9.0, 11.0]}


def test_two_rules_of_one_type_are_independent(spark):
    other = {**SIMPLE, "levels": [-100, 100]}
    data = readings(spark, [(0, 0), (1, 1.5), (2, 1.5), (3, 1.5)])
    alarms = simple_alarms(data, config(spark, rule_doc(SIMPLE, other)))
    assert [(r.rule_id, r.severity) for r in alarms.collect()] == [(0, 0.0)]


def test_equal_times_count_in_order_of_arrival(spark):
    data = readings(spark, [(0, 0), (1, 1.5), (1, 1.5), (1, 1.5), (1, 0)])
    checked = simple_checked(data, config(spark, rule_doc(SIMPLE)))
    assert [r.severity for r in checked.orderBy("seq").collect()] == [-1, -1, -1, 0, -1]


def test_series_is_host_and_name_whatever_the_channel(spark):
    data = readings(spark, [(0, 0, "T1", "h1"), (1, 2, "T1", "h1"), (1, 2, "T1", "h2")])
    cfg = config(spark, rule_doc({**SIMPLE, "recurrence": 2}, host="h1"))
    assert simple_checked(data, cfg).select("host").distinct().collect()[0].host == "h1"
    # The value at 1 s is the first out of band and one in band precedes it: no alarm.
    assert simple_alarms(data, cfg).count() == 0
