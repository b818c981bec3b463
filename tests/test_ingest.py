import math

import pytest

from bandwatch.functions.formula import BadFormula, compute, parse
from bandwatch.operators.combined import combined_readings
from bandwatch.operators.numeric import parsed_readings, split_combined, to_numeric
from bandwatch.operators.rules import attach_rules, rule_problems
from bandwatch.plans.readings import prepare_readings
from bandwatch.sources.config import combined_from
from bandwatch.sources.records import decode_records
from tests.helpers import START, config, decoded, raw_records, readings, rule_doc


def test_decode(spark):
    raw = raw_records(spark, [
        ("exp_pressure", 0, "P1,1.25"), ("exp_x_y", 1, "A,1,2"), ("exp_sysmon", 2, "h1,A,1,2"),
        ("exp_x", 3, "A"), ("exp_sysmon", 4, "h1,A"), ("exp_", 5, "A,1"), ("exp_x", 6, None),
        ("exp__x", 7, "A,")])
    ok, diagnostics = decode_records(raw, "exp")
    rows = [tuple(r)[:5] for r in ok.orderBy("ts").collect()]
    assert rows == [
        ("pressure", START, "", "P1", "1.25"), ("x", START + 1000, "", "A", "1,2"),
        ("sysmon", START + 2000, "h1", "A", "1,2"), ("", START + 7000, "", "A", "")]
    assert [r.level for r in diagnostics.collect()] == [20] * 4


def test_numbers_as_a_double_parser_takes_them(spark):
    texts = {"1.5": 1.5, " 2 ": 2.0, "1d": 1.0, "0x1p3": 8.0, "NaN": math.nan,
             "-Infinity": -math.inf, "nan": None, "inf": None, "1,2": None, "": None, "x": None}
    ok, diagnostics = to_numeric(decoded(spark, [(i, "T1", t) for i, t in enumerate(texts)]))
    got = {(r.ts - START) // 1000: r.value for r in ok.collect()}
    for i, (text, value) in enumerate(texts.items()):
        if value is None:
            assert i not in got, text
        else:
            assert got[i] == value or (math.isnan(value) and math.isnan(got[i])), text
    assert diagnostics.count() == sum(v is None for v in texts.values())


def test_rule_lookup(spark):
    rule = {"type": "simple", "setpoint": 1, "levels": [-1, 1], "recurrence": 1}
    data = readings(spark, [(0, 1, "cpu", ""), (1, 1, "cpu", "h1"), (2, 1, "cpu", "h2"),
                            (3, 1, "X9", ""), (4, 1, "X9", "h1"), (5, 1, "P1", ""),
                            (6, 1, "Q1", "")])
    cfg = config(
        spark,
        rule_doc({**rule, "setpoint": 7}, name="cpu", host="h1"),
        rule_doc(rule, name="cpu", host="h3"),
        rule_doc(rule, name="cpu", host="h1"),
        {**rule_doc(rule, name="P1"), "runmode": "testing"},
        {"name": "Q1", "runmode": "default"},
    )
    rows, diagnostics = attach_rules(data, cfg, "simple")
    assert {(r.host, r.reading_name, r.setpoint) for r in rows.collect()} == {
        ("", "cpu", 7.0), ("h1", "cpu", 7.0)}
    assert sorted((r.msg, r.level) for r in diagnostics.collect()) == [
        ("Can't access alarm config for Q1", 10), ("Can't access alarm config for X9", 10)]


def test_disabled_rules_and_integer_numbers(spark):
    rule = {"type": "simple", "setpoint": 1, "levels": [[-1, 1]], "recurrence": 2}
    cfg = config(spark, rule_doc({**rule, "enabled": "false"}, {**rule, "enabled": "True"}, rule))
    rows, _ = attach_rules(readings(spark, [(0, 1)]), cfg, "simple")
    row = rows.collect()
    assert [(r.rule_id, r.recurrence, r.bands[0].lo) for r in row] == [(2, 2.0, 0.0)]


def test_rules_that_cannot_be_used(spark):
    good = {"type": "simple", "setpoint": 1, "levels": [[-1, 1]], "recurrence": 2}
    since = {"type": "time_since", "lower_threshold": 0, "upper_threshold": 1, "max_duration": 5}
    cfg = config(spark, rule_doc(
        good, {**good, "type": None}, {**good, "enabled": None}, {**good, "levels": "wide"},
        {**good, "levels": [[-1]]}, {**good, "recurrence": "often"},
        {**good, "enabled": "false", "levels": "wide"}, since, {**since, "max_duration": "long"}))
    got = sorted(r.msg.split(": ")[0].split(" of ")[0][-1] for r in rule_problems(cfg).collect())
    assert got == ["1", "2", "3", "4", "5", "8"]


def combined(spark, rows, names=("C1",), lookback_s=60):
    plain, formulas = split_combined(decoded(spark, rows), combined_from(spark, list(names)))
    ok, diagnostics = combined_readings(formulas, parsed_readings(plain), lookback_s)
    return ({((r.ts - START) / 1000, r.host, r.reading_name): r.value for r in ok.collect()},
            [r.msg for r in diagnostics.collect()])


def test_formula_over_newest_values(spark):
    base = [(0, "T1", "3"), (0, "T10", "7"), (0, "T2", "4", "h1")]
    text = "T1 + T2,h1 * 2 - T10"
    ok, bad = combined(spark, [*base, (30, "C1", text), (61, "C1", text), (59, "C1", "T1/0")])
    assert ok == {(30, "", "C1"): 4.0, (59, "", "C1"): math.inf}
    assert len(bad) == 1


def test_formula_corner_cases(spark):
    rows = [(0, "T1", "1"), (1, "T1", "5"), (2, "T1", "x"), (3, "T2", "-3"),
            (4, "C1", "T1 + 1"),             # newest T1 is no number
            (5, "C1", "2 - T2"), (6, "C1", "C1 + 1"), (7, "C1", ""), (8, "C1", "1 +"),
            (9, "C1", "__import__('os')"), (10, "C1", "Math.sqrt(16) + 2"), (11, "C1", "1+2*3"),
            (12, "C1", "unknown/0"), (13, "C1", "-(T2) * -2"), (14, "C1", "0/0")]
    ok, bad = combined(spark, rows)
    nan = ok.pop((14, "", "C1"))
    assert math.isnan(nan)
    assert ok == {(5, "", "C1"): 5.0, (7, "", "C1"): 0.0, (10, "", "C1"): 6.0,
                  (11, "", "C1"): 7.0, (13, "", "C1"): -6.0}
    assert len(bad) == 5


def test_comma_in_a_call_is_a_key_only_where_that_key_has_a_value(spark):
    rows = [(0, "A", "1"), (0, "B", "9"), (1, "C1", "max(A,B)"), (2, "A", "20", "B"),
            (3, "C1", "max(A,B)"), (4, "C1", "pow(A, B)"), (5, "C1", "max(A,B, 30)")]
    ok, bad = combined(spark, rows)
    assert ok == {(1, "", "C1"): 9.0, (3, "", "C1"): 20.0, (4, "", "C1"): 1.0, (5, "", "C1"): 30.0}


def test_names_with_dashes_dots_and_digits(spark):
    rows = [(0, "cpu", "50", "node"), (0, "cpu", "70", "node-01"), (0, "PT-1", "4"),
            (0, "load", "3", "10.0.0.5"), (0, "2nd", "8"), (0, "x", "1"),
            (1, "C1", "cpu,node-01 * 2"), (2, "C1", "PT-1 * 2"), (3, "C1", "load,10.0.0.5 + 1"),
            (4, "C1", "2nd/2"), (5, "C1", "x-1"), (6, "C1", "max(cpu,node-01,cpu,node)"),
            (7, "C1", "PT-10"), (8, "C1", "cpu,node-02"), (9, "C1", "x-5*2"), (10, "C1", "-PT-1-x"),
            (100, "x", "1"), (100, "cpu", "50", "node"), (101, "C1", "cpu,node-01 * 2")]
    ok, bad = combined(spark, rows)
    assert {t: v for (t, _, _), v in ok.items()} == {1: 140, 2: 8, 3: 4, 4: 4, 5: 0, 6: 70, 9: -9,
                                                     10: -5}
    # no such name; no such name; known, but without a value of late: never a number
    assert len(bad) == 3


def test_many_texts_in_one_batch():
    """Work grows with the rows, not with rows times texts."""
    import time

    import pyarrow as pa

    from bandwatch.functions.formula import _evaluate

    n = 10_000
    began = time.time()
    got = _evaluate(pa.array([f"x + {i + 1}" for i in range(n)]), pa.array([["x"]] * n),
                    pa.array([[1.0]] * n))
    assert got.to_pylist()[:2] == [2.0, 3.0] and time.time() - began < 2


@pytest.mark.parametrize("text,value", [
    ("1+2*3", 7), ("(1+2)*3", 9), ("2*-3", -6), ("-2-3", -5), ("8/2/2", 2), ("1-2-3", -4),
    ("1e3+.5", 1000.5), ("min(3,1,2)", 1), ("Math.pow(2,10)", 1024), ("round(-2.5)", -2),
    ("round(2.5)", 3), ("max(1,(2+3)*2)", 10), ("--3", 3), ("+4", 4), ("-min(1,2)*3", -3),
    ("abs(-1)+floor(1.9)-ceil(0.1)", 1)])
def test_arithmetic(text, value):
    assert compute(parse(text), None, 1)[0] == value


@pytest.mark.parametrize("text", ["1 2", "(1", "1)", "*2", "f(1)", "pow(1)", "1,2", "()", "a b",
                                  "max()", "1;2", "a.b()", "sqrt(1,2)", "max(1,)"])
def test_what_cannot_be_parsed(text):
    with pytest.raises(BadFormula):
        parse(text)


def test_prepare_readings_keeps_all_and_reports_the_rest(spark):
    raw = raw_records(spark, [("exp_x", 0, "T1,3"), ("exp_x", 1, "C1,T1*2"), ("exp_x", 2, "T1,no"),
                              ("exp_x", 3, "C1,T1*2"), ("exp_x", 4, "bad"),
                              ("exp_sysmon", 5, "h1,cpu,7")])
    ok, diagnostics = prepare_readings(raw, "exp", combined_from(spark, ["C1"]))
    assert sorted((r.reading_name, r.host, r.value) for r in ok.collect()) == [
        ("C1", "", 6.0), ("T1", "", 3.0), ("cpu", "h1", 7.0)]
    assert sorted(r.operator for r in diagnostics.collect()) == [
        "combined_readings", "decode_records", "to_numeric"]
