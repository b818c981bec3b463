"""Names in formulas: the automaton against a plain search, quotes, many names, repeated records."""

import random
import time

import pytest

from bandwatch.functions.formula import BadFormula, parse
from bandwatch.functions.names import NameFinder, names_in_texts, stands_alone
from tests.test_ingest import combined


def plain_search(names, text):
    hits = {(at, name) for name in names for at in range(len(text)) if text.startswith(name, at)}
    return sorted({name for at, name in hits if stands_alone(text, at, at + len(name))})


def test_automaton_equals_plain_search():
    rng = random.Random(3)
    names = ["T1", "T10", "T1-T2", "Tank A", "Tank", "A", "a*b", "a", "b", "cpu,node-01", "cpu,node", "cpu", "-x",
             "x-", "5", "1e3", "Math.pi", "°C", "(y)", "tank a/b", "10.0.0.5", "2nd", "T1 T2", "ü"]
    finder = NameFinder(names)
    pieces = [*names, *(f'"{n}"' for n in names), *(f"'{n}'" for n in names), " + ", "*", "/", "(", ")", ",", "-", " ", "9"]
    for _ in range(2000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 9)))
        assert finder.names_in(text) == plain_search(names, text), text
    assert NameFinder([]).names_in("T1") == [] and NameFinder(["", "T1"]).names_in("T1") == ["T1"]


@pytest.mark.parametrize("text", ['"T1', "'T1", '"T1" "T2"', 'T1"T2"'])
def test_quotes_that_cannot_be_parsed(text):
    with pytest.raises(BadFormula):
        parse(text, (("T1", True), ("T2", True)))


def test_blocks_of_names_and_texts(spark):
    """A grid of blocks finds what one block finds; repeats and nulls do not matter."""
    rng = random.Random(4)
    names = [f"r{i},h{i % 3}" if i % 2 else f"r {i}" for i in range(60)]
    texts = [" + ".join(rng.sample(names, 5)) + f" * {i}" for i in range(40)] + ["1 + 1", "", None]
    given = spark.createDataFrame([(t,) for t in texts + texts], "raw_value string")
    known = spark.createDataFrame([(n,) for n in [*names, *names, None]], "key string")
    want = {t: NameFinder(names).names_in(t) for t in texts if t is not None}
    for sizes in ((10, 10), (10_000, 10_000), (7, 10_000), (10_000, 7)):
        got = names_in_texts(given, known, *sizes).collect()
        assert {r.raw_value: r["keys"] for r in got} == want and len(got) == len(want)
    assert names_in_texts(given.limit(0), known).count() == 0
    assert all(r["keys"] == [] for r in names_in_texts(given, known.limit(0)).collect())


def test_two_hundred_names_are_two_hundred_keys():
    names = [f"T{i}" for i in range(200)]
    text = f"max({','.join(names)})"
    finder = NameFinder([*names, *(f"X{i},h" for i in range(20_000))])
    began = time.time()
    assert finder.names_in(text) == sorted(names)
    parse(text, tuple((n, True) for n in names))
    assert time.time() - began < 0.25


def test_names_with_blanks_and_signs(spark):
    rows = [(0, "Tank A", "2"), (0, "Tank", "9"), (0, "a*b", "5"), (0, "a", "3"), (0, "b", "4"), (0, "f(x)", "7", "h 1"),
            (0, 'say "x"', "6"), (1, "C1", "Tank A * 2"), (2, "C1", '"a*b" + 1'), (3, "C1", "a*b"),
            (4, "C1", '"f(x),h 1" - Tank'), (5, "C1", "'say \"x\"' / 2"), (6, "C1", '"no such" + 1'),
            (7, "C1", 'max("a*b",a)'), (8, "C1", '"Tank A"*"Tank"')]
    ok, bad = combined(spark, rows)
    assert {t: v for (t, _, _), v in ok.items()} == {1: 4, 2: 6, 3: 12, 4: -2, 5: 3, 7: 5, 8: 18}
    assert len(bad) == 1


def test_wide_formula_and_repeated_records(spark):
    """200 names in one record; equal records are evaluated each."""
    from bandwatch.operators.combined import evaluated_formulas
    from tests.helpers import decoded
    from bandwatch.operators.numeric import parsed_readings

    base = parsed_readings(decoded(spark, [(0, f"T{i}", str(i)) for i in range(200)]))
    text = f"max({','.join(f'T{i}' for i in range(200))})"
    asks = decoded(spark, [(1, "C1", text), (2, "C1", "1 + 1"), (3, "C1", "T5 + T7 + T5")])
    got = evaluated_formulas(asks.unionByName(asks), base).collect()
    assert sorted(r.value for r in got) == [2, 2, 17, 17, 199, 199]
