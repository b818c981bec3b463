"""The registered queries and their SQL twins, on the smallest tables."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracles import plain
from registry.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
# The rest runs in `check_oracles.py`; together they would take minutes here.
QUICK = ["decode_sysmon", "numeric_rejects", "combined_readings", "rule_lookup_host",
         "simple_alarms", "pid_alarms", "time_since_alarms"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_every_query_has_a_twin():
    assert {query.__name__ for query in QUERIES} <= set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{SF_DIR}/events.parquet'")
    df = queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    relation = duck.sql(oracle_sql()[name])
    assert sorted(relation.columns) == columns
    names = ", ".join(f'"{c}"' for c in columns)
    assert got == sorted(tuple(map(plain, r)) for r in relation.project(names).fetchall())
