"""The stream's log: what a batch reads does not grow with the age of the stream."""

import json
import os

import pytest
from pyspark.sql import functions as F, types as T

from bandwatch.streaming.state import HOUR_MS, Log, State

SCHEMA = T.StructType([T.StructField("ts", T.LongType()), T.StructField("batch", T.LongType())])


def rows(spark, batch, *hours):
    one = spark.range(0, 1, 1, 1)
    hour = F.explode(F.array(*(F.lit(h).cast("bigint") for h in hours)))
    return one.select(hour.alias("h")).select((F.col("h") * HOUR_MS + batch).alias("ts"), F.lit(batch).cast("bigint").alias("batch"))


def files(paths):
    return [f"{d}/{n}" for p in paths for d, _, names in os.walk(p) for n in names if n.endswith(".parquet")]


@pytest.fixture(scope="module")
def aged(spark, tmp_path_factory):
    """200 batches, 20 an hour; each also has a late row of hour 0. What each of them read."""
    state = State(spark, str(tmp_path_factory.mktemp("state")))
    log, seen = Log(state, "rows"), {}
    for n in range(200):
        log.write(n, rows(spark, n, n // 20, 0))
        if n % 20 == 19:
            paths = log.paths(n, [n // 20], HOUR_MS)
            seen[n] = (len(paths), len(files(paths)), sorted(r.batch for r in log.read(n, SCHEMA, [n // 20], 1).collect()))
        log.commit(n, SCHEMA)
        log.clean(n)
    return state, log, seen


def test_batch_200_lists_no_more_than_batch_20(aged):
    _, log, seen = aged
    # from the third hour on (the first one gets late rows for ever): the same paths and files
    assert len({seen[n][:2] for n in range(59, 200, 20)}) == 1
    assert seen[199][0] <= seen[39][0] and seen[199][1] <= seen[39][1]
    # and that hour, after 200 batches: below FAN segments in each of three tiers
    assert len(files(log.paths(200, [0], 0))) <= 3 * 7


def test_all_rows_are_found_once(aged):
    state, log, seen = aged
    # hour 9 and the one before it, and no later ones
    assert seen[199][2] == [n for n in range(160, 199)]
    everything = [r.batch for r in log.read(200, SCHEMA, list(range(10)), 0).collect()]
    assert sorted(everything) == sorted([*range(200), *range(200)])


def test_old_segments_are_removed(aged):
    state, log, _ = aged
    left = [d for d in os.listdir(f"{state.path}/rows") if d[0] in "bm" and d[1:].isdigit()]
    live = {s for segments in log.manifest(199)["live"].values() for _, s in segments}
    assert len(left) <= len(live) + 4, set(left) - live
    assert sum(d.startswith("manifest") for d in os.listdir(f"{state.path}/rows")) == 2
    assert len(files([f"{state.path}/rows"])) < 80


def test_replay_reads_and_writes_the_same(spark, tmp_path):
    log = Log(State(spark, str(tmp_path)), "rows", fan=2)
    for n in range(6):
        for _ in range(2):  # each batch is tried twice; the first try gets as far as it can
            log.write(n, rows(spark, n, 5))
            assert [r.batch for r in log.read(n, SCHEMA, [5], 0).orderBy("batch").collect()] == list(range(n))
            log.commit(n, SCHEMA)
        log.clean(n)
        log.clean(n)
    assert sorted(r.batch for r in log.read(6, SCHEMA, [5], 0).collect()) == list(range(6))


def test_tiers(spark, tmp_path):
    log = Log(State(spark, str(tmp_path)), "rows", fan=3)
    assert [log._due([[t, "b0"] for t in tiers]) for tiers in ([], [0, 0], [0, 0, 0], [1, 1, 0, 0, 0], [1, 0, 0], [2, 2, 1, 1, 0, 0, 0])] == [
        0, 0, 1, 2, 0, 3]


def test_quiet_hours_expire(spark, tmp_path):
    log = Log(State(spark, str(tmp_path)), "rows", expire_after=3)
    for n in range(8):
        log.write(n, rows(spark, n, 0 if n < 2 else 1 + n))
        log.commit(n, SCHEMA)
        log.clean(n)
    assert sorted(log.manifest(7)["live"]) == [f"bucket={1 + n}" for n in range(4, 8)]
    assert log.read(8, SCHEMA, [0], 0).count() == 0
    json.dumps(log.manifest(7))


def test_negative_hours_and_parts(spark, tmp_path):
    log = Log(State(spark, str(tmp_path)), "rows", ["tag=a", "tag=b"], fan=2)
    for n in range(3):
        tagged = rows(spark, n, -3, 4).withColumn("tag", F.when(F.col("ts") < 0, "a").otherwise("b"))
        tagged.withColumn("bucket", F.floor(F.col("ts") / HOUR_MS)).write.partitionBy("tag", "bucket").parquet(log.segment(n))
        log.commit(n, SCHEMA)
        log.clean(n)
    assert log.read(3, SCHEMA, [-3], 0, "tag=a").count() == 3
    assert log.read(3, SCHEMA, [-3, 4], 0).count() == 6
    assert log.read(3, SCHEMA, [-3], 0, "tag=b").count() == 0


def test_bucket_length_is_settled_once(spark, tmp_path):
    state = State(spark, str(tmp_path))
    first = Log(state, "rows", bucket_ms=2 * HOUR_MS)
    first.write(0, rows(spark, 0, 4, 5, 6))
    first.commit(0, SCHEMA)
    later = Log(state, "rows", batch_id=1, bucket_ms=HOUR_MS)
    assert later.bucket_ms == 2 * HOUR_MS and later.read(1, SCHEMA, [2], 0).count() == 2
