"""The whole flow over an unbounded stream of records.

Every record is numbered, stored and checked, whatever its time. Look-backs are bounded, so each
micro-batch runs the batch plans over its own rows plus what earlier batches logged in the buckets of
time that these rows can look back to, and only its own rows give results. There is no clock: a record
from the future or from last month only reads other buckets. Batch and stream share all operators;
for records that arrive in order of time they give equal tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from bandwatch.operators.latest import LOOKBACK_S
from bandwatch.operators.slices import millis
from bandwatch.plans.batch import config_diagnostics
from bandwatch.plans.checks import WINDOW_S, all_alarms
from bandwatch.plans.messages import alarm_messages
from bandwatch.plans.readings import BROKEN, COMPUTED, FORMULA, PLAIN, bad, good, write_rows
from bandwatch.plans.staging import Parts, at_once
from bandwatch.schemas import ALARM, ROW
from bandwatch.sinks.tables import (
    write_alarm_history, write_alarms, write_diagnostics, write_readings,
)
from bandwatch.streaming.state import HOUR_MS, Log, State

SERIES = ["host", "reading_name"]
CONFIG = ["config", "combined", "groups"]


class StreamJob:
    """Process micro-batches: `process(batch, batch_id)` is what `foreachBatch` calls.

    `config_loader()` gives (readings config, combined names, alarm groups) and is asked once
    per micro-batch, so changes take effect while the stream runs.
    """

    def __init__(
        self,
        experiment: str,
        config_loader: Callable[[], tuple[DataFrame, DataFrame, DataFrame]],
        out: str,
        window_s: float = WINDOW_S,
        lookback_s: float = LOOKBACK_S,
        slice_s: float | None = None,
        expire_after: int | None = None,
    ):
        self.experiment, self.config_loader, self.out = experiment, config_loader, out
        self.window_s, self.lookback_s, self.slice_s = window_s, lookback_s, slice_s
        self.expire_after = expire_after

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark, out = batch.sparkSession, self.out
        state = State(spark, f"{out}/_state")
        state.require(batch_id)
        config, combined, groups = state.snapshots(CONFIG, batch_id, self.config_loader)
        window_ms = millis(self.window_s)
        tags = [f"tag={t}" for t in (PLAIN, COMPUTED)]
        # A row then looks back into the bucket before its own at most.
        bucket_ms = max(HOUR_MS, 2 * window_ms, millis(self.lookback_s))
        logging = {"batch_id": batch_id, "bucket_ms": bucket_ms, "expire_after": self.expire_after}
        row_log, alarm_log = Log(state, "rows", tags, **logging), Log(state, "alarms", **logging)

        # The batch's own segment of the log is also what the steps below read.
        parts = Parts(spark, row_log.segment(batch_id), row_log.bucket_ms)

        def earlier() -> tuple[DataFrame, DataFrame]:
            buckets = row_log.buckets(batch_id, f"tag={FORMULA}")
            old = row_log.read(batch_id, ROW, buckets, millis(self.lookback_s), tags[0])
            # Whether a name exists does not depend on how long it has been silent. Virtual
            # readings cannot be named, whatever they were before.
            names = self._names(state, batch_id, parts).join(combined, "reading_name", "left_anti")
            return old.join(combined, "reading_name", "left_anti").select(*old.columns), names

        rows = write_rows(batch, self.experiment, combined, parts, self.lookback_s, earlier)
        if not parts.holds(FORMULA):
            self._names(state, batch_id, parts)
        readings = good(rows)

        # A history of PID values reaches one window back, and each of them another.
        buckets = row_log.buckets(batch_id)
        old_readings = good(row_log.read(batch_id, ROW, buckets, 2 * window_ms))
        alarms = all_alarms(
            self._with_history(readings, old_readings, 2 * window_ms), config,
            self.window_s, self.slice_s,
        )
        alarms = alarm_log.write(batch_id, alarms)
        old_alarms = alarm_log.read(batch_id, ALARM, alarm_log.buckets(batch_id), window_ms)
        messages = alarm_messages(marked(alarms, old_alarms), groups, self.window_s)
        diagnostics = bad(rows).unionByName(config_diagnostics(readings, config))
        at_once(
            spark,
            lambda: write_readings(readings, self.experiment, f"{out}/readings", batch_id),
            lambda: write_alarms(alarms, f"{out}/alarms", batch_id),
            lambda: write_alarm_history(messages, f"{out}/history", batch_id),
            lambda: write_diagnostics(diagnostics, f"{out}/diagnostics", batch_id),
            lambda: row_log.commit(batch_id, ROW),
            lambda: alarm_log.commit(batch_id, ALARM),
        )
        state.mark("batch", batch_id)
        row_log.clean(batch_id)
        alarm_log.clean(batch_id)
        state.remove(*(f"{row_log.segment(batch_id - 1)}/tag={t}" for t in (FORMULA, BROKEN)))
        for name in [*CONFIG, "names", "batch"]:
            state.drop(name, batch_id - 2)

    def _names(self, state: State, batch_id: int, parts: Parts) -> DataFrame:
        return state.names(batch_id, parts.read(ROW, PLAIN), SERIES)

    def _with_history(self, new: DataFrame, old: DataFrame, reach_ms: int) -> DataFrame:
        """New readings, and of their series the earlier ones they can look back to."""
        span = new.groupBy(*SERIES).agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"))
        needed = old.join(span, SERIES).where(
            (F.col("ts") > F.col("_first") - F.lit(reach_ms)) & (F.col("ts") <= F.col("_last"))
        )
        return marked(new, needed.select(*old.columns))


def marked(new: DataFrame, old: DataFrame) -> DataFrame:
    """Both, told apart by `is_new`."""
    return new.withColumn("is_new", F.lit(True)).unionByName(
        old.withColumn("is_new", F.lit(False))
    )


def run_stream(
    raw_stream: DataFrame,
    experiment: str,
    config_loader: Callable[[], tuple[DataFrame, DataFrame, DataFrame]],
    out: str,
    checkpoint: str,
    window_s: float = WINDOW_S,
    lookback_s: float = LOOKBACK_S,
    slice_s: float | None = None,
    trigger: dict | None = None,
    expire_after: int | None = None,
) -> StreamingQuery:
    """Start the stream; tables grow under `out`, progress is kept in `checkpoint`.

    A late record is checked at its own time, with all that arrived before it and is older; what
    was written before is not revised. `trigger` is as for `DataStreamWriter.trigger`. With
    `expire_after`, a bucket of time that has got no row for so many micro-batches is forgotten: later rows
    no longer find what lies in it.
    """
    job = StreamJob(experiment, config_loader, out, window_s, lookback_s, slice_s, expire_after)
    writer = raw_stream.writeStream.foreachBatch(job.process).option(
        "checkpointLocation", checkpoint
    )
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start()
