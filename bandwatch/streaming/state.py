"""State of the stream between micro-batches.

Small tables have one folder per batch, dropped two batches later. Logs keep every record by a
bucket of its time, an hour or as long as the longest look-back: a row of any time, early or late,
finds what lies before it. Batch n reads what a manifest written by batch n - 1 names, and
overwrites its own part, so a replay of n finds the same input. Neither a log nor the folder of a
bucket is ever listed: paths follow from the manifest, and the segments of a bucket are merged as
they pile up.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, types as T

from bandwatch.plans.staging import at_once, by_bucket, hadoop

HOUR_MS = 3_600_000
# Segments of one tier that a bucket may have; then they become one of the next tier.
FAN = 8


class LostState(RuntimeError):
    """What an earlier micro-batch wrote is gone."""


class State:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _folder(self, name: str, batch_id: int) -> str:
        return f"{self.path}/{name}/batch={batch_id}"

    def _marker(self, name: str, batch_id: int) -> str:
        return f"{self.path}/_complete/{name}-{batch_id}"

    def mark(self, name: str, batch_id: int) -> None:
        """Note, last of all, that a table or a whole batch has been written."""
        files, path = hadoop(self.spark, self._marker(name, batch_id))
        files.create(path, True).close()

    def is_marked(self, name: str, batch_id: int) -> bool:
        files, path = hadoop(self.spark, self._marker(name, batch_id))
        return files.exists(path)

    def require(self, batch_id: int) -> None:
        """Raise if the batch before this one has left no sign of being complete."""
        if batch_id > 0 and not self.is_marked("batch", batch_id - 1):
            raise LostState(
                f"batch {batch_id} follows one of which {self.path} knows nothing: "
                "the checkpoint and the output folder do not belong together"
            )

    def write(self, name: str, batch_id: int, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self._folder(name, batch_id))
        return self.spark.read.schema(df.schema).parquet(self._folder(name, batch_id))

    def snapshots(self, names: list[str], batch_id: int, load) -> list[DataFrame]:
        """The tables that `load()` gives when the batch is first tried; the same on a replay."""
        if not all(self.is_marked(name, batch_id) for name in names):
            tables = dict(zip(names, load(), strict=True))
            at_once(self.spark, *(
                lambda n=n, t=t: self.write(n, batch_id, t.coalesce(1)) for n, t in tables.items()))
            for name in names:
                self.mark(name, batch_id)
        return [self.spark.read.parquet(self._folder(name, batch_id)) for name in names]

    def drop(self, name: str, batch_id: int) -> None:
        self.remove(self._folder(name, batch_id), self._marker(name, batch_id))

    def remove(self, *paths: str) -> None:
        for path in paths:
            files, folder = hadoop(self.spark, path)
            files.delete(folder, True)

    def names(self, batch_id: int, rows: DataFrame, columns: list[str]) -> DataFrame:
        """The distinct names of all batches up to this one, whose rows are given.

        Each batch writes the whole (small) table from its predecessor's.
        """
        name, every = "names", rows.select(columns)
        if self.is_marked(name, batch_id - 1):
            earlier = self.spark.read.schema(every.schema).parquet(self._folder(name, batch_id - 1))
            every = earlier.unionByName(every)
        written = self.write(name, batch_id, every.distinct().hint("rebalance"))
        self.mark(name, batch_id)
        return written


class Log:
    """Rows of all batches by time bucket, in segments.

    A segment is what one batch has written or merged: `<root>/b<batch>` or `<root>/m<batch>`, and in
    it a folder per bucket, below one per part where the log has parts. The manifest of a batch says
    for each folder (its key, as `tag=plain/bucket=472222`) in which segments it lies, and of which
    tier they are: rows of one batch are of tier 0, and FAN segments of a tier are merged into one
    of the next. So a bucket has at most FAN - 1 segments of each of a few tiers. How long a bucket
    is was settled by the first batch.
    """

    def __init__(self, state: State, root: str, parts: Iterable[str] = ("",), batch_id: int = 0,
                 bucket_ms: int = HOUR_MS, fan: int = FAN, expire_after: int | None = None):
        self.state, self.root, self.parts = state, root, [p and f"{p}/" for p in parts]
        self.fan, self.expire_after = fan, expire_after
        self.bucket_ms = self.manifest(batch_id - 1).get("bucket_ms", bucket_ms)

    def segment(self, batch_id: int) -> str:
        """Where a batch writes its own rows, by bucket."""
        return f"{self.state.path}/{self.root}/b{batch_id}"

    def write(self, batch_id: int, rows: DataFrame) -> DataFrame:
        """Write a batch's own rows (a log without parts); what was written."""
        by_bucket(rows, self.bucket_ms).write.mode("overwrite").partitionBy("bucket").parquet(self.segment(batch_id))
        written = self.state.spark.read.schema(rows.schema).parquet(self.segment(batch_id))
        return written.select(*rows.columns)

    def buckets(self, batch_id: int, *parts: str) -> list[int]:
        """Buckets of a batch's own rows."""
        found = set()
        for part in parts or self.parts:
            found |= {int(key.split("=")[-1]) for key in self._own_keys(batch_id, part)}
        return sorted(found)

    def _own_keys(self, batch_id: int, part: str) -> list[str]:
        part = part if not part or part.endswith("/") else f"{part}/"
        files, path = hadoop(self.state.spark, f"{self.segment(batch_id)}/{part}")
        if not files.exists(path):
            return []
        names = [str(s.getPath().getName()) for s in files.listStatus(path)]
        return [f"{part}{n}" for n in names if n.startswith("bucket=") and n[7:].lstrip("-").isdigit()]

    def _manifest_path(self, batch_id: int) -> str:
        return f"{self.state.path}/{self.root}/manifest-{batch_id}.json"

    def manifest(self, batch_id: int) -> dict:
        """What is known after a batch: `live` keys with their [tier, segment]s, `obsolete` paths."""
        files, path = hadoop(self.state.spark, self._manifest_path(batch_id))
        if not files.exists(path):
            return {"live": {}, "obsolete": []}
        stream = files.open(path)
        try:
            return json.loads(self.state.spark._jvm.org.apache.commons.io.IOUtils.toString(
                stream, "UTF-8"))
        finally:
            stream.close()

    def _save(self, batch_id: int, manifest: dict) -> None:
        files, path = hadoop(self.state.spark, self._manifest_path(batch_id))
        stream = files.create(path, True)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()

    def _paths(self, live: dict, keys: Iterable[str]) -> list[str]:
        return [f"{self.state.path}/{self.root}/{segment}/{key}"
                for key in keys for _, segment in live.get(key, [])]

    def paths(self, batch_id: int, buckets: list[int], reach_ms: int, *parts: str) -> list[str]:
        """Folders of earlier batches that rows of these buckets can look back to."""
        wanted = sorted({h - k for h in buckets for k in range(-(-reach_ms // self.bucket_ms) + 1)})
        live = self.manifest(batch_id - 1)["live"]
        found = [p and f"{p}/" for p in parts] or self.parts
        return self._paths(live, (f"{part}bucket={h}" for part in found for h in wanted))

    def read(self, batch_id: int, schema: T.StructType, buckets: list[int], reach_ms: int,
             *parts: str) -> DataFrame:
        """Rows of earlier batches in the buckets that these can look back to."""
        paths = self.paths(batch_id, buckets, reach_ms, *parts)
        if not paths:
            return self.state.spark.createDataFrame([], schema)
        return self.state.spark.read.schema(schema).parquet(*paths)

    def commit(self, batch_id: int, schema: T.StructType) -> None:
        """Take the batch's own rows into the manifest, merge what has piled up, forget what expired."""
        before = self.manifest(batch_id - 1)
        live = {key: [list(s) for s in segments] for key, segments in before["live"].items()}
        for part in self.parts:
            for key in self._own_keys(batch_id, part):
                live.setdefault(key, []).append([0, f"b{batch_id}"])
        obsolete = []
        for part in self.parts:
            due = {key: tier for key in live if key.startswith(f"{part}bucket=")
                   and (tier := self._due(live[key]))}
            if not due:
                continue
            merged = {key: [s for s in live[key] if s[0] < tier] for key, tier in due.items()}
            old = self._paths(merged, merged)
            rows = self.state.spark.read.schema(schema).parquet(*old)
            by_bucket(rows, self.bucket_ms).write.mode("overwrite").partitionBy("bucket").parquet(
                f"{self.state.path}/{self.root}/m{batch_id}/{part}")
            obsolete += old
            for key, tier in due.items():
                live[key] = [s for s in live[key] if s[0] >= tier] + [[tier, f"m{batch_id}"]]
        if self.expire_after is not None:
            for key in [k for k, segments in live.items()
                        if max(int(s[1:]) for _, s in segments) < batch_id - self.expire_after]:
                obsolete += self._paths(live, [key])
                del live[key]
        self._save(batch_id, {"bucket_ms": self.bucket_ms, "live": live, "obsolete": obsolete})

    def _due(self, segments: list) -> int:
        """The tier that a bucket's lower segments are to be merged into; 0 for none yet."""
        tier, extra = 0, 0
        while sum(t == tier for t, _ in segments) + extra >= self.fan:
            tier, extra = tier + 1, 1
        return tier

    def clean(self, batch_id: int) -> None:
        """After a batch is complete: remove what only batches before it can have read."""
        live = {s for segments in self.manifest(batch_id)["live"].values() for _, s in segments}
        gone = self.manifest(batch_id - 1)["obsolete"]
        self.state.remove(*gone)
        root = f"{self.state.path}/{self.root}"
        touched = {path[len(root) + 1:].split("/")[0] for path in gone} | {f"b{batch_id - 2}"}
        self.state.remove(*(f"{root}/{segment}" for segment in touched - live))
        self.state.remove(self._manifest_path(batch_id - 2))
