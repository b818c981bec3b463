"""Centroid clustering in whole numbers: exact rounds of k-means, distances ruled out by Ptolemaic pivots.

For a vector v, a centroid c and two fixed pivots p, s, Ptolemy's inequality gives

    |v c| >= ( | |v p| |c s| - |v s| |c p| | ) / |p s|

Pivots are the centroids of an anchor round. A vector's distances to them are measured once, which assigns it in that
round, and written beside it; they serve all rounds up to the next anchor. A centroid is paired with its own place as a
pivot, from which it moves little, and with a few others, near to far. In a round, the centroid of the least bound is
measured exactly; then, number by number, those whose bound is not above the best distance so far. Bounds are lowered
by more than all rounding could raise them, so a centroid that could win or tie is always measured, in whole numbers:
the result is that of measuring all.

Tasks hand out one sum per cluster and component in a round; the driver sees the centroids (k rows) only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

DIMS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, "2"
ANCHORS = (0, 2)  # rounds whose centroids become the pivots
PARTNERS = 5  # pivots that a centroid's own one is paired with
ROWS = 4096
#: Cached distances are 32-bit floats (2**-24 off at most); four times what they and the double sums could amount to.
SLACK = 2.0**-21
#: Components beyond it would leave 64 bits as a squared distance.
LARGEST = 1 << 27
#: Below it, sums of 64 squared differences are exact in doubles.
EXACT = 1 << 22

STAGED = "vec_id {id}, x binary, near binary"


def kept(vectors: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """vec_id and vector (doubles) of rows with exactly `dims` components, none null or non-finite."""
    vector = F.col(vector_col).cast("array<double>")
    bad = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    picked = vectors.select(F.col(id_col).alias("vec_id"), vector.alias("vector"))
    return picked.where(F.when(F.size("vector") == dims, ~bad).otherwise(False))


def whole(column: pa.Array, dims: int, scale: float = SCALE) -> np.ndarray:
    """floor(scale * c) of each component, a row per vector."""
    values = np.floor(scale * np.asarray(column.flatten(), float)).reshape(len(column), dims)
    if len(values) and np.abs(values).max() >= LARGEST:
        raise OverflowError(f"components of {LARGEST / scale:.0f} and more have no squared distance in 64 bits")
    return values.astype(np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows, whole numbers in and out."""
    small = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < EXACT
    diff = (x - c).astype(float if small else np.int64)
    return np.einsum("ij,ij->i", diff, diff).astype(np.int64)


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distance of each row to each point."""
    found = np.empty((len(x), len(points)))
    for j, p in enumerate(points):
        found[:, j] = np.sqrt(squared(x, p))
    return found


class Pivots:
    """Fixed pivots, one per centroid, each with its partners: the pairs whose bounds are taken."""

    def __init__(self, points: np.ndarray, partners: int = PARTNERS):
        self.points, self.between = points, distances(points, points)
        self.pairs = []
        for j, far in enumerate(self.between):
            order = [s for s in np.argsort(far, kind="stable") if far[s] > 0]
            picked = np.unique(np.linspace(0, len(order) - 1, min(partners, len(order))).astype(int)) if order else []
            self.pairs += [(j, int(order[i])) for i in picked]

    def below(self, near: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """For each row (by its cached distances) and centroid a distance that the true one is not below."""
        far = distances(centroids, self.points)
        low = np.zeros((len(near), len(centroids)))
        for p, s in self.pairs:
            a, b = near[:, p] * far[p, s], near[:, s] * far[p, p]
            bound = (np.abs(a - b) - (a + b) * SLACK) / self.between[p, s]
            np.maximum(low[:, p], bound, out=low[:, p])
        return low


def assign(x: np.ndarray, near: np.ndarray, centroids: np.ndarray, pivots: Pivots) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row (ties: the smaller number), its squared distance, and how many were measured."""
    low = pivots.below(near, centroids)
    first = low.argmin(1)
    cluster, best, measured = first.copy(), squared(x, centroids[first]), len(x)
    low *= low * (1 - 2.0**-40)  # bounds on squares, lowered for this rounding
    for j in range(len(centroids)):
        rows = np.flatnonzero((low[:, j] <= best) & (first != j))
        if not len(rows):
            continue
        measured += len(rows)
        d = squared(x[rows], centroids[j])
        closer = (d < best[rows]) | ((d == best[rows]) & (j < cluster[rows]))
        best[rows[closer]], cluster[rows[closer]] = d[closer], j
    return cluster, best, measured


def _parts(batches: Iterable[pa.RecordBatch], dims: int, n_pivots: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Ids, vectors and cached distances of at most ROWS rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            x = np.frombuffer(b"".join(part.column(1).to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)
            near = np.frombuffer(b"".join(part.column(2).to_pylist()), "<f4").reshape(-1, n_pivots).astype(float)
            yield part.column(0), x, near


def _cached(ids: pa.Array, x: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
    binary = [[r.tobytes() for r in m] for m in (x.astype("<i4"), near.astype("<f4"))]
    return pa.RecordBatch.from_arrays([ids, *(pa.array(b, pa.binary()) for b in binary)], ["vec_id", "x", "near"])


def _digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def starts(rows: DataFrame, clusters: int, seed: str, dims: int, scale: float) -> np.ndarray:
    """The kept vectors with the smallest hashes of seed and id; equal ids by vector, rows without an id last."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(order.asc_nulls_last(), "vector").limit(clusters).select("vector").collect()
    if not first:
        return np.zeros((0, dims), np.int64)
    return whole(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), dims, scale)


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, clusters: int = CLUSTERS,
    rounds: int = ROUNDS, seed: str = SEED, scale: float = SCALE, anchors: tuple[int, ...] = ANCHORS,
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance of each kept row; the final centroids).

    Rows of another length, null ones and those with null or non-finite components are left out. Repeated rows count
    each. With fewer kept rows than clusters, each starts one. An empty table gives no rows. Components of 524,288 and
    more raise OverflowError: their squared distances do not fit 64 bits.
    """
    rows = kept(vectors, id_col, vector_col, dims)
    id_type = dict(rows.dtypes)["vec_id"]
    centroids = starts(rows, clusters, seed, dims, scale)
    pivots = Pivots(centroids)

    def plain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = whole(part.column(1), dims, scale)
                yield _cached(part.column(0), x, distances(x, pivots.points))

    def anchored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, _ in _parts(batches, dims, len(centroids)):
            yield _cached(ids, x, distances(x, pivots.points))

    def partial(now: np.ndarray, fixed: Pivots):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros((len(now), dims), np.int64), np.zeros(len(now), np.int64)
            for _, x, near in _parts(batches, dims, len(now)):
                found, _, _ = assign(x, near, now, fixed)
                order = np.argsort(found, kind="stable")
                who, at = np.unique(found[order], return_index=True)
                total[who] += np.add.reduceat(x[order], at)
                count += np.bincount(found, minlength=len(now))
            who = np.flatnonzero(count)
            every = np.concatenate([total, count[:, None]], axis=1)[who]
            places = np.tile(np.arange(dims + 1, dtype=np.int32), len(who))
            columns = [np.repeat(who.astype(np.int32), dims + 1), places, every.reshape(-1)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cluster", "place", "total"])

        return run

    cached = staged(rows.mapInArrow(plain, STAGED.format(id=id_type)))
    for i in range(rounds if len(centroids) else 0):
        if i and i in anchors:
            pivots = Pivots(centroids)
            cached = staged(cached.mapInArrow(anchored, STAGED.format(id=id_type)))
        # one row per task, cluster and component, the last one the count; decimals hold sums of any number of rows
        sums = cached.mapInArrow(partial(centroids, pivots), "cluster int, place int, total long")
        moved = sums.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
        total = {(r["cluster"], r["place"]): int(r["total"]) for r in moved}
        centroids = np.array([[total[j, i] // total[j, dims] for i in range(dims)] if (j, dims) in total else c.tolist() for j, c in enumerate(centroids)])

    def last(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, near in _parts(batches, dims, len(centroids)):
            found, distance, _ = assign(x, near, centroids, pivots)
            yield pa.RecordBatch.from_arrays([ids, pa.array(found.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return cached.mapInArrow(last, f"vec_id {id_type}, cluster int, distance long"), centroids


def summary(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """assigned with each cluster's and the total sum of distances, and a digest of the cluster's centroid."""
    assigned = staged(assigned)
    sums = {r["cluster"]: r["d"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    facts = [(j, sums.get(j, 0), sum(sums.values()), _digest(c)) for j, c in enumerate(centroids)]
    told = assigned.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(dims: int = DIMS, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED, scale: int = SCALE) -> str:
    """The same for DuckDB: all distances of every round."""
    parts = [
        f"""kept AS (SELECT vec_id, [CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT) FOR e IN embedding] AS x
  FROM embeddings WHERE len(embedding) = {dims} AND len([e FOR e IN embedding IF e IS NOT NULL AND isfinite(e)]) = {dims})""",
        f"""c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) - 1 AS cluster, x FROM kept
  QUALIFY cluster < {clusters})""",
    ]
    near = """a{i} AS (SELECT k.vec_id, k.x, min(struct_pack(distance := list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(k.x, c.x)]),
  cluster := c.cluster)) AS best FROM kept k CROSS JOIN c{i} c GROUP BY k.vec_id, k.x)"""
    for i in range(rounds):
        parts.append(near.format(i=i))
        parts.append(f"""m{i} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY d) AS x FROM
  (SELECT cluster, d, CAST(sum(v) AS HUGEINT) AS s, CAST(count(*) AS HUGEINT) AS n FROM
    (SELECT best.cluster AS cluster, unnest(x) AS v, generate_subscripts(x, 1) AS d FROM a{i}) GROUP BY cluster, d) GROUP BY cluster)""")
        parts.append(f"c{i + 1} AS (SELECT c.cluster, CAST(coalesce(m.x, c.x) AS BIGINT[]) AS x FROM c{i} c LEFT JOIN m{i} m ON m.cluster = c.cluster)")
    parts.append(near.format(i=rounds))
    return "WITH " + ",\n".join(parts) + f"""
SELECT a.vec_id, CAST(c.cluster AS INTEGER) AS cluster, CAST(a.best.distance AS BIGINT) AS distance,
  CAST(sum(a.best.distance) OVER (PARTITION BY c.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.best.distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.best.cluster"""


ORACLE = _oracle()
