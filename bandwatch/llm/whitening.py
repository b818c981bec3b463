"""Embedding whitening by principal components, found by FEAST contour integration.

Vectors become whole numbers, and the covariance of the distinct ones is summed exactly: first their sums, then, around
the whole part of the mean, their products, as decimals that Spark adds up. What is left to the driver is a matrix of
dims x dims. Its eigenvalues are counted by inertia (signs of the pivots of V - s), which yields slices in gaps of the
spectrum that hold the largest ones. In each slice the projector onto its eigenvectors is a contour integral of the
resolvent: a quadrature of complex shifted solves filters a block of vectors, Rayleigh-Ritz extracts eigenpairs from it,
and this is repeated until the residuals vanish. A slice is done only if it holds as many as its inertia count says.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
ROWS = 4096
SLICE = 8  # eigenvalues that a contour takes in, where the gaps allow it
NODES = 8  # quadrature points on the upper half of the circle
SWEEPS = 40
#: Eigenvalues below this share of the trace are rounding: such components are not returned.
RANK = 1e-12
#: Whole numbers beyond it are no longer exact as products of entries.
LARGEST = 1 << 52


# Eigenvalues in an interval


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and side diagonal of a symmetric matrix after Householder reflections, with the same eigenvalues."""
    a = matrix.copy()
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if length == 0:
            continue
        v[0] += math.copysign(length, v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :, :] -= 2 * np.outer(v, v @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy()


def inertia_above(diagonal: np.ndarray, side: np.ndarray, s: float) -> int:
    """How many eigenvalues lie above s: the positive pivots of T - s."""
    tiny = np.finfo(float).tiny
    count, pivot = 0, 1.0
    for i, d in enumerate(diagonal):
        pivot = d - s - (side[i - 1] ** 2 / pivot if i else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        count += pivot > 0
    return count


def cut_points(above: Callable[[float], int], bound: float, wanted: int, size: int, per_slice: int = SLICE) -> list[float]:
    """Falling bounds of slices that hold the `wanted` largest eigenvalues: each lies in a gap of the spectrum.

    The k-th eigenvalue is enclosed by bisection on the count. A bound between the k-th and the next one is taken where
    they are told apart; of the places allowed, the one of the widest gap.
    """

    def enclose(k: int) -> tuple[float, float]:
        low, high = -bound, bound
        while high - low > bound * 1e-9:
            middle = (low + high) / 2
            low, high = (middle, high) if above(middle) >= k else (low, middle)
        return low, high

    known: dict[int, tuple[float, float]] = {}

    def gap(k: int) -> tuple[float, float]:
        """Width and middle of the gap below the k-th eigenvalue."""
        if k >= size:
            return math.inf, -bound
        for i in (k, k + 1):
            if i not in known:
                known[i] = enclose(i)
        return known[k][0] - known[k + 1][1], (known[k][0] + known[k + 1][1]) / 2

    cuts, done = [bound], 0
    while done < wanted:
        left = wanted - done
        if left > per_slice:
            best = max(range(done + per_slice // 2, done + per_slice + 1), key=gap)
        else:
            best = wanted  # a few more than wanted, where the last ones are too close to part
        while gap(best)[0] <= bound * 1e-7:
            best += 1
        cuts.append(gap(best)[1])
        done = best
    return cuts


def feast(v: np.ndarray, low: float, high: float, expected: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """All eigenvalues of v within (low, high] and their unit eigenvectors; `expected` is their number by inertia."""
    size, norm = len(v), np.linalg.norm(v)
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    angles = math.pi / 2 * (1 + nodes)  # upper half; the lower one gives the conjugates
    centre, radius = (low + high) / 2, (high - low) / 2
    block = min(size, max(expected + 4, 3 * expected // 2))
    rng = np.random.default_rng(seed)
    while True:
        y = rng.standard_normal((size, block))
        for _ in range(SWEEPS):
            filtered = np.zeros_like(y)
            for angle, weight in zip(angles, weights, strict=True):
                turn = np.exp(1j * angle)
                solved = np.linalg.solve((centre + radius * turn) * np.eye(size) - v, y.astype(complex))
                filtered += weight / 2 * (radius * turn * solved).real
            q, strength, _ = np.linalg.svd(filtered, full_matrices=False)
            q = q[:, strength > strength[0] * 1e-14]
            values, ritz = np.linalg.eigh(q.T @ v @ q)
            y = q @ ritz
            inside = (values > low) & (values <= high)
            residual = np.linalg.norm(v @ y[:, inside] - y[:, inside] * values[inside], axis=0)
            if inside.sum() == expected and residual.max(initial=0) <= 1e-14 * norm * math.sqrt(size):
                return values[inside], y[:, inside]
        if block == size:
            raise ArithmeticError(f"{inside.sum()} eigenvalues found where inertia counts {expected}")
        block = min(size, 2 * block)  # too small for what lies in and near the contour


def components(v: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a covariance, falling, and their unit eigenvectors as columns.

    As many as asked for and as the rank allows. The entry of largest size is positive.
    """
    size, trace = len(v), float(np.trace(v))
    if not size or not trace > 0:
        return np.zeros(0), np.zeros((size, 0))
    scaled = v / trace
    diagonal, side = tridiagonal(scaled)
    around = np.abs(np.concatenate([[0], side])) + np.abs(np.concatenate([side, [0]]))
    bound = float((np.abs(diagonal) + around).max()) * 1.01
    above = lambda s: inertia_above(diagonal, side, s)
    cuts = cut_points(above, bound, min(wanted, size), size)
    found = []
    for i, (high, low) in enumerate(zip(cuts, cuts[1:], strict=False)):
        low = low if low > -bound else -bound * 1.01
        found.append(feast(scaled, low, high, above(low) - above(high), i)[1])
    # slices side by side: one more Rayleigh-Ritz step makes them orthogonal to each other as well
    q, _ = np.linalg.qr(np.concatenate(found, axis=1))
    values, ritz = np.linalg.eigh(q.T @ scaled @ q)
    order = np.argsort(-values, kind="stable")[:wanted]
    order = order[values[order] > RANK]
    vectors = q @ ritz[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return values[order] * trace, vectors * signs


# Whole numbers and their sums


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vector (doubles) of rows whose vector is not null and holds no null or non-finite entry."""
    bad = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    picked = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return picked.where(F.col("vector").isNotNull() & ~bad)


def whole(values: np.ndarray) -> np.ndarray:
    """floor(64 c), without the shift that all share."""
    y = np.floor(SCALE * values)
    if len(y) and np.abs(y).max(initial=0) >= LARGEST:
        raise OverflowError(f"entries of {LARGEST // SCALE} and more are no whole numbers in doubles")
    return y.astype(np.int64)


def packed(row: np.ndarray) -> bytes:
    """A vector's bytes; equal vectors have equal ones, in the width that its largest entry asks for."""
    largest = max(abs(int(row.max(initial=0))), abs(int(row.min(initial=0))))
    width = 2 if largest < 1 << 15 else 4 if largest < 1 << 31 else 8
    return bytes([width]) + row.astype(f"<i{width}").tobytes()


def unpacked(data: list[bytes], dims: int) -> np.ndarray:
    out = np.empty((len(data), dims), np.int64)
    widths = np.array([d[0] for d in data])
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        out[rows] = np.frombuffer(b"".join(data[i][1:] for i in rows), f"<i{width}").reshape(-1, dims)
    return out


def gram(z: np.ndarray) -> np.ndarray:
    """Exact z' z of whole numbers."""
    largest = int(np.abs(z).max(initial=0))
    bound = largest * largest * len(z)
    if bound < 1 << 53:
        return (z.astype(float).T @ z.astype(float)).astype(np.int64).astype(object)
    if bound < 1 << 63:
        return (z.T @ z).astype(object)
    z = z.astype(object)
    return z.T @ z


def summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], length: int, dims: int, exact: bool = True) -> list:
    """Sum of part(vectors) over all packed vectors: added up within tasks, then by Spark, place by place."""
    kind = "decimal(38,0)" if exact else "double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length, object if exact else float)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                total = total + part(unpacked(batch.column(0).slice(at, ROWS).to_pylist(), dims)).reshape(-1)
        places = np.flatnonzero(total)
        # whole numbers travel as text: they may be longer than 64 bits
        told = pa.array([str(x) for x in total[places]]) if exact else pa.array(total[places])
        yield pa.RecordBatch.from_arrays([pa.array(places.astype(np.int32)), told], ["place", "total"])

    sums = rows.select("x").mapInArrow(run, f"place int, total {'string' if exact else 'double'}")
    found = [0 if exact else 0.0] * length
    for r in sums.groupBy("place").agg(F.sum(F.col("total").cast(kind)).alias("total")).collect():
        found[r["place"]] = int(r["total"]) if exact else r["total"]
    return found


class Fit:
    """Mean, components and eigenvalues of the distinct vectors, and how well they whiten these."""

    def __init__(self, n: int, middle: np.ndarray, rest: np.ndarray, values: np.ndarray, vectors: np.ndarray, explained: np.ndarray, error: float):
        self.n, self.middle, self.rest = n, middle, rest  # the mean is middle + rest / n, 0 <= rest < n
        self.values, self.vectors, self.explained, self.error = values, vectors, explained, error
        self.scaled = vectors / np.sqrt(values)

    def whiten(self, y: np.ndarray) -> np.ndarray:
        """Rows on the components, each of variance 1."""
        return (y - self.middle - self.rest.astype(float) / self.n) @ self.scaled

    def deviation(self, y: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; None beyond 64 bits."""
        z = y - self.middle
        reach = self.n * (int(np.abs(z).max(initial=0)) + 1)
        if reach * reach * z.shape[1] < 1 << 63:
            return ((self.n * z - self.rest.astype(np.int64)) ** 2).sum(1).tolist()
        exact = ((self.n * z.astype(object) - self.rest) ** 2).sum(1)
        return [x if x < 1 << 63 else None for x in exact]


def fit(rows: DataFrame, wanted: int = COMPONENTS) -> Fit | None:
    """From usable rows; None if there are none. Rows of another length than most distinct ones have take no part."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                column = batch.column(0).slice(at, ROWS)
                y, ends = whole(np.asarray(column.flatten(), float)), np.cumsum(np.asarray(column.value_lengths()))
                parts = np.split(y, ends[:-1])
                yield pa.RecordBatch.from_arrays([pa.array([packed(p) for p in parts], pa.binary()), pa.array([len(p) for p in parts], pa.int32())], ["x", "dims"])

    distinct = staged(rows.select("vector").mapInArrow(pack, "x binary, dims int").distinct())
    lengths = distinct.groupBy("dims").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if lengths is None:
        return None
    dims, n = lengths["dims"], lengths["n"]
    distinct = distinct.where(F.col("dims") == dims)
    sums = summed(distinct, lambda y: y.astype(object).sum(0) if len(y) else np.zeros(dims, object), dims, dims)
    middle, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], object)
    products = summed(distinct, lambda y: gram(y - middle), dims * dims, dims)
    # sums of products around the whole part of the mean, less what the rest of the mean adds: whole numbers throughout
    cov = np.empty((dims, dims))
    for i in range(dims):
        for j in range(dims):
            cov[i, j] = float(Fraction(n * products[i * dims + j] - rest[i] * rest[j], n * n))
    trace = sum((Fraction(n * products[i * dims + i] - rest[i] * rest[i], n * n) for i in range(dims)), Fraction(0))
    values, vectors = components(cov, wanted)
    k = len(values)
    told = Fit(n, middle, rest, values, vectors, values / float(trace) if k else values, 0.0)
    if k:

        def moments(y: np.ndarray) -> np.ndarray:
            w = told.whiten(y)
            return np.concatenate([w.sum(0), (w.T @ w).reshape(-1)])

        got = np.array(summed(distinct, moments, k + k * k, dims, exact=False)) / n
        told.error = float(np.abs(got[k:].reshape(k, k) - np.outer(got[:k], got[:k]) - np.eye(k)).max())
    return told


OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for each usable row and component.

    Rows whose vector is null or holds null or non-finite entries are left out, and rows of another length than most
    distinct vectors have (of equally common lengths the larger one counts). Repeated rows are whitened each, and fitted
    once. Components without variance are not returned: fewer than `wanted` where the rank is lower, no rows where all
    vectors are equal or the table is empty. A deviation beyond 64 bits is null.
    """
    rows = usable(vectors, id_col, vector_col)
    schema = f"vec_id {dict(rows.dtypes)['vec_id']}, {OUT}"
    told = fit(rows, wanted)
    if told is None or not len(told.values):
        return vectors.sparkSession.createDataFrame([], schema)
    k, dims = len(told.values), len(told.middle)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                m = part.num_rows
                y = whole(np.asarray(part.column(1).flatten(), float)).reshape(m, dims)
                each = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, told.n)),
                        pa.array(told.deviation(y), pa.int64()).take(pa.array(each)),
                        pa.array(told.whiten(y).reshape(-1)),
                        pa.array(np.tile(told.explained, m)),
                        pa.array(np.full(m * k, told.error)),
                    ],
                    schema=None,
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.where(F.size("vector") == dims).mapInArrow(run, schema)
