"""Operators 11 to 13: clustering and whitening of vectors, token counts by spliced chunks."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from bandwatch.llm import centroids, token_counts, whitening

from .helpers import LONG, empty, rough, table

INF, NAN = math.inf, math.nan
VECTORS = "vec_id long, embedding array<float>, label int, cluster string, x string, component string, dims string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash", "clash", "clash", "clash") for i, v in rows], VECTORS)


def points(rng, n, dims, groups=6):
    middles = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(groups)]
    return [[m + rng.gauss(0, 0.2) for m in rng.choice(middles)] for _ in range(n)]


# Centroid clustering


def brute_clusters(rows, dims, k, rounds, seed="2"):
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    key = lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    now = [x for _, x in sorted(kept, key=key)[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(now))
    for _ in range(rounds):
        mine = [near(x)[1] for _, x in kept]
        for j in range(len(now)):
            members = [x for (_, x), m in zip(kept, mine, strict=True) if m == j]
            if members:
                now[j] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    found = [(i, *near(x)[::-1]) for i, x in kept]
    total = sum(d for *_, d in found)
    return sorted(
        ((i, j, d, sum(e for _, m, e in found if m == j), total, hashlib.sha256(",".join(map(str, now[j])).encode()).hexdigest()) for i, j, d in found),
        key=str,
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = list(enumerate(points(rng, 150, 4)))
    rows += [(200 + i, rows[7][1]) for i in range(60)]  # one vector many times
    rows += [(300, None), (301, []), (302, [1.0] * 5), (303, [1.0, None, 0.0, 0.0]), (304, [NAN, 0.0, 0.0, 0.0]), (305, [INF, 0.0, 0.0, 0.0])]
    rows += [(306, rows[1][1]), (306, rows[1][1]), (306, rows[2][1]), (None, rows[3][1]), (None, rows[4][1])]
    got = centroids.summary(*centroids.cluster(vectors(spark, rows), dims=4, clusters=9))
    assert sorted(map(tuple, got.collect()), key=str) == brute_clusters(rows, 4, 9, 5)


def test_clusters_with_ties_and_few_rows(spark):
    grid = [(i, [float(i % 3), float(i // 3 % 3)]) for i in range(18)]  # equal distances, equal starts
    got = centroids.summary(*centroids.cluster(vectors(spark, grid), dims=2, clusters=7, rounds=3))
    assert sorted(map(tuple, got.collect()), key=str) == brute_clusters(grid, 2, 7, 3)
    few = vectors(spark, grid[:3])
    assert {r.distance for r in centroids.cluster(few, dims=2, clusters=40)[0].collect()} == {0}
    assert centroids.summary(*centroids.cluster(few.limit(0))).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        centroids.cluster(vectors(spark, [(1, [1e30, 0.0])]), dims=2)


def test_bounds_never_exceed_distances_and_save_measuring():
    rng = random.Random(5)
    x = np.floor(256 * np.array(points(rng, 3000, 16, groups=30))).astype(np.int64)
    start = x[:30]
    pivots = centroids.Pivots(start)
    near = centroids.distances(x, pivots.points).astype("f4").astype(float)
    moved = start + np.array([[rng.randint(-9, 9) for _ in range(16)] for _ in range(30)])
    true = centroids.distances(x, moved)
    assert (pivots.below(near, moved) <= true).all()
    cluster, distance, measured = centroids.assign(x, near, moved, pivots)
    assert (cluster == (true**2).round().argmin(1)).all()
    assert (distance == (true**2).round().min(1)).all()
    assert measured < 0.5 * true.size


def test_exact_distances_of_large_numbers():
    x = np.array([[centroids.LARGEST - 1] * 64], np.int64)
    assert centroids.squared(x, -x[0]).tolist() == [sum((2 * (centroids.LARGEST - 1)) ** 2 for _ in range(64))]


# Whitening


def spectrum(kind, dims):
    return {
        "one": np.ones(dims), "falling": 0.5 ** np.arange(dims), "pairs": np.repeat(np.arange(dims // 2) + 1.0, 2),
        "close": 1 + 1e-9 * np.arange(dims), "cluster": np.r_[[100.0] * 15, np.ones(dims - 15)], "rank": np.r_[[5.0, 4.0], np.zeros(dims - 2)],
        "edge": np.r_[[2.0] * 17, np.linspace(0.1, 1, dims - 17)],
    }[kind]


@pytest.mark.parametrize("kind", ["one", "falling", "pairs", "close", "cluster", "rank", "edge"])
def test_components_of_known_spectra(kind):
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.standard_normal((48, 48)))
    v = (q * spectrum(kind, 48)) @ q.T
    v = (v + v.T) / 2
    values, vectors_ = whitening.components(v)
    want = np.linalg.eigvalsh(v)[::-1][:16]
    want = want[want > 1e-12 * np.trace(v)]
    assert len(values) == len(want) and np.allclose(values, want, rtol=1e-10, atol=1e-14 * want[0])
    assert np.abs(vectors_.T @ vectors_ - np.eye(len(values))).max() < 1e-13
    assert np.abs(v @ vectors_ - vectors_ * values).max() < 1e-12 * want[0] * 48


def test_inertia_counts_eigenvalues():
    rng = np.random.default_rng(4)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    diagonal, side = whitening.tridiagonal(a)
    values = np.linalg.eigvalsh(a)
    for s in [*(values[:-1] + values[1:]) / 2, values[0] - 1, values[-1] + 1]:
        assert whitening.inertia_above(diagonal, side, s) == (values > s).sum()


def test_contour_asks_for_what_inertia_counts():
    v = np.diag([5.0, 4.0, 3.0, 2.0, 1.0])
    assert np.allclose(whitening.feast(v, 2.5, 6, 3)[0], [3, 4, 5])
    with pytest.raises(ArithmeticError):
        whitening.feast(v, 2.5, 6, 4)


def test_whitening_equals_plain_version(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1 + j) for j in range(6)]) for i in range(120)]
    rows += [(500 + i, rows[0][1]) for i in range(200)]  # counted once in the fit
    odd = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [NAN] * 6), (903, [-INF] * 6), (904, []), (905, [1.0])]
    got = whitening.whiten(vectors(spark, [*rows, *odd, (None, rows[1][1])]), wanted=4).collect()
    assert len(got) == 4 * 321
    x = {i: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for i, v in rows}
    distinct = sorted({tuple(v) for v in x.values()})
    n = len(distinct)
    sums = [sum(c) for c in zip(*distinct, strict=True)]
    mean = [Fraction(s, n) for s in sums]
    cov = np.array([[float(sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in distinct) / n) for j in range(6)] for i in range(6)])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    signs = {}
    for r in got:
        v, c = x[1 if r.vec_id is None else r.vec_id], r.component - 1
        assert r.n == n and r.identity_error < 1e-9
        assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))
        assert math.isclose(r.explained, e[c] / np.trace(cov), rel_tol=1e-9)
        want = float(sum(float(a - m) * b for a, m, b in zip(v, mean, u[:, c], strict=True))) / math.sqrt(e[c])
        if abs(want) > 1e-3:
            sign = signs.setdefault(c, math.copysign(1, want * r.whitened))
            assert math.isclose(r.whitened * sign, want, rel_tol=1e-6), (r, want)
        else:
            assert abs(r.whitened) < 2e-3


def test_whitening_of_little(spark):
    whiten = lambda rows: whitening.whiten(vectors(spark, rows)).collect()
    assert whiten([(1, None), (2, [NAN])]) == []
    assert whitening.whiten(vectors(spark, [(1, [1.0])]).limit(0)).count() == 0
    assert whiten([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []  # no variance
    two = whiten([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [2.0, 4.0])])  # rank 1
    assert {(r.component, r.n, round(abs(r.whitened), 9), round(r.explained, 9)) for r in two} == {(1, 2, 1.0, 1.0)}


def test_whole_numbers_keep_their_width_and_sums():
    for row in ([1, -5, 32767], [-32768, 0, 1], [1 << 20, 0, 0], [-(1 << 40), 1, 2]):
        data = whitening.packed(np.array(row, np.int64))
        assert whitening.unpacked([data, data], 3).tolist() == [row, row]
    big = np.array([[1 << 50, -3], [1 << 50, 7]], np.int64)
    assert whitening.gram(big).tolist() == [[2 << 100, 4 << 50], [4 << 50, 58]]
    fit = whitening.Fit(10**9, np.zeros(2, np.int64), np.zeros(2, object), np.ones(2), np.eye(2), np.ones(2) / 2, 0.0)
    assert fit.deviation(np.array([[1, 0], [100, 0]])) == [10**18, None]


# Token counts


def whole_counts(texts):
    c = token_counts.Counter(token_counts.default_path())
    return [len(c.tokenizer.encode(t or "", add_special_tokens=False)) for t in texts]


PARTS = ["a", "é", "日本", "  ", "\n", " ", "'re", "'ll", "1", "!!", "<|endoftext|>", "<|endo", "hello world ", "x" * 50, " " * 40, "aaaa" * 60, "'", "\t", " 'll "]


@pytest.mark.parametrize("step, overlap", [(64, 16), (64, 64), (40, 1), (200, 30)])
def test_spliced_counts_equal_whole_ones(step, overlap):
    rng = random.Random(step + overlap)
    c = token_counts.Counter(token_counts.default_path(), step, overlap)
    texts = ["".join(rng.choice(PARTS[: rng.randint(2, len(PARTS))]) for _ in range(rng.randint(1, 150))) for _ in range(300)]
    assert c.counts(texts) == whole_counts(texts)
    assert c.widened > 0


def test_overlaps_widen_over_one_endless_word():
    c = token_counts.Counter(token_counts.default_path(), 1000, 50)
    texts = ["z" * 40_000, " " * 40_000, "word " * 3 + "日本語" * 9_000 + " end", "<|endoftext|>" * 4_000, "a b " * 9_000 + "q" * 9_000]
    assert c.counts(texts) == whole_counts(texts)
    assert c.widened < 60


def test_token_counts_of_rough_rows(spark):
    got = sorted(map(tuple, token_counts.count(rough(spark), step=500, overlap=20).collect()), key=str)
    texts = [(r.doc_id, r.text) for r in rough(spark).collect()]
    counts = whole_counts([t for _, t in texts])
    assert got == sorted(((i, len((t or "").encode()), n, n > 1024) for (i, t), n in zip(texts, counts, strict=True)), key=str)
    assert any(over for *_, over in got)
    assert token_counts.count(empty(spark)).count() == 0
    assert token_counts.count(table(spark, [LONG[:30], None]), limit=2).where("over_limit").count() == 1
