"""Semantic classes against all pairs, on spread and on crowded vectors."""

import numpy as np
import pytest

from assayer.operators import crosspolytope as X, dedup


def brute(points, threshold):
    known = X.Joined()
    for i, j in zip(*np.nonzero(np.triu(points @ points.T >= threshold, 1))):
        known.add(int(i), int(j))
    lowest = {}
    for i in range(len(points)):
        lowest.setdefault(known.top(i), i)
    return {i: lowest[known.top(i)] for i in range(len(points))}


def unit(points):
    return points / np.linalg.norm(points, axis=1)[:, None]


def made(rng, n, dims=48):
    """Spread vectors, each tenth with partners around a cosine of 0.85, chains included."""
    points = unit(rng.standard_normal((n, dims)))
    for i in range(0, n - 3, 10):
        for j in (1, 2):
            side = rng.standard_normal(dims)
            side -= (side @ points[i + j - 1]) * points[i + j - 1]
            c = rng.uniform(0.8, 0.95)
            points[i + j] = c * points[i + j - 1] + np.sqrt(1 - c * c) * side / np.linalg.norm(side)
    return unit(points)


def classes(spark, points, **options):
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id bigint, v array<double>")
    got = {r.id: r.component for r in X.classes_of(frame, 0.85, 0.9999, **options).collect()}
    return {i: got.get(i, i) for i in range(len(points))}


@pytest.mark.parametrize("n", [40, 2500])
def test_against_all_pairs(spark, n):
    points = made(np.random.default_rng(n), n)
    assert classes(spark, points) == brute(points, 0.85)


def test_crowds_of_near_copies(spark):
    """A third of all rows around one vector and another crowd beside it, joined by one stray; buckets far above the bound."""
    rng = np.random.default_rng(2)
    centre = unit(rng.standard_normal((1, 32)))
    other = unit(centre + 0.9 * unit(rng.standard_normal((1, 32))))
    crowd = unit(np.repeat(centre, 300, axis=0) + 0.02 * rng.standard_normal((300, 32)))
    beside = unit(np.repeat(other, 150, axis=0) + 0.02 * rng.standard_normal((150, 32)))
    points = np.concatenate([crowd, beside, unit(centre + other), made(rng, 450, 32)])
    want = brute(points, 0.85)
    assert classes(spark, points, crowd=40, core=4) == want == classes(spark, points) and want[300] == 0


def test_work_per_vector_is_bounded():
    """Rows and comparisons of unrelated vectors per vector, at 1 to 10**6 times the rows; recall is the same throughout."""
    for count in (10**3, 10**4, 10**5, 10**6, 10**9):
        hashes, tables = X.tables_for(count, 0.85, 0.9999)
        assert 1 - (1 - X.agreement(0.85) ** hashes) ** tables >= 0.9999
        assert tables * count / (2 * X.AXES) ** hashes < 4000 and tables < 1500
    points = unit(np.random.default_rng(5).standard_normal((20_000, 64)))
    hashes, tables = X.tables_for(len(points), 0.85, 0.9999)
    axes = np.random.default_rng(7).standard_normal((64, tables * hashes * X.AXES))
    code = X._largest((points @ axes).reshape(len(points), tables, hashes, X.AXES))
    pairs = sum((np.unique((code[:, t] * 128 ** np.arange(hashes)).sum(axis=1), return_counts=True)[1].astype(float) ** 2).sum() for t in range(tables))
    assert pairs / len(points) < 20_000 / 8


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1e-30, 0.0]), (3, [1e30, 1e29]), (4, [0.0, 0.0]), (5, None), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [0.0, 1.0]), (9, [1.0, 0.0]), (10, None), (11, [1.0, 0.0, 0.0]), (12, [float("inf"), 1.0]), (13, [])]
    got = {r.vec_id: r.cluster for r in dedup.semantic_dedup(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 1, 10: 10, 11: 11, 12: 12, 13: 13}
    assert dedup.semantic_dedup(spark.createDataFrame([], "vec_id bigint, embedding array<double>")).collect() == []
