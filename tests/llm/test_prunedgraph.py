import math
import random

import numpy as np

from assayer.llm import prunedgraph


def brute(rows, queries, k):
    good = {i: v for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in queries:
        if q in good:
            a = np.array(good[q], dtype=float)
            scored = [(-(a @ (b := np.array(v, dtype=float))) / (math.sqrt(a @ a) * math.sqrt(b @ b)), i) for i, v in good.items() if i != q and len(v) == len(a)]
            out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def run(spark, rows, queries, **options):
    vectors = spark.createDataFrame([(i, v, 1.0, 2) for i, v in rows], "vec_id bigint, embedding array<float>, score double, shard int")
    found = {}
    for r in prunedgraph.nearest(vectors, vectors.where(vectors.vec_id.isin(list(queries))), **options).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(found[r.query_id])
    return found


def test_recall_and_scores(spark):
    rng = np.random.default_rng(15)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=16))]) for i in range(1500)]
    queries = [i for i, _ in rows if i % 50 == 0]
    got, exact = run(spark, rows, queries, shard=400, block=10), brute(rows, queries, 5)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in exact[q]}) for q in queries)
    assert hits / (5 * len(queries)) >= 0.95 and all(len(v) == 5 for v in got.values())
    known = {(q, i): s for q in queries for i, s in brute(rows, [q], len(rows))[q]}
    assert all(abs(known[q, i] - s) < 1e-12 for q in queries for i, s in got[q])


def test_equal_vectors_and_unusable_rows(spark):
    rng = random.Random(16)
    common = [1.0, 2.0, 3.0]
    rows = [(i, common) for i in range(0, 80)] + [(100 + i, [rng.random(), rng.random(), rng.random()]) for i in range(40)]
    rows += [(200, None), (201, []), (202, [0.0, 0.0, 0.0]), (203, [1.0, None, 2.0]), (204, [float("nan"), 1.0, 1.0]), (205, [float("inf"), 1.0, 1.0]), (206, [1.0, 2.0])]
    queries = [0, 50, 100, 200, 202, 204, 206]
    got, exact = run(spark, rows, queries), brute(rows, queries, 5)
    assert set(got) == {0, 50, 100} and exact.pop(206) == []
    for q in exact:
        assert [i for i, _ in got[q]] == [i for i, _ in exact[q]]
    assert [i for i, _ in got[50]] == [0, 1, 2, 3, 4]


def test_few_and_no_rows(spark):
    assert [i for i, _ in run(spark, [(1, [1.0, 0.0]), (2, [1.0, 1.0])], [1])[1]] == [2]
    assert run(spark, [], [1]) == {}


def test_pruning_keeps_diverse_edges():
    points = np.array([[0.0, 0.0], [1.0, 0.0], [1.1, 0.0], [0.0, 2.0]])
    assert prunedgraph.robust_prune(points, 0, np.array([1, 2, 3]), 3, 1.2).tolist() == [1, 3]
