"""Nearest points against all distances, for far spots and tight clusters."""

import math
import random

from assayer.operators import neighbours, series


def brute(spots, known, k):
    out = {}
    for x, y in spots:
        near = sorted((math.sqrt((x - p[1]) ** 2 + (y - p[2]) ** 2), p[0]) for p in known)
        out[x, y] = [i for _, i in near[:k]]
    return out


def plane(seed):
    rng = random.Random(seed)
    known = [(i, rng.uniform(0, 100), rng.uniform(0, 100), float(i)) for i in range(900)]
    known += [(1000 + i, 20 + rng.uniform(0, 1e-7), 30 + rng.uniform(0, 1e-7), 1.0) for i in range(300)]
    known += [(2000 + i, 50.0, 50.0, 2.0) for i in range(200)] + [(3000 + i, 99.0, 1 + i * 1e-12, 3.0) for i in range(100)]
    spots = [(rng.uniform(-5, 105), rng.uniform(-5, 105)) for _ in range(40)] + [(1e6, 3.0), (-4e4, -4e4), (50.0, 1e9), (20.00000005, 30.00000005), (50.0, 50.0), (99.0, 1.0)]
    return spots, known


def frames(spark, spots, known):
    return spark.createDataFrame(spots, "x double, y double"), spark.createDataFrame(known, "point_id bigint, x double, y double, value double")


def test_against_all_distances(spark):
    spots, known = plane(3)
    for k in (1, 7):
        got = {}
        for r in neighbours.nearest_points(*frames(spark, spots, known), k, leaf=16).orderBy("tx", "ty", "distance", "point_id").collect():
            got.setdefault((r.tx, r.ty), []).append(r.point_id)
        assert got == brute(spots, known, k)


def test_rows_a_spot_are_bounded(spark):
    """Pairs of a spot and a point: a few cells' worth, wherever the spot lies; far spots see one edge of the points."""
    spots, known = plane(4)
    seen, points = neighbours.candidates(*frames(spark, spots, known), 4, leaf=16)
    pairs = {(r.tx, r.ty): r["count"] for r in seen.join(points, ["level", "cx", "cy"]).groupBy("tx", "ty").count().collect()}
    assert len(pairs) == len(spots) and max(pairs.values()) < 200
    assert points.groupBy("level", "cx", "cy").count().agg({"count": "max"}).first()[0] <= 16


def test_odd_rows(spark):
    known = [(1, 0.0, 0.0, 5.0), (2, None, 1.0, 9.0), (3, float("nan"), 0.0, 9.0), (4, 0.0, 3.0, 7.0)]
    targets = [(1, 0.0, 1.0), (2, 0.0, 1.0), (3, None, 1.0), (4, float("inf"), 1.0)]
    frame = spark.createDataFrame(targets, "target_id bigint, x double, y double")
    got = {r.target_id: (round(r.estimate, 6), r.neighbours) for r in series.idw_neighbours(frame, frames(spark, [(0.0, 0.0)], known)[1], 5).collect()}
    assert got == {1: (5.4, 2), 2: (5.4, 2)}
    assert series.idw_neighbours(frame, frames(spark, [(0.0, 0.0)], known)[1].where("false"), 5).collect() == []
