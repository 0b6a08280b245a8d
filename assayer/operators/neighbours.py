"""Nearest known points of the plane by a tree of square cells that adapts to where the points lie."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.session import cut_lineage

# A cell of more points than LEAF is divided into 4 x 4; at DEEPEST halvings of the plane's side a double has no digits left.
LEAF, DEEPEST = 64, 48
_CELL = ["level", "cx", "cy"]


def _index(share: str, level: int) -> Column:
    return F.floor(F.col(share) * float(2**level)).cast("bigint")


def _tree(known: DataFrame, leaf: int) -> tuple[dict[int, DataFrame], DataFrame]:
    """Cells by level (``cx, cy, n, leaf``) and the points with the cell they end in. Every level keeps only points of cells that are divided."""
    levels, placed, live = {}, [], known
    for level in range(0, DEEPEST + 1, 2):
        live = live.withColumns({"cx": _index("u", level), "cy": _index("v", level)})
        cells = cut_lineage(live.groupBy("cx", "cy").agg(F.count("*").alias("n")).withColumn("leaf", (F.col("n") <= leaf) | F.lit(level == DEEPEST)))
        levels[level] = cells
        placed.append(live.join(cells.where("leaf").select("cx", "cy"), ["cx", "cy"]).select("point_id", "x", "y", "value", F.lit(level).alias("level"), "cx", "cy"))
        big = cells.where("not leaf").select("cx", "cy")
        if big.isEmpty():
            break
        live = cut_lineage(live.join(big, ["cx", "cy"], "left_semi").select(*known.columns))
    return levels, cut_lineage(functools.reduce(DataFrame.unionByName, placed))


def _near(cells: DataFrame, k: int, low_x: float, low_y: float, side: float) -> DataFrame:
    """Cells that can hold one of the k nearest points: not farther away than the far corners of cells that hold k points together."""
    size = F.lit(side) / F.pow(F.lit(2.0), F.col("level"))
    left, below, slack = F.lit(low_x) + F.col("cx") * size, F.lit(low_y) + F.col("cy") * size, F.lit(side * 1e-12)
    outside = lambda at, start: F.greatest(start - at - slack, F.lit(0.0), at - start - size - slack)
    farthest = lambda at, start: F.greatest(F.abs(at - start), F.abs(at - start - size)) + slack
    measured = cells.withColumns({"least": F.hypot(outside(F.col("tx"), left), outside(F.col("ty"), below)), "most": F.hypot(farthest(F.col("tx"), left), farthest(F.col("ty"), below))})
    target = Window.partitionBy("tx", "ty")
    upto = measured.withColumn("upto", F.sum("n").over(target.orderBy("most").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    bounded = upto.withColumn("bound", F.min(F.when(F.col("upto") >= k, F.col("most"))).over(target))
    return bounded.where(F.col("bound").isNull() | (F.col("least") <= F.col("bound") * (1 + 1e-12))).select("tx", "ty", *_CELL, "n", "leaf")


def candidates(spots: DataFrame, known: DataFrame, k: int, leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """Undivided cells that can hold a neighbour of each spot (``tx, ty`` and the cell), and all points with their cell.

    Spots go down the tree level by level and keep the cells that can hold a neighbour, so a far spot
    sees the near edge of the points only and a tight cluster is divided as deep as its points differ. Points on one place beyond the k
    lowest ids can never be needed and leave first. Points and spots without finite coordinates take no part.
    """
    finite = lambda rows: rows.where("x is not null and y is not null and not isnan(x) and not isnan(y)").where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
    place = Window.partitionBy("x", "y").orderBy("point_id")
    known = finite(known.select("point_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "value")).withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= k).drop("_r")
    low_x, low_y, side = known.agg(F.min("x"), F.min("y"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))).first()
    low_x, low_y, side = low_x or 0.0, low_y or 0.0, (side or 1.0) * (1 + 1e-9)
    shares = {"u": (F.col("x") - low_x) / side, "v": (F.col("y") - low_y) / side}
    levels, points = _tree(cut_lineage(known.withColumns(shares)), leaf)
    spots = finite(spots.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))).distinct().toDF("tx", "ty")
    seen = cut_lineage(spots.join(F.broadcast(levels[0].select(F.lit(0).alias("level"), "cx", "cy", "n", "leaf"))))  # the root: one row
    for level in list(levels)[1:]:
        parents = [F.shiftright("cx", 2).alias("px"), F.shiftright("cy", 2).alias("py")]
        children = levels[level].select(*parents, F.lit(level).alias("level"), "cx", "cy", "n", "leaf")
        inner = seen.where("not leaf").select("tx", "ty", F.col("cx").alias("px"), F.col("cy").alias("py")).join(children, ["px", "py"])
        seen = cut_lineage(_near(inner.select("tx", "ty", *_CELL, "n", "leaf").unionByName(seen.where("leaf")), k, low_x, low_y, side))
    return seen.select("tx", "ty", *_CELL), points


def nearest_points(spots: DataFrame, known: DataFrame, k: int, leaf: int = LEAF) -> DataFrame:
    """``tx, ty, point_id, value, distance``: the k nearest known points of every spot ``x, y``; equal distances go by the lower id.

    ``known``: ``point_id, x, y, value``; see ``candidates``. Cells hold at most ``leaf`` points, unless those differ in no digit that counts.
    """
    seen, points = candidates(spots, known, k, leaf)
    pairs = seen.join(points, _CELL)
    distance = F.sqrt(F.pow(F.col("tx") - F.col("x"), 2) + F.pow(F.col("ty") - F.col("y"), 2))
    order = Window.partitionBy("tx", "ty").orderBy("distance", "point_id")
    return pairs.withColumn("distance", distance).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).select("tx", "ty", "point_id", "value", "distance")
