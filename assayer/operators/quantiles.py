"""Exact medians and ranks that order only a small part of a large group together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

WIDTH = 0.002


def exact_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact median per key.

    Approximate quantiles on either side of the middle, a combinable sketch, bound the values that can hold the middle
    ranks. Values below the bounds are only counted, values above dropped, and the rest, about ``2 * WIDTH`` of a large
    group however its values are spread, is counted per distinct value and put in order.
    """
    known = rows.where(F.col(value).isNotNull()).select(*keys, value)
    bounds = known.groupBy(*keys).agg(F.count("*").alias("total"), F.percentile_approx(value, [0.5 - WIDTH, 0.5 + WIDTH], int(4 / WIDTH)).alias("bounds"))
    low, high = F.get("bounds", F.lit(0)), F.get("bounds", F.lit(1))
    inside = known.join(bounds, keys).where(F.col(value) <= high)
    counted = inside.groupBy(*keys, F.when(F.col(value) >= low, F.col(value)).alias(value)).agg(F.count("*").alias("n"), F.first("total").alias("total"))
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_first(value))
    ranked = counted.withColumn("upto", F.sum("n").over(order)).withColumn("from", F.col("upto") - F.col("n"))
    # Middle ranks: both equal when the count is odd.
    left, right = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    has = lambda rank: (F.col("from") < rank) & (rank <= F.col("upto"))
    middle = ranked.groupBy(*keys).agg(F.max(F.when(has(left), F.col(value))).alias("left_value"),
                                       F.max(F.when(has(right), F.col(value))).alias("right_value"))
    return middle.select(*keys, ((F.col("left_value") + F.col("right_value")) / 2).alias(value))


def salt(key: Column) -> Column:
    """4096 equal parts of a uniform hash order."""
    return F.substring(key, 1, 3)


def rank_in_order(rows: DataFrame, coarse: Column, fine_key: Column, group: list[str] | None = None) -> DataFrame:
    """Adds ``rank`` (1-based) by (coarse, fine hash key) without ordering a whole group in one task.

    ``coarse`` is a bounded-cardinality sort value, ``fine_key`` a uniform hash text that breaks ties. Counts per
    (coarse, salt) are cumulated on aggregated tables; only the rows of one salt part are ordered together.
    """
    group = group or []
    keyed = rows.withColumn("_coarse", coarse).withColumn("_fine", fine_key).withColumn("_salt", salt(F.col("_fine")))
    parts = keyed.groupBy(*group, "_coarse", "_salt").agg(F.count("*").alias("_n"))
    levels = parts.groupBy(*group, "_coarse").agg(F.sum("_n").alias("_level"))
    over_levels = Window.partitionBy(*group).orderBy("_coarse") if group else Window.partitionBy(F.lit(0)).orderBy("_coarse")
    levels = levels.withColumn("_below", F.sum("_level").over(over_levels) - F.col("_level")).drop("_level")
    within = Window.partitionBy(*group, "_coarse").orderBy("_salt")
    parts = parts.withColumn("_earlier", F.sum("_n").over(within) - F.col("_n")).drop("_n")
    offsets = parts.join(levels, [*group, "_coarse"]).select(*group, "_coarse", "_salt", (F.col("_below") + F.col("_earlier")).alias("_offset"))
    local = Window.partitionBy(*group, "_coarse", "_salt").orderBy("_fine")
    ranked = keyed.join(offsets, [*group, "_coarse", "_salt"]).withColumn("rank", F.col("_offset") + F.row_number().over(local))
    return ranked.drop("_coarse", "_fine", "_salt", "_offset")


def hash_rank(rows: DataFrame, fine_key: Column, group: list[str] | None = None) -> DataFrame:
    return rank_in_order(rows, F.lit(0), fine_key, group)
