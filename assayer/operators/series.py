"""Ordered series: carrying values, extrapolation, errors, ensembles, bootstrap and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.operators.neighbours import nearest_points
from assayer.operators.quantiles import exact_median, rank_in_order
from assayer.session import cut_lineage


def known_tail(points: DataFrame) -> DataFrame:
    """Last known position and value per series, as one combinable aggregate. ``points``: ``series, pos, known``."""
    have = points.where(F.col("known").isNotNull())
    return have.groupBy("series").agg(F.max("pos").alias("last_pos"), F.max_by("known", "pos").alias("last_value"))


def const_hold(points: DataFrame, slice_of: int = 4096) -> DataFrame:
    """``held``: the last known value at or before each position.

    A series is cut into slices of positions. Each slice carries forward inside itself; what precedes a slice comes from
    a window over one summary line per slice, so no task orders a whole series.
    """
    cut = points.withColumn("_slice", F.floor(F.col("pos") / slice_of))
    inside = Window.partitionBy("series", "_slice").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumn("_local", F.last("known", ignorenulls=True).over(inside))
    ends = cut.groupBy("series", "_slice").agg(F.max_by("known", F.when(F.col("known").isNotNull(), F.col("pos"))).alias("_end"))
    before = Window.partitionBy("series").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).select("series", "_slice", "_carried")
    return local.join(carried, ["series", "_slice"]).withColumn("held", F.coalesce("_local", "_carried")).drop("_slice", "_local", "_carried")


def slope_extrapolate(points: DataFrame, tail: int, half_life: float | None = None) -> DataFrame:
    """Linear extension of unknown points from the regression over the last ``tail`` positions before the cut.

    With ``half_life`` the slope decays, so a step of d positions counts ``h (1 - 2^(-d/h)) / ln 2``.
    """
    ends = known_tail(points)
    near = points.join(ends, "series").where(F.col("known").isNotNull() & (F.col("pos") > F.col("last_pos") - tail))
    fit = near.groupBy("series").agg(F.regr_slope("known", "pos").alias("slope"), F.first("last_pos").alias("last_pos"), F.first("last_value").alias("last_value"))
    ahead = F.col("pos") - F.col("last_pos")
    reach = ahead if half_life is None else F.lit(half_life) * (1 - F.pow(F.lit(2.0), -ahead / half_life)) / F.log(F.lit(2.0))
    value = F.col("last_value") + F.coalesce("slope", F.lit(0.0)) * reach
    return points.where(F.col("known").isNull()).join(fit, "series").where(ahead > 0).withColumn("extended", value).drop("slope", "last_pos", "last_value")


def rmse_by(errors: DataFrame, key: str = "series") -> DataFrame:
    """Root mean squared error per series and pooled (label ``ALL``). ``errors``: ``series, error``."""
    rolled = errors.rollup(key).agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"))
    return rolled.select(F.when(F.col("level") == 1, "ALL").otherwise(F.col(key).cast("string")).alias(key), "n", "rmse")


def error_concentration(errors: DataFrame, k: int, key: str = "series") -> DataFrame:
    """Worst ``k`` series by squared error with their cumulative share; only k lines reach the ordered window."""
    per_series = errors.groupBy(key).agg(F.sum(F.col("error") * F.col("error")).alias("squared"))
    total = per_series.agg(F.sum("squared").alias("total")).scalar()
    worst = per_series.orderBy(F.desc("squared"), key).limit(k)
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("squared"), key).rowsBetween(Window.unboundedPreceding, 0)
    return worst.select(key, "squared", F.row_number().over(order).alias("rank"), (F.sum("squared").over(order) / total).alias("cumulative_share"))


# Cumulative Poisson(1) probabilities; the first above a uniform number gives the weight.
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183,
           0.9999167588507119, 0.9999897508033253, 0.999998874797402, 0.9999998885745217]


def poisson_weight(key: Column) -> Column:
    """Weight from a hash text: eight hex digits as a uniform number."""
    uniform = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    weight = F.lit(0)
    for edge in POISSON:
        weight = weight + F.when(uniform >= edge, 1).otherwise(0)
    return weight


def paired_bootstrap_ci(pairs: DataFrame, replicates: int, level: float = 0.95) -> DataFrame:
    """Confidence interval of the mean difference of two runs by Poisson resampling.

    ``pairs``: ``row_id, difference``. Each task sums its own rows per replicate, so ``replicates`` lines per task are
    shuffled whatever the table size; the interval is read off those sums.
    """
    drawn = pairs.select("row_id", "difference", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    weight = poisson_weight(F.concat_ws("-", F.col("row_id").cast("string"), F.col("replicate").cast("string")))
    sums = drawn.withColumn("w", weight).groupBy("replicate").agg((F.sum(F.col("w") * F.col("difference")) / F.nullif(F.sum("w"), F.lit(0))).alias("mean"))
    tail = (1 - level) / 2
    interval = sums.agg(F.percentile("mean", F.lit(tail)).alias("low"), F.percentile("mean", F.lit(1 - tail)).alias("high"), F.lit(1).alias("key"))
    centre = pairs.agg(F.count("*").alias("n"), F.avg("difference").alias("mean"), F.lit(1).alias("key"))
    return centre.join(interval, "key").drop("key")


def median_ensemble(predictions: DataFrame) -> DataFrame:
    """Per-point exact median over runs. ``predictions``: ``series, pos, value``."""
    return exact_median(predictions, ["series", "pos"], "value")


def group_fold(key: Column, k: int) -> Column:
    """Fold number of a group by hash; rows of a group share the fold."""
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % k).cast("int")


def folds_of_classes(classes: list[tuple[int, int]], k: int) -> dict[int, list[int]]:
    """Groups of each size that every fold gets when groups go, largest first, to the fold with the fewest rows (the first of equals).

    ``classes``: size and number of groups. The ``m`` groups of a size take the ``m`` lowest of the loads that the folds pass through, so a
    class is dealt at once.
    """
    loads, out = [0] * k, {}
    for size, count in sorted(classes, reverse=True):
        low, high = 0, max(loads) + size * count
        taken = lambda upto: [max(0, (upto - load) // size + 1) if upto >= load else 0 for load in loads]  # noqa: B023,E731
        while low < high:  # the highest load below which no more than all groups go
            middle = (low + high + 1) // 2
            low, high = (middle, high) if sum(taken(middle)) <= count else (low, middle - 1)
        given = taken(low) if sum(taken(low)) <= count else [0] * k
        rest = sorted((loads[f] + given[f] * size, f) for f in range(k))[:count - sum(given)]
        for _, f in rest:
            given[f] += 1
        loads = [load + g * size for load, g in zip(loads, given)]
        out[size] = given
    return out


def balanced_folds(rows: DataFrame, group: str, k: int) -> DataFrame:
    """``group, n, fold``: every group in one of ``k`` folds of nearly equal numbers of rows, none above another by more than the largest group.

    Largest groups go first to the fold with the fewest rows. Only the number of groups of each size, of which n rows have at most the root of
    2 n, is dealt out on the driver; groups of one size are then told apart by the order of their md5, ranked in parts.
    """
    counted = cut_lineage(rows.groupBy(group).agg(F.count("*").alias("n")))
    sizes = counted.groupBy("n").agg(F.count("*").alias("groups"))
    dealt = folds_of_classes([(r.n, r.groups) for r in sizes.collect()], k)
    ends = [(size, fold, sum(given[:fold]), sum(given[:fold + 1])) for size, given in dealt.items() for fold in range(k) if given[fold]]
    table = rows.sparkSession.createDataFrame(ends, "size bigint, fold int, low bigint, high bigint")
    ranked = rank_in_order(counted, F.col("n"), F.md5(F.coalesce(F.col(group).cast("string"), F.lit(""))), group=["n"])
    return ranked.join(table, (F.col("n") == F.col("size")) & (F.col("rank") > F.col("low")) & (F.col("rank") <= F.col("high"))).select(group, "n", "fold")


def run_trajectory(history: DataFrame, types: list[str]) -> DataFrame:
    """One line per run in time order: a cell per type ('-' without samples), total accuracy and change to the run before.

    ``history``: ``run, started, type, correct, n``. Lines are aggregated per run before the ordered window.
    """
    share = F.sum("correct") / F.nullif(F.sum("n"), F.lit(0))
    cells = [F.coalesce(F.concat(F.round(100 * F.sum(F.when(F.col("type") == t, F.col("correct"))) / F.nullif(F.sum(F.when(F.col("type") == t, F.col("n"))), F.lit(0)), 0).cast("int").cast("string"), F.lit("%")),
                        F.lit("-")).alias(t) for t in types]
    per_run = history.groupBy("run").agg(F.min("started").alias("started"), share.alias("acc"), *cells)
    order = Window.partitionBy(F.lit(1)).orderBy("started", "run")
    return per_run.withColumn("change", F.col("acc") - F.lag("acc").over(order))


def idw_neighbours(targets: DataFrame, known: DataFrame, k: int, power: float = 2.0) -> DataFrame:
    """``target_id, estimate, neighbours``: inverse-distance estimate from the ``k`` nearest known points, exact (``neighbours.nearest_points``).

    ``targets``: ``target_id, x, y``; ``known``: ``point_id, x, y, value``. Targets on one place are answered once.
    """
    best = nearest_points(targets.select("x", "y"), known, k)
    w = 1 / F.pow(F.greatest(F.col("distance"), F.lit(1e-9)), power)
    estimates = best.groupBy("tx", "ty").agg((F.sum(w * F.col("value")) / F.sum(w)).alias("estimate"), F.count("*").alias("neighbours"))
    return targets.join(estimates, (F.col("x") == F.col("tx")) & (F.col("y") == F.col("ty"))).select("target_id", "estimate", "neighbours")
