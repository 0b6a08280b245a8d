"""Example pairs out of prompts, and ratio fits over the long pair table ``row_id, pos, lhs, rhs``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions.text import strip
from assayer.operators.quantiles import exact_median

# Line patterns by type. A pair pattern has two groups, a target pattern one.
PAIR_PATTERNS = {
    "binary": r"^([01]{8})\s*->\s*([01]{8})\s*$",
    "cipher": r"^(.*?)\s*->\s*(.*)$",
    "equation": r"^(.{5})\s*=\s*(.+)$",
    "gravity": r"(?i)t\s*=\s*([0-9.]+)\s*s?\s*,\s*distance\s*=\s*([0-9.]+)",
    "unit": r"(?i)([0-9.]+)\s*m\s*becomes\s*([0-9.]+)",
}
TARGET_PATTERNS = {
    "binary": r"(?i)determine the output for[:\s]+([01]{8})",
    "cipher": r"(?i)decrypt[^:]*:\s*(.+)",
    "equation": r"(?i)determine the result for[:\s]+(.{1,10})$",
    "gravity": r"(?i)falling distance for\s+t\s*=\s*([0-9.]+)",
    "unit": r"(?i)convert the following measurement[:\s]+([0-9.]+)",
}


def _skip(kind: str, lhs: Column, line: Column) -> Column:
    lowered = F.lower(line)
    if kind == "cipher":
        left = F.lower(lhs)
        return F.contains(left, F.lit("input")) | F.contains(left, F.lit("example"))
    if kind == "equation":
        return F.contains(lowered, F.lit("example")) | F.contains(lowered, F.lit("determine"))
    return F.lit(False)


def prompt_pairs(prompt: Column, kind: str) -> Column:
    """Array of (lhs, rhs) in line order; the number of pairs is bounded by the lines of one prompt."""
    pattern = PAIR_PATTERNS[kind]
    lines = F.transform(F.split(prompt, "\n"), strip)
    hits = F.filter(lines, lambda line: line.rlike(pattern) & ~_skip(kind, F.regexp_extract(line, pattern, 1), line))
    return F.transform(hits, lambda line: F.struct(F.regexp_extract(line, pattern, 1).alias("lhs"),
                                                   strip(F.regexp_extract(line, pattern, 2)).alias("rhs")))


def prompt_target(prompt: Column, kind: str) -> Column:
    """Target of the question line; the last such line wins, null when absent."""
    pattern = TARGET_PATTERNS[kind]
    usable = lambda line: line.rlike(pattern)
    if kind == "cipher":
        usable = lambda line: line.rlike(pattern) & ~F.contains(line, F.lit("->")) & (
            F.contains(F.lower(line), F.lit("decrypt the following")) | F.contains(F.lower(line), F.lit("decrypt:")))
    last = F.try_element_at(F.filter(F.transform(F.split(prompt, "\n"), strip), usable), F.lit(-1))
    return strip(F.regexp_extract(last, pattern, 1))


def pairs_from_prompts(puzzles: DataFrame, kind: str) -> DataFrame:
    """Long pair table of one puzzle type."""
    rows = puzzles.where(F.col("type") == kind)
    return (rows.select("row_id", F.posexplode(prompt_pairs(F.col("prompt"), kind)).alias("pos", "pair"))
            .select("row_id", "pos", "pair.lhs", "pair.rhs"))


def targets_from_prompts(puzzles: DataFrame, kind: str) -> DataFrame:
    rows = puzzles.where(F.col("type") == kind)
    keep = [c for c in ("expected",) if c in puzzles.columns]
    return rows.select("row_id", *keep, prompt_target(F.col("prompt"), kind).alias("target"))


def ratio_fit(pairs: DataFrame, targets: DataFrame, how: str = "mean") -> DataFrame:
    """Linear rule through the origin: mean of y/x over x != 0, or median over x > 0, applied to the target."""
    x, y = F.col("x"), F.col("y")
    if how == "mean":
        fit = pairs.where(x != 0).groupBy("row_id").agg(F.avg(y / x).alias("slope"))
    else:
        fit = exact_median(pairs.where(x > 0).select("row_id", (y / x).alias("slope")), ["row_id"], "slope")
    return targets.join(fit, "row_id").withColumn("computed", F.col("slope") * F.col("target_x"))


def quadratic_fit(pairs: DataFrame, targets: DataFrame, how: str = "mean") -> DataFrame:
    """Fall law d = g t^2 / 2: g from each pair by mean (median over t > 0), applied to the target time."""
    t, d = F.col("x"), F.col("y")
    ratio = 2 * d / (t * t)
    if how == "mean":
        fit = pairs.where(t != 0).groupBy("row_id").agg(F.avg(ratio).alias("g"))
    else:
        fit = exact_median(pairs.where(t > 0).select("row_id", ratio.alias("g")), ["row_id"], "g")
    return targets.join(fit, "row_id").withColumn("computed", 0.5 * F.col("g") * F.col("target_x") * F.col("target_x"))


def numeric_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select("row_id", "pos", F.col("lhs").try_cast("double").alias("x"), F.col("rhs").try_cast("double").alias("y"))


def numeric_targets(targets: DataFrame) -> DataFrame:
    return targets.withColumn("target_x", F.col("target").try_cast("double"))
