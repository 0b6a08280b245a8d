"""Release decision of a run from its evaluation, calibration and comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assayer.functions.markers import HARD_GATES, SOFT_GATES
from assayer.operators.evaluation import ones


def gate_inputs(rows: DataFrame, pairs: DataFrame | None = None, bins: int = 10) -> DataFrame:
    """One row of measures. ``rows``: ``type, ok, confidence, drift, boxed`` of one run; ``pairs``: both runs' flags.

    Everything is counted per confidence bin in one pass over the rows; the bins then give the calibration error too.
    """
    ok, c, kind = F.col("ok"), F.col("confidence"), F.col("type")
    index = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(c * bins)))
    counts = {"n": F.count("*"), "right": ones(ok), "stated": F.sum("confidence"), "n_cipher": ones(kind == "cipher"), "right_cipher": ones(ok & (kind == "cipher")),
              "n_binary": ones(kind == "binary"), "right_binary": ones(ok & (kind == "binary")), "drift": ones(F.col("drift")), "boxed": ones(F.col("boxed")),
              "over": ones(~ok & (c > 0.7))}
    per_bin = rows.groupBy(index.alias("bin")).agg(*[expression.alias(name) for name, expression in counts.items()])
    share = lambda part, whole, empty: F.coalesce(F.sum(part) / F.nullif(F.sum(whole), F.lit(0)), F.lit(empty))
    gap = F.abs(F.col("right") / F.col("n") - F.col("stated") / F.col("n")) * F.col("n")
    measures = per_bin.agg(
        share("right", "n", 0.0).alias("total_accuracy"), share("right_cipher", "n_cipher", 1.0).alias("cipher_accuracy"),
        share("right_binary", "n_binary", 0.0).alias("binary_accuracy"), F.coalesce(F.sum("drift"), F.lit(0)).alias("drift_flags"),
        share("boxed", "n", 0.0).alias("format_share"), share("over", "n", 0.0).alias("overclaim"),
        F.coalesce(F.sum(gap) / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("ece"))
    if pairs is None:
        return measures.withColumns({"improvements": F.lit(None).cast("bigint"), "regressions": F.lit(None).cast("bigint")})
    change = pairs.agg(ones(~F.col("a_ok") & F.col("b_ok")).alias("improvements"), ones(F.col("a_ok") & ~F.col("b_ok")).alias("regressions"))
    return measures.withColumn("key", F.lit(1)).join(change.withColumn("key", F.lit(1)), "key").drop("key")


def gates(measures: DataFrame, fixed_true: bool = False) -> DataFrame:
    """One row per gate: ``gate, hard, passed``. ``fixed_true`` treats the drift and format gates as always met."""
    m = F.col
    met = lambda c: F.lit(True) if fixed_true else c
    rows = [
        ("cipher_accuracy", True, m("cipher_accuracy") >= HARD_GATES["cipher_accuracy_min"]),
        ("no_template_drift", True, met(m("drift_flags") <= HARD_GATES["drift_flags_max"])),
        ("format_share", True, met(m("format_share") >= HARD_GATES["format_share_min"])),
        ("regressions_below_improvements", True, F.coalesce(m("regressions") < m("improvements"), F.lit(True))),
        ("total_accuracy", False, m("total_accuracy") >= SOFT_GATES["total_accuracy_min"]),
        ("binary_accuracy", False, m("binary_accuracy") >= SOFT_GATES["binary_accuracy_min"]),
        ("overclaim", False, m("overclaim") <= SOFT_GATES["overclaim_max"]),
        ("ece", False, m("ece") <= SOFT_GATES["ece_max"]),
    ]
    return measures.select(F.inline(F.array(*[F.struct(F.lit(n).alias("gate"), F.lit(h).alias("hard"), c.alias("passed")) for n, h, c in rows])))


def release_gate(measures: DataFrame, fixed_true: bool = False) -> DataFrame:
    table = gates(measures, fixed_true)
    summed = table.agg(
        F.bool_and(F.col("passed") | ~F.col("hard")).alias("hard_pass"), ones(F.col("passed") & ~F.col("hard")).alias("soft_passed"),
        ones(~F.col("hard")).alias("soft_total"))
    verdict = (F.when(~F.col("hard_pass"), "ABORT").when(F.col("soft_passed") >= F.col("soft_total"), "STRONG")
               .when(F.col("soft_passed") >= F.floor(F.col("soft_total") / 2), "MARGINAL").otherwise("WEAK"))
    return summed.withColumn("verdict", verdict)
