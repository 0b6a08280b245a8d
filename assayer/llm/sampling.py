"""Bounded training samples for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from assayer.llm.stored import stored

SALTS = 64


def bounded_sample(completions: DataFrame, labels: DataFrame, per_class: int, longest: int) -> tuple[DataFrame, dict[int, int]]:
    """``id, text, label`` of at most ``per_class`` texts of each label, and the number of labelled texts per label.

    Texts are chosen by a hash of their id; those over ``longest`` characters are used only where others are few. Ids, labels and lengths
    alone are shuffled; the chosen ids, ``per_class`` for each of two labels, are then sent to the texts. The sample is stored, so that
    whoever reads it in one task reads nothing else.
    """
    known = labels.where(F.col("id").isNotNull() & F.col("label").isin(0, 1)).select("id", F.col("label").cast("int").alias("label"))
    sizes = completions.where(F.col("text").isNotNull()).select("id", (F.length("text") > longest).cast("int").alias("long")).join(known, "id")
    # The first of every salt hold the first of a label; only they are ordered together.
    best = ["long", F.xxhash64("id"), "id"]
    salted = sizes.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(SALTS)))
    front = salted.withColumn("nth", F.row_number().over(Window.partitionBy("label", "salt").orderBy(*best))).where(F.col("nth") <= per_class)
    ranked = front.withColumn("nth", F.row_number().over(Window.partitionBy("label").orderBy(*best)))
    chosen = stored(ranked.where(F.col("nth") <= per_class).select("id", "label").distinct(), "sample")
    totals = {r.label: r.n for r in sizes.groupBy("label").agg(F.count("*").alias("n")).collect()}
    texts = completions.where(F.col("text").isNotNull()).select("id", "text").join(F.broadcast(chosen), "id")
    return stored(texts, "sample-texts"), totals
