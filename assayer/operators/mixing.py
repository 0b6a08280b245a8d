"""Mixing sources with provenance."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F


def mix(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Union of the parts by column name, each row tagged with its provenance."""
    mixed = None
    for name, part in parts.items():
        tagged = part.withColumn("provenance", F.lit(name))
        mixed = tagged if mixed is None else mixed.unionByName(tagged, allowMissingColumns=True)
    return mixed


def replace_type(base: DataFrame, rebuilt: DataFrame, kind: str) -> DataFrame:
    """Base without one type, plus the rebuilt rows of that type."""
    return mix({"kept": base.where(F.col("type") != kind), "rebuilt": rebuilt.where(F.col("type") == kind)})


def replicate(rows: DataFrame, weight: Column) -> DataFrame:
    """Each row repeated ``weight`` times with its copy number; a weight below one drops the row."""
    return rows.withColumn("copy", F.explode(F.when(weight >= 1, F.sequence(F.lit(1), weight.cast("int")))))


def distinct_words_in_order(text: Column) -> Column:
    """Words of a text, the first position of each kept."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))
