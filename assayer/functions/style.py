"""Style, confidence and copy metrics of a reasoning text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions import markers as M
from assayer.functions.text import BOX_OPEN, count_matches, last_match, occurrences_of, strip, think_block, words


def marker_count(lowered: Column, dictionary: Sequence[str]) -> Column:
    """Occurrences summed over a family. Overlaps between markers count for each, as intended."""
    return occurrences_of(lowered, dictionary)


def confidence(text: Column, lowered: Column | None = None) -> Column:
    """Stated confidence; pass the lower-cased text as a column of its own to lower it once per row."""
    lowered = F.lower(text) if lowered is None else lowered
    base = F.when(F.contains(text, F.lit(BOX_OPEN)), F.lit(0.7)).otherwise(F.lit(0.3))
    score = base + F.lit(0.1) * marker_count(lowered, M.CONFIDENT)
    score = score + F.lit(-0.1) * marker_count(lowered, M.DOUBTFUL)
    score = score + F.lit(0.05) * marker_count(lowered, M.DECLARATIVE)
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    return F.when(text.isNull() | (text == ""), F.lit(0.5)).otherwise(clamped)


def style_metrics(text: Column, lowered: Column, block: Column) -> dict[str, Column]:
    """Deterministic style columns of one text from its lower-case form and think block."""
    chunks = F.filter(F.split(block, "\n"), lambda c: strip(c) != "")
    chunk_chars = F.aggregate(chunks, F.lit(0).cast("bigint"), lambda acc, c: acc + F.char_length(c))
    high, low = marker_count(lowered, M.STYLE_HIGH), marker_count(lowered, M.STYLE_LOW)
    chars = F.char_length(text)
    return {
        "think_chars": F.char_length(block),
        "think_words": F.size(words(block)),
        "think_lines": F.when(block == "", 0).otherwise(F.size(F.split(block, "\n"))),
        "attempts": marker_count(lowered, M.ATTEMPT),
        "self_corrections": marker_count(lowered, M.SELF_CORRECTION),
        "confident": high,
        "doubtful": low,
        "confidence_ratio": high / (high + low + 1),
        "verifications": marker_count(lowered, M.VERIFICATION),
        "chunk_length": F.coalesce(F.floor(chunk_chars / F.nullif(F.size(chunks), F.lit(0))), F.lit(0)).cast("int"),
        "numeric_density": F.coalesce(count_matches(text, r"\b[0-9]+(?:\.[0-9]+)?\b") / F.nullif(chars / F.lit(100.0), F.lit(0.0)), F.lit(0.0)),
        "labels": count_matches(text, r"(?:^|\s)([A-Z][A-Z0-9_]{1,15}):"),
    }


def _longest_shared(needle: str, text: str) -> float:
    """Length share of the longest piece of ``needle`` inside ``text``; window growth, linear in the answer length."""
    best = start = 0
    while start + best < len(needle):
        if needle[start:start + best + 1] in text:
            best += 1
        else:
            start += 1
    return best / len(needle)


def copy_ratio(text: Column, boxed: Column | None = None) -> Column:
    """Longest contiguous part of the boxed answer found in the rest of the text, over the answer length.

    Whole containment is decided by a built-in test; only the remaining rows reach the Arrow function.
    """
    plain = r"\\boxed\{([^{}]*)\}"
    boxed = F.coalesce(strip(last_match(text, plain)), F.lit("")) if boxed is None else boxed
    rest = F.regexp_replace(text, plain, "")

    @F.pandas_udf("double")
    def partial(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for needles, texts in batches:
            yield pd.Series([None if n is None else _longest_shared(n, t) for n, t in zip(needles, texts)], dtype="float64")

    whole = F.contains(rest, boxed)
    open_case = ~whole & (boxed != "")
    needle = F.when(open_case, boxed)
    return (F.when((boxed == "") | (rest == ""), 0.0).when(whole, 1.0)
            .otherwise(partial(needle, F.when(open_case, rest))))


def with_confidence(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_low", F.lower("text")).withColumn("confidence", confidence(F.col("text"), F.col("_low"))).drop("_low")


def with_style(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and the style metrics; the lowered text and the think block are computed once per row."""
    filled = rows.withColumn("text", F.coalesce("text", F.lit("")))
    ready = filled.select(*keep, "text", F.lower("text").alias("_low"), think_block(F.col("text")).alias("_block"))
    metrics = style_metrics(F.col("text"), F.col("_low"), F.col("_block"))
    return ready.select(*keep, *[c.alias(n) for n, c in metrics.items()])
