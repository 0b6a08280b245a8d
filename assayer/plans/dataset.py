"""Dataset construction: solve, verify, tag and assemble."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from assayer.functions.match import match_by_type
from assayer.functions.numerals import roman_decode, roman_encode
from assayer.functions.text import ensure_suffix, make_chat
from assayer.operators import bits, combos, substitution
from assayer.operators.facts import numeral_target
from assayer.operators.pairs import numeric_pairs, numeric_targets, pairs_from_prompts, quadratic_fit, ratio_fit, targets_from_prompts


# The puzzle types that rule jobs can solve.
KINDS = ("binary", "cipher", "equation", "gravity", "roman", "unit")


def solved_by_type(puzzles: DataFrame, kind: str) -> DataFrame:
    """``row_id, type, expected, computed`` of the rows a rule job could solve."""
    keep = lambda frame, computed: frame.select("row_id", F.lit(kind).alias("type"), "expected", computed.alias("computed")).where(F.col("computed").isNotNull())
    if kind == "roman":
        direction, target = numeral_target(F.col("prompt"))
        rows = puzzles.where(F.col("type") == "roman").select("row_id", "expected", direction.alias("direction"), target.alias("target"))
        answer = F.when(F.col("direction") == "arabic_to_roman", roman_encode(F.col("target").try_cast("bigint"))).otherwise(roman_decode(F.col("target")).cast("string"))
        return keep(rows, answer)
    pairs, targets = pairs_from_prompts(puzzles, kind), targets_from_prompts(puzzles, kind)
    if kind in ("unit", "gravity"):
        fit = ratio_fit if kind == "unit" else quadratic_fit
        return keep(fit(numeric_pairs(pairs), numeric_targets(targets), "median"), F.round("computed", 2).cast("string"))
    if kind == "binary":
        return keep(bits.bit_apply(bits.first_matching(pairs), targets), F.col("predicted"))
    if kind == "equation":
        return keep(combos.combination_scan(pairs, targets), F.col("predicted"))
    return keep(substitution.apply_substitution(targets, substitution.learn_substitution(pairs)), F.col("decoded"))


def solved_rows(puzzles: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """All solved rows with the verdict of the per-type rule; types accepted by rule stay labelled as such."""
    union = None
    for kind in kinds:
        part = solved_by_type(puzzles, kind)
        union = part if union is None else union.unionByName(part)
    return union.withColumn("verdict", match_by_type(F.col("type"), F.col("expected"), F.col("computed")))


def verified_chats(puzzles: DataFrame, solved: DataFrame, source: str, suffix: str) -> DataFrame:
    """Tagged chat examples of the rows whose computed answer matched or whose type is accepted by rule; ``verdict`` says which."""
    kept = puzzles.join(solved.where(F.col("verdict") != "mismatch").select("row_id", "computed", "verdict"), "row_id")
    answer = F.concat(F.lit("\\boxed{"), F.col("expected"), F.lit("}"))
    return kept.select("row_id", "verdict", *make_chat(ensure_suffix(F.col("prompt"), suffix), answer, source=F.lit(source), puzzle_type=F.col("type")))


def full_and_verified(puzzles: DataFrame, source: str, suffix: str, kinds: Sequence[str] = KINDS) -> tuple[DataFrame, DataFrame]:
    """Chats of every labelled puzzle, and of those that a rule job of any type verified or accepts."""
    answer = F.concat(F.lit("\\boxed{"), F.col("expected"), F.lit("}"))
    full = puzzles.where(F.col("expected").isNotNull()).select("row_id", *make_chat(ensure_suffix(F.col("prompt"), suffix), answer, source=F.lit(source), puzzle_type=F.col("type")))
    return full, verified_chats(puzzles, solved_rows(puzzles, kinds), source, suffix)
