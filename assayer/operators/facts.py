"""Per-puzzle ground truth that verdicts, chains and attribution share: one row per puzzle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions.numerals import roman_decode, roman_encode
from assayer.operators import bits, combos, substitution
from assayer.operators.pairs import prompt_pairs, prompt_target
from assayer.session import cut_lineage

# Question patterns of numeral prompts.
NUMERAL_ASKS = [r"(?i)write the number\s+([0-9]+)", r"(?i)what.*?(?:arabic\s+)?number\s+is\s+([IVXLCDM]+)",
                r"(?i)convert\s+([IVXLCDM]+)\s+to"]


def numeral_target(prompt: Column) -> tuple[Column, Column]:
    """Direction and target of a numeral prompt, from the first line that asks."""
    asks, backs, converts = NUMERAL_ASKS
    line = F.get(F.filter(F.split(prompt, "\n"), lambda x: x.rlike(asks) | x.rlike(backs) | x.rlike(converts)), F.lit(0))
    direction = (F.when(line.rlike(asks), "arabic_to_roman").when(line.isNotNull(), "roman_to_arabic").otherwise("unknown"))
    target = (F.when(line.rlike(asks), F.regexp_extract(line, asks, 1)).when(line.rlike(backs), F.upper(F.regexp_extract(line, backs, 1)))
              .when(line.rlike(converts), F.upper(F.regexp_extract(line, converts, 1))))
    return direction, target


def with_asked(puzzles: DataFrame) -> DataFrame:
    """``pairs, target, direction`` of every prompt beside the other columns."""
    kind, prompt = F.col("type"), F.col("prompt")
    pairs, target = None, None
    for name in ("binary", "cipher", "equation", "gravity", "unit"):
        p, t = prompt_pairs(prompt, name), prompt_target(prompt, name)
        pairs = F.when(kind == name, p) if pairs is None else pairs.when(kind == name, p)
        target = F.when(kind == name, t) if target is None else target.when(kind == name, t)
    direction, numeral = numeral_target(prompt)
    return puzzles.withColumns({"pairs": pairs, "target": target.when(kind == "roman", numeral), "direction": F.when(kind == "roman", direction)})


def parsed(puzzles: DataFrame) -> DataFrame:
    """``row_id, type, expected, pairs, target, direction``: every prompt parsed once.

    The parsed table is small beside the reasoning texts and feeds several jobs, so it is written once instead of
    parsing the prompts again in every branch.
    """
    return cut_lineage(with_asked(puzzles).select("row_id", "type", "expected", "pairs", "target", "direction"))


def long_pairs(table: DataFrame, kind: str) -> DataFrame:
    rows = table.where(F.col("type") == kind).select("row_id", F.posexplode("pairs").alias("pos", "pair"))
    return rows.select("row_id", "pos", "pair.lhs", "pair.rhs")


def binary_facts(table: DataFrame) -> DataFrame:
    """``row_id, true_answer, difficulty, rule_kinds`` of the 8-bit puzzles of a parsed table."""
    rows = table.where(F.col("type") == "binary").select("row_id", "target", F.size("pairs").alias("n_pairs"))
    return bits.solve_and_describe(bits.first_matching(long_pairs(table, "binary")), rows)


def puzzle_facts(puzzles: DataFrame) -> DataFrame:
    """Everything the graders need besides the text, keyed by row id."""
    table = parsed(puzzles)
    true_tables = substitution.as_map(substitution.learn_substitution(long_pairs(table, "cipher")), "true_table")
    numeral_answer = F.when(F.col("direction") == "arabic_to_roman", roman_encode(F.col("target").try_cast("bigint"))).when(
        F.col("direction") == "roman_to_arabic", roman_decode(F.col("target")).cast("string"))
    joined = table.join(binary_facts(table), "row_id", "left").join(true_tables, "row_id", "left")
    return joined.withColumns({
        "true_answer": F.when(F.col("type") == "roman", numeral_answer).otherwise(F.col("true_answer")),
        "true_table": F.coalesce("true_table", F.create_map().cast("map<string,string>")),
        "subtype": F.when(F.col("type") == "equation", combos.equation_subtype(F.col("pairs")))}).drop("type", "expected")
