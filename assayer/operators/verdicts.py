"""Per-row verdicts: correctness, failure mode and the flags behind them, as column expressions over the long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions import markers as M, match
from assayer.functions.text import parts_present, strip
from assayer.operators import substitution


def _expected_box() -> tuple[Column, Column]:
    return strip(F.col("expected")), strip(F.coalesce("box", F.lit("")))


def _mode(correct: Column, *cases: tuple[Column, str], otherwise: str) -> Column:
    chain = F.when(correct, "correct").when(F.coalesce("box", F.lit("")) == "", "no_boxed")
    for condition, name in cases:
        chain = chain.when(condition, name)
    return chain.otherwise(otherwise)


def numeric_mode(kind: str) -> tuple[Column, Column]:
    correct = match.match_unit_tol(F.col("expected"), F.col("box"))
    return correct, _mode(correct, (F.col("drift") >= 2, "cipher_template_drift"), otherwise="wrong_answer" if kind == "gravity" else "wrong_slope")


def roman_mode() -> tuple[Column, Column]:
    expected, box = _expected_box()
    correct = F.upper(box) == F.upper(expected)
    return correct, _mode(correct, (F.col("drift") >= 2, "cipher_template_drift"), otherwise="wrong_answer")


def binary_mode() -> tuple[Column, Column]:
    expected, box = _expected_box()
    correct = box == expected
    target = F.coalesce("target", F.lit(""))
    return correct, _mode(
        correct, (~box.rlike("^[01]{8}$"), "format_bad"), (F.col("difficulty") == "HARD", "complex_gates"),
        (box == "00000000", "lazy_constant_0"), (box == "11111111", "lazy_constant_1"), (box == target, "lazy_copy"),
        (box == F.translate(target, "01", "10"), "lazy_not"), otherwise="wrong_2gate")


def equation_mode() -> tuple[Column, Column]:
    expected, box = _expected_box()
    correct = box == expected
    return correct, _mode(
        correct, (F.coalesce(F.col("target") != "", F.lit(False)) & (box == F.col("target")), "copied_input"),
        (F.col("template_markers") >= 3, "cipher_template_misfire"),
        (F.col("arithmetic_markers") < 2, "no_arithmetic_attempted"), otherwise="arithmetic_wrong")


def cipher_mode() -> tuple[Column, Column]:
    """Uses the columns ``stated, table_*, claim, honesty, vocab_fill, word_accuracy`` of ``with_cipher_flags``."""
    expected, box = _expected_box()
    correct = F.lower(box) == F.lower(expected)
    emitted = F.col("table_size") > 0
    return correct, _mode(
        correct, (emitted & (F.col("honesty") == "PASS_LIE"), "template_with_lying_ver"),
        (emitted & (F.col("table_accuracy") < 0.8), "template_with_wrong_table"),
        (F.col("vocab_fill") & (F.col("word_accuracy") < 1.0), "hallucinated_vocab"),
        (~emitted, "free_form_wrong_mapping"), otherwise="other_wrong")


def with_text_flags(rows: DataFrame) -> DataFrame:
    """What a text says by itself: stated table, claim and vocabulary fill of ciphers, marker counts of the other types.

    They are found before the facts are joined, so a text that no later step asks for never reaches a shuffle.
    """
    kind, lowered = F.col("type"), F.lower("text")
    only = lambda name, c: F.when(kind == name, c)
    drift = None
    for name in ("gravity", "unit", "roman"):
        found = parts_present(lowered, M.DRIFT[name])
        drift = F.when(kind == name, found) if drift is None else drift.when(kind == name, found)
    return rows.withColumns({"stated": only("cipher", substitution.stated_map(F.col("text"))), "claim": only("cipher", substitution.claim(F.col("text"))),
                             "vocab_fill": only("cipher", F.col("text").rlike("(?i)" + M.VOCABULARY_FILL)), "drift": drift,
                             "template_markers": only("equation", parts_present(lowered, M.EQUATION_TEMPLATE)),
                             "arithmetic_markers": only("equation", parts_present(lowered, M.EQUATION_ARITHMETIC))})


def with_cipher_flags(stated: DataFrame) -> DataFrame:
    """Grade of the stated table and honesty of the claim; null outside the cipher type. Needs the text flags and the facts."""
    only = lambda c: F.when(F.col("type") == "cipher", c)
    grade = substitution.table_grade(F.col("stated"), F.col("true_table"))
    graded = stated.withColumns({**{name: only(c) for name, c in grade.items()},
                                 "word_accuracy": only(match.per_word_accuracy(F.col("expected"), F.col("box"))),
                                 "first_pair": only(F.get("pairs", F.lit(0)))})
    return graded.withColumn("honesty", only(substitution.honesty(F.col("claim"), F.col("stated"), F.col("first_pair.lhs"),
                                                                  F.col("first_pair.rhs")))).drop("first_pair")


def verdicts(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """The long table with ``correct, failure_mode`` and all type-specific flags; one join on the row id."""
    joined = with_cipher_flags(with_text_flags(rows).join(facts, "row_id", "left"))
    correct, mode = F.lit(None).cast("boolean"), None
    by_type = {"binary": binary_mode(), "cipher": cipher_mode(), "equation": equation_mode(), "gravity": numeric_mode("gravity"),
               "roman": roman_mode(), "unit": numeric_mode("unit")}
    correct = None
    for kind, (ok, failure) in by_type.items():
        here = F.col("type") == kind
        correct = F.when(here, ok) if correct is None else correct.when(here, ok)
        mode = F.when(here, failure) if mode is None else mode.when(here, failure)
    return joined.withColumns({
        "correct": F.coalesce(correct.otherwise(False), F.lit(False)), "failure_mode": mode.otherwise("unknown_type"),
        "answer_matches_truth": F.when(F.col("type") == "binary", F.coalesce(strip(F.col("box")) == F.col("true_answer"), F.lit(False)))}).drop("drift")
