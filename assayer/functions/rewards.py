"""Reward terms of a completion as column expressions (inputs: type, text, box, expected)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from assayer.functions import markers as M
from assayer.functions.match import match_strict_binary, number
from assayer.functions.text import BOX_OPEN, boxed_last, contains_any, occurrences, parts_present


def _by_type(kind: Column, values: dict[str, Column], default: Column) -> Column:
    chosen = None
    for name, value in values.items():
        chosen = F.when(kind == name, value) if chosen is None else chosen.when(kind == name, value)
    return chosen.otherwise(default)


def _has(text: Column, part: str) -> Column:
    return F.contains(text, F.lit(part))


def _points(condition: Column, points: float) -> Column:
    return F.when(condition, F.lit(points)).otherwise(F.lit(0.0))


def reward_correct(text: Column, expected: Column) -> Column:
    return _points(match_strict_binary(expected, boxed_last(text)), 2.0)


def reward_format(text: Column) -> Column:
    boxed, opened, closed = _has(text, BOX_OPEN), _has(text, "<think>"), _has(text, "</think>")
    return _points(boxed, 0.5) + _points(opened & closed, 0.3) + _points(boxed & opened, 0.2)


def labels_present(kind: Column, text: Column) -> Column:
    return _by_type(kind, {t: parts_present(text, labels) for t, labels in M.STEP_LABELS.items()}, F.lit(0))


def reward_steps(kind: Column, text: Column) -> Column:
    return F.lit(0.1) * labels_present(kind, text)


def contamination_hits(kind: Column, text: Column) -> Column:
    low = F.lower(text)
    return _by_type(kind, {t: parts_present(low, [m.lower() for m in ms]) for t, ms in M.CONTAMINATION.items()}, F.lit(0))


def thrash_hits(text: Column) -> Column:
    return parts_present(F.lower(text), M.THRASH)


def penalty_contamination(kind: Column, text: Column) -> Column:
    return F.lit(-0.2) * contamination_hits(kind, text)


def penalty_thrash(text: Column) -> Column:
    return F.lit(-0.15) * thrash_hits(text)


def reward_honesty(text: Column, expected: Column) -> Column:
    """Correct with a pass claim, wrong with a fail claim, correct with a fail claim, anything else with a claim."""
    correct = match_strict_binary(expected, boxed_last(text))
    passed, failed = text.rlike("(?i)VER.*?(PASS|YES)"), text.rlike("(?i)VER.*?(FAIL|NO)")
    return (F.when(~(passed | failed), 0.0).when(correct & passed, 0.5).when(~correct & failed, 0.2)
            .when(correct & failed, -0.1).otherwise(-0.5))


def bonus_clean(kind: Column, text: Column, expected: Column) -> Column:
    complete = _by_type(kind, {t: parts_present(text, labels) == len(labels) for t, labels in M.STEP_LABELS.items()}, F.lit(True))
    clean = (thrash_hits(text) == 0) & (contamination_hits(kind, text) == 0)
    return _points(match_strict_binary(expected, boxed_last(text)) & complete & clean, 5.0)


def reward_thinking(text: Column) -> Column:
    return _points(_has(text, "<think>") | (F.char_length(text) > 200), 0.25)


def level_format(text: Column) -> Column:
    total = (_points(_has(text, "<think>"), 0.2) + _points(_has(text, "</think>"), 0.1) + _points(_has(text, BOX_OPEN), 0.5)
             + _points(occurrences(text, BOX_OPEN) == 1, 0.2))
    return F.least(total, F.lit(1.0))


def level_process(kind: Column, text: Column) -> Column:
    low = F.lower(text)
    binary = (_points(contains_any(text, ["bit[", "bit "]), 0.5) + _points(contains_any(text, ["AND", "OR", "XOR", "NOT", "IDENTITY"]), 0.5)
              + _points(_has(low, "verify") | _has(text, "✓"), 0.5) + _points(text.rlike("[01]{8}"), 0.5))
    cipher = (_points(_has(text, "->") | _has(low, "mapping"), 0.5) + _points(text.rlike("[a-z] -> [a-z]"), 0.5) + _points(_has(low, "decrypt"), 0.5))
    gravity = (_points(_has(text, "g =") | _has(low, "gravitational"), 0.5) + _points(text.rlike(r"[0-9]+\.[0-9]{2}"), 0.5)
               + _points(_has(text, "0.5") & _has(text, "t^2"), 1.0))
    equation = (_points(contains_any(text, ["add", "multiply", "subtract", "+", "*", "-"]), 0.5) + _points(contains_any(low, ["symbol", "digit"]), 0.5)
                + _points(_has(low, "verify"), 0.5))
    terms = {"binary": binary, "cipher": cipher, "gravity": gravity, "equation": equation}
    return F.least(_by_type(kind, terms, F.lit(0.0)), F.lit(2.0))


def level_correct(kind: Column, predicted: Column, expected: Column) -> Column:
    """Full marks for an exact match, half a point per equal bit, or a step by numeric distance."""
    from assayer.functions.match import hamming

    gap = F.abs(number(predicted) - number(expected))
    bits = (8 - hamming(predicted, expected)) * F.lit(0.5)
    return (F.when(predicted == expected, 5.0)
            .when((kind == "binary") & (F.char_length(predicted) == 8) & (F.char_length(expected) == 8), bits)
            .when(kind.isin("gravity", "unit") & (gap < 0.1), 3.0).when(kind.isin("gravity", "unit") & (gap < 1.0), 1.0).otherwise(0.0))


def level_penalty(kind: Column, text: Column) -> Column:
    low = F.lower(text)
    asserted = _points(_has(low, "i identify") & ~_has(text, "bit["), -1.0)
    thrash = _points(parts_present(low, ["hmm", "let me try", "actually", "wait", "no that"]) > 3, -0.5)
    mixed = _points((kind == "binary") & contains_any(text, ["LEN:", "TABLE:", "VOCAB"]), -1.5)
    return F.greatest(asserted + thrash + mixed, F.lit(-2.0))


def reward_multilevel(kind: Column, text: Column, predicted: Column, expected: Column) -> Column:
    return level_format(text) + level_process(kind, text) + level_correct(kind, predicted, expected) + level_penalty(kind, text)
