"""Answer equivalence rules. Each rule keeps its own tolerance; they are deliberately not merged."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from assayer.functions.text import strip

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def number(text: Column) -> Column:
    """Double value of numeric text, null for everything else (one anchored pattern guards the cast)."""
    trimmed = strip(text)
    return F.when(trimmed.rlike(NUMBER), trimmed.try_cast("double"))


def same_text(a: Column, b: Column) -> Column:
    return F.lower(strip(a)) == F.lower(strip(b))


def isclose(a: Column, b: Column, rel: float, absolute: float) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def match_metric(expected: Column, got: Column) -> Column:
    e, g = number(expected), number(got)
    return F.coalesce(F.when(e.isNotNull() & g.isNotNull(), isclose(e, g, 1e-2, 1e-5)).otherwise(same_text(expected, got)), F.lit(False))


def match_strict_binary(expected: Column, got: Column) -> Column:
    e, g = strip(expected), strip(got)
    return (F.when(e.isNull() | g.isNull() | (g == ""), False)
            .when(e.rlike("^[01]+$"), F.lower(e) == F.lower(g))
            .otherwise(match_metric(expected, got)))


def match_abs(expected: Column, got: Column, tolerance: float = 0.02) -> Column:
    near = F.abs(number(got) - number(expected)) < tolerance
    return F.coalesce(same_text(expected, got) | F.coalesce(near, F.lit(False)), F.lit(False))


def rounded(text: Column) -> Column:
    """Numeric part of a normalised answer: two places."""
    return F.bround(number(text), 2)


def normalize_answer(text: Column) -> Column:
    """Comparison key: numbers rounded to two places, else trimmed lower-case text."""
    return F.coalesce(rounded(text).cast("string"), F.lower(strip(text)))


def match_round2(expected: Column, got: Column) -> Column:
    return F.coalesce(normalize_answer(expected) == normalize_answer(got), F.lit(False))


def match_abs_rel(expected: Column, got: Column) -> Column:
    e, g = number(expected), number(got)
    near = (F.abs(g - e) < 0.01) | ((e != 0) & (F.abs((g - e) / F.nullif(e, F.lit(0.0))) < 0.001))
    blank = (strip(expected) == "") | (strip(got) == "")
    return F.coalesce(~blank & (same_text(expected, got) | F.coalesce(near, F.lit(False))), F.lit(False))


def match_unit_tol(expected: Column, got: Column) -> Column:
    e, g = number(expected), number(got)
    gap = F.abs(g - e)
    return F.coalesce((gap < 0.01) | (gap / F.greatest(F.lit(0.01), F.abs(e)) < 0.01), F.lit(False))


def match_by_type(kind: Column, expected: Column, got: Column) -> Column:
    """``matched`` or ``mismatch``; types that are accepted whatever the value are labelled ``accepted_by_rule``."""
    near = F.coalesce(F.abs(number(got) - number(expected)) < 0.05, strip(got) == strip(expected))
    verdict = lambda ok: F.when(F.coalesce(ok, F.lit(False)), "matched").otherwise("mismatch")
    return (F.when(kind.isin("gravity", "unit", "unit_conversion"), verdict(near))
            .when(kind.isin("cipher", "equation", "equation_transform"), "accepted_by_rule")
            .otherwise(verdict(same_text(expected, got))))


def per_word_accuracy(expected: Column, got: Column) -> Column:
    e = F.filter(F.split(F.lower(expected), r"\s+"), lambda w: w != "")
    g = F.filter(F.split(F.lower(got), r"\s+"), lambda w: w != "")
    equal = F.size(F.filter(F.zip_with(e, g, lambda a, b: a == b), lambda same: same))
    return F.when((F.size(e) == 0) | (F.size(e) != F.size(g)), 0.0).otherwise(equal / F.nullif(F.size(e), F.lit(0)))


def hamming(a: Column, b: Column) -> Column:
    """Differing positions over the common length."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y)
    return F.size(F.filter(pairs, lambda differs: differs))


def verified_within(computed: Column, stated: Column, tolerance: float = 0.02) -> tuple[Column, Column]:
    """Validity of a computed value against a stated answer, and the reason for a reject."""
    value = number(stated)
    gap = F.abs(F.round(computed, 2) - value)
    reason = (F.when(computed.isNull(), "no usable pairs").when(value.isNull(), "answer not numeric")
              .when(gap > tolerance + 1e-9, "outside tolerance"))
    return reason.isNull(), reason
