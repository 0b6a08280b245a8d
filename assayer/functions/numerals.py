"""Numeral encoding and decoding as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Digit tables by place, and letter values.
PLACES = [
    (1000, ["", "M", "MM", "MMM"]),
    (100, ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"]),
    (10, ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"]),
    (1, ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]),
]
VALUES = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def roman_encode(n: Column) -> Column:
    """Numeral of an integer from 0 to 3999 (null outside)."""
    parts = []
    for unit, digits in PLACES:
        table = F.array(*[F.lit(d) for d in digits])
        parts.append(F.get(table, (F.floor(n / unit) % 10).cast("int")))
    return F.when((n >= 0) & (n < 4000), F.concat(*parts))


def roman_decode(text: Column) -> Column:
    """Value by the subtractive rule: a letter smaller than its successor counts negative; null on other characters."""
    letters = F.filter(F.split(F.upper(text), ""), lambda c: c != "")
    values = F.transform(letters, lambda c: F.coalesce(*[F.when(c == k, v) for k, v in VALUES.items()]))
    following = F.concat(F.slice(values, 2, F.greatest(F.size(values), F.lit(1))), F.array(F.lit(0)))
    signed = F.zip_with(values, following, lambda v, nxt: F.when(v < nxt, -v).otherwise(v))
    total = F.aggregate(signed, F.lit(0), lambda acc, v: acc + v)
    return F.when(text.rlike("^(?i)[IVXLCDM]*$"), total)
