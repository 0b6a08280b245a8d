"""Micro-fixtures of extraction and equivalence, expected values by hand."""

from pyspark.sql import functions as F

from assayer.functions import match as Q, style, text as T
from assayer.functions.numerals import roman_decode, roman_encode


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("t")).alias("x")).collect()]


def matches(spark, rule, pairs):
    rows = spark.createDataFrame([(i, e, g) for i, (e, g) in enumerate(pairs)], "i int, e string, g string")
    return [r[0] for r in rows.orderBy("i").select(rule(F.col("e"), F.col("g"))).collect()]


def test_strict_binary(spark):
    pairs = [("00000001", "1"), ("0234", "234"), ("1d", "1"), ("1_000", "1000"), ("100", "101"), ("200", "202"), ("abc", "ABC"), ("5", "")]
    assert matches(spark, Q.match_strict_binary, pairs) == [False, True, False, False, False, True, True, False]
    assert matches(spark, Q.match_metric, [("00000001", "1")]) == [True]


def test_tolerances_differ(spark):
    assert matches(spark, Q.match_metric, [("200", "203")]) == [False]
    assert matches(spark, Q.match_unit_tol, [("200", "201.9"), ("200", "202"), ("x", "x")]) == [True, False, False]
    assert matches(spark, Q.match_abs, [("1.00", "1.019"), ("1.00", "1.021"), ("a", "A")]) == [True, False, True]
    assert matches(spark, Q.match_abs_rel, [("10000", "10009"), ("10000", "10011"), ("", "")]) == [True, False, False]


def test_boxed(spark):
    texts = [r"\boxed{1} \boxed{ 2 }", r"\boxed{a{b}c}", r"\boxed{x} \boxed{open", r"\boxed{} \boxed{y}", "none", None]
    assert column(spark, texts, T.boxed_last) == ["2", "a{b", "x", "y", "", ""]
    assert column(spark, texts, T.boxed_balanced) == ["2", "a{b}c", "x", "y", None, None]


def test_final_answer(spark):
    texts = [r"The answer is \boxed{42}", "The final answer is: 3.14", "Just a number 100 in text", None, r"\boxed{5} \boxed{}", r"so \boxed{7", "words only\n last ", " \n"]
    assert column(spark, texts, T.final_answer) == ["42", "3.14", "100", "NOT_FOUND", "5", "7", "last", "NOT_FOUND"]


def test_think_block(spark):
    texts = ["<think>a</think>b", r"<think>a\boxed{1}", "<think>a", "a</think>b", "plain"]
    assert column(spark, texts, T.think_block) == ["a", "a", "", "a", ""]


def test_confidence_and_clamp(spark):
    texts = ["", "plain", r"\boxed{1}", "maybe perhaps possibly maybe", r"\boxed{1} certainly clearly obviously verified", "maybe"]
    got = column(spark, texts, style.confidence)
    assert [round(x, 9) for x in got] == [0.5, 0.3, 0.7, 0.0, 1.0, 0.2]


def test_marker_overlap_counts_both_ways(spark):
    assert round(column(spark, ["inconsistent across"], style.confidence)[0], 9) == 0.3


def test_copy_ratio(spark):
    assert column(spark, [r"abc \boxed{abd}", r"xyz \boxed{xyz}", "no box"], style.copy_ratio) == [2 / 3, 1.0, 0.0]


def test_numerals(spark):
    numbers = [1, 4, 9, 40, 1994, 3999]
    rows = spark.createDataFrame([(n,) for n in numbers], "n int")
    encoded = [r[0] for r in rows.orderBy("n").select(roman_encode(F.col("n"))).collect()]
    assert encoded == ["I", "IV", "IX", "XL", "MCMXCIV", "MMMCMXCIX"]
    assert column(spark, encoded + ["XQ"], roman_decode) == numbers + [None]


def test_wrap_think(spark):
    assert column(spark, [r"why \boxed{1}", r"\boxed{1}", r"<think>x</think>\boxed{1}", "none"], T.wrap_think) == [
        "<think>\nwhy\n</think>\n\n\\boxed{1}", r"\boxed{1}", r"<think>x</think>\boxed{1}", "none"]
