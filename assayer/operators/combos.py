"""Order, operation and format combinations on five-character digit expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

# Canonical scan order.
ORDERS = ["AB_CD", "BA_DC"]
OPERATIONS = ["add", "sub", "mul", "cat", "rcat", "mul_add1", "mul_sub1", "addm1", "add1"]
FORMATS = ["raw", "rev", "abs", "rev_abs", "zpad4"]
COMBINATIONS = [(o, p, f) for o in ORDERS for p in OPERATIONS for f in FORMATS]


def combination_literals() -> Column:
    """All combinations as one folded constant array."""
    table = [dict(combo=i, operand_order=o, operation=p, format=f) for i, (o, p, f) in enumerate(COMBINATIONS)]
    return F.from_json(F.lit(json.dumps(table)), "array<struct<combo:int,operand_order:string,operation:string,format:string>>")


def apply_combination(expression: Column, order: Column, operation: Column, fmt: Column) -> Column:
    """Result text of one combination; null for non-digit operands or a combination that does not apply."""
    digits = expression.rlike(r"^[0-9]{2}(?s:.)[0-9]{2}$")
    first = F.when(order == "AB_CD", F.substring(expression, 1, 2)).otherwise(F.reverse(F.substring(expression, 1, 2)))
    second = F.when(order == "AB_CD", F.substring(expression, 4, 2)).otherwise(F.reverse(F.substring(expression, 4, 2)))
    a, b = F.when(digits, first).try_cast("bigint"), F.when(digits, second).try_cast("bigint")
    value = (F.when(operation == "add", a + b).when(operation == "sub", a - b).when(operation == "mul", a * b)
             .when(operation == "mul_add1", a * b + 1).when(operation == "mul_sub1", a * b - 1)
             .when(operation == "addm1", a + b - 1).when(operation == "add1", a + b + 1))
    plain, size = value.cast("string"), F.abs(value).cast("string")
    padded = F.when(F.char_length(plain) >= 4, plain).otherwise(F.lpad(plain, 4, "0"))
    calculated = (F.when(fmt == "raw", plain).when(fmt == "rev", F.reverse(plain)).when(fmt == "abs", size)
                  .when(fmt == "rev_abs", F.reverse(size)).when((fmt == "zpad4") & (value >= 0), padded))
    forward, backward = F.concat(first, second), F.concat(second, first)
    joined = (F.when(((operation == "cat") & (fmt == "raw")) | ((operation == "rcat") & (fmt == "rev")), forward)
              .when(((operation == "cat") & (fmt == "rev")) | ((operation == "rcat") & (fmt == "raw")), backward))
    return F.when(digits, F.when(operation.isin("cat", "rcat"), joined).otherwise(calculated))


def combination_scan(pairs: DataFrame, targets: DataFrame, fewest: int = 3) -> DataFrame:
    """First combination in canonical order that holds for all pairs of a row, applied to the target.

    Only combinations that explain a pair leave the generator; a combination holds when it explains as many pairs as
    the row has. ``targets``: ``row_id, target, expected``.
    """
    tried = pairs.select("row_id", "lhs", "rhs", F.inline(combination_literals()))
    fits = apply_combination(F.col("lhs"), F.col("operand_order"), F.col("operation"), F.col("format")) == F.col("rhs")
    explained = tried.where(fits).groupBy("row_id", "combo").agg(F.count("*").alias("explained"))
    sizes = pairs.groupBy("row_id").agg(F.count("*").alias("n_pairs")).where(F.col("n_pairs") >= fewest)
    holds = explained.join(sizes, "row_id").where(F.col("explained") == F.col("n_pairs"))
    first = holds.groupBy("row_id").agg(F.min("combo").alias("combo"), F.count("*").alias("n_valid"))
    table = combination_literals()
    chosen = targets.join(first, "row_id").withColumn("choice", F.get(table, F.col("combo")))
    got = apply_combination(F.col("target"), F.col("choice.operand_order"), F.col("choice.operation"), F.col("choice.format"))
    return chosen.select("row_id", "target", "expected", F.col("choice.operand_order").alias("operand_order"),
                         F.col("choice.operation").alias("operation"), F.col("choice.format").alias("format"), "n_valid",
                         got.alias("predicted"), F.coalesce(got == F.col("expected"), F.lit(False)).alias("verified"))


def equation_subtype(pairs: Column) -> Column:
    """Digit share of the operand characters above 0.7: SYMBOL-DIGIT, else CIPHER-DIGIT; UNKNOWN without pairs."""
    sides = F.filter(F.transform(pairs, lambda p: p["lhs"]), lambda lhs: F.char_length(lhs) >= 5)
    operands = F.array_join(F.transform(sides, lambda lhs: F.concat(F.substring(lhs, 1, 2), F.substring(lhs, 4, 2))), "")
    digits = F.char_length(F.regexp_replace(operands, "[^0-9]", ""))
    return (F.when(F.coalesce(F.char_length(operands), F.lit(0)) == 0, "UNKNOWN")
            .when(digits / F.nullif(F.char_length(operands), F.lit(0)) > 0.7, "SYMBOL-DIGIT").otherwise("CIPHER-DIGIT"))
