"""Steps of reasoning texts: texts are searched once, where they are read, and no join moves them."""

import random
import re

from pyspark.sql import functions as F

from assayer.functions import markers as M, text as T
from assayer.plans import derive as D
from registry import grading
from tests.conftest import SMALL
from tests.test_moved_bytes import shuffled


def test_first_failures_move_no_text(spark):
    chars = D.traces(spark, SMALL).agg(F.sum(F.length("a_text") + F.length("b_text"))).first()[0]
    moved, rows = shuffled(spark, lambda: grading.first_failures(spark, SMALL).collect())
    assert rows and moved < 0.2 * chars


def test_first_failures_search_a_text_once(spark):
    plan = grading.first_failures(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    for pattern in (M.CHAR_ALIGN, M.DIVISION, M.PER_BIT[0][2:], "(?i)" + M.CONSISTENCY[0]):
        assert plan.count(pattern) == 1


def texts():
    rng = random.Random(11)
    parts = ["bit", "Bit", "position", "pos", "b", "B", "out", "output", "column", "col", "input", "input_bit", "AND", "xnor", "nor", "3", "7", "9", "[", "]", ":", "=", "_", " ",
             " ", "\n", "matches", "match", "all", "example", "examples", "fits", "every", "VER", "ver", "pass", "OK", "consistent", "with", "holds", "for", "g", "rate", "2", "*", "d",
             "/", "t", "^", "é", "K", "İ", "ſ", "ß", " bit [3", " Bit 7", "pos[1]", " B2 =", " out[ 5 ]", " output [4]", " column 0", " Position 6", " col[ 3]", " bit_5", " input bit", " Input [",
             "\nXOR ", "(nand)"]
    return ["".join(rng.choice(parts) + rng.choice(["", "", " "]) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + [None]


def test_searches_find_what_single_patterns_find(spark):
    rows = spark.createDataFrame([(t,) for t in texts()], "text string").repartition(8)
    text, low = F.col("text"), F.lower("text")
    gates = [part for g in M.STEP_WORDS["binary"]["gates"] for part in (g, g.lower())]
    total = lambda patterns: sum((T.count_matches(text, "(?i)" + p) for p in patterns), F.lit(0))
    checks = {"gates": T.count_words(text, gates, r"\b").eqNullSafe(T.count_matches(text, r"\b(?:" + "|".join(gates) + r")\b"))}
    for name, patterns in (("bits", M.PER_BIT), ("inputs", M.INPUT_MENTIONS)):
        assert all(re.match(r"\\b[a-zA-Z]", p) for p in patterns)
        checks[name] = T.count_words(text, [p[2:] for p in patterns], flags="i").eqNullSafe(total(patterns))
    for i, p in enumerate(M.CONSISTENCY + M.GRAVITY_FORMS):
        search = text.rlike("(?i)" + p)
        checks[f"guard{i}"] = T.guarded(low, p, search, F.lit(False)).eqNullSafe(search)
    failed = rows.agg(*[F.count_if(~ok).alias(name) for name, ok in checks.items()]).first().asDict()
    assert not any(failed.values()), failed
    hits = rows.agg(F.count_if(total(M.PER_BIT) > 1).alias("bits"), F.count_if(text.rlike("(?i)" + "|".join(M.CONSISTENCY))).alias("said")).first()
    assert hits.bits > 100 and hits.said > 20


def test_plain_runs():
    assert T.plain_runs(r"\bpos\s*\[\s*[0-7]\s*\]") == ["pos"]
    assert T.plain_runs(r"fits?\s+(?:with|across)+\s+All\.x*(?:a(?:b|c))?") == ["fit", "all"]
    assert T.plain_runs("one|two") == [] and T.plain_runs("a{2}") == []
