"""What queries shuffle, beside what they read."""

import json
import random

from pyspark.sql import functions as F

from assayer.operators import bits, selection as S
from assayer.plans import derive as D
from assayer.sources import tables as T
from registry import selection, storage
from tests.conftest import SMALL


def shuffled(spark, action):
    """Bytes that the stages of an action write for shuffles, and its result."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway

    def written():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = written()
    out = action()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return written() - before, out


def test_rows_of_dumps_stay_in_their_task(spark, tmp_path):
    rng = random.Random(3)
    sizes = [300, 1, 0, 40]
    for i, n in enumerate(sizes):
        rows = [{"row_id": i * 1000 + j, "text": "".join(rng.choice("abcdefghij {}[]\"\\") for _ in range(2000))} for j in range(n)]
        (tmp_path / f"{i}.json").write_text(json.dumps({"meta": {"n": n}, "rows": rows} if i % 2 else rows))
    # As at size: the pieces are above Spark's limit, the states of their ranges are not.
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "100k")
    try:
        moved, got = shuffled(spark, lambda: T.read_dump(spark, str(tmp_path)).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first())
    finally:
        spark.conf.set(name, before)
    assert (got.n, got.chars) == (sum(sizes), 2000 * sum(sizes))
    assert moved < 0.1 * got.chars


def test_dumps_are_written_without_a_shuffle(spark):
    rows = D.traces(spark, SMALL)
    chars = rows.agg(F.sum(F.length("a_text") + F.length("b_text"))).first()[0]
    for wrapped in (False, True):
        moved, got = shuffled(spark, lambda: storage._dump(spark, SMALL, wrapped).agg(F.sum("n")).first()[0])
        assert got == rows.count() and moved < 0.1 * chars


def test_first_rules_need_no_line_per_valid_rule(spark):
    """Rows of one chunk, of several, and without a rule for some bits get the same first rules as from the list of all valid ones."""
    rng = random.Random(5)
    byte = lambda: f"{rng.randrange(256):08b}"
    turn = {0: lambda x: x, 1: lambda x: "".join("10"[int(c)] for c in x), 2: lambda x: x[1:] + x[0], 3: lambda x: x[:4] + byte()[4:]}
    rows = [(r, p, x, turn[r % 4](x)) for r in range(40) for p, x in enumerate(byte() for _ in range([8, 1, 62, 63, 150][r % 5]))]
    pairs = spark.createDataFrame(rows, "row_id int, pos int, lhs string, rhs string")
    columns = ["row_id", "bit", "rule", "kind", "op", "a", "b", "c"]
    for rules in (bits.gate_rules(), bits.simple_rules(), bits.ordered_rules()):
        found = bits.first_matching(pairs, rules).select(columns)
        want = {tuple(r) for r in bits.first_rules(bits.bit_rules(pairs, rules)).select(columns).collect()}
        assert {tuple(r) for r in found.collect()} == want and len(want) == found.count()
    # Whole numbers alone are aggregated while rules are tried, so that no task sorts a line for each rule.
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_first_and_longest_need_no_ranks(spark):
    """Votes and best candidates by the place of a line itself equal those by its number, and no window ranks the lines."""
    ranked, placed = (selection.candidates(spark, SMALL, **how) for how in ({}, {"ordered": True}))
    prompts = selection.prompts(spark, SMALL)
    for operator in (S.vote_oracle_greedy, lambda c, p: S.best_candidate(p, c), lambda c, p: S.majority_vote(c)):
        assert sorted(map(str, operator(placed, prompts).collect())) == sorted(map(str, operator(ranked, prompts).collect()))
    for name in ("vote_oracle_greedy", "best_candidate", "majority_vote"):
        assert "Window" not in selection.QUERIES[name][0](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
