"""Learned language profiles: held-out texts against the fixed word lists, and odd rows."""

from pyspark.sql import functions as F

from assayer.operators import filters, profiles
from assayer.plans import derive
from tests.conftest import SMALL


def test_held_out_texts_beat_the_word_lists(spark):
    docs = derive.documents(spark, SMALL.replace("0.001", "0.01")).where("lang is not null")
    learned = profiles.learn_profiles(docs.where("doc_id % 5 <> 0"))
    held = docs.where("doc_id % 5 = 0")
    right = lambda rows: rows.where("language = lang").count()
    mine = right(profiles.profile_language(held, learned, "doc_id", "lang"))
    lists = right(held.select("lang", filters.detect_language(F.col("text")).alias("language")))
    assert mine > lists and mine >= 0.97 * held.where("text rlike '\\\\p{L}'").count()


def test_small_profiles_and_odd_rows(spark):
    teach = spark.createDataFrame([("der die und ich nicht", "de"), ("the and of this that", "en"), (None, "en"), ("zzz", None)] * 6, "text string, lang string")
    learned = profiles.learn_profiles(teach)
    weights = {(r.edge, r.language): r.weight for r in learned.collect()}
    assert all((e, other) in weights for e, _ in weights for other in ("de", "en")) and ("^zz", "en") not in weights
    texts = [(1, "this and that"), (2, "und nicht"), (3, None), (4, "12 !"), (5, "xyzw qqqq"), (None, "the of")]
    frame = spark.createDataFrame([(i, t, "x", 1.0) for i, t in texts], "doc_id bigint, text string, language string, weight double").select("doc_id", "text")
    assert {r.doc_id: r.language for r in profiles.profile_language(frame, learned).collect()} == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und", None: "en"}
    assert {r.language for r in profiles.profile_language(frame, learned.where("false")).collect()} == {"und"}


def test_edges_of_a_text_are_not_moved(spark):
    """Sums leave the task that reads a text, not its edges: a line a text and language at most."""
    teach = spark.createDataFrame([("der die und ich nicht", "de"), ("the and of this that", "en")] * 6, "text string, lang string")
    named = profiles.profile_language(spark.createDataFrame([(1, "the and"), (2, "und die")], "doc_id bigint, text string"), profiles.learn_profiles(teach))
    assert {r.doc_id: r.language for r in named.collect()} == {1: "en", 2: "de"}
    plan = named._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [_doc_id" in plan and not any("Aggregate [" in line and "doc_id" in line.split("],")[0] and "edge" in line.split("],")[0] for line in plan.splitlines())


def test_equal_scores_and_missing_weights(spark):
    known = spark.createDataFrame([("^th", "en", -1.0), ("^th", "de", -1.0), ("^un", "fr", -2.0)], "edge string, language string, weight double")
    frame = spark.createDataFrame([(1, "this"), (2, "unter"), (3, "xx"), (1, "this")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.language) for r in profiles.profile_language(frame, known).collect()) == [(1, "de"), (1, "de"), (2, "fr"), (3, "und")]
