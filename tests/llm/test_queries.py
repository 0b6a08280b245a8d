"""Queries with SQL against their SQL, and the pipeline's stages against the operators' brute force."""

import duckdb
import pytest

import corpus_pipeline
from assayer.llm.queries import QUERIES
from tests.conftest import SMALL
from tests.llm.test_minhash import brute as near
from tests.llm.test_suffixes import brute as repeats
from tests.llm.test_winnowing import brute as leaks
from tools.check import TABLES, table


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_matches_sql(spark, name):
    query, sql = QUERIES[name]
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    frame, cursor = query(spark, SMALL), db.execute(sql)
    assert table(frame.columns, [tuple(r) for r in frame.collect()]) == table([d[0] for d in cursor.description], cursor.fetchall())


def test_pipeline_stages(spark):
    docs = corpus_pipeline.read(spark, SMALL, "documents")
    odd = spark.createDataFrame([(10_001, None, "en", "s", 0), (10_002, "", "en", "s", 0), (10_003, "12 34", None, None, 5)], docs.schema)
    docs = docs.unionByName(odd)
    steps = dict(corpus_pipeline.STAGES)
    first = steps["language"](spark, docs, SMALL)
    assert first.columns == docs.columns and {r.doc_id for r in docs.collect()} - {r.doc_id for r in first.collect()} == {10_001, 10_002, 10_003}
    second = steps["near_copies"](spark, first, SMALL)
    rows = sorted((r.doc_id, r.text) for r in first.collect())
    classes = near(rows)
    assert sorted(r.doc_id for r in second.collect()) == sorted(k for k, v in classes.items() if k == v) and second.columns == docs.columns
    third = steps["repeated_passages"](spark, second, SMALL)
    want = {k: kept.decode("utf-8", "ignore") for k, (_, _, kept) in repeats([(r.doc_id, r.text) for r in second.collect()], 100).items() if kept}
    assert {r.doc_id: r.text for r in third.collect()} == want and third.columns == docs.columns
    fourth = steps["benchmark_leaks"](spark, third, SMALL)
    bench = [(r.item_id, r.text) for r in corpus_pipeline.read(spark, SMALL, "benchmark").collect()]
    hit = leaks([(r.doc_id, r.text) for r in third.collect()], bench)
    assert sorted(r.doc_id for r in fourth.collect()) == sorted(k for k, v in hit.items() if not v[1])
    last = steps["packed"](spark, fourth, SMALL)
    assert {r.doc_id for r in last.select("doc_id").collect()} == {r.doc_id for r in fourth.collect()}


def test_run_equals_the_stages(spark):
    docs = corpus_pipeline.read(spark, SMALL, "documents")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SMALL), f"test-{name}")
    placed = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows.collect())
    found = corpus_pipeline.run(spark, SMALL)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert placed(found) == placed(docs) and found.count() > 100
    # Seats are gapless and no sequence is longer than it may be; which piece sits where is arbitrary.
    seats = {}
    for r in found.collect():
        seats.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for listed in seats.values():
        ends = [0]
        for offset, length in sorted(listed):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 2048


def test_stages_of_an_empty_table_a_long_text_and_more_columns(spark):
    docs = corpus_pipeline.read(spark, SMALL, "documents")
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        none = corpus_pipeline.stored(stage(spark, none, SMALL), f"none-{name}")
        assert none.count() == 0
    words = " ".join(f"the rule {i} gives the number {i * i % 9973} and the letter {i % 26}" for i in range(3_000))
    few = docs.where("doc_id < 12").unionByName(spark.createDataFrame([(77_777, words, "en", "s", len(words))], docs.schema))
    wide = few.selectExpr("*", "'x' as id", "1 as n_words", "'y' as keeper", "2 as label", "'z' as bucket")
    for name, stage in corpus_pipeline.STAGES:
        wide = corpus_pipeline.stored(stage(spark, wide, SMALL), f"long-{name}")
        assert wide.where("doc_id = 77777").count() > 0
        if name != "packed":
            assert wide.columns == docs.columns
            wide = wide.selectExpr("*", "'x' as id", "1 as n_words", "'y' as keeper")
    assert wide.where("doc_id = 77777").agg({"length": "sum"}).first()[0] > 30_000


def test_pipeline_keeps_repeated_rows_once(spark):
    docs = corpus_pipeline.read(spark, SMALL, "documents")
    row = docs.where("length(text) between 400 and 2000").orderBy("doc_id").first()
    words = " ".join(f"la réponse {i} de la règle numéro {i * i}" for i in range(20))
    other = " ".join(f"the answer {i} of another rule {i * 7}" for i in range(20))
    odd = spark.createDataFrame([tuple(row), tuple(row), (None, words, "fr", "s", 1), (None, words, "fr", "s", 1), (None, other, "en", "s", 1), (None, "12", "en", "s", 1)], docs.schema)
    steps = dict(corpus_pipeline.STAGES)
    first = steps["language"](spark, docs.where("doc_id % 4 = 0").unionByName(odd).where(f"text <> '' or doc_id = {row.doc_id}"), SMALL)
    assert sorted(r.text for r in first.where("doc_id is null").collect()) == sorted([words, words, other])
    second = steps["near_copies"](spark, first, SMALL)
    assert second.where(second.doc_id == row.doc_id).count() == 1
    assert sorted(r.text for r in second.where("doc_id is null").collect()) == sorted([words, other])
    third = steps["repeated_passages"](spark, second, SMALL)
    assert third.where(third.doc_id == row.doc_id).count() == 1 and third.where("doc_id is null").count() == 2
