"""Every registered query runs at the smallest scale; a sample of groups is compared with its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from tools.check import TABLES, table

COMPARED = ["outcome_buckets_by_type", "calibration_error", "release_gate", "failure_modes", "chain_scores", "sequence_rule", "combo_scan", "apply_substitution",
            "byte_transform_scan", "best_candidate", "pass_at_k", "stratified_total", "curation_stages", "benchmark_overlap", "const_hold", "idw_neighbours",
            "read_puzzles", "read_dump_wrapped", "incremental_history"]


@pytest.mark.parametrize("name", COMPARED)
def test_matches_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    frame = entry.queries()[name](spark, SMALL)
    cursor = db.execute(entry.oracle_sql()[name])
    theirs = cursor.fetchall()
    assert table(frame.columns, [tuple(r) for r in frame.collect()]) == table([d[0] for d in cursor.description], theirs)


def test_registration_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_partition_count_does_not_change_results(spark):
    query = entry.queries()["majority_vote"]
    first = sorted(map(tuple, query(spark, SMALL).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert sorted(map(tuple, query(spark, SMALL).collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_unused_texts_are_not_read(spark):
    plan = entry.queries()["accuracy_by_type_run"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "a_box" in plan and "a_text" not in plan
