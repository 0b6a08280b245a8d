"""Balanced folds, user aggregates of hot groups, and a history that counts a run once."""

import random

import pytest

from assayer.operators import groups, series
from assayer.sources import history, tables


def greedy(sizes, k):
    loads = [0] * k
    for n in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += n
    return loads


def test_classes_equal_one_group_at_a_time():
    rng = random.Random(0)
    for _ in range(300):
        sizes, k = [rng.choice([1, 1, 1, 2, 3, 7, rng.randint(1, 60)]) for _ in range(rng.randint(0, 80))], rng.randint(1, 6)
        dealt = series.folds_of_classes([(n, sizes.count(n)) for n in set(sizes)], k)
        assert all(sum(given) == sizes.count(n) for n, given in dealt.items())
        assert [sum(n * given[f] for n, given in dealt.items()) for f in range(k)] == greedy(sizes, k)


def test_folds_keep_groups_whole_and_even(spark):
    rng = random.Random(1)
    rows = [(f"g{int(rng.paretovariate(0.8))}",) for _ in range(2000)] + [(None,)] * 7
    found = series.balanced_folds(spark.createDataFrame(rows, "series string"), "series", 4).collect()
    assert len(found) == len({r[0] for r in rows}) and sum(r.n for r in found) == 2007
    loads = [sum(r.n for r in found if r.fold == f) for f in range(4)]
    assert max(loads) - min(loads) <= max(r.n for r in found)
    assert series.balanced_folds(spark.createDataFrame([], "series string"), "series", 4).collect() == []


def test_map_groups_of_a_hot_group(spark):
    rows = spark.createDataFrame([(None if i % 7 == 0 else "hot" if i % 3 == 0 else f"k{i % 11}", i) for i in range(5000)], "key string, value bigint").repartition(9)
    seen = groups.map_groups(rows, ["key"], lambda t: {"n": t.num_rows, "values": sorted(t.column("value").to_pylist())[-3:], "most": t.num_rows},
                             lambda a, b: {"n": a["n"] + b["n"], "values": sorted(a["values"] + b["values"])[-3:], "most": max(a["most"], b["most"])}, lambda s: s,
                             "n bigint, values array<bigint>, most bigint", "n bigint, values array<bigint>, most bigint")
    got = {r.key: (r.n, list(r["values"]), r.most) for r in seen.collect()}
    want = {}
    for i in range(5000):
        want.setdefault(None if i % 7 == 0 else "hot" if i % 3 == 0 else f"k{i % 11}", []).append(i)
    assert {k: v[:2] for k, v in got.items()} == {k: (len(v), v[-3:]) for k, v in want.items()}
    assert got["hot"][2] < len(want["hot"]) / 3  # no task saw the whole group at once
    assert groups.map_groups(rows.where("false"), ["key"], lambda t: {"n": t.num_rows}, lambda a, b: a, lambda s: s, "n bigint", "n bigint").collect() == []


def line(spark, run, day, right):
    rows = spark.createDataFrame([("roman", i < right) for i in range(10)], "type string, ok boolean")
    return tables.summarise_run(rows, run, day)


def test_history_counts_a_run_once(spark, tmp_path):
    path = str(tmp_path / "history")
    with pytest.raises(FileNotFoundError):
        history.read_history(spark, path)
    line(spark, "lost", "2024-01-03", 1).write.parquet(f"{path}/runs/half-written")  # staged, never committed
    with pytest.raises(FileNotFoundError):
        history.read_history(spark, path)
    history.append_history(line(spark, "a", "2024-01-01", 4), path)
    history.append_history(line(spark, "a", "2024-01-01", 4), path)  # replayed
    history.append_history(line(spark, "a", "2024-01-02", 5).unionByName(line(spark, "b", "2024-01-02", 6)), path)
    history.append_history(line(spark, "b", "2024-01-02", 6).unionByName(line(spark, "c", "2024-01-02", 7)), path)  # half of it is there
    got = sorted((r.run, r.run_date, r.local_total_acc) for r in history.read_history(spark, path).collect())
    assert got == [("a", "2024-01-01", 0.4), ("a", "2024-01-02", 0.5), ("b", "2024-01-02", 0.6), ("c", "2024-01-02", 0.7)]
