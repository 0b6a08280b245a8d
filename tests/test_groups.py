"""Ranks, medians, components, deduplication and neighbours against brute force."""

import math
import random
import statistics

import pytest

from pyspark.sql import functions as F

from assayer.operators import components, dedup, evaluation, quantiles, redaction, selection, series, substitution
from assayer.plans import curation
from tests.conftest import SMALL


def test_exact_median(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([1.0, 2.5, rng.random() * 100])) for k in range(5) for _ in range(k * 37 + 1)] + [(9, 4.0)] * 6
    rows += [(10, rng.random()) for _ in range(20001)] + [(10, 1e12)] + [(11, -1e9), (11, 3.0)] + [(12, float(i % 3)) for i in range(9999)]
    got = {r.k: r.v for r in quantiles.exact_median(spark.createDataFrame(rows, "k int, v double"), ["k"], "v").collect()}
    assert got == {k: statistics.median(v for q, v in rows if q == k) for k in {q for q, _ in rows}}


def test_rank_in_order(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 7).alias("level"))
    ranked = quantiles.rank_in_order(rows, F.col("level"), F.md5(F.col("id").cast("string"))).collect()
    import hashlib
    order = sorted(ranked, key=lambda r: (r.level, hashlib.md5(str(r.id).encode()).hexdigest()))
    assert [r.rank for r in order] == list(range(1, 3001))


def test_large_quota_equals_small_path(spark, monkeypatch):
    rows = spark.range(2000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("type"))
    small = {r.row_id for r in selection.stratified_n(rows, 400, "s").collect()}
    monkeypatch.setattr(selection, "PRUNED_RANKS", 10)
    assert {r.row_id for r in selection.stratified_n(rows, 400, "s").collect()} == small and len(small) == 800


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(101, 100)], "id long, leader long")
    got = {r.id: r.component for r in components.connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_bucket_classes_keep_every_link(spark):
    """One hot bucket of three unlike groups, chains that avoid the leader, and unlike members: no link is lost."""
    entries = spark.range(300).select(F.lit(1).alias("bucket"), "id").unionByName(spark.range(400, 440).select(F.lit(2).alias("bucket"), "id"))
    near = (F.col("id") < 300) & (F.col("id") % 3 == F.col("leader") % 3) | (F.col("id") >= 400) & (F.abs(F.col("id") - F.col("leader")) == 1) & (F.col("id") < 410)
    for block in (512, 7):
        got = {r.id: r.component for r in components.bucket_classes(entries, lambda pairs: pairs.where(near), block).collect()}
        assert got == {**{i: i % 3 for i in range(300)}, **{i: 400 for i in range(400, 410)}}


def jaccard_clusters(texts, threshold):
    import re
    shingles = {}
    for key, text in texts.items():
        tokens = re.findall(r"[^\W_]+", text.lower())
        shingles[key] = {tuple(tokens[i:i + 3]) for i in range(max(len(tokens) - 2, 1))}
    parent = {k: k for k in texts}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            s, t = shingles[a], shingles[b]
            if len(s & t) >= threshold * len(s | t):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: root(k) for k in keys}


def test_fuzzy_dedup_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    truth = jaccard_clusters({r.doc_id: r.text for r in docs.collect()}, 0.8)
    got = {r.doc_id: r.cluster for r in dedup.fuzzy_dedup(docs).collect()}
    assert got == truth


def test_fuzzy_dedup_chain_unlike_members_and_wordless_texts(spark):
    rng = random.Random(3)
    word = lambda: "w" + str(rng.randint(0, 10**6))
    base = [word() for _ in range(100)]
    chain, texts = list(base), [" ".join(base)]
    for k in range(3):
        chain[20 * k + 5], chain[20 * k + 15] = f"a{k}", f"b{k}"
        texts.append(" ".join(chain))
    shared = [word() for _ in range(40)]
    texts += [" ".join(shared + [word() for _ in range(40)]) for _ in range(200)]
    rows = list(enumerate(texts)) + [(900, "!!!"), (901, "??? ---"), (902, "!!!"), (903, ""), (904, "")]
    got = {r.doc_id: r.cluster for r in dedup.fuzzy_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    truth = jaccard_clusters({k: t for k, t in rows if k < 900}, 0.8)
    assert {k: v for k, v in got.items() if k < 900} == truth and len({truth[k] for k in range(4)}) == 1
    assert [got[k] for k in range(900, 905)] == [900, 901, 900, 903, 903]


def test_nested_benchmark_item_is_found(spark):
    from assayer.operators import contamination
    outer = " ".join(f"w{i}" for i in range(60))
    bench = spark.createDataFrame([(1, outer), (2, " ".join(outer.split()[10:30]))], "item_id long, text string")
    docs = spark.createDataFrame([(5, "x y z " + " ".join(outer.split()[10:30])), (6, "clean text of other words only and nothing else here")], "doc_id long, text string")
    shares = {(r.doc_id, r.item_id): r.share for r in contamination.overlap(docs, bench).collect()}
    assert shares == {(5, 1): 13 / 53, (5, 2): 1.0} and [r.doc_id for r in contamination.decontaminate(docs, bench).collect()] == [6]


def test_mixed_dump_folder(spark, tmp_path):
    import json

    from assayer.sources import tables
    (tmp_path / "a.json").write_text(json.dumps({"meta": {"seed": 1}, "rows": [{"type": "unit", "expected": "1"}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"type": "roman", "expected": "X"}, {"type": "roman", "expected": "V"}]))
    assert sorted((r.type, r.expected) for r in tables.read_dump(spark, str(tmp_path)).collect()) == [("roman", "V"), ("roman", "X"), ("unit", "1")]


def test_scratch_needs_a_shared_folder_on_clusters():
    from types import SimpleNamespace

    from assayer.session import shared_folder
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        shared_folder(cluster)


def test_fuzzy_dedup_is_idempotent(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    rows = [(1, base), (2, base), (3, base + " phi"), (4, "something else entirely with other words in it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clusters = {r.doc_id: r.cluster for r in dedup.fuzzy_dedup(docs).collect()}
    assert clusters == {1: 1, 2: 1, 3: 1, 4: 4}
    kept = docs.where(F.col("doc_id").isin(*set(clusters.values())))
    assert {r.doc_id: r.cluster for r in dedup.fuzzy_dedup(kept).collect()} == {1: 1, 4: 4}


def test_semantic_dedup_against_all_pairs(spark):
    import numpy as np
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding")
    rows = sorted((r.vec_id, np.array(r.embedding, dtype=float)) for r in vectors.collect())
    parent = {k: k for k, _ in rows}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, (a, u) in enumerate(rows):
        for b, v in rows[i + 1:]:
            if u @ v / math.sqrt((u @ u) * (v @ v)) >= 0.85:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r.vec_id: r.cluster for r in dedup.semantic_dedup(vectors).collect()}
    assert got == {k: root(k) for k, _ in rows}


def test_redaction(spark):
    rows = spark.createDataFrame([("é a.b@c.org and +1 555-123-4567, x@y.de", ), ("none",)], "text string")
    got = [(r.text, r.email_address, r.phone_number) for r in redaction.pii_redact(rows).collect()]
    assert got == [("é <EMAIL_ADDRESS> and <PHONE_NUMBER>, <EMAIL_ADDRESS>", 2, 1), ("none", 0, 0)]


def test_buckets_and_empty_calibration(spark):
    flags = [(0, "x", True, True), (1, "x", True, False), (2, "x", False, True), (3, "x", False, False), (4, "x", False, True)]
    out = {r.type: r for r in evaluation.outcome_buckets(spark.createDataFrame(flags, "row_id int, type string, a_ok boolean, b_ok boolean")).collect()}
    assert (out["ALL"].both_right, out["ALL"].both_wrong, out["ALL"].regression, out["ALL"].improvement) == (1, 1, 1, 2)
    assert round(out["ALL"].delta, 9) == 0.2
    empty = evaluation.calibration(spark.createDataFrame([], "ok boolean, confidence double")).collect()[0]
    assert set(empty) == {0}
    edges = spark.createDataFrame([(True, 1.0), (True, 0.9), (False, 0.0)], "ok boolean, confidence double")
    assert round(evaluation.ece(edges).collect()[0].ece, 9) == round((0.1 / 2) * 2 / 3, 9)


def test_selection_edges(spark):
    prompts = spark.createDataFrame([(1, "f1"), (2, "f2"), (3, "f3")], "prompt_id int, fallback string")
    rows = spark.createDataFrame([(1, 0, "aa", True), (1, 1, "bb", True), (1, 2, "cccc", False), (2, 0, "z", False)], "prompt_id int, k int, text string, ok boolean")
    got = {r.prompt_id: (r.text, r.num_correct, r.num_candidates, r.is_fallback) for r in selection.best_candidate(prompts, rows).collect()}
    assert got == {1: ("aa", 2, 3, False), 2: ("f2", 0, 1, True), 3: ("f3", 0, 0, True)}


def test_const_hold_across_slices(spark):
    rows = [(1, p, float(p) if p in (0, 7) else None) for p in range(30)] + [(2, 3, None)]
    points = spark.createDataFrame(rows, "series int, pos int, known double")
    got = {(r.series, r.pos): r.held for r in series.const_hold(points, slice_of=4).collect()}
    assert got == {**{(1, p): 0.0 if p < 7 else 7.0 for p in range(30)}, (2, 3): None}


def test_null_texts_stay_in_both_dedups(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, None), (3, "one two three four"), (4, None), (5, "other")], "doc_id long, text string")
    assert sorted(map(tuple, dedup.exact_dedup(docs).collect())) == [(1, 1, 2), (2, 2, 2), (3, 1, 2), (4, 2, 2), (5, 5, 1)]
    assert sorted(map(tuple, dedup.fuzzy_dedup(docs).collect())) == [(1, 1), (2, 2), (3, 1), (4, 4), (5, 5)]


def shuffled_bytes(spark):
    """Bytes written to shuffles by all stages so far."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_fuzzy_dedup_moves_no_sets_of_unlike_texts(spark):
    """400 texts with a quarter of their words in common share rare shingles pair by pair; none of the pairs moves a set of shingles."""
    rng = random.Random(8)
    word = lambda: "w" + str(rng.randint(0, 10**9))
    shared = [word() for _ in range(100)]
    rows = [(k, " ".join(shared + [word() for _ in range(300)])) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").localCheckpoint()
    before, joins = shuffled_bytes(spark), "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(joins, "-1")
    try:
        got = {r.doc_id: r.cluster for r in dedup.fuzzy_dedup(docs, common=10).collect()}
    finally:
        spark.conf.unset(joins)
    assert got == {k: k for k in range(400)}
    assert shuffled_bytes(spark) - before < 20_000_000


@pytest.mark.parametrize("whole", [False, True])
def test_curation_moves_few_bytes(spark, whole, tmp_path):
    """Rules, near copies and redaction over the given texts shuffle less than a few times their bytes, also where nothing is broadcast."""
    docs, labels = (spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/{name}.parquet") for name in ("documents", "labels"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    before, joins = shuffled_bytes(spark), "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(joins, "-1")
    try:
        if whole:
            curation.curate(docs, labels, ["en", "de", "fr", "es"], str(tmp_path / "out")).collect()
        else:
            curation.curated(docs, ["en", "de", "fr", "es"]).write.parquet(str(tmp_path / "out"))
    finally:
        spark.conf.unset(joins)
    assert shuffled_bytes(spark) - before < (10 if whole else 7) * size


def test_substitution_moves_no_words(spark):
    """Long texts of ever new words shuffle a few lines per letter; the first place wins a tie, in texts and in lines."""
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(3000)) for _ in range(24)]
    rows = [(k, 0, t, t) for k, t in enumerate(texts)] + [(100, 0, "ab xy", "cd xz"), (100, 1, "ba yx", "ec yx")]
    pairs = spark.createDataFrame(rows, "row_id long, pos int, lhs string, rhs string").repartition(4).localCheckpoint()
    before = shuffled_bytes(spark)
    got = {(r.row_id, r.src): (r.dst, r.votes) for r in substitution.learn_substitution(pairs).collect()}
    assert {k: v for k, v in got.items() if k[0] < 100} == {(k, c): (c, t.count(c)) for k, t in enumerate(texts) for c in "abcdefgh"}
    assert {k[1]: v for k, v in got.items() if k[0] == 100} == {"a": ("c", 2), "b": ("d", 1), "x": ("x", 2), "y": ("z", 1)}
    assert shuffled_bytes(spark) - before < 100_000
