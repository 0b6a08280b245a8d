"""Quality by lines and toxicity by sentences: exact inference on small chains, held-out accuracy, odd rows."""

import itertools
import math
import random

import numpy as np

from assayer.llm import linefield, noisyor, queries
from tests.llm.common import frame, sentence

TABLES = "/root/testdata/sf0.01"
BAD = ["idiot", "moron", "pathetic"]


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(12)
    sizes = [1, 4, 0, 3, 6]
    row = np.repeat(np.arange(5), sizes)
    score, stay = rng.normal(size=len(row)) * 3, rng.normal(size=(2, 2))
    good, pairs, total = linefield.marginals(score, row, 5, stay)
    at = 0
    for k, n in enumerate(sizes):
        own, weights = score[at:at + n], {}
        for labels in itertools.product((0, 1), repeat=n):
            weights[labels] = math.exp(sum(s for s, y in zip(own, labels) if y) + sum(stay[a, b] for a, b in zip(labels, labels[1:])))
        z = sum(weights.values())
        assert abs(total[k] - (math.log(z) if n else 0)) < 1e-9
        for t in range(n):
            assert abs(good[at + t] - sum(w for y, w in weights.items() if y[t]) / z) < 1e-9
        at += n
    assert np.allclose(pairs.sum(axis=(1, 2)), 1)


def test_quality_odd_rows(spark):
    rng = random.Random(13)
    graded = [(f"g{i}", "\n".join(sentence(rng, 12).capitalize() + "." for _ in range(4)), 1) for i in range(30)]
    graded += [(f"b{i}", "\n".join("$$ ".join(sentence(rng, 12).upper().split()) for _ in range(4)), 0) for i in range(30)] + [("n", None, 1), ("u", "x", None)]
    graded = spark.createDataFrame(graded, "id string, text string, label int")
    first, broken = graded.where("id = 'g0'").first().text, graded.where("id = 'b0'").first().text
    model = linefield.fit_quality(graded.select("id", "text"), graded.select("id", "label"), steps=80)
    rows = [("good", first), ("bad", broken), ("null", None), ("empty", ""), ("blank", " \n\n "), ("long", "\n".join([first] * 3000)), ("mixed", first + "\n" + broken), ("good", first)]
    got = [(r.id, r.score, r.n_lines, r.bad_lines) for r in linefield.score_quality(frame(spark, rows), model).collect()]
    by = {k: (s, n, b) for k, s, n, b in got}
    assert len(got) == len(rows) and by["good"][0] > 0.8 and by["bad"][0] < 0.2 and by["mixed"][1] == 8
    assert by["null"] == by["empty"] == by["blank"] == (model["prior"], 0, 0) and by["long"][1] == 12000
    assert [r.score for r in linefield.score_quality(frame(spark, rows[:1]), None).collect()] == [0.5]
    assert linefield.score_quality(frame(spark, []), model).collect() == []
    assert linefield.fit_quality(graded.limit(0), graded.limit(0)) is None


def measures(found):
    right = {(y, p): sum(r.label == y and r.predicted == p for r in found) for y in (0, 1) for p in (0, 1)}
    return right[1, 1] / (right[1, 1] + right[1, 0]), right[0, 0] / (right[0, 0] + right[0, 1])


def test_held_out_quality(spark):
    labels = spark.read.parquet(f"{TABLES}/labels.parquet").selectExpr("doc_id", "quality as label")
    good, bad = measures(queries.op8(spark, TABLES).join(labels, "doc_id").where("held_out").collect())
    assert good > 0.95 and bad > 0.8


def test_toxicity_odd_rows_and_spans(spark):
    rng = random.Random(14)
    clean = lambda: ". ".join(sentence(rng, 8) for _ in range(4)) + "."
    flagged = [(f"c{i}", clean(), 0) for i in range(60)] + [(f"t{i}", f"{clean()} {sentence(rng, 2)} {rng.choice(BAD)} {sentence(rng, 3)}! {clean()}", 1) for i in range(40)] + [("n", None, 1), ("u", "moron", None)]
    flagged = spark.createDataFrame(flagged, "id string, text string, label int")
    model = noisyor.fit_toxicity(flagged.select("id", "text"), flagged.select("id", "label"))
    text = f"Été fine. {clean()} Such a MORON here? {clean()}"
    rows = [("bad", text), ("good", clean()), ("null", None), ("empty", ""), ("marks", "!!! ..."), ("long", clean() * 2000), ("bad", text)]
    got = {r.id: r for r in noisyor.score_toxicity(frame(spark, rows), model).collect()}
    assert got["bad"].score > 0.5 and got["good"].score < 0.3 and got["long"].score < 0.3
    assert [text.encode()[s.start:s.end].decode() for s in got["bad"].sentences] == ["Such a MORON here"]
    assert all(got[k].score == 0 and got[k].sentences == [] for k in ("null", "empty", "marks"))
    assert noisyor.score_toxicity(frame(spark, []), model).collect() == []
    nothing = noisyor.fit_toxicity(flagged.limit(0), flagged.limit(0))
    assert noisyor.score_toxicity(frame(spark, rows[:1]), nothing).first().score < 1e-6


def test_held_out_toxicity(spark):
    large = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{large}/labels.parquet").selectExpr("doc_id", "toxic as label")
    toxic, clean = measures(queries.op9(spark, large).join(labels, "doc_id").where("held_out").collect())
    assert toxic > 0.85 and clean > 0.95
