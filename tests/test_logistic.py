"""The fitted text model: gradients against differences, the minimum against a plain descent, held-out texts."""

import numpy as np
import pyarrow as pa
import pytest

from assayer.operators import logistic
from assayer.plans import derive
from tests.conftest import SMALL


def batch(rng, n, width):
    slots = [sorted(set(rng.integers(0, width, rng.integers(0, 9)).tolist())) for _ in range(n)]
    return pa.array(slots, pa.list_(pa.int32())), rng.integers(0, 2, n).astype(float)


def plain_loss(slots, labels, w):
    total = 0.0
    for s, y in zip(slots.to_pylist(), labels):
        z = sum(w[i] for i in s) / max(len(s), 1) ** 0.5 + w[-1]
        total += np.log1p(np.exp(-z if y else z))
    return total


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    slots, labels = batch(rng, 60, 12)
    w = rng.normal(size=13)
    loss, gradient = logistic.loss_and_gradient(slots, labels, w)
    assert loss == pytest.approx(plain_loss(slots, labels, w))
    for i in range(13):
        step = np.eye(13)[i] * 1e-6
        assert gradient[i] == pytest.approx((plain_loss(slots, labels, w + step) - plain_loss(slots, labels, w - step)) / 2e-6, abs=1e-4)


def test_sums_over_partitions(spark):
    rng = np.random.default_rng(1)
    slots, labels = batch(rng, 500, 20)
    frame = spark.createDataFrame([(int(y), s) for y, s in zip(labels, slots.to_pylist())], "label int, slots array<int>").repartition(5)
    w = rng.normal(size=21)
    loss, gradient = logistic._total(frame, w)
    want = logistic.loss_and_gradient(slots, labels, w)
    assert loss == pytest.approx(want[0]) and np.allclose(gradient, want[1])


def test_minimum():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(30, 8))
    target = rng.normal(size=8)
    function = lambda x: (0.5 * float(((a @ (x - target)) ** 2).sum()), a.T @ (a @ (x - target)))
    assert np.allclose(logistic.minimise(function, np.zeros(8), rounds=60), target, atol=1e-2)


def auc(rows):
    ranked = sorted(rows)
    ones = [i for i, (_, y) in enumerate(ranked, 1) if y]
    n1, n0 = len(ones), len(ranked) - len(ones)
    return (sum(ones) - n1 * (n1 + 1) / 2) / (n1 * n0)


@pytest.mark.parametrize("label,least", [("quality", 0.9), ("toxic", 0.75)])
def test_held_out_texts(spark, label, least):
    from registry.curation import QUERIES

    folder = SMALL.replace("0.001", "0.01")
    rows = QUERIES["quality_model" if label == "quality" else "toxicity_model"][0](spark, folder)
    known = derive.read(spark, folder, "labels").where(f"{label} is not null")
    held = [(r.score, r[label]) for r in rows.join(known, "doc_id").where("held_out").collect()]
    assert len(held) > 60 and auc(held) > least


def test_model_files_and_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, "good text here"), (2, "bad bad"), (3, None), (4, ""), (None, "good"), (1, "good text here")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (4, 0), (9, 1)], "doc_id bigint, quality int")
    model = logistic.fit_text_model(docs, labels, "quality", width=64)
    logistic.save_model(spark, model, f"{tmp_path}/v1")
    assert np.array_equal(logistic.load_model(spark, f"{tmp_path}/v1").weights, model.weights)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        logistic.save_model(spark, model, f"{tmp_path}/v1")
    got = [(r.doc_id, r.score) for r in logistic.score_text(docs, model).collect()]
    assert len(got) == 6 and dict(got)[1] > dict(got)[2] and dict(got)[3] == dict(got)[4] and dict(got)[None] > 0.5
    empty = logistic.fit_text_model(docs, labels.where("false"), "quality", width=64)
    assert {r.score for r in logistic.score_text(docs, empty).collect()} == {0.5}
