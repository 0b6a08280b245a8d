"""The trained operators against plain loops: noisy-or scores and their minimum, line fields and their minimum, the sample."""

import re

import numpy as np

from assayer.llm import linefield, noisyor, sampling
from assayer.llm.arrays import flat
import pyarrow as pa


def noisy_loss(words, sentence, text_of, labels, weights, w, bias):
    """Weighted loss of texts whose sentences are toxic independently; sentences without a word are clean."""
    total = 0.0
    for t, y in enumerate(labels):
        clean = 1.0
        for s in np.flatnonzero(text_of == t):
            mine = words[sentence == s]
            if len(mine):
                clean *= 1 - 1 / (1 + np.exp(-(bias + w[mine].sum())))
        p = 1 - clean
        total -= weights[t] / weights.sum() * (np.log(max(p, 1e-12)) if y else np.log(max(clean, 1e-12)))
    return total


def test_noisy_or_fit_ends_in_a_minimum():
    rng = np.random.default_rng(4)
    n_texts, n_words = 40, 5
    text_of = np.repeat(np.arange(n_texts), 3)
    pairs = np.unique(np.stack([rng.integers(0, len(text_of), 150), rng.integers(0, n_words, 150)]), axis=1)
    sentence, words = pairs
    labels = rng.integers(0, 2, n_texts)
    weights = rng.uniform(0.5, 2, n_texts)
    w, bias = noisyor.noisy_or_fit(words, sentence, text_of, labels, weights, n_words, 3000, 0.0)
    best = noisy_loss(words, sentence, text_of, labels, weights, w, bias)
    for i in range(n_words + 1):
        for step in (0.05, -0.05):
            moved, other = w.copy(), bias
            if i < n_words:
                moved[i] += step
            else:
                other += step
            assert noisy_loss(words, sentence, text_of, labels, weights, moved, other) >= best - 1e-4


def word_hashes(word):
    """Hashes of a word and its longer beginnings, as the operator numbers them."""
    return [int(h) for h in noisyor.sentence_words(*flat(pa.array([word])))[2][0] if h]


def test_noisy_or_score_equals_a_loop(spark):
    model = {0: -2.0}
    for word, weight in (("bad", 3.0), ("awful", 2.5), ("fine", -1.0), ("horribleness", 4.0)):
        model[word_hashes(word)[0] - (1 << 64) if word_hashes(word)[0] >= 1 << 63 else word_hashes(word)[0]] = weight
    known = {h % (1 << 64): weight for h, weight in model.items() if h}
    texts = ["This is bad. That is fine! BAD bad awful?", "fine fine\nfine", "horribleness", "horrible", "", None, "... !!", "bad" * 3, "x bad\ny awful fine. z", "awful " * 3000]

    def loop(text):
        clean = 1.0
        for part in re.split(r"[.!?\n]", text or ""):
            lowered = "".join(c.lower() if c.isascii() else c for c in part)
            met = {h for word in re.findall(r"[a-z0-9\x80-\U0010ffff]+", lowered) for h in word_hashes(word)} & set(known)
            if any(known[h] > 0 for h in met):
                clean *= 1 - 1 / (1 + np.exp(-(model[0] + sum(known[h] for h in met))))
        return 1 - clean

    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")
    got = {int(r.id): r.score for r in noisyor.score_toxicity(rows, model).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], [loop(t) for t in texts])


def field_loss(codes, row, labels, weights, theta, stay, width):
    """Weighted conditional loss per line by summing over all labellings of a text."""
    total = 0.0
    score = linefield._unary(codes, row, theta)
    for t, y in enumerate(labels):
        mine = score[row == t]
        if not len(mine):
            continue
        ways = {}
        for way in np.ndindex(*[2] * len(mine)):
            ways[way] = sum(s for s, k in zip(mine, way) if k) + sum(stay[a, b] for a, b in zip(way, way[1:]))
        truth = ways[(int(y),) * len(mine)]
        total -= weights[t] / weights.sum() / len(mine) * (truth - np.logaddexp.reduce(list(ways.values())))
    return total


def test_field_fit_ends_in_a_minimum():
    rng = np.random.default_rng(5)
    n_texts, width = 25, 4
    counts = rng.integers(1, 4, n_texts)
    row = np.repeat(np.arange(n_texts), counts)
    codes = rng.integers(0, width, (len(row), 1))
    labels, weights = rng.integers(0, 2, n_texts), rng.uniform(0.5, 2, n_texts)
    theta, stay = linefield.field_fit(codes, row, labels, weights, width, 4000, 0.02)
    ridge = lambda th, st: 0.02 / 2 * ((th**2).sum() / width + (st**2).sum())
    best = field_loss(codes, row, labels, weights, theta, stay, width) + ridge(theta, stay)
    for i in range(len(theta) + 4):
        for step in (0.1, -0.1):
            th, st = theta.copy(), stay.copy()
            if i < len(theta):
                th[i] += step
            else:
                st.reshape(-1)[i - len(theta)] += step
            assert field_loss(codes, row, labels, weights, th, st, width) + ridge(th, st) >= best - 1e-4


def test_the_sample_is_the_first_of_each_label(spark):
    """Salted ranking picks the same rows as one ranking of a whole label."""
    rows = [(f"p{i}", "word " * (1 + i % 9)) for i in range(900)] + [("n", None), (None, "text")]
    texts = spark.createDataFrame(rows, "id string, text string")
    labels = spark.createDataFrame([(f"p{i}", i % 2 if i % 5 else None) for i in range(900)] + [("n", 1), (None, 1), ("other", 0)], "id string, label int")
    found, totals = sampling.bounded_sample(texts, labels, 60, 40)
    from pyspark.sql import Window, functions as F
    known = texts.join(labels.where("label is not null"), "id").where("text is not null").withColumn("long", F.length("text") > 40)
    order = Window.partitionBy("label").orderBy("long", F.xxhash64("id"), "id")
    want = {r.id for r in known.withColumn("r", F.row_number().over(order)).where("r <= 60").collect()}
    assert {r.id for r in found.collect()} == want and len(want) == 120 and totals == {0: 360, 1: 360}
    assert found.rdd.getNumPartitions() > 0 and "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
