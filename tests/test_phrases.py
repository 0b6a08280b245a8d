"""Shared phrases against all n-grams of all lengths, and the sketch against exact counts."""

import random
import re

import numpy as np
import pyarrow as pa

from assayer.operators import phrases


def brute(texts, share, fewest):
    listed = [re.findall(r"[^ \t\n\x0b\f\r]+", t or "") for t in texts]
    least = max(2, int(np.ceil(share * len(texts) - 1e-9)))
    documents = {}
    for i, words in enumerate(listed):
        for size in range(fewest, len(words) + 1):
            for at in range(len(words) - size + 1):
                documents.setdefault(tuple(words[at:at + size]), set()).add(i)
    frequent = {p: len(d) for p, d in documents.items() if len(d) >= least}
    inner = {part for p in frequent for part in (p[1:], p[:-1])}
    return {" ".join(p): n for p, n in frequent.items() if p not in inner}


def found(spark, texts, share=0.1, fewest=3):
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, phrase string, documents int").repartition(3)
    rows = phrases.phrase_leakage(frame, share, fewest).collect()
    assert all(r.words == len(r.phrase.split(" ")) for r in rows) and len({r.phrase for r in rows}) == len(rows)
    return {r.phrase: r.documents for r in rows}


def made(rng, n):
    """Texts of few words with planted templates of 3 to 70 words, some cut short, some nested in others."""
    long = [f"t{i}" for i in range(70)]
    planted = [long, long[5:40], ["Let", "me", "verify:"], ["é", "à", "ü", "日本"], ["a", "a", "a", "a", "a"]]
    out = []
    for _ in range(n):
        words = [rng.choice("abcdefg") for _ in range(rng.randint(0, 25))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(planted)
            p = p[:rng.randint(3, len(p))] if rng.random() < 0.3 else p
            at = rng.randint(0, len(words))
            words[at:at] = p
        out.append("".join(w + rng.choice([" ", " ", "\n", "\t ", " \r\n"]) for w in words))
    return out + [None, "", " \n", out[0], out[0]]


def test_against_all_lengths(spark):
    for seed, share in ((1, 0.05), (2, 0.2)):
        texts = made(random.Random(seed), 60)
        want = brute(texts, share, 3)
        assert max(len(p.split()) for p in want) > 20 and found(spark, texts, share) == want


def test_other_lengths_and_no_result(spark):
    texts = ["one two three four"] * 2 + ["four five six", "x"]
    assert found(spark, texts, 0.5, 1) == brute(texts, 0.5, 1) == {"one two three four": 2}
    assert found(spark, ["a b c d", "e f g h"]) == {} and found(spark, []) == {} and found(spark, [None]) == {}


def test_slices_do_not_change_the_result(spark, monkeypatch):
    texts = made(random.Random(9), 40)
    monkeypatch.setattr(phrases, "SLICE", 50)
    batches = lambda: iter([pa.RecordBatch.from_pydict({"text": texts})])
    rows = [r for out in phrases._sketch(3, 10**6)(batches()) for r in zip(*(c.to_pylist() for c in out.columns))]
    words = phrases.Words(pa.array(texts))
    at = np.flatnonzero(words.left >= 3)
    keys, counts = phrases._once(words.rows[at], words.spans(at, 3))
    assert dict(rows) == {**dict(zip(keys.tolist(), counts.tolist())), None: 0}


def test_sketches_miss_nothing_frequent():
    """Merged sketches of a few counters: every true count lies between the merged one and the merged one plus all losses."""
    rng = np.random.default_rng(3)
    merged, lost, truth = {}, 0, {}
    for _ in range(20):
        keys, counts = np.unique(rng.zipf(1.3, 3000) % 5000, return_counts=True)
        for k, n in zip(keys.tolist(), counts.tolist()):
            truth[k] = truth.get(k, 0) + n
        kept, left, loss = phrases.shortened(keys, counts, 50)
        assert len(kept) <= 50
        lost += loss
        for k, n in zip(kept.tolist(), left.tolist()):
            merged[k] = merged.get(k, 0) + n
    assert all(merged.get(k, 0) <= n <= merged.get(k, 0) + lost for k, n in truth.items())
    assert lost * 50 <= sum(truth.values())
