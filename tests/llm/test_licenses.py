"""License scan against a word-by-word matcher."""

import itertools
import random
import re

import pytest

from assayer.llm import licenses
from registry.text import long_eval
from tests.conftest import SMALL


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def match(tokens, words, at):
    """End of the first way, long ones first, in which the tokens stand at a place."""
    if not tokens:
        return at
    token = tokens[0]
    if at < len(words) and words[at] in token.rstrip("?").split("|"):
        end = match(tokens[1:], words, at + 1)
        if end is not None:
            return end
    return match(tokens[1:], words, at) if token.endswith("?") else None


def places(signature, words):
    at, out = 0, []
    while at < len(words):
        end = match(signature.split(), words, at)
        if end:
            out.append((at, end))
        at = end or at + 1
    return out


def brute(text):
    words = words_of(text)
    spans = [(s, e, rank, label, weight) for rank, (label, signature, weight) in enumerate(licenses.signatures()) for s, e in places(signature, words)]
    nested = lambda x, y: (y[0] <= x[0] and x[1] <= y[1]) or (x[0] <= y[0] and y[1] <= x[1])
    kept = [x for x in spans if not any(y[2] < x[2] and nested(x, y) for y in spans)]
    base = sorted((s, e, label) for phrase, label in licenses.BASE.items() for s, e in places(phrase, words))
    score = max([x[4] for x in kept] + [0.8 if base else 0.0])
    return len(words), base, sorted((x[0], x[1], x[3], x[4]) for x in kept), sorted({x[3] for x in kept} | {b[2] for b in base}), sorted({b[2] for b in base}), score


def found(spark, texts):
    frame = spark.createDataFrame([(f"r{i}", "a", t, 7, "x", 1.0) for i, t in enumerate(texts)], "row_id string, run string, text string, n_words int, labels string, score double")
    rows = {r.row_id: r for r in licenses.license_scan(frame).collect()}
    return [(r.n_words, [tuple(p) for p in r.base_places], sorted(tuple(p) for p in r.found), r.labels, r.base_labels, r.score) for r in (rows[f"r{i}"] for i in range(len(texts)))]


TEXTS = [None, "", "  \n", "no words about it", "All rights reserved.", "all rights, reserved! ALL RIGHTS RESERVED", "CC BY", "cc by cc by cc-by", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.",
         "This work is licensed under the GNU General Public License, version 3.", "GPL-3.0-or-later or MIT License", "Released under the MIT License.", "gplv2", "Éall rights reserved", "xcc by", "_cc by", "a GNU Lesser General Public License v2.1 text",
         "GNU general public license version 2 or any later version", "creative commons attribution share alike 4 0", "creative commons attribution 4.0", "Redistribution and use in source and binary forms, with or without modification, are permitted",
         "mozilla public license version 2.0 and eclipse public license 1.0", "cc", "license", "general public license general public license"]


def test_cases(spark):
    assert found(spark, TEXTS) == [brute(t) for t in TEXTS]


def test_random_mixtures(spark):
    rng = random.Random(4)
    vocabulary = sorted({w for _, s, _ in licenses.signatures() for t in s.split() for w in t.rstrip("?").split("|")})
    pieces = [" ".join(rng.choice(t.rstrip("?").split("|")) for t in s.split() if not t.endswith("?") or rng.random() < 0.5) for _, s, _ in licenses.signatures()]
    texts = [" ".join(rng.choice([rng.choice(pieces), rng.choice(vocabulary), "plain"]) + rng.choice(["", ".", "-"]) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    assert found(spark, texts) == [brute(t) for t in texts]


@pytest.mark.parametrize("label,signature,_", licenses.signatures(), ids=lambda v: str(v)[:30])
def test_every_signature_passes_the_gate(label, signature, _):
    """Each way to write a signature passes the gate and holds its keyword."""
    options = [[w for w in t.rstrip("?").split("|")] + ([""] if t.endswith("?") else []) for t in signature.split()]
    for way in itertools.islice(itertools.product(*options), 2000):
        text = " ".join(w for w in way if w)
        assert re.search(licenses.GATE, text) and licenses.keyword(signature) in text.split(), text


def test_hundreds_of_rules_and_base_phrases():
    assert len(licenses.signatures()) > 200
    keys = {licenses.keyword(s) for _, s, _ in licenses.signatures()}
    assert all(re.search(licenses.GATE, p) and keys & set(p.split()) for p in licenses.BASE)


def test_long_text(spark):
    text = "word " * 200_000 + "all rights reserved " + "licensed under the MIT License. " * 3000
    assert found(spark, [text])[0][:2] == (200_003 + 5 * 3000, [(200_000, 200_003, "reserved")])
    assert found(spark, [text])[0][3] == ["licensed", "mit", "reserved"]


def test_repeated_rows_null_keys_and_no_rows(spark):
    frame = spark.createDataFrame([(None, None, "MIT License"), (None, None, "MIT License"), ("a", "b", None)], "row_id string, run string, text string")
    assert sorted((str(r.row_id), r.labels, r.score) for r in licenses.license_scan(frame).collect()) == [("None", ["mit"], 0.8)] * 2 + [("a", [], 0.0)]
    assert licenses.license_scan(frame.where("false")).collect() == []


def test_traces_of_runs(spark):
    rows = long_eval(spark, SMALL)
    texts = {(r.row_id, r.run): r.text for r in rows.collect()}
    got = licenses.license_scan(rows).collect()
    assert len(got) == len(texts) and any(r.labels for r in got)
    sample = sorted(got, key=lambda r: (-len(r.labels), r.row_id, r.run))[:12]
    assert [(r.labels, r.n_words) for r in sample] == [(brute(texts[r.row_id, r.run])[3], len(words_of(texts[r.row_id, r.run]))) for r in sample]


def test_plan_is_native(spark):
    plan = licenses.license_scan(spark.createDataFrame([("a", "b", "c")], "row_id string, run string, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan and "Exchange" not in plan
