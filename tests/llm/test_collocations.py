"""Phrase mining against plain counting."""

import random
import re
from collections import Counter

import pytest

from assayer.llm import collocations
from registry.text import long_eval
from tests.conftest import SMALL


def brute(rows, least, keep):
    counts, totals = Counter(), Counter()
    for run, text in rows:
        run = run or "und"
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^ \t]+", piece)
            totals[run] += len(words)
            counts.update((run, *words[i:i + size]) for size in (1, 2, 3) for i in range(len(words) - size + 1))
    candidates = {g: n for g, n in counts.items() if len(g) > 2 and n >= least}
    dropped = {part for g, n in candidates.items() if len(g) == 4 for part in (g[:3], (g[0], *g[2:])) if 2 * n >= candidates[part]}
    listed = []
    for g, a in candidates.items():
        if g not in dropped:
            cuts = [(10**6 * a * a // (counts[g[:k + 1]] * counts[(g[0], *g[k + 1:])]), k) for k in range(1, len(g) - 1)]
            score, k = min(cuts)
            listed.append((g[0], -score, -a, " ".join(g[1:]).encode(), counts[g[:k + 1]], counts[(g[0], *g[k + 1:])]))
    out, rank = [], Counter()
    for run, score, a, phrase, left, right in sorted(listed):
        rank[run] += 1
        if rank[run] <= keep:
            out.append((run, rank[run], phrase.decode(), -a, left, right, totals[run], -score))
    return sorted(out)


def found(spark, rows, least=3, keep=2000):
    frame = spark.createDataFrame([(r, t, 1, "p", "x", 2) for r, t in rows], "run string, text string, n int, phrase string, w1 string, part int")
    return sorted(tuple(r) for r in collocations.mine_phrases(frame, least=least, keep=keep).collect())


def random_rows(rng, n, words=12):
    vocabulary = ["the", "rule", "Gravity", "bit", "é", "ÉA", "a\x01b", "x_y", "日本", "o'k", "and", "word"] + [f"w{i}" for i in range(words)]
    glue = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "?!", "\r\n", ":"]
    return [(rng.choice(["a", "b", None, "und"]), "".join(rng.choice(vocabulary) + rng.choice(glue) for _ in range(rng.randint(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [64, 1 << 22])
def test_against_counting(spark, chunk, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    rows = random_rows(random.Random(chunk), 150) + [("a", None), ("a", ""), (None, None), ("b", "the rule the rule the rule"), ("b", "the rule the rule the rule")]
    want = brute(rows, 3, 2000)
    assert len(want) > 100 and found(spark, rows) == want


def test_a_hot_word_over_many_ranges(spark):
    """One word begins and ends most phrases, so its header stands ranges before its extensions."""
    rng = random.Random(3)
    rows = [("hot", " ".join(w for i in range(400) for w in ("zz", rng.choice(["zz", f"v{rng.randint(0, 150)}"])))) for _ in range(30)]
    assert found(spark, rows) == brute(rows, 3, 2000)


def test_keep_and_ties(spark):
    rows = [("r", ". ".join(f"{x}1 {x}2" for x in "hgfedcba"))] * 4
    got = found(spark, rows, keep=3)
    assert [r[2] for r in got] == ["a1 a2", "b1 b2", "c1 c2"] and got == brute(rows, 3, 3) and got[0][7] == 10**6


def test_no_rows(spark):
    assert found(spark, []) == [] and found(spark, [("a", None), (None, " .\n"), ("a", "one two three")]) == []


def test_exact_above_64_bits(spark):
    a, left, right = 3 * 10**12, 4 * 10**12, 10**13
    row = spark.range(1).selectExpr(f"bigint({a}) as n", f"bigint({left}) as l", f"bigint({right}) as r").select(collocations._score("n", "l", "r")).first()
    assert row[0] == 10**6 * a * a // (left * right)


def test_long_text_without_piece_ends(spark, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 100)
    rows = [("a", "one two three four " * 20_000), ("b", "x. " * 50_000)]
    assert found(spark, rows) == brute(rows, 3, 2000)


def test_traces_of_runs(spark):
    rows = long_eval(spark, SMALL).select("run", "text")
    got = sorted(tuple(r) for r in collocations.mine_phrases(long_eval(spark, SMALL), least=10, keep=50).collect())
    assert got and got == brute([tuple(r) for r in rows.collect()], 10, 50)
