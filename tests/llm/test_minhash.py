import random
from collections import Counter

import numpy as np

from assayer.llm import minhash
from tests.llm.common import frame, sentence
from tests.llm.test_winnowing import words


def similarity(a, b):
    keys = set(a) | set(b)
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in keys) for i in a if i in b)


def shingles(text, size=5):
    w = words(text)
    return Counter(tuple(w[i:i + size]) for i in range(max(len(w) - size + 1, 1))) if w else None


def brute(rows, threshold=0.8):
    parent = {k: k for k, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(rows):
        for b, t in rows[:i]:
            x, y = shingles(s), shingles(t)
            alike = s is not None and t is not None and (s == t or (x and y and similarity(x, y) >= threshold))
            if alike and top(a) != top(b):
                low, high = sorted((top(a), top(b)))
                parent[high] = low
    return {k: top(k) for k in parent}


def test_against_all_pairs(spark):
    rng = random.Random(5)
    rows = []
    for i in range(10):
        base = sentence(rng, rng.randint(8, 120)).split()
        rows.append((f"b{i}", " ".join(base)))
        for j in range(4):
            changed = list(base)
            for _ in range(rng.randint(0, 4)):
                changed[rng.randrange(len(changed))] = "changed" + str(rng.randint(0, 9))
            rows.append((f"b{i}v{j}", " ".join(changed)))
    rows += [("x1", "same text"), ("x2", "Same TEXT!"), ("x3", "same"), ("m1", "!!!"), ("m2", "!!!"), ("m3", "??? ---"), ("n1", None), ("n2", None), ("e1", ""), ("e2", ""), ("r1", "alpha beta gamma delta eta " * 30), ("r2", "alpha beta gamma delta eta " * 33)]
    got = {r.id: r.keeper for r in minhash.near_classes(frame(spark, rows)).collect()}
    assert got == brute(rows)
    assert got["n1"] == "n1" and got["n2"] == "n2" and got["m3"] == "m3" and got["m2"] == "m1"


def test_chain_and_hot_group_join_across_leaders(spark):
    """Copies of one original that are too far from each other, a chain, and unlike texts with one common passage."""
    rng = random.Random(6)
    base = sentence(rng, 150).split()
    rows = [("a", " ".join(base))]
    for i in range(60):
        changed = list(base)
        for p in rng.sample(range(150), 3):
            changed[p] = f"w{i}x{p}"
        rows.append((f"c{i:02}", " ".join(changed)))
    for step in range(4):
        base = base[:step * 5] + [f"s{step}y{k}" for k in range(5)] + base[step * 5 + 5:]
        rows.append((f"d{step}", " ".join(base)))
    passage = sentence(rng, 60)
    rows += [(f"u{i:02}", f"{passage} {sentence(rng, 60)}") for i in range(30)]
    for rounds, block in ((1, 512), (0, 7), (3, 16)):
        got = {r.id: r.keeper for r in minhash.near_classes(frame(spark, rows), rounds=rounds, block=block).collect()}
        assert got == brute(rows)


def test_estimate_and_exact_similarity():
    rng = np.random.default_rng(7)
    for _ in range(5):
        a, b = ({int(k): int(rng.integers(1, 6)) for k in rng.choice(50, 35, replace=False)} for _ in range(2))
        (p, x), (q, y) = ((minhash.mix(np.array(sorted(d), dtype=np.uint64) + np.uint64(9)), np.array([d[k] for k in sorted(d)], dtype=float)) for d in (a, b))
        exact = similarity(a, b)
        order_p, order_q = np.argsort(p), np.argsort(q)
        assert abs(minhash.probability_jaccard(p[order_p], x[order_p], q[order_q], y[order_q]) - exact) < 1e-12
        kept = minhash.prob_minhash(np.repeat([0, 1], [len(p), len(q)]), np.concatenate([p, q]), np.concatenate([x, y]), 2, 4000)
        assert abs((kept[0] == kept[1]).mean() - exact) < 0.04
        assert (minhash.prob_minhash(np.zeros(len(p), dtype=int), p, x, 1, 4000)[0] == kept[0]).all()


def test_empty_table(spark):
    assert minhash.near_classes(frame(spark, [])).collect() == []
