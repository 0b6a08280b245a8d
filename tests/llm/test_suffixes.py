import random

import pytest

from assayer.llm import suffixes
from tests.llm.common import frame, sentence


def brute(rows, span):
    seen, out = set(), {}
    for key, text in sorted(rows):
        data, gone = (text or "").encode(), set()
        for i in range(len(data) - span + 1):
            if data[i:i + span] in seen:
                gone.update(range(i, i + span))
            seen.add(data[i:i + span])
        spans = []
        for p in sorted(gone):
            if spans and spans[-1][1] == p:
                spans[-1][1] = p + 1
            else:
                spans.append([p, p + 1])
        out[key] = (len(data), [tuple(s) for s in spans], bytes(b for i, b in enumerate(data) if i not in gone))
    return out


def rows():
    rng = random.Random(4)
    passages = [sentence(rng, 40) for _ in range(4)]
    made = []
    for i in range(40):
        made.append((f"c{i:03}", " ".join(rng.choice([sentence(rng, rng.randint(1, 30)), rng.choice(passages), rng.choice(passages)[rng.randint(0, 60):]]) for _ in range(rng.randint(1, 5)))))
    made += [("copy1", made[3][1]), ("copy2", made[3][1]), ("null", None), ("null2", None), ("empty", ""), ("short", "abc"), ("run", "a" * 700), ("period", "roman numeral é " * 60), ("zzlong", sentence(rng, 3000) + passages[0])]
    return made


@pytest.mark.parametrize("crowd", [32_768, 2])
def test_against_all_strings(spark, crowd):
    found = suffixes.drop_repeats(frame(spark, rows()), crowd=crowd)
    assert {r.id: (r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in found.collect()} == brute(rows(), 100)


def test_short_span(spark):
    made = [("a", "abcdefghijklmnop"), ("b", "xxcdefghijklyy"), ("c", "bcdefghijk")]
    found = suffixes.drop_repeats(frame(spark, made), span=8, gram=4)
    assert {r.id: (r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in found.collect()} == brute(made, 8)


def test_empty_table(spark):
    assert suffixes.drop_repeats(frame(spark, [])).collect() == []


@pytest.mark.parametrize("crowd", [32_768, 2])
def test_repeated_rows_and_null_ids(spark, crowd):
    rng = random.Random(9)
    a, b, c, d, e = (sentence(rng, 40) for _ in range(5))
    made = [("r", a), ("r", a), ("r", a), ("s", b + a), ("t", c), ("t", c), ("t", d), (None, e), (None, e), (None, sentence(rng, 30) + b), (None, "short"), (None, "short")]
    got = [(r.id, bytes(r.kept).decode()) for r in suffixes.drop_repeats(frame(spark, made), crowd=crowd).collect()]
    assert len(got) == len(made)
    assert [k for i, k in got if i == "r"] == [a] * 3
    assert [k for i, k in got if i == "s"] == [b]
    assert sorted(k for i, k in got if i == "t") == sorted([c, c, d])
    assert sorted(k for i, k in got if i is None) == sorted([e, "", made[9][1][:-len(b)], "short", "short"])


def test_carried_columns_follow_their_row(spark):
    rng = random.Random(2)
    a, b = sentence(rng, 40), sentence(rng, 40)
    made = [("r", a, "one"), ("r", b, "two"), (None, a, "three"), (None, "short", None)]
    found = suffixes.drop_repeats(spark.createDataFrame(made, "id string, text string, lang string"), carry=("lang",))
    assert found.columns == ["id", "n_bytes", "spans", "kept", "lang"]
    assert sorted((str(r.lang), len(r.kept)) for r in found.collect()) == [("None", 5), ("one", len(a)), ("three", 0), ("two", len(b))]
