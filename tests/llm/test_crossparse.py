import random

import numpy as np
import pyarrow as pa

from assayer.llm import crossparse, queries
from tests.conftest import SMALL
from tests.llm.common import frame


def naive(text, sample):
    """Phrases of the greedy parse of a text into substrings of a sample."""
    at = phrases = 0
    while at < len(text):
        size = 0
        while at + size < len(text) and text[at:at + size + 1] in sample:
            size += 1
        phrases, at = phrases + 1, at + max(size, 1)
    return phrases


def test_parse_equals_the_naive_parse():
    rng = random.Random(11)
    sample = "".join(rng.choice("abc ") for _ in range(300)).replace("  ", " ")
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 90))) for _ in range(80)]
    symbol = {c: i for i, c in enumerate(sorted(set(sample)))}
    table = crossparse.suffix_automaton([symbol[c] for c in sample], len(symbol) + 1)
    codes = np.array([symbol.get(c, len(symbol)) for c in "".join(texts)])
    for lane in (1, 2, 7, 400):
        got = crossparse.phrase_counts(codes, np.array([len(t) for t in texts]), [table], len(symbol) + 1, lane)[:, 0]
        assert got.tolist() == [naive(t, sample) for t in texts]


def test_a_long_text_is_parsed_without_a_break():
    """Matches cross the ends of many lanes: the sample itself is one phrase, pieces of it a few long ones."""
    rng = random.Random(12)
    sample = "".join(rng.choice("ab") for _ in range(3000))
    texts = [sample, sample[5:2900] + "c" + sample[:2000], "".join(sample[i:i + rng.randint(1, 900)] for i in rng.sample(range(3000), 9)), "", "c"]
    table, symbol = crossparse.suffix_automaton(["ab".index(c) for c in sample], 3), {"a": 0, "b": 1, "c": 2}
    codes = np.array([symbol[c] for c in "".join(texts)])
    for lane in (3, 50, 400):
        got = crossparse.phrase_counts(codes, np.array([len(t) for t in texts]), [table], 3, lane)[:, 0]
        assert got.tolist() == [naive(t, sample) for t in texts]


def test_characters():
    points, counts = crossparse._characters(pa.array(["Ab  1c", None, "", "..", "éÉ!x"]))
    assert counts.tolist() == [4, 0, 0, 0, 4] and "".join(chr(p) if p else "_" for p in points) == "ab_céé_x"


def test_answers_and_odd_rows(spark):
    samples = {"en": "the number becomes the answer of the rule " * 5, "fr": "le nombre devient la réponse de la règle " * 5}
    rows = [("a", "the answer becomes"), ("b", "la réponse de la règle"), ("c", None), ("d", ""), ("e", "12 !?"), ("f", "the rule " * 5000), ("a", "the answer becomes")]
    got = [(r.id, r.lang_pred, r.score) for r in crossparse.identify_language(frame(spark, rows, text="prompt"), samples).collect()]
    assert sorted((k, p) for k, p, _ in got) == [("a", "en"), ("a", "en"), ("b", "fr"), ("c", "und"), ("d", "und"), ("e", "und"), ("f", "en")]
    assert all(0 <= s <= 1 for *_, s in got)
    assert [r.lang_pred for r in crossparse.identify_language(frame(spark, rows[:1], text="prompt"), {}).collect()] == ["und"]
    assert crossparse.identify_language(frame(spark, [], text="prompt"), samples).collect() == []


def test_held_out_accuracy(spark):
    found = queries.op7(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 40 and sum(r.lang == r.lang_pred for r in found) / len(found) > 0.95


def test_samples_are_bounded(spark):
    rows = [(f"p{i}", f"word{i} " * 50, "en" if i % 2 else None) for i in range(60)] + [("n", None, "en")]
    samples = crossparse.language_samples(spark.createDataFrame(rows, "id string, prompt string, lang string"), rows=5, chars=900)
    assert list(samples) == ["en"] and len(samples["en"]) <= 900


def test_samples_count_a_copied_text_once(spark):
    rows = [(f"text{chr(97 + i)} of the sample", "en") for i in range(12)]
    hot = [(t, "en") for t in (rows[0][0], rows[1][0], "12 34") for _ in range(3000)]
    samples = crossparse.language_samples(spark.createDataFrame(rows + hot, "prompt string, lang string"), rows=12, chars=5000)
    assert sorted(samples["en"].split(" text")[1:]) == sorted(t.removeprefix("text") for t, _ in rows)


def test_every_letter_of_the_samples_has_a_symbol(spark):
    rng = random.Random(5)
    alphabets = {"ko": range(0xAC00, 0xAC00 + 400), "zh": range(0x4E00, 0x4E00 + 500), "zz": range(0x5200, 0x5200 + 500)}
    pools = {k: ["".join(chr(rng.choice(v)) for _ in range(rng.randint(1, 4))) for _ in range(400)] for k, v in alphabets.items()}
    write = lambda k, n: " ".join(rng.choice(pools[k]) for _ in range(n))
    samples = {k: write(k, 900) for k in pools} | {"en": "the number becomes the answer of the rule " * 20}
    rows = [(f"{k}{i}", write(k, 30)) for k in pools for i in range(20)] + [("unseen", chr(0x9000) * 50 + " the rule"), ("mixed", "the answer " * 5 + write("zh", 2))]
    got = {r.id: r for r in crossparse.identify_language(frame(spark, rows, text="prompt"), samples).collect()}
    texts = dict(rows)
    assert all(r.lang_pred == ("en" if i in ("unseen", "mixed") else i[:2]) for i, r in got.items())
    assert all(r.phrases == naive(texts[i], samples[r.lang_pred]) for i, r in got.items())
