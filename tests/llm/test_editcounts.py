import random

import numpy as np
from tokenizers import Tokenizer

from assayer.llm import editcounts
from assayer.llm.queries import tokenizer_file
from assayer.llm.tokens import WordEncoder
from tests.llm.common import frame, sentence

PATH = tokenizer_file("word_bpe_49k.json")
SHAPE = "id string, text string, edits array<struct<start bigint, length bigint, replacement string>>, tokens int, bytes int"


def count(text):
    return len(Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids)


def test_repeated_edits_equal_full_counts():
    rng, encoder, tokenizer = random.Random(17), WordEncoder(PATH), Tokenizer.from_file(PATH)
    for _ in range(150):
        text = "".join(rng.choice("ab'é,. \n1-s") for _ in range(rng.randint(0, 120))).encode()
        data = np.frombuffer(text, dtype=np.uint8)
        starts, ends, _ = editcounts.pre_tokens(data, np.array([0, len(data)]))
        size, tokens = editcounts._leaf_sums(starts, encoder.counts(data, starts, ends), len(text), np.arange(0, len(starts), 3))
        leaves, size, tokens = len(size), editcounts.build_tree(size), editcounts.build_tree(tokens)
        for _ in range(4):
            at = rng.randint(0, len(text.decode()))
            start = len(text.decode()[:at].encode())
            length = len(text.decode()[at:at + rng.randint(0, 6)].encode())
            new = "".join(rng.choice("ab'é,. \n1-s") for _ in range(rng.randint(0, 5))).encode()
            want = text[:start] + new + text[start + length:]
            text, _ = editcounts.edit_tree(text, leaves, size, tokens, [(start, length, new)], encoder)
            assert text == want and size[1] == len(text)
            assert tokens[1] == len(tokenizer.encode(text.decode(), add_special_tokens=False).ids)


def test_rows_with_and_without_edits(spark):
    rng = random.Random(18)
    long = sentence(rng, 5000)
    rows = [("plain", "a b c", None), ("null", None, [(0, 0, "new text")]), ("empty", "", []), ("drop", "one two three", [(4, 4, None)]), ("overlap", "one two three", [(4, 3, "x"), (5, 4, "y"), (-3, 1, "z"), (99, 1, "q")]),
            ("tail", "one two", [(4, 99, "six")]), ("long", long, [(10_000, 5, "changed words here"), (20_000, 0, " ")])]
    found = {r.id: r for r in editcounts.apply_edits(editcounts.token_trees(spark.createDataFrame([(*r, 1, 2) for r in rows], SHAPE), PATH), PATH).collect()}
    want = {"plain": "a b c", "null": "new text", "empty": "", "drop": "one three", "overlap": "one x three", "tail": "one six", "long": long[:10_000] + "changed words here" + long[10_005:20_000] + " " + long[20_000:]}
    for k, text in want.items():
        assert (found[k].text or "") == text and found[k].n_tokens == count(text) and found[k].n_bytes == len(text)
    assert found["overlap"].n_edits == 1 and found["long"].n_encoded < 2000 and found["plain"].n_encoded == 0


def test_edited_trees_can_be_edited_again(spark):
    rows = [("a", sentence(random.Random(19), 400), [(50, 3, "xyz w")], 0, 0)]
    once = editcounts.apply_edits(editcounts.token_trees(spark.createDataFrame(rows, SHAPE), PATH), PATH)
    again = once.selectExpr("id", "text", "array(named_struct('start', 900L, 'length', 4L, 'replacement', 'q')) as edits", "n_tokens", "leaves", "bytes", "tokens")
    r = editcounts.apply_edits(again, PATH).first()
    assert r.n_tokens == count(r.text) and r.n_before == once.first().n_tokens


def test_redaction_edits(spark):
    rows = [("a", "mail é bob@example.com or +1 555-123-4567 now"), ("b", None), ("c", "nothing 12 345")]
    found = {r.id: r for r in editcounts.apply_edits(editcounts.token_trees(editcounts.redaction_edits(frame(spark, rows)), PATH), PATH).collect()}
    whole = {r.id: r for r in editcounts.redacted_counts(frame(spark, rows), PATH).collect()}
    assert whole == found
    assert found["a"].text == "mail é <EMAIL_ADDRESS> or <PHONE_NUMBER> now" and found["a"].n_tokens == count(found["a"].text) and found["c"].n_edits == 0


def test_empty_table(spark):
    assert editcounts.apply_edits(editcounts.token_trees(frame(spark, []), PATH), PATH).collect() == []


def test_many_edits_at_once_equal_full_counts():
    """Several edits of one text, also beside each other and in one leaf, against the plainly edited text."""
    rng, encoder, tokenizer = random.Random(20), WordEncoder(PATH), Tokenizer.from_file(PATH)
    for _ in range(200):
        text = "".join(rng.choice("ab'é,. \n1-s") for _ in range(rng.randint(0, 200)))
        raw = text.encode()
        data = np.frombuffer(raw, dtype=np.uint8)
        starts, ends, _ = editcounts.pre_tokens(data, np.array([0, len(data)]))
        size, tokens = editcounts._leaf_sums(starts, encoder.counts(data, starts, ends), len(raw), np.arange(0, len(starts), 3))
        leaves, size, tokens = len(size), editcounts.build_tree(size), editcounts.build_tree(tokens)
        edits, at, want = [], 0, ""
        while at < len(text):
            a = at + rng.randint(0, 12)
            b = a + rng.randint(0, 5)
            if b > len(text):
                break
            new = "".join(rng.choice("ab'é,. \n1-s") for _ in range(rng.randint(0, 5)))
            edits.append((len(text[:a].encode()), len(text[a:b].encode()), new.encode()))
            want, at = want + text[at:a] + new, max(b, a + 1)
            want += text[b:at]
        want += text[at:]
        got, _ = editcounts.edit_tree(raw, leaves, size, tokens, edits, encoder)
        assert got.decode() == want and size[1] == len(got) and tokens[1] == len(tokenizer.encode(want, add_special_tokens=False).ids)


def test_100_000_edits_in_one_text(spark):
    import time

    text = "".join(f"é a{i}@b.com, +1 555-123-{i % 10_000:04d};\n" for i in range(50_000))
    started = time.time()
    r = editcounts.redacted_counts(spark.createDataFrame([("a", text)], "id string, text string"), PATH).first()
    want = "é <EMAIL_ADDRESS>, <PHONE_NUMBER>;\n" * 50_000
    assert r.n_edits == 100_000 and r.text == want and r.n_tokens == count(want) and time.time() - started < 120


def test_repeated_rows(spark):
    rows = [("a", "mail bob@example.com"), ("a", "mail bob@example.com"), (None, "x +1 555-123-4567"), (None, "plain")]
    found = editcounts.redacted_counts(frame(spark, rows), PATH).collect()
    assert sorted((str(r.id), r.text, r.n_edits) for r in found) == [("None", "plain", 0), ("None", "x <PHONE_NUMBER>", 1), ("a", "mail <EMAIL_ADDRESS>", 1), ("a", "mail <EMAIL_ADDRESS>", 1)]
