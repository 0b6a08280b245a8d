import random
import re

from assayer.llm import winnowing
from tests.llm.common import frame, sentence


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(puzzles, held, span=10):
    windows = {}
    for item, text in held:
        w = words(text)
        if w:
            size = min(span, len(w))
            for i in range(len(w) - size + 1):
                windows.setdefault(tuple(w[i:i + size]), set()).add(item)
    out = {}
    for key, text in puzzles:
        w, hit, items = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in windows:
                    hit.update(range(i, i + size))
                    items |= windows[tuple(w[i:i + size])]
        out[key] = (len(w), len(hit), sorted(items))
    return out


def run(spark, puzzles, held):
    found = winnowing.contamination(frame(spark, puzzles, text="prompt"), frame(spark, held, text="prompt"))
    return {r.id: (r.n_words, r.n_hit, r["items"]) for r in found.collect()}


def test_against_all_windows(spark):
    rng = random.Random(1)
    held = [(f"h{i:02}", sentence(rng, rng.randint(3, 40))) for i in range(12)]
    held += [("nested", " ".join(held[3][1].split()[4:18])), ("twice", held[5][1]), ("short", "Gravity, rule!"), ("one", "zebra"), ("none", "?!"), ("null", None), ("periodic", "ab " * 30)]
    puzzles = [(f"p{i:02}", sentence(rng, rng.randint(0, 80))) for i in range(20)]
    for i, (_, text) in enumerate(held[:16]):
        w = (text or "").split()
        cut = " ".join(w[rng.randint(0, 3):rng.randint(8, 40)])
        puzzles.append((f"q{i:02}", f"{sentence(rng, 5)} {cut.upper()}! {sentence(rng, 9)}"))
    puzzles += [("null", None), ("empty", ""), ("marks", "?!. -"), ("long", sentence(rng, 4000) + " " + held[0][1] + " ab ab" * 20), ("accents", "Été zebra naïve GRAVITY - rule")]
    got = run(spark, puzzles, held)
    assert got == brute(puzzles, held)
    assert got["null"] == (0, 0, []) and got["accents"][1] == 3


def test_span_edges(spark):
    base = sentence(random.Random(2), 10)
    assert run(spark, [("a", base), ("b", " ".join(base.split()[:9])), ("c", f"x {base} y")], [("h", base)]) == {"a": (10, 10, ["h"]), "b": (9, 0, []), "c": (12, 10, ["h"])}


def test_empty_tables(spark):
    assert run(spark, [], [("h", "a b c")]) == {}
    assert run(spark, [("a", "a b c")], []) == {"a": (3, 0, [])}


def test_rows_keep_their_own_hits(spark):
    """Equal and null ids with different texts: every row has the figures of its own text."""
    item = " ".join(f"w{i}" for i in range(12))
    rows = [("a", f"x {item}"), ("a", "x y z"), (None, item), (None, "clean words only"), ("a", f"x {item}")]
    found = winnowing.contamination(frame(spark, rows, text="prompt"), frame(spark, [("i", item)], text="prompt", extra=False)).collect()
    assert sorted((str(r.id), r.n_words, r.n_hit, len(r["items"])) for r in found) == [("None", 3, 0, 0), ("None", 12, 12, 1), ("a", 3, 0, 0), ("a", 13, 12, 1), ("a", 13, 12, 1)]
