"""Rows shared by the tests: prompts and completions with odd cases, under string ids as in the puzzle table."""

import random

WORDS = "the becomes input output cipher number gravity measurement roman numeral distance table letter secret rule apply convert answer final value binary shift".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "x", str(rng.randint(0, 99))]) for _ in range(n))


def frame(spark, rows, kind="string", text="text", extra=True):
    """``id, <text>`` and, with ``extra``, columns whose names the operators use themselves."""
    clash = ", n_words int, rows int, label string, _id int, bucket int, at int, part int" if extra else ""
    values = [(*r, *((1, 2, "x", 3, 4, 5, 6) if extra else ())) for r in rows]
    return spark.createDataFrame(values, f"id {kind}, {text} string{clash}")
