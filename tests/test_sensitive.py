"""Checked entities against a plain scan."""

import math
import random
import re
from collections import Counter

from assayer.operators import sensitive


def luhn_ok(m):
    d = [int(c) for c in m if c.isdigit()]
    total = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d)))
    return 13 <= len(d) <= 19 and 2 <= d[0] <= 6 and total % 10 == 0


def iban_ok(m):
    m = m.replace(" ", "")
    return 15 <= len(m) <= 34 and int("".join(str(int(c, 36)) for c in m[4:] + m[:4])) % 97 == 1


def secret_ok(m):
    bits = -sum(n / len(m) * math.log2(n / len(m)) for n in Counter(m).values())
    return bool(re.search("[0-9]", m) and re.search("[A-Za-z]", m)) and round(bits, 9) >= sensitive.ENTROPY


OK = {"SECRET": secret_ok, "IBAN_CODE": iban_ok, "CREDIT_CARD": luhn_ok}


def brute(text, action="replace"):
    counts, current, spans = {}, text, []
    for name, pattern in sensitive.PATTERNS.items():
        hits = [m for m in re.finditer(pattern, current or "") if OK[name](m[0])]
        counts[name] = len(hits)
        spans += [(name, m.start(), m.end()) for m in re.finditer(pattern, text or "") if OK[name](m[0])]
        if current is not None:
            current = re.sub(pattern, lambda m: (f"<{name}>" if action == "replace" else "") if OK[name](m[0]) else m[0], current)  # noqa: B023
    return counts, current, spans


def luhn_number(rng, n):
    body = "4" + "".join(str(rng.randint(0, 9)) for _ in range(n - 2))
    return next(body + c for c in "0123456789" if luhn_ok(body + c)) if n >= 13 else body


def made(rng, n):
    pieces = lambda: rng.choice([
        luhn_number(rng, rng.choice([13, 16, 19])), "-".join(re.findall("....", luhn_number(rng, 16))), "".join(str(rng.randint(0, 9)) for _ in range(rng.randint(9, 24))), "GB82 WEST 1234 5698 7654 32",
        "DE89370400440532013000", "DE89370400440532013001", "FR1420041010050500013M02606", "".join(rng.choice("0123456789abcdef") for _ in range(40)), "a" * 30, "aaaa1111aaaa1111aaaa1111", "plain", "é日本", "ÉAB12", "x=y", "-", "\n"])
    return ["".join(pieces() + rng.choice([" ", ", ", "", "\n"]) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_against_a_plain_scan(spark):
    texts = made(random.Random(6), 120) + [None, "", "4111 1111 1111 1111", "4111 1111 1111 1112", "0" * 16]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, secret string").drop("secret")
    want = [brute(t) for t in texts]
    assert sum(w[0]["CREDIT_CARD"] for w in want) > 20 and sum(w[0]["IBAN_CODE"] for w in want) > 20 and sum(w[0]["SECRET"] for w in want) > 20
    got = {r.doc_id: r for r in sensitive.checked_redact(frame).collect()}
    assert [({n: got[i][n.lower()] for n in OK}, got[i].text) for i in range(len(texts))] == [w[:2] for w in want]
    bare = {r.doc_id: r.text for r in sensitive.checked_redact(frame, action="redact").collect()}
    assert [bare[i] for i in range(len(texts))] == [brute(t, "redact")[1] for t in texts]
    spans = sorted(tuple(r) for r in sensitive.sensitive_spans(frame).collect())
    assert spans == sorted((i, *s) for i, w in enumerate(want) for s in w[2])
