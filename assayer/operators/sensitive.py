"""Entities that a pattern alone cannot tell: card and account numbers by their check digits, secrets by the entropy of their characters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# Whole runs, so that a number inside a longer one is never taken. Secrets go first: a token may hold many digits.
PATTERNS = {
    "SECRET": r"[A-Za-z0-9_+/=-]{20,}",
    "IBAN_CODE": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "CREDIT_CARD": r"[0-9](?:[ -]?[0-9]){12,}",
}
ENTROPY = 3.0


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def luhn(number: Column) -> Column:
    """Payment card number of 13 to 19 digits, separators aside, whose weighted digit sum ends in 0."""
    digits = F.regexp_replace(number, "[^0-9]", "")
    weighed = F.transform(_characters(F.reverse(digits)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c > "4", 9).otherwise(0)))
    return digits.rlike("^[2-6]") & F.length(digits).between(13, 19) & (F.aggregate(weighed, F.lit(0), lambda a, d: a + d) % 10 == 0)


def iban(account: Column) -> Column:
    """Account number of 15 to 34 characters whose rearranged value leaves 1 when divided by 97."""
    plain = F.replace(account, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    step = lambda a, c: (F.when(c < "A", a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97).cast("int")
    return F.length(plain).between(15, 34) & (F.aggregate(_characters(turned), F.lit(0), step) == 1)


def secret(token: Column) -> Column:
    """Token with letters and digits whose characters carry at least ``ENTROPY`` bits each."""
    kinds = F.array_distinct(_characters(token))
    counts = F.transform(kinds, lambda c: (F.length(token) - F.length(F.replace(token, c, F.lit("")))).cast("double"))
    bits = F.log2(F.length(token).cast("double")) - F.aggregate(counts, F.lit(0.0), lambda a, n: a + n * F.log2(n)) / F.length(token)
    return token.rlike("[0-9]") & token.rlike("[A-Za-z]") & (F.round(bits, 9) >= ENTROPY)


CHECKS: dict[str, Callable[[Column], Column]] = {"SECRET": secret, "IBAN_CODE": iban, "CREDIT_CARD": luhn}


def _parts(text: Column, name: str) -> Column:
    """Alternating text: what stands before each match, and the match, null after the last one."""
    pattern = PATTERNS[name]
    return F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda before, match: F.struct(before.alias("before"), match.alias("match")))


def checked_redact(docs: DataFrame, action: str = "replace", text: str = "text") -> DataFrame:
    """Documents with ``secret, iban_code, credit_card`` (numbers of hits) and the text with a tag in place of each, or without them
    (``redact``). Only runs that pass their check are touched; a null text stays null and has no hits."""
    current, entities = docs, list(PATTERNS)
    for name in entities:
        tag = F.lit(f"<{name}>" if action == "replace" else "")
        current = current.withColumn("_parts", F.transform(_parts(F.col(text), name), lambda p: F.struct(p["before"], p["match"], F.coalesce(CHECKS[name](p["match"]), F.lit(False)).alias("hit"))))  # noqa: B023
        pieces = F.transform("_parts", lambda p: F.concat(p["before"], F.when(p["hit"], tag).otherwise(F.coalesce(p["match"], F.lit("")))))  # noqa: B023
        hits = F.coalesce(F.size(F.filter("_parts", lambda p: p["hit"])), F.lit(0))
        current = current.withColumns({name.lower(): F.when(F.col(text).isNull(), 0).otherwise(hits).cast("bigint"), text: F.array_join(pieces, "")}).drop("_parts")
    return current


def sensitive_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, entity, start, end``: every run that passes its check, in characters of the text as it stands, from 0."""
    found = []
    for name in PATTERNS:
        place = F.aggregate(
            _parts(F.col(text), name), F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("spans")),
            lambda a, p: F.struct((a["at"] + F.length(p["before"]) + F.coalesce(F.length(p["match"]), F.lit(0))).alias("at"),
                                  F.when(CHECKS[name](p["match"]), F.concat(a["spans"], F.array(F.struct(  # noqa: B023
                                      (a["at"] + F.length(p["before"])).alias("start"), (a["at"] + F.length(p["before"]) + F.length(p["match"])).alias("end"))))).otherwise(a["spans"]).alias("spans")),
            lambda a: a["spans"])
        found.append(F.transform(place, lambda s: F.struct(F.lit(name).alias("entity"), s["start"].alias("start"), s["end"].alias("end"))))  # noqa: B023
    # Most texts hold none of the runs: one test of the three patterns spares them the rest.
    some = docs.where(F.col(text).rlike("|".join(PATTERNS.values())))
    return some.select("doc_id", F.explode(F.concat(*found)).alias("s")).select("doc_id", "s.entity", "s.start", "s.end")
