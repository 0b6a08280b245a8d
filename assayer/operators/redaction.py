"""Pattern-based redaction of personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Entity patterns in the order they are applied. Names and places need a model and are left out.
ENTITIES = {
    "EMAIL_ADDRESS": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "PHONE_NUMBER": r"\+?[0-9]{1,3}[ .-]\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-]?[0-9]{2,4}\b|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}\b",
}


def redact(text: Column, action: str = "replace") -> tuple[Column, dict[str, Column]]:
    """Redacted text and the number of hits per entity. ``replace`` leaves a tag, ``redact`` removes the span."""
    counts: dict[str, Column] = {}
    current = text
    for name, pattern in ENTITIES.items():
        counts[name.lower()] = F.regexp_count(current, F.lit(pattern))
        current = F.regexp_replace(current, pattern, f"<{name}>" if action == "replace" else "")
    return current, counts


def pii_redact(docs: DataFrame, action: str = "replace") -> DataFrame:
    redacted, counts = redact(F.col("text"), action)
    return docs.withColumns({**{n: c for n, c in counts.items()}, "text": redacted})
