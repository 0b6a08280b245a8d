"""Heuristic document measures and filters, each one column expression over the whole text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions.text import with_value, words

# Limits of the documented filters; the last five are ours, the guide only names those filters.
LIMITS = {"min_words": 50, "max_words": 100000, "repeated_lines": 0.3, "symbol_ratio": 0.3, "url_ratio": 0.2,
          "non_alnum": 0.25, "bullets": 0.9, "whitespace": 0.25, "parentheses": 0.1, "longest_word": 1000}
URL = r"https?://[^\s]+"
# Frequent function words by language.
STOP_WORDS = {
    "en": ["the", "and", "of", "to", "in", "is", "that", "it", "for", "with", "as", "was", "on", "are", "by", "this", "be", "from", "at", "not"],
    "de": ["der", "die", "und", "das", "ist", "nicht", "mit", "ein", "eine", "von", "zu", "den", "auf", "für", "sich", "auch", "dem", "des", "im", "wird"],
    "fr": ["le", "la", "les", "et", "des", "est", "dans", "une", "un", "pour", "qui", "du", "sur", "par", "pas", "avec", "au", "ce", "il", "elle"],
    "es": ["el", "los", "las", "que", "y", "una", "por", "con", "para", "se", "del", "no", "su", "al", "lo", "como", "más", "es", "en", "ser"],
}


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def filled_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.trim(line) != "")


def measures(text: Column) -> dict[str, Column]:
    """Named measures of a text; ratios are zero where undefined."""
    chars = F.char_length(text)
    lines = filled_lines(text)
    word_list = words(text)
    removed = lambda pattern: chars - F.char_length(F.regexp_replace(text, pattern, ""))
    return {
        "n_words": F.size(word_list),
        "repeated_lines": ratio(F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines)),
        "symbol_ratio": ratio(removed("[#*~^{}<>|%$@]+"), F.size(word_list)),
        "url_ratio": ratio(removed(URL), chars),
        "non_alnum": ratio(removed(r"[^\p{L}\p{N}\s]+"), chars),
        "bullets": ratio(F.size(F.filter(lines, lambda line: line.rlike(r"^\s*[-*•]"))), F.size(lines)),
        "whitespace": ratio(removed(r"\s+"), chars),
        "parentheses": ratio(removed(r"[()\[\]]+"), chars),
        "longest_word": F.coalesce(F.array_max(F.transform(word_list, F.char_length)), F.lit(0)),
    }


def with_measures(docs: DataFrame, *keep: str) -> DataFrame:
    return docs.select(*keep, *[c.alias(n) for n, c in measures(F.col("text")).items()])


def detect_language(text: Column) -> Column:
    """Language with most stop words, the first by name on ties, ``und`` without any.

    The words are cut once; membership in a constant set is hashed, so the cost is one pass per language.
    """
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    names = sorted(STOP_WORDS)

    def hits(t: Column, stop: list[str]) -> Column:
        return F.size(F.filter(t, lambda w: w.isin(*stop)))

    def pick(counts: Column) -> Column:
        best = F.array_max(counts)
        position = (F.array_position(counts, best) - 1).cast("int")
        return F.when(best == 0, "und").otherwise(F.get(F.array(*[F.lit(n) for n in names]), position))

    return with_value(tokens, lambda t: with_value(F.array(*[hits(t, STOP_WORDS[n]) for n in names]), pick))


def language_filter(docs: DataFrame, targets: Sequence[str]) -> DataFrame:
    return docs.withColumn("language", detect_language(F.col("text"))).where(F.col("language").isin(*targets))


def with_ngram_repetition(docs: DataFrame, n: int, *keep: str) -> DataFrame:
    """Share of word n-grams of a text that repeat an earlier one, as ``repetition``; zero for shorter texts."""
    listed = docs.select(*keep, words(F.lower("text")).alias("_t"))
    grams = F.transform(F.sequence(F.lit(1), F.size("_t") - (n - 1)), lambda i: F.xxhash64(F.slice("_t", i, n)))
    shaped = listed.select(*keep, F.when(F.size("_t") >= n, grams).alias("_g"))
    value = F.coalesce(1 - F.size(F.array_distinct("_g")) / F.nullif(F.size("_g"), F.lit(0)), F.lit(0.0))
    return shaped.select(*keep, value.alias("repetition"))


def template_leakage(docs: DataFrame, share: float = 0.01, min_chars: int = 5) -> DataFrame:
    """Lines found in at least a share of all documents: ``line, documents``. Lines are made distinct within a document first."""
    total = docs.agg(F.count("*").alias("n"))
    lines = F.array_distinct(F.filter(F.transform(F.split("text", "\n"), F.trim), lambda x: F.char_length(x) >= min_chars))
    counted = docs.select(F.explode(lines).alias("line")).groupBy("line").agg(F.count("*").alias("documents"))
    return counted.where(F.col("documents") >= F.lit(share) * total.scalar())


def regeneration_diff(old: DataFrame, new: DataFrame, alert: float = 0.3) -> DataFrame:
    """Changed, added and removed texts between two versions by id, and the alert. Only digests are shuffled."""
    digest = lambda frame, name: frame.select("doc_id", F.md5("text").alias(name))
    both = digest(old, "before").join(digest(new, "after"), "doc_id", "full")
    counted = both.agg(
        F.count("*").alias("total"), F.count_if(F.col("before").isNull()).alias("added"), F.count_if(F.col("after").isNull()).alias("removed"),
        F.count_if(F.col("before") != F.col("after")).alias("changed"))
    changed = F.coalesce(F.col("changed") / F.nullif(F.col("total") - F.col("added") - F.col("removed"), F.lit(0)), F.lit(0.0))
    return counted.withColumn("changed_share", changed).withColumn("alert", F.col("changed_share") > alert)
