"""Curation of a document table as one plan: cheap rules first, then exact copies, then redaction."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, functions as F

from assayer.operators import filters
from assayer.operators.classifiers import word_scores
from assayer.operators.dedup import fuzzy_dedup
from assayer.operators.redaction import redact
from assayer.session import stored

STAGES = ["word_count", "repeated_lines", "symbol_ratio", "url_ratio", "language", "exact_copy", "kept"]
# Limits of the documented web-scrape example.
LIMITS = {"min_words": 100, "max_words": 50000, "repeated_lines": 0.2, "symbol_ratio": 0.3, "url_ratio": 0.3}


def staged(docs: DataFrame, languages: Sequence[str], limits: dict[str, float] = LIMITS) -> DataFrame:
    """Every document with the stage that drops it, or ``kept``. One scan for the rules; copies are judged among passers."""
    measured = filters.measures(F.col("text"))
    named = docs.select("doc_id", F.md5("text").alias("digest"), *[measured[n].alias(n) for n in ("n_words", "repeated_lines", "symbol_ratio", "url_ratio")],
                        filters.detect_language(F.col("text")).alias("language"))
    chain = F.when((F.col("n_words") < limits["min_words"]) | (F.col("n_words") > limits["max_words"]), "word_count")
    for name in ("repeated_lines", "symbol_ratio", "url_ratio"):
        chain = chain.when(F.col(name) > limits[name], name)
    ruled = named.select("doc_id", "digest", chain.when(~F.col("language").isin(*languages), "language").alias("stage"))
    keepers = ruled.where(F.col("stage").isNull()).groupBy("digest").agg(F.min("doc_id").alias("keeper"))
    joined = ruled.join(keepers, "digest", "left")
    return joined.select("doc_id", F.coalesce("stage", F.when(F.col("doc_id") == F.col("keeper"), "kept").otherwise("exact_copy")).alias("stage"))


def stage_counts(stages: DataFrame) -> DataFrame:
    return stages.groupBy("stage").agg(F.count("*").alias("documents"))


def curated(docs: DataFrame, languages: Sequence[str], fuzzy: bool = True) -> DataFrame:
    """Kept documents with personal data redacted; near copies leave when ``fuzzy`` is set."""
    ids = stored(staged(docs, languages).where(F.col("stage") == "kept").select("doc_id"), "passed")
    if fuzzy:
        clusters = fuzzy_dedup(docs, among=ids)
        ids = stored(clusters.where(F.col("doc_id") == F.col("cluster")).select("doc_id"), "single")
    kept = docs.join(ids, "doc_id", "left_semi")
    return kept.withColumn("text", redact(F.col("text"))[0])


FUNNEL = [*STAGES[:-1], "near_copy", "toxic", "kept", "redacted"]


def curate(docs: DataFrame, labels: DataFrame, languages: Sequence[str], path: str, toxic: float = 0.8) -> DataFrame:
    """Curate documents into ``path`` and return how many each step drops: ``stage, documents``, the stages in ``FUNNEL``.

    Rules, language, exact copies, near copies, redaction and the classifier for unsafe texts, in this order of work. The counts are
    observed while the steps write their results, so none of them costs a scan of its own. ``kept`` are the documents written, ``redacted``
    those of them with personal data. The classifier learns from the labelled documents of the whole table and reads a text as it was before redaction.
    """
    spark = docs.sparkSession
    ruled, near, written = (Observation(f"{name}-{uuid.uuid4().hex}") for name in ("ruled", "near", "written"))
    stages = staged(docs, languages)
    stages = stages.observe(ruled, *[F.count_if(F.col("stage") == s).alias(s) for s in STAGES])
    passed = stored(stages.where(F.col("stage") == "kept").select("doc_id"), "passed")
    clusters = fuzzy_dedup(docs, among=passed).observe(near, F.count_if(F.col("doc_id") != F.col("cluster")).alias("near_copy"))
    single = stored(clusters.where(F.col("doc_id") == F.col("cluster")).select("doc_id"), "single")
    scores = stored(word_scores(docs, labels, "toxic").join(single, "doc_id", "left_semi"), "scores")
    judged = docs.join(scores, "doc_id")
    text, counts = redact(F.col("text"))
    safe = F.col("score") < toxic
    hits = functools.reduce(lambda a, b: a + b, counts.values())
    # ``is_safe`` is false and never null for a score of a document, so both sides of the split are counted.
    final = judged.select("*", safe.alias("is_safe"), hits.alias("hits")).withColumn("text", text)
    final = final.observe(written, F.count_if(~F.col("is_safe")).alias("toxic"), F.count_if("is_safe").alias("kept"), F.count_if(F.col("is_safe") & (F.col("hits") > 0)).alias("redacted"))
    final.where("is_safe").select(*docs.columns).write.parquet(path)
    counted = {**ruled.get, **near.get, **written.get}
    return spark.createDataFrame([(s, counted[s]) for s in FUNNEL], "stage string, documents bigint")
