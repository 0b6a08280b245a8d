"""Learned quality and toxicity scores, and batch inference."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


# Words, and runs of marks, which tell layouts and noise apart.
TOKENS = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"


def word_scores(docs: DataFrame, labels: DataFrame, label: str, fewest: int = 5, errors: float = 3.0) -> DataFrame:
    """``doc_id, score``: probability of a label from the distinct words of a text, in closed form, for every document.

    A word weighs the logarithm of its smoothed share of labelled texts in the class against the other class; words of
    fewer than ``fewest`` labelled texts, or whose shares differ by less than ``errors`` standard errors, do not count. All counts are combinable aggregates over the whole table; texts
    without a known word, and null texts, get the share of the class.
    """
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(TOKENS), F.lit(0)))
    listed = docs.select("doc_id", tokens.alias("words"))
    known = labels.where(F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    totals = docs.select("doc_id").join(known, "doc_id").agg(F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") == 0).alias("n0"))
    counted = (listed.join(known, "doc_id").select(F.explode("words").alias("word"), "label").groupBy("word")
               .agg(F.count_if(F.col("label") == 1).alias("c1"), F.count_if(F.col("label") == 0).alias("c0")).where(F.col("c1") + F.col("c0") >= fewest))
    # One row of totals, so the nested-loop join holds nothing else.
    pooled = (F.col("c1") + F.col("c0")) / (F.col("n1") + F.col("n0"))
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("n1") + 1 / F.col("n0")))
    telling = counted.join(F.broadcast(totals)).where((F.col("n1") > 0) & (F.col("n0") > 0) & (F.abs(F.col("c1") / F.col("n1") - F.col("c0") / F.col("n0")) >= errors * error))
    weighed = telling.select("word", (F.log((F.col("c1") + 1) / (F.col("n1") + 2)) - F.log((F.col("c0") + 1) / (F.col("n0") + 2))).alias("weight"))
    sums = listed.select("doc_id", F.explode("words").alias("word")).join(weighed, "word").groupBy("doc_id").agg(F.sum("weight").alias("weight"))
    prior = F.log((F.col("n1") + 1) / (F.col("n0") + 1))
    scored = docs.select("doc_id").join(sums, "doc_id", "left").join(F.broadcast(totals))
    return scored.select("doc_id", (1 / (1 + F.exp(-(F.coalesce("weight", F.lit(0.0)) + prior)))).alias("score"))


def text_scores(docs: DataFrame, labels: DataFrame, label: str, features: int = 1 << 14) -> DataFrame:
    """``doc_id, score`` from hashed word counts and logistic regression: the fitted option beside ``word_scores``."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    tokens = RegexTokenizer(inputCol="text", outputCol="tokens", pattern=r"[^\p{L}\p{N}]+", toLowercase=True)
    hashed = HashingTF(inputCol="tokens", outputCol="features", numFeatures=features)
    prepared = hashed.transform(tokens.transform(docs.select("doc_id", "text"))).select("doc_id", "features")
    training = prepared.join(labels.select("doc_id", F.col(label).cast("double").alias("label")), "doc_id")
    model = LogisticRegression(maxIter=20, regParam=0.01).fit(training)
    return model.transform(prepared).select("doc_id", F.get(vector_to_array("probability"), F.lit(1)).alias("score"))


def quality_classifier(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    return word_scores(docs, labels, "quality").where(F.col("score") > threshold)


def toxicity_filter(docs: DataFrame, labels: DataFrame, threshold: float = 0.9) -> DataFrame:
    return word_scores(docs, labels, "toxic").where(F.col("score") < threshold)


def batch_inference(build: Callable[[], Callable[[pd.Series], pd.Series]]) -> Callable[[Column], Column]:
    """Arrow function around a model built once per worker process and applied to every batch of its partition."""

    @F.pandas_udf("double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = build()
        for batch in batches:
            yield model(batch)

    return predict


def map_batches(rows: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Vectorised transform of Arrow batches."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch)

    return rows.mapInPandas(run, schema)
