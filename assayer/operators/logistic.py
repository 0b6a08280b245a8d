"""Text classifier: logistic regression over hashed words, fitted on all labelled rows by gradients that combine before they leave the executors."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer.operators.classifiers import TOKENS
from assayer.session import cut_lineage

WIDTH, PENALTY, ROUNDS, MEMORY = 1 << 15, 1e-3, 25, 8


class TextModel(NamedTuple):
    """Weight of every hashed word; the last one stands for no word and is in every text."""

    weights: np.ndarray

    @property
    def width(self) -> int:
        return len(self.weights) - 1


def hashed_words(rows: DataFrame, *keep: str, width: int = WIDTH, text: str = "text") -> DataFrame:
    """``keep`` and ``slots``: distinct hashed words and runs of marks of a text; a null text has none."""
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TOKENS), F.lit(0)))
    return rows.select(*keep, F.array_distinct(F.transform(tokens, lambda w: F.pmod(F.xxhash64(w), F.lit(width)).cast("int"))).alias("slots"))


def _flat(slots) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and slot of every word of a batch and the value of each row's words, one over the root of their number."""
    slots = slots.combine_chunks() if isinstance(slots, pa.ChunkedArray) else slots
    sizes = np.diff(slots.offsets.to_numpy())
    return np.repeat(np.arange(len(sizes)), sizes), slots.flatten().to_numpy(zero_copy_only=False), 1 / np.sqrt(np.maximum(sizes, 1))


def margins(slots, weights: np.ndarray) -> np.ndarray:
    rows, at, value = _flat(slots)
    return np.bincount(rows, weights=weights[at], minlength=len(value)) * value + weights[-1]


def loss_and_gradient(slots, labels: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed logistic loss of a batch and its gradient."""
    rows, at, value = _flat(slots)
    z = margins(slots, weights)
    signed = np.where(labels > 0, z, -z)
    error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels
    gradient = np.bincount(at, weights=(error * value)[rows], minlength=len(weights))
    gradient[-1] = error.sum()
    return float(np.logaddexp(0, -signed).sum()), gradient


def _total(training: DataFrame, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Loss and gradient over all rows. A task sends its nonzero sums, which combine by slot: what the driver gets is one row a slot."""
    held = training.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, gradient = 0.0, np.zeros(len(held.value))
        for batch in batches:
            if batch.num_rows:
                more, part = loss_and_gradient(batch.column("slots"), batch.column("label").to_numpy().astype(np.float64), held.value)
                loss, gradient = loss + more, gradient + part
        at = np.flatnonzero(gradient)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(gradient[at], loss))], ["slot", "sum"])

    out, loss = np.zeros(len(weights)), 0.0
    for row in training.mapInArrow(run, "slot bigint, sum double").groupBy("slot").agg(F.sum("sum").alias("sum")).toLocalIterator():
        if row.slot < 0:
            loss = row.sum
        else:
            out[row.slot] = row.sum
    held.unpersist()
    return loss, out


def minimise(function, start: np.ndarray, rounds: int = ROUNDS, memory: int = MEMORY) -> np.ndarray:
    """Limited-memory quasi-Newton steps with halving of a step that does not lower the value enough."""
    x, (value, gradient), steps = start, function(start), []
    for _ in range(rounds):
        direction, alphas = gradient.copy(), []
        for s, y in reversed(steps):
            alphas.append(s @ direction / (y @ s))
            direction -= alphas[-1] * y
        if steps:
            s, y = steps[-1]
            direction *= s @ y / (y @ y)
        for (s, y), a in zip(steps, reversed(alphas)):
            direction += s * (a - y @ direction / (y @ s))
        slope, size = -gradient @ direction, 1.0 if steps else 1.0 / max(np.linalg.norm(gradient), 1e-12)
        if -slope < 1e-12:
            break
        for _ in range(12):
            new = x - size * direction
            new_value, new_gradient = function(new)
            if new_value <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        if (new - x) @ (new_gradient - gradient) > 1e-12:
            steps = [*steps, (new - x, new_gradient - gradient)][-memory:]
        done = value - new_value < 1e-7 * max(abs(value), 1)
        x, value, gradient = new, new_value, new_gradient
        if done:
            break
    return x


def fit_text_model(docs: DataFrame, labels: DataFrame, label: str, width: int = WIDTH, penalty: float = PENALTY, rounds: int = ROUNDS) -> TextModel:
    """Model of a 0/1 label from all labelled documents (``doc_id, text``; ``doc_id`` and the label).

    The loss is the mean logistic loss plus ``penalty / 2`` times the squared weights. Words of the labelled texts are hashed once and kept
    in the shared folder; a round is one pass over them. Without labelled rows all weights are 0.
    """
    known = labels.where(F.col(label).isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label"))
    training = cut_lineage(hashed_words(docs, "doc_id", width=width).join(known, F.col("doc_id") == F.col("_id")).select("label", "slots"))
    count = training.count()
    if not count:
        return TextModel(np.zeros(width + 1))

    def function(weights: np.ndarray) -> tuple[float, np.ndarray]:
        loss, gradient = _total(training, weights)
        ridge = np.append(weights[:-1], 0.0)
        return loss / count + penalty / 2 * float(ridge @ ridge), gradient / count + penalty * ridge

    return TextModel(minimise(function, np.zeros(width + 1), rounds))


def score_text(docs: DataFrame, model: TextModel, *keep: str) -> DataFrame:
    """``keep`` (``doc_id`` by default) and ``score``, the probability of label 1, of every document. The weights reach a worker once."""
    held = docs.sparkSession.sparkContext.broadcast(model.weights)

    @F.pandas_udf("double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            z = margins(pa.array(batch, pa.list_(pa.int32())), held.value)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    return hashed_words(docs, *(keep or ("doc_id",)), width=model.width).withColumn("score", predict("slots")).drop("slots")


def save_model(spark: SparkSession, model: TextModel, path: str) -> None:
    """One row with the weights and the sizes that belong to them; an existing model is not replaced, so a path is a version."""
    spark.createDataFrame([(json.dumps({"width": model.width}), model.weights.tolist())], "about string, weights array<double>").coalesce(1).write.parquet(path)


def load_model(spark: SparkSession, path: str) -> TextModel:
    row = spark.read.parquet(path).first()
    weights = np.array(row.weights)
    if json.loads(row.about)["width"] != len(weights) - 1:
        raise ValueError(f"{path} is not a whole model")
    return TextModel(weights)
