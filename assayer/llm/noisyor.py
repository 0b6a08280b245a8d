"""Toxicity by multiple-instance learning: noisy-or over sentences, trained from labels of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayer.llm.arrays import LOWER, byte_values, flat, lists, prefix_hashes, slices, span_hashes, word_spans
from assayer.llm.sampling import bounded_sample

PER_CLASS, LONGEST, LEAST_TEXTS, SCREEN, STEPS, SPARSITY = 2500, 20_000, 4, 2.5, 400, 0.0005
PREFIXES = (4, 5, 6, 7, 8, 9)
_STOPS = np.zeros(256, dtype=bool)
_STOPS[np.frombuffer(b".!?\n", dtype=np.uint8)] = True


def sentence_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row and sentence of every word, its features (columns: the word, then its longer beginnings; 0 where there is none), and the byte spans and rows of sentences."""
    lowered = LOWER[data]
    starts, ends, rows = word_spans(lowered, offsets)
    sums = prefix_hashes(byte_values(lowered))
    features = np.zeros((len(starts), 1 + len(PREFIXES)), dtype=np.uint64)
    features[:, 0] = span_hashes(sums, starts, ends)
    for k, size in enumerate(PREFIXES, 1):
        longer = np.flatnonzero(ends - starts > size)
        features[longer, k] = span_hashes(sums, starts[longer], starts[longer] + size) ^ np.uint64(k)
    stops = np.cumsum(_STOPS[data]) if len(data) else np.zeros(0, dtype=np.int64)
    mark = stops[starts] if len(starts) else starts
    new = np.concatenate([[True], (mark[1:] != mark[:-1]) | (rows[1:] != rows[:-1])]) if len(starts) else np.zeros(0, dtype=bool)
    sentence = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1 if len(starts) else first
    return rows, sentence, features, starts[first], ends[last], rows[first]


def noisy_or_fit(words: np.ndarray, sentence: np.ndarray, text_of: np.ndarray, labels: np.ndarray, weights: np.ndarray, n_words: int, steps: int, sparsity: float) -> tuple[np.ndarray, float]:
    """Word weights and bias of the sentence model: proximal Adam on the noisy-or likelihood of the texts, with an L1 penalty on words.

    Only sentences with one of the words can be toxic, so that long texts do not gather toxicity by their number of sentences.
    """
    n_sentences, n_texts = len(text_of), len(labels)
    evident = np.bincount(sentence, minlength=n_sentences) > 0
    w, bias = np.zeros(n_words), -5.0
    m, v, mb, vb = np.zeros(n_words), np.zeros(n_words), 0.0, 0.0
    share = weights / weights.sum()
    for step in range(1, steps + 1):
        score = bias + np.bincount(sentence, weights=w[words], minlength=n_sentences)
        p = evident / (1 + np.exp(-np.clip(score, -30, 30)))
        clean = np.bincount(text_of, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n_texts)
        toxic = -np.expm1(clean)
        # Derivative of the loss by each sentence score: p for clean texts, -p (1 - P) / P for toxic ones.
        slope = np.where(labels[text_of] == 1, -p * np.exp(clean)[text_of] / np.maximum(toxic[text_of], 1e-3), p) * share[text_of]
        g, gb = np.bincount(words, weights=slope[sentence], minlength=n_words), slope.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.15 / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-4)
        w = w - rate * m / (1 - 0.9 ** step)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * sparsity, 0.0)
        bias -= 0.15 * (mb / (1 - 0.9 ** step)) / (np.sqrt(vb / (1 - 0.99 ** step)) + 1e-4)
    return w, float(bias)


def fit_toxicity(completions: DataFrame, flags: DataFrame, per_class: int = PER_CLASS, longest: int = LONGEST, least_texts: int = LEAST_TEXTS, screen: float = SCREEN, steps: int = STEPS, sparsity: float = SPARSITY) -> dict[int, float]:
    """Sentence model from ``id, text`` and ``id, label`` (1 for toxic texts): hash of a word or word beginning to weight, and the bias under 0.

    Learns from at most ``per_class`` rows of each label, in one task that holds this bounded sample; classes weigh as in the whole table.
    Features of fewer than ``least_texts`` texts, or whose share of toxic and of clean texts differs by less than ``screen`` standard
    errors, are left out. Without rows of both labels the model finds nothing toxic.
    """
    sample, totals = bounded_sample(completions, flags, per_class, longest)
    if not totals.get(0) or not totals.get(1):
        return {0: -30.0}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows, sentence, features, _, _, sentence_row = sentence_words(*flat(part.column(1)))
            first = np.searchsorted(sentence_row, np.arange(part.num_rows))
            counts = np.bincount(rows, minlength=part.num_rows)
            yield pa.RecordBatch.from_pydict({"label": part.column(2), "sentences": lists(pa.array((sentence - first[rows]).astype(np.int32)), counts),
                                              **{f"f{k}": lists(pa.array(features[:, k].copy().view(np.int64)), counts) for k in range(features.shape[1])}})

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([b for b in batches if b.num_rows]).combine_chunks()
        labels = table.column("label").to_numpy().astype(np.int64)
        text = np.repeat(np.arange(len(labels)), pa.compute.list_value_length(table.column("sentences")).to_numpy())
        own = text * (1 << 32) + table.column("sentences").combine_chunks().flatten().to_numpy()
        sentence_keys, sentence = np.unique(own, return_inverse=True)
        kept_keys, kept_pairs = [], []
        for k in range(1 + len(PREFIXES)):
            values = table.column(f"f{k}").combine_chunks().flatten().to_numpy().view(np.uint64)
            keys, code = np.unique(values, return_inverse=True)
            seen = np.unique(code * len(labels) + text)
            toxic, clean = (np.bincount(seen[labels[seen % len(labels)] == y] // len(labels), minlength=len(keys)) for y in (1, 0))
            # Features whose share among toxic and clean texts differs by more than chance.
            n = np.array([(labels == 1).sum(), (labels == 0).sum()])
            pooled = (toxic + clean + 1) / (n.sum() + 2)
            z = (toxic / n[0] - clean / n[1]) / np.sqrt(pooled * (1 - pooled) * (1 / n[0] + 1 / n[1]) + 1e-12)
            good = (toxic + clean >= least_texts) & (np.abs(z) >= screen) & (keys > 0)
            number = np.cumsum(good) - 1 + sum(map(len, kept_keys))
            inside = good[code]
            kept_keys.append(keys[good])
            kept_pairs.append(np.stack([sentence[inside], number[code[inside]]]))
        keys, pairs = np.concatenate(kept_keys), np.concatenate(kept_pairs, axis=1)
        width = max(len(keys), 1)
        once = np.unique(pairs[0] * width + pairs[1])
        share = {y: totals[y] / max((labels == y).sum(), 1) for y in (0, 1)}
        w, bias = noisy_or_fit(once % width, once // width, sentence_keys >> 32, labels, np.where(labels == 1, share[1], share[0]), width, steps, sparsity)
        used = np.flatnonzero(w[:len(keys)])
        yield pa.RecordBatch.from_pydict({"word": pa.array(np.append(keys[used].view(np.int64), 0)), "weight": pa.array(np.append(w[used], bias))})

    encoded = sample.mapInArrow(encode, "label int, sentences array<int>, " + ", ".join(f"f{k} array<bigint>" for k in range(1 + len(PREFIXES))))
    return {r.word: r.weight for r in encoded.coalesce(1).mapInArrow(fit, "word bigint, weight double").collect()}


def score_toxicity(completions: DataFrame, model: dict[int, float], offending: float = 0.5, text: str = "text") -> DataFrame:
    """Toxicity of completion texts and the sentences behind it.

    ``completions`` holds ``id`` and ``text``; further columns are ignored. Returns ``id, score, sentences``: the noisy-or of the sentence
    probabilities, between 0 and 1, and ``start, end, score`` (bytes) of every sentence of probability ``offending`` or more. A sentence ends at
    ``. ! ?`` or a line feed; its probability is logistic in the weights of its distinct words and their beginnings, and 0 where none of them speaks for toxicity.

    Null, empty and wordless texts have no sentences and score 0; texts are read whole; repeated rows get equal scores; an empty table gives
    an empty result.
    """
    bias = model.get(0, -30.0)
    keys = np.array(sorted(k for k in model if k), dtype=np.int64)
    held = completions.sparkSession.sparkContext.broadcast((keys.view(np.uint64)[np.argsort(keys.view(np.uint64))], np.array([model[k] for k in keys[np.argsort(keys.view(np.uint64))].tolist()])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight = held.value
        near = np.zeros(1 << 16, dtype=bool)
        near[(known & np.uint64(0xFFFF)).astype(np.int64)] = True
        for part in slices(batches, "text"):
            data, offsets = flat(part.column(1))
            _, sentence, features, start, end, row = sentence_words(data, offsets)
            met, which = np.nonzero(near[(features & np.uint64(0xFFFF)).astype(np.int64)])
            values = features[met, which]
            at = np.minimum(np.searchsorted(known, values), max(len(known) - 1, 0))
            hit = known[at] == values if len(known) else np.zeros(len(met), dtype=bool)
            width = max(len(known), 1)
            once = np.unique(sentence[met[hit]] * width + at[hit])
            score = bias + np.bincount(once // width, weights=weight[once % width] if len(known) else None, minlength=len(start))
            evident = np.bincount(once // width, weights=weight[once % width] > 0 if len(known) else None, minlength=len(start)) > 0
            p = evident / (1 + np.exp(-np.clip(score, -30, 30)))
            total = -np.expm1(np.bincount(row, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=part.num_rows))
            bad = np.flatnonzero(p >= offending)
            spans = pa.StructArray.from_arrays([pa.array(start[bad] - offsets[row[bad]]), pa.array(end[bad] - offsets[row[bad]]), pa.array(p[bad])], ["start", "end", "score"])
            yield pa.RecordBatch.from_pydict({"id": part.column(0), "score": pa.array(np.abs(np.clip(total, 0.0, 1.0))), "sentences": lists(spans, np.bincount(row[bad], minlength=part.num_rows))})

    shape = f"id {completions.schema['id'].dataType.simpleString()}, score double, sentences array<struct<start bigint, end bigint, score double>>"
    return completions.select("id", F.col(text).alias("text")).mapInArrow(run, shape)
