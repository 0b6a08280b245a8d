"""Text quality by a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayer.llm.arrays import LOWER, byte_values, flat, prefix_hashes, slices, span_hashes, word_spans
from assayer.llm.sampling import bounded_sample

PER_CLASS, LONGEST, BINS, STEPS, RIDGE = 1500, 8_000, 8, 250, 1e-3

# Byte classes whose shares describe a line; a byte may belong to several.
_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b",;:", b".?", b"!", b"|", b"#$%&*+=<>@^_~{}[]\\/", b"'\"()-"]
FEATURES = ["length", "lower", "upper", "digits", "blanks", "commas", "stops", "calls", "bars", "symbols", "quotes", "foreign", "word_length", "short_words", "distinct_words", "fresh_words", "repeated", "lines", "fresh_text"]


def _table() -> np.ndarray:
    table = np.zeros((len(_CLASSES) + 1, 256), dtype=bool)
    for k, members in enumerate(_CLASSES):
        table[k, np.frombuffer(members, dtype=np.uint8)] = True
    table[-1, 128:] = True
    return table


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line that holds a byte besides blanks, its row and its length in bytes."""
    if not len(data):
        return np.zeros((0, len(FEATURES))), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    edge[np.flatnonzero(data == 10) + 1] = True
    starts = np.flatnonzero(edge[:-1])
    size = np.diff(np.append(starts, len(data)))
    size = size - (data[starts + size - 1] == 10)
    full = np.concatenate([[0], np.cumsum((data != 32) & (data != 10) & (data != 13) & (data != 9))])
    keep = full[starts + size] > full[starts]
    starts, size = starts[keep], size[keep]
    if not len(starts):
        return np.zeros((0, len(FEATURES))), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    row = np.searchsorted(offsets, starts, "right") - 1
    columns = [np.log1p(size)]
    for members in _table():
        sums = np.concatenate([[0], np.cumsum(members[data], dtype=np.int32)])
        columns.append((sums[starts + size] - sums[starts]) / size)
    lowered = LOWER[data]
    sums = prefix_hashes(byte_values(lowered))
    word, word_end, word_row = word_spans(lowered, offsets)
    line = np.searchsorted(starts, word, "right") - 1
    hashes = span_hashes(sums, word, word_end)
    n = len(starts)
    words = np.bincount(line, minlength=n)
    least = np.maximum(words, 1)
    order = np.lexsort((word, hashes, word_row))
    again = np.zeros(len(word), dtype=bool)
    same = (hashes[order][1:] == hashes[order][:-1]) & (word_row[order][1:] == word_row[order][:-1])
    again[order[1:]] = same
    in_line = np.zeros(len(word), dtype=bool)
    in_line[order[1:]] = same & (line[order][1:] == line[order][:-1])
    columns += [np.bincount(line, weights=word_end - word, minlength=n) / least, np.bincount(line, weights=word_end - word <= 2, minlength=n) / least,
                1 - np.bincount(line, weights=in_line, minlength=n) / least, 1 - np.bincount(line, weights=again, minlength=n) / least]
    whole = span_hashes(sums, starts, starts + size)
    order = np.lexsort((whole, row))
    new = np.concatenate([[True], (whole[order][1:] != whole[order][:-1]) | (row[order][1:] != row[order][:-1])])
    copies = np.diff(np.append(np.flatnonzero(new), n))
    repeated = np.empty(n)
    repeated[order] = np.repeat(copies, copies) > 1
    rows = len(offsets) - 1
    per_row, fresh = np.bincount(row, minlength=rows), np.bincount(word_row, weights=~again, minlength=rows) / np.maximum(np.bincount(word_row, minlength=rows), 1)
    columns += [repeated, np.log1p(per_row)[row], fresh[row]]
    return np.stack(columns, axis=1), row, size


def _codes(features: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin of every feature, numbered over all features."""
    return np.stack([np.searchsorted(cuts[k], features[:, k], "right") + k * BINS for k in range(features.shape[1])], axis=1) if len(features) else np.zeros((0, len(cuts)), dtype=np.int64)


def _unary(codes: np.ndarray, row: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Score of a good against a bad line from its own bins and those of its neighbours; weights: (own, previous, next) by bin, then the bias."""
    own, before, after = (w[codes].sum(axis=1) for w in weights[:-1].reshape(3, -1))
    same = row[1:] == row[:-1]
    score = own + weights[-1]
    score[1:] += np.where(same, before[:-1], 0.0)
    score[:-1] += np.where(same, after[1:], 0.0)
    return score


def marginals(score: np.ndarray, row: np.ndarray, n_rows: int, stay: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over all texts side by side: probability of good per line, expected pairs (2, 2) and log partition of every row.

    ``stay`` holds the transition scores, by (previous, next) label.
    """
    counts = np.bincount(row, minlength=n_rows)
    first = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    move = np.exp(stay)
    base = np.stack([np.zeros(len(score)), score], axis=1)
    high = base.max(axis=1, keepdims=True)
    own = np.exp(base - high)
    ahead, behind, scale = np.zeros((len(score), 2)), np.zeros((len(score), 2)), np.ones(len(score))
    longest, sizes = int(counts.max(initial=0)), counts[order]
    live = [order[:np.searchsorted(-sizes, -t, "left")] for t in range(longest)]
    for t in range(longest):
        at = first[live[t]] + t
        value = own[at] if t == 0 else (ahead[at - 1] @ move) * own[at]
        scale[at] = value.sum(axis=1)
        ahead[at] = value / scale[at, None]
    for t in range(longest - 1, -1, -1):
        rows = live[t]
        at = first[rows] + t
        last = counts[rows] == t + 1
        behind[at[last]] = 1.0
        rest = at[~last]
        behind[rest] = ((own[rest + 1] * behind[rest + 1]) @ move.T) / scale[rest + 1, None]
    both = ahead * behind
    good = both[:, 1] / np.maximum(both.sum(axis=1), 1e-300)
    inner = np.flatnonzero(row[1:] == row[:-1])
    pairs = ahead[inner, :, None] * move * (own[inner + 1] * behind[inner + 1] / scale[inner + 1, None])[:, None, :]
    return good, pairs, np.bincount(row, weights=np.log(scale) + high[:, 0], minlength=n_rows)


def field_fit(codes: np.ndarray, row: np.ndarray, labels: np.ndarray, weights: np.ndarray, width: int, steps: int, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Bin weights and transition scores by Adam on the conditional likelihood; every line of a training text carries the text's label."""
    theta, stay = np.zeros(3 * width + 1), np.zeros((2, 2))
    m, v = np.zeros(len(theta) + 4), np.zeros(len(theta) + 4)
    share = (weights / weights.sum() / np.maximum(np.bincount(row, minlength=len(labels)), 1))[row]
    same = row[1:] == row[:-1]
    truth = labels[row].astype(np.float64)
    inner = np.flatnonzero(same)
    observed = np.zeros((2, 2))
    np.add.at(observed, (labels[row[inner]], labels[row[inner]]), share[inner])
    for step in range(1, steps + 1):
        good, pairs, _ = marginals(_unary(codes, row, theta), row, len(labels), stay)
        slope = (good - truth) * share
        before, after = np.append(np.where(same, slope[1:], 0.0), 0.0), np.concatenate([[0.0], np.where(same, slope[:-1], 0.0)])
        grad = [np.bincount(codes.reshape(-1), weights=np.repeat(g, codes.shape[1]), minlength=width) for g in (slope, before, after)]
        g = np.concatenate([*grad, [slope.sum()], ((pairs * share[inner, None, None]).sum(axis=0) - observed).reshape(-1)])
        g[:-4] += ridge * theta / width
        g[-4:] += ridge * stay.reshape(-1)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)
        theta, stay = theta - move[:-4], stay - move[-4:].reshape(2, 2)
    return theta, stay


def fit_quality(completions: DataFrame, verdicts: DataFrame, per_class: int = PER_CLASS, longest: int = LONGEST, steps: int = STEPS, ridge: float = RIDGE) -> dict | None:
    """Line model from ``id, text`` and ``id, label`` (1 for good texts), or None where a label is missing.

    Learns from at most ``per_class`` rows of each label in one task that holds this bounded sample; classes weigh as in the whole table.
    """
    sample, totals = bounded_sample(completions, verdicts, per_class, longest)
    if not totals.get(0) or not totals.get(1):
        return None
    sample = sample.select("text", "label")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, rows, labels, base = [], [], [], 0
        for part in slices(batches, "text"):
            values, row, _ = line_features(*flat(part.column(0)))
            features.append(values)
            rows.append(row + base)
            labels.append(part.column(1).to_numpy().astype(np.int64))
            base += part.num_rows
        values, row, label = np.concatenate(features), np.concatenate(rows), np.concatenate(labels)
        cuts = [np.unique(np.quantile(values[:, k], np.arange(1, BINS) / BINS)) for k in range(values.shape[1])]
        share = {y: totals[y] / max((label == y).sum(), 1) for y in (0, 1)}
        theta, stay = field_fit(_codes(values, cuts), row, label, np.where(label == 1, share[1], share[0]), BINS * values.shape[1], steps, ridge)
        yield pa.RecordBatch.from_pydict({"cuts": pa.array([[c.tolist() for c in cuts]], pa.list_(pa.list_(pa.float64()))), "theta": pa.array([theta.tolist()], pa.list_(pa.float64())),
                                          "stay": pa.array([stay.reshape(-1).tolist()], pa.list_(pa.float64()))})

    found = sample.coalesce(1).mapInArrow(fit, "cuts array<array<double>>, theta array<double>, stay array<double>").first()
    return {"cuts": [np.array(c) for c in found.cuts], "theta": np.array(found.theta), "stay": np.array(found.stay).reshape(2, 2), "prior": totals[1] / (totals[0] + totals[1])}


def score_quality(completions: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """Quality of completion texts from the marginals of their lines.

    ``completions`` holds ``id`` and ``text``; further columns are ignored. Returns ``id, score, n_lines, bad_lines``: the mean probability of
    good over the lines, weighted by their length in bytes, the number of lines that are not blank, and of those more likely bad.

    Null, empty and blank texts have no lines and get the share of good texts in training (0.5 without a model); texts are read whole;
    repeated rows get equal scores; an empty table gives an empty result.
    """
    held = completions.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for part in slices(batches, "text"):
            values, row, size = line_features(*flat(part.column(1)))
            n = part.num_rows
            good = marginals(_unary(_codes(values, known["cuts"]), row, known["theta"]), row, n, known["stay"])[0] if known else np.full(len(row), 0.5)
            length = np.bincount(row, weights=size, minlength=n)
            score = np.where(length > 0, np.bincount(row, weights=good * size, minlength=n) / np.maximum(length, 1), known["prior"] if known else 0.5)
            yield pa.RecordBatch.from_pydict({"id": part.column(0), "score": pa.array(np.clip(score, 0.0, 1.0)), "n_lines": pa.array(np.bincount(row, minlength=n)),
                                              "bad_lines": pa.array(np.bincount(row, weights=good < 0.5, minlength=n).astype(np.int64))})

    shape = f"id {completions.schema['id'].dataType.simpleString()}, score double, n_lines bigint, bad_lines bigint"
    return completions.select("id", F.col(text).alias("text")).mapInArrow(run, shape)
