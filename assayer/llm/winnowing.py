"""Benchmark decontamination by winnowed fingerprints, extended hits and exact word comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayer.llm.arrays import LOWER, byte_values, flat, mix, prefix_hashes, slices, span_hashes, word_spans
from assayer.llm.membership import bits_for, build_filter, maybe
from assayer.session import scratch_path

SPAN, GRAM = 10, 5
_SEEDS = "array<struct<size int, hash bigint, at int, first int, words array<string>>>"


def winnow(grams: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """Positions of the minimum (the rightmost of equals) of every window of ``width`` k-grams inside one row."""
    last = len(grams) - width + 1
    if last <= 0:
        return np.zeros(0, dtype=np.int64)
    best, at = grams[:last].copy(), np.arange(last)
    for step in range(1, width):
        other = grams[step:step + last]
        lower = other <= best
        best[lower] = other[lower]
        at[lower] = (np.arange(last) + step)[lower]
    return np.unique(at[rows[:last] == rows[width - 1:width - 1 + last]])


def _fingerprints(batch: pa.RecordBatch, span: int, gram: int, whole: bool, sizes: list[int], keep) -> tuple[np.ndarray, list[list[dict]]]:
    """Words per row and its seeds: winnowed k-grams with up to ``2 * span - gram`` words of context.

    ``whole`` takes rows of fewer than ``span`` words as one seed; ``sizes`` lists such short sizes to be looked for at every word.
    """
    data, offsets = flat(batch.column(1))
    data = LOWER[data]
    starts, ends, rows = word_spans(data, offsets)
    counts = np.bincount(rows, minlength=batch.num_rows)
    first = np.concatenate([[0], np.cumsum(counts)])
    sums = prefix_hashes(span_hashes(prefix_hashes(byte_values(data)), starts, ends))
    found: list[tuple[int, np.ndarray, np.ndarray]] = []

    def grams(size: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(max(len(starts) - size + 1, 0))
        return at, mix(span_hashes(sums, at, at + size) ^ np.uint64(size))

    at, hashes = grams(gram)
    inside = rows[at] == rows[at + gram - 1]
    at, hashes = at[inside], hashes[inside]
    chosen = winnow(hashes, rows[at], span - gram + 1)
    found.append((span, at[chosen], hashes[chosen]))
    for size in sizes:
        at, hashes = grams(size)
        inside = rows[at] == rows[at + size - 1]
        found.append((size, at[inside], hashes[inside]))
    if whole:
        for size in range(1, span):
            at = first[:-1][counts == size]
            found.append((size, at, mix(span_hashes(sums, at, at + size) ^ np.uint64(size))))
    seeds: list[list[dict]] = [[] for _ in range(batch.num_rows)]
    for size, at, hashes in found:
        if keep is not None:
            passed = keep(hashes)
            at, hashes = at[passed], hashes[passed]
        for word, h in zip(at.tolist(), hashes.view(np.int64).tolist()):
            row = rows[word]
            low = max(first[row], word - (span - gram)) if size == span else word
            high = min(first[row + 1], word + span) if size == span else word + size
            words = [data[starts[i]:ends[i]].tobytes().decode("utf-8", "replace") for i in range(low, high)]
            seeds[row].append({"size": size, "hash": h, "at": int(word - first[row]), "first": int(low - first[row]), "words": words})
    return counts, seeds


def _seeded(texts: DataFrame, span: int, gram: int, whole: bool, sizes: list[int], cells) -> DataFrame:
    kind, bits = texts.schema[0].dataType, cells.value[1] if cells is not None else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = None if cells is None else (lambda hashes: maybe(cells.value[0], bits, hashes))
        shape = pa.list_(pa.struct([("size", pa.int32()), ("hash", pa.int64()), ("at", pa.int32()), ("first", pa.int32()), ("words", pa.list_(pa.string()))]))
        for part in slices(batches, "text"):
            counts, seeds = _fingerprints(part, span, gram, whole, sizes, keep)
            yield pa.RecordBatch.from_pydict({"id": part.column(0), "n_words": pa.array(counts, pa.int64()), "seeds": pa.array(seeds, shape)})

    return texts.mapInArrow(run, f"id {kind.simpleString()}, n_words bigint, seeds {_SEEDS}")


def _extend(span: int):
    """Arrow function: the longest equal run through each seed pair, kept where it fills a window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, low, high = [], [], []
            columns = [batch.column(i).to_pylist() for i in range(2, 9)]
            for i, (size, at, first, words, its_at, its_first, its_words) in enumerate(zip(*columns)):
                a, b = at - first, its_at - its_first
                if words[a] != its_words[b]:
                    continue
                left = 0
                while left < min(a, b) and words[a - left - 1] == its_words[b - left - 1]:
                    left += 1
                right = 1
                while right < min(len(words) - a, len(its_words) - b) and words[a + right] == its_words[b + right]:
                    right += 1
                if left + right >= size:
                    keep.append(i)
                    low.append(at - left)
                    high.append(at + right)
            taken = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_pydict({"row": taken.column(0), "item": taken.column(1), "low": pa.array(low, pa.int32()), "high": pa.array(high, pa.int32())})
    return run


def contamination(puzzles: DataFrame, held_out: DataFrame, span: int = SPAN, gram: int = GRAM, text: str = "prompt") -> DataFrame:
    """Words of training prompts that stand inside passages of held-out prompts.

    ``puzzles`` and ``held_out`` hold ``id`` and the ``text`` column (by default ``prompt``); further columns are ignored, so clashing
    names cannot meet. Returns ``id, n_words, n_hit, items`` for every training row: the number of words, of words inside any occurrence
    of a window of ``span`` words (a shorter held-out text is one window), and the sorted distinct held-out ids with such windows.

    Winnowing keeps the smallest ``gram``-word hash of each ``span - gram + 1`` neighbouring ones on both sides, so two texts that share
    ``span`` words share a fingerprint of that span. A fixed-size filter of held-out fingerprints drops the others where they arise; the
    join, the extension over the seed's neighbouring words and the comparison of the words themselves are exact.

    Null and wordless texts have no words and no hits; a repeated held-out text counts once per id; every training row
    gets the figures of its own text, also where ids repeat or are null; empty tables give empty or clean results.
    """
    spark = puzzles.sparkSession
    held = held_out.select("id", F.col(text).alias("text"))
    item_seeds = (_seeded(held, span, gram, True, [], None).select(F.col("id").alias("item"), F.explode("seeds").alias("s"))
                  .select("item", "s.size", "s.hash", F.col("s.at").alias("its_at"), F.col("s.first").alias("its_first"), F.col("s.words").alias("its_words")))
    stored = scratch_path(spark, "held-out")
    item_seeds.write.parquet(stored)
    item_seeds = spark.read.parquet(stored)
    bits = bits_for(item_seeds.count(), most=26)
    sizes = [r.size for r in item_seeds.where(F.col("size") < span).select("size").distinct().collect()]
    cells = spark.sparkContext.broadcast((build_filter(item_seeds.select("hash"), bits), bits))
    seeded = scratch_path(spark, "seeds")
    _seeded(puzzles.select("id", F.col(text).alias("text")), span, gram, False, sizes, cells).withColumn("row", F.monotonically_increasing_id()).write.parquet(seeded)
    rows = spark.read.parquet(seeded)
    # Hits belong to a row, not to an id: ids may repeat or be null. Row numbers are fixed by what was written.
    met = (rows.select("row", F.explode("seeds").alias("s")).select("row", "s.*").join(item_seeds, ["size", "hash"])
           .select("row", "item", "size", "at", "first", "words", "its_at", "its_first", "its_words"))
    types = f"row bigint, item {held_out.schema['id'].dataType.simpleString()}, low int, high int"
    hits = met.mapInArrow(_extend(span), types)
    # Overlapping runs are merged in order; the fold carries (end so far, words so far).
    merged = F.aggregate(F.sort_array("runs"), F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n")), lambda acc, r: F.struct(
        F.greatest(acc["end"], r["high"]).alias("end"), (acc["n"] + F.greatest(r["high"] - F.greatest(acc["end"], r["low"]), F.lit(0))).alias("n")))["n"]
    per_row = hits.groupBy("row").agg(F.collect_set(F.struct("low", "high")).alias("runs"), F.sort_array(F.collect_set("item")).alias("items"))
    per_row = per_row.select("row", merged.alias("n_hit"), "items")
    empty = F.array().cast(f"array<{held_out.schema['id'].dataType.simpleString()}>")
    return (rows.join(per_row, "row", "left")
            .select("id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("items", empty).alias("items")))
