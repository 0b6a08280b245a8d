"""Phrases whose words stand together far more often than apart, from sorted count streams.

Words are counted first, then the pairs of words that may be frequent, then the triples of pairs that may be; "may be" is a filter of
fixed size without false refusals, so every count of a frequent phrase is whole. The counts of frequent phrases are then laid out twice,
in prefix order (``w1 w2 w3``) and in suffix order (``w3 w2 w1``). A header of a group - a single word, a pair - precedes its extensions in either order, so one pass over the
sorted stream hands every phrase the counts of its beginnings (ends) and every pair the largest count of its right (left) extensions.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.llm.arrays import LOWER, byte_values, flat, mix, prefix_hashes, slices, span_hashes
from assayer.llm.membership import bits_for, build_filter, maybe
from assayer.llm.stored import stored

LEAST, KEEP, SALTS, CHUNK = 10, 2000, 1024, 1 << 22
_ENDS_PIECE = np.zeros(256, dtype=bool)
_ENDS_PIECE[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_ENDS_WORD = _ENDS_PIECE.copy()
_ENDS_WORD[[32, 9]] = True
U = np.uint64


def mine_phrases(traces: DataFrame, group: str = "run", text: str = "text", least: int = LEAST, keep: int = KEEP, bits: int = 28) -> DataFrame:
    """The ``keep`` best phrases of every run: ``run, rank, phrase, a, l, r, n, score``.

    ``traces``: texts of model runs, ``run, text``; other columns are ignored. A-Z is lowered; ``.,;:!?`` and line ends (bytes 10-13) end a
    piece, blanks and tabs a word. A null text is empty, a null run is ``und``. ``n`` counts the words of the run, ``a`` the occurrences of
    the phrase (2 or 3 words, at least ``least``), ``l`` and ``r`` those of the two sides of its lowest-scoring cut, ``score`` is
    ``floor(10**6 * a * a / (l * r))``, exact below 10**16 occurrences. A pair inside a three-word phrase with half its count or more is
    dropped. Order: score and ``a`` descending, phrase ascending by bytes. Repeated rows count as often as they stand; a run with less than
    ``least`` occurrences of every phrase has no row. A text of any length is counted in chunks that end with a piece.
    The filters hold at most ``2**bits`` bits (32 MB); beyond some ten million frequent phrases a fuller one lets more be counted, at the same results.
    """
    rows = traces.select(F.coalesce(F.col(group).cast("string"), F.lit("und")).alias("run"), F.col(text).alias("text")).where("length(text) > 0")
    none, enough = F.lit(None).cast("string"), F.col("n") >= least
    words = stored(_counted(rows, 1, []), "words")
    known = [words.where(enough)]
    filters: list[tuple[np.ndarray, int]] = []
    for size, label in ((2, "pairs"), (3, "triples")):
        filters.append(_filter(known[-1], bits))
        known.append(stored(_counted(rows, size, filters).where(enough), label))
    columns = lambda size: ["run", *[F.col(f"w{i}") if i <= size else none.alias(f"w{i}") for i in (1, 2, 3)], "n"]
    frequent = known[0].select(*columns(1)).unionByName(known[1].select(*columns(2))).unionByName(known[2].select(*columns(3)))

    triple, pair = F.col("w3").isNotNull(), F.col("w2").isNotNull()
    ahead = _in_order(frequent, [F.col("w1"), F.col("w2"), F.col("w3")])
    behind = _in_order(frequent, [F.coalesce("w3", "w2", "w1"), F.when(triple, F.col("w2")).when(pair, F.col("w1")), F.when(triple, F.col("w1"))])
    begins = ahead.select("run", F.col("k1").alias("w1"), F.col("k2").alias("w2"), F.col("k3").alias("w3"), "n", F.col("one").alias("l1"), F.col("two").alias("l2"))
    three = F.col("k3").isNotNull()
    ends = behind.select("run", F.when(three, F.col("k3")).otherwise(F.col("k2")).alias("w1"), F.when(three, F.col("k2")).otherwise(F.col("k1")).alias("w2"),
                         F.when(three, F.col("k1")).alias("w3"), F.col("one").alias("r1"), F.col("two").alias("r2"))
    right, left = ahead.where(three).select("run", F.col("k1").alias("w1"), F.col("k2").alias("w2"), F.col("n").alias("more")), behind.where(three).select("run", F.col("k2").alias("w1"), F.col("k1").alias("w2"), F.col("n").alias("more"))
    parts = [begins, ends, right.withColumn("w3", none), left.withColumn("w3", none)]
    union = functools.reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    counts = union.groupBy("run", "w1", "w2", "w3").agg(*[F.max(c).alias(c) for c in ("n", "l1", "l2", "r1", "r2", "more")])

    # Cut after the first word: l1 and, of a triple, the pair r2; cut after the second: the pair l2 and r1.
    early, late = _score("n", "l1", "coalesce(r2, r1)"), F.when(triple, _score("n", "l2", "r1"))
    scored = counts.where(triple | F.col("more").isNull() | (100 * F.col("more") < 50 * F.col("n"))).withColumn("early", early).withColumn("late", late)
    second = F.coalesce(F.col("late") < F.col("early"), F.lit(False))
    listed = scored.select("run", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("n").alias("a"), F.when(second, F.col("l2")).otherwise(F.col("l1")).alias("l"),
                           F.when(second, F.col("r1")).otherwise(F.coalesce("r2", "r1")).alias("r"), F.when(second, F.col("late")).otherwise(F.col("early")).alias("score"))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = listed.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    # The best of every salt are a bounded list per run; only they are ranked together.
    front = salted.withColumn("nth", F.row_number().over(Window.partitionBy("run", "salt").orderBy(*best))).where(F.col("nth") <= keep)
    ranked = front.withColumn("rank", F.row_number().over(Window.partitionBy("run").orderBy(*best)).cast("bigint")).where(F.col("rank") <= keep)
    total = words.groupBy(F.col("run").alias("_run")).agg(F.sum("n").alias("n"))
    return ranked.join(total, F.col("run") == F.col("_run")).select("run", "rank", "phrase", "a", "l", "r", "n", "score")


def _score(a: str, left: str, right: str) -> Column:
    wide = lambda c: f"cast({c} as decimal(19,0))"
    return F.expr(f"(cast(1000000 as decimal(7,0)) * ({wide(a)} * {wide(a)})) div ({wide(left)} * {wide(right)})")


def _filter(frequent: DataFrame, most: int) -> tuple[np.ndarray, int]:
    """Filter of the hashes of frequent phrases and its size in bits, at most ``2**most``: a fuller one only lets more be counted."""
    bits = bits_for(frequent.count(), most)
    return build_filter(frequent.select("h"), bits), bits


def _counted(rows: DataFrame, size: int, filters: list[tuple[np.ndarray, int]]) -> DataFrame:
    """``run, w1.., n, h``: phrases of ``size`` words all of whose parts of one word less may be frequent, and a hash of each."""
    held = rows.sparkSession.sparkContext.broadcast(filters[-1] if filters else None)
    names = [f"w{i + 1}" for i in range(size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK, CHUNK):
            runs = batch.column("run").dictionary_encode()
            code, labels = runs.indices.to_numpy(zero_copy_only=False).astype(np.int64), runs.dictionary.cast(pa.string())
            salt = _hashes(labels)
            data, offsets = flat(batch.column("text"))
            for low, high in _chunks(data, offsets):
                yield from _phrases(LOWER[data[low:high]], np.clip(offsets - low, 0, high - low), code, labels, salt, names, held.value)

    parts = rows.mapInArrow(run, ", ".join(["run string", *[f"{n} string" for n in names], "n bigint", "h bigint"]))
    return parts.groupBy("run", *names).agg(F.sum("n").alias("n"), F.max("h").alias("h"))


def _hashes(words: pa.Array) -> np.ndarray:
    data, offsets = flat(words)
    return span_hashes(prefix_hashes(byte_values(data)), offsets[:-1], offsets[1:])


def _chunks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of ``CHUNK`` or a little more that end with a row or right after the end of a piece."""
    low, step = 0, 1 << 16
    while low < len(data):
        high = min(low + CHUNK, len(data))
        while high < len(data):
            row, stops = int(offsets[np.searchsorted(offsets, high)]), np.flatnonzero(_ENDS_PIECE[data[high - 1:high - 1 + step]])
            cut = min(row, high + int(stops[0])) if len(stops) else row
            high = min(cut, high + step)
            if high == cut:
                break
        yield low, high
        low = high


def _phrases(data: np.ndarray, offsets: np.ndarray, code: np.ndarray, labels: pa.Array, salt: np.ndarray, names: list[str], held) -> Iterator[pa.RecordBatch]:
    """Counted phrases of one chunk; a phrase never crosses the end of a piece or of a row."""
    inside = ~_ENDS_WORD[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    if not len(starts):
        return
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    places = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[inside]))).dictionary_encode()
    ids, vocabulary = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(words.dictionary)
    rows = (np.searchsorted(offsets, starts, "right") - 1).astype(np.int32)
    run = code[rows]
    # Hashes of the phrases of one word, two words and so on that begin at each word; a phrase is there if its words stand in one piece.
    own = mix(_hashes(words.dictionary)[ids] + salt[run])
    piece = np.searchsorted(np.flatnonzero(_ENDS_PIECE[data]), starts)
    joined = (piece[1:] == piece[:-1]) & (rows[1:] == rows[:-1])
    hashes, there = own, np.ones(len(starts), dtype=bool)
    for size in range(1, len(names)):
        fits = maybe(*held, hashes) if size == len(names) - 1 else np.ones(len(hashes), dtype=bool)
        there = there[:-1] & there[1:] & joined[:len(there) - 1] & fits[:-1] & fits[1:]
        hashes = mix(hashes[:-1] * U(3) + own[size:])
    at = np.flatnonzero(there)
    if not len(at):
        return
    key = ids[at]
    for i in range(1, len(names)):
        if i > 1:
            key = np.unique(key, return_inverse=True)[1]
        key = key * vocabulary + ids[at + i]
    key = np.unique(key, return_inverse=True)[1] * len(labels) + run[at]
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    dictionary = words.dictionary.cast(pa.string())
    for low in range(0, len(first), 1 << 16):
        chosen = at[first[low:low + (1 << 16)]]
        columns = [dictionary.take(pa.array(ids[chosen + i])) for i in range(len(names))]
        yield pa.RecordBatch.from_arrays([labels.take(pa.array(run[chosen])), *columns, pa.array(counts[low:low + (1 << 16)]), pa.array(hashes[chosen].view(np.int64))], ["run", *names, "n", "h"])


def _in_order(frequent: DataFrame, key: list[Column]) -> DataFrame:
    """Phrases of two and more words in the order of ``key``: ``run, k1, k2, k3, n`` and the counts of the headers above them, ``one`` (of k1)
    and ``two`` (of k1 k2, of triples).

    The order is dealt out by ranges, so a frequent word is spread over tasks. The headers that are open where a range begins are the last
    ones of the ranges before; they are laid in front of it, two rows a range, and one pass in order carries every header to its extensions.
    """
    order = ["run", "k1", "k2", "k3"]
    keyed = frequent.select("run", *[k.alias(f"k{i + 1}") for i, k in enumerate(key)], "n")
    laid = stored(keyed.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "count-stream")
    word, pair = F.col("k2").isNull(), F.col("k2").isNotNull() & F.col("k3").isNull()
    place = F.struct("run", "k1", "k2", "n")
    tails = laid.groupBy("part").agg(F.max(F.when(word, place)).alias("word"), F.max(F.when(pair, place)).alias("pair"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    opened = tails.select("part", F.max("word").over(before).alias("word"), F.max("pair").over(before).alias("pair"))
    opened = opened.select("part", F.explode(F.array("word", "pair")).alias("head")).where("head is not null")
    none = F.lit(None).cast("string")
    stream = laid.select("part", *order, "n").unionByName(opened.select("part", "head.run", "head.k1", "head.k2", none.alias("k3"), "head.n").select("part", *order, "n"))
    upto = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda header: F.last(F.when(header, place), ignorenulls=True).over(upto)
    merged = stream.withColumn("word", last(word)).withColumn("pair", last(pair)).where("k2 is not null")
    own = (F.col("word.run") == F.col("run")) & (F.col("word.k1") == F.col("k1"))
    same = (F.col("pair.run") == F.col("run")) & (F.col("pair.k1") == F.col("k1")) & (F.col("pair.k2") == F.col("k2")) & F.col("k3").isNotNull()
    return merged.select(*order, "n", F.when(own, F.col("word.n")).alias("one"), F.when(same, F.col("pair.n")).alias("two"))
