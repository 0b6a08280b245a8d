"""Packing of token sequences by minimum bin slack over the histogram of piece lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from assayer.llm.arrays import slices
from assayer.llm.tokens import WordEncoder
from assayer.session import scratch_path

LENGTH, END, RANKED = 2048, 0, 10_000


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The available lengths, with multiplicity, whose sum is largest without passing ``capacity``.

    A subset-sum table is kept as the bits of one integer: bit s is set when the sum s can be reached. Lengths enter from the longest down,
    their counts in powers of two; the search ends as soon as the capacity itself is reached.
    """
    reach, mask, steps = 1, (1 << (capacity + 1)) - 1, []
    for length in sorted((x for x, n in counts.items() if n > 0 and x <= capacity), reverse=True):
        left, block = min(counts[length], capacity // length), 1
        while left > 0 and not reach >> capacity & 1:
            block = min(block, left)
            steps.append((length, block, reach))
            reach = (reach | reach << (length * block)) & mask
            left -= block
            block *= 2
        if reach >> capacity & 1:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, block, before in reversed(steps):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + block
            total -= length * block
    return taken


def minimum_bin_slack(histogram: dict[int, int], capacity: int = LENGTH) -> list[tuple[dict[int, int], int]]:
    """Bins as ``(lengths with multiplicity, number of equal bins)`` that use up the histogram.

    Every bin starts with the longest remaining piece and takes the fullest combination of the others beside it. The same
    combination is repeated while the counts allow, and each repetition uses up a length, so the work depends on the number of distinct
    lengths (``capacity`` at most), not on the number of pieces.
    """
    counts, bins = {k: n for k, n in histogram.items() if n > 0}, []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        taken = fullest(counts, capacity - longest)
        counts[longest] += 1
        taken[longest] = taken.get(longest, 0) + 1
        times = min(counts[k] // n for k, n in taken.items())
        for k, n in taken.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        bins.append((taken, times))
    return bins


def pieces(chats: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """``id, piece, start, length, ids_crc32`` (and ``ids``): token pieces of whole texts, ``end`` closing each text; only longer texts are cut."""
    kind = chats.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer)
        for part in slices(batches, "text"):
            ids, counts = encoder.encode(part.column(1))
            whole = np.full(len(ids) + len(counts), end, dtype="<u4")
            ends = np.cumsum(counts + 1)
            inner = np.ones(len(whole), dtype=bool)
            inner[ends - 1] = False
            whole[inner] = ids
            number = -(-(counts + 1) // length)
            rows = np.repeat(np.arange(len(counts)), number)
            piece = np.arange(len(rows)) - np.repeat(np.cumsum(number) - number, number)
            start = piece * length
            sizes = np.minimum(length, (counts + 1)[rows] - start)
            at = (ends - counts - 1)[rows] + start
            raw = memoryview(whole).cast("B")
            sums = [zlib.crc32(raw[4 * a:4 * (a + n)]) for a, n in zip(at.tolist(), sizes.tolist())]
            out = {"id": part.column(0).take(pa.array(rows)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(sizes, pa.int64()),
                   "ids_crc32": pa.array(sums, pa.int64())}
            if keep_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(at, len(whole)).astype(np.int32)), pa.array(whole.astype(np.int32)))
            yield pa.RecordBatch.from_pydict(out)

    shape = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if keep_ids else "")
    return chats.select("id", F.col(text).alias("text")).mapInArrow(run, shape)


def _seats(bins: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length, the numbered seats in order: first seat, first sequence, seats in a sequence, place of the first."""
    seats: dict[int, list] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for lengths, times in bins:
        place = 0
        for size, n in sorted(lengths.items(), reverse=True):
            seats.setdefault(size, []).append((taken.get(size, 0), sequence, n, place))
            taken[size] = taken.get(size, 0) + n * times
            place += size * n
        sequence += times
    return {size: tuple(np.array(x, dtype=np.int64) for x in zip(*rows)) for size, rows in seats.items()}


def pack(chats: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, text: str = "text", ranked: int = RANKED) -> DataFrame:
    """Rendered chats packed into sequences of at most ``length`` tokens.

    ``chats`` holds ``id`` and the rendered ``text``; further columns are ignored. Returns a row per piece: ``id, piece, start, length,
    ids_crc32, sequence_id, offset``; the pieces of a sequence lie gapless from offset 0. ``ids_crc32`` (little-endian unsigned 32-bit ids)
    lets ``sequences`` be checked against this plan.

    The plan needs the histogram of piece lengths only, ``length`` numbers at most whatever the input, and minimum bin slack works on
    that; a piece then takes the seat of its rank among the pieces of its length. Ranks are counted per (length, hash part) with about
    ``ranked`` pieces each, so a length that a third of all pieces share is spread over many tasks.

    Null and empty texts are one closing token; long texts are cut, never shortened; repeated rows are packed as often as they occur; an
    empty table gives an empty result.
    """
    spark, kind = chats.sparkSession, chats.schema["id"].dataType.simpleString()
    stored = scratch_path(spark, "pieces")
    pieces(chats, tokenizer, length, end, text).write.parquet(stored)
    rows = spark.read.parquet(stored)
    histogram = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    seats = spark.sparkContext.broadcast(_seats(minimum_bin_slack(histogram, length)))
    parts = max(1, -(-max(histogram.values(), default=1) // ranked))
    salted = rows.withColumn("part", F.pmod(F.xxhash64("id", "piece"), F.lit(parts)))
    sizes = salted.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = sizes.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("length", "part").orderBy("id", "piece")
    placed = salted.withColumn("nth", F.row_number().over(inside)).join(before, ["length", "part"])
    placed = placed.select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth") - 1).cast("bigint").alias("seat"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, seat = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int64)
            for value in np.unique(size):
                first, start, n, place = seats.value[int(value)]
                own = np.flatnonzero(size == value)
                at = np.searchsorted(first, seat[own], "right") - 1
                step = seat[own] - first[at]
                sequence[own] = start[at] + step // n[at]
                offset[own] = place[at] + step % n[at] * value
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return placed.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def sequences(chats: DataFrame, plan: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, text: str = "text") -> DataFrame:
    """``sequence_id, ids``: the token ids of every packed sequence of ``plan``."""
    full = pieces(chats, tokenizer, length, end, text, keep_ids=True).select("id", "piece", "ids")
    placed = full.join(plan.select("id", "piece", "sequence_id", "offset"), ["id", "piece"])
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids"))
