"""Phrases of any length that many documents share: a mergeable sketch of candidates, exact counts, and only the longest ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from assayer.session import cut_lineage

SHARE, FEWEST, SLICE = 0.01, 3, 1 << 20
U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE, _WORD = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


def _powers(base: U, size: int) -> np.ndarray:
    steps = np.full(size, base, dtype=U)
    steps[:1] = U(1)
    return np.cumprod(steps)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(29))


class Words:
    """Words (runs of other than white space) of a slice of texts, and hashes of their spans in constant time each."""

    def __init__(self, texts):
        texts = pc.fill_null((texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.large_string()), "")
        places = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        self.data = np.frombuffer(raw, dtype=np.uint8)[places[0]:places[-1]] if raw is not None and len(texts) else np.zeros(0, dtype=np.uint8)
        places = places - places[0]
        inside = np.concatenate([[False], ~_SPACE[self.data], [False]])
        edge = np.zeros(len(self.data) + 1, dtype=bool)
        edge[places] = True
        self.starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
        self.ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
        self.rows = np.searchsorted(places, self.starts, "right") - 1
        sums = np.concatenate([[U(0)], np.cumsum((self.data.astype(U) + U(1)) * _powers(_BYTE, len(self.data)))])
        back = _powers(U(pow(int(_BYTE), -1, 2**64)), len(self.data) + 1)
        own = _mixed((sums[self.ends] - sums[self.starts]) * back[self.starts] + (self.ends - self.starts).astype(U))
        self._sums = np.concatenate([[U(0)], np.cumsum(own * _powers(_WORD, len(own)))])
        self._back = _powers(U(pow(int(_WORD), -1, 2**64)), len(own) + 1)
        # Words from each place to the end of its text.
        self.left = np.searchsorted(self.rows, self.rows, "right") - np.arange(len(self.rows))

    def spans(self, at: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
        return _mixed((self._sums[at + sizes] - self._sums[at]) * self._back[at] + np.asarray(sizes, dtype=U)).view(np.int64)

    def text(self, at: int, size: int) -> str:
        return " ".join(bytes(self.data[a:b]).decode("utf-8", "replace") for a, b in zip(self.starts[at:at + size].tolist(), self.ends[at:at + size].tolist()))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends, start = np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def _once(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and the number of texts that hold each."""
    order = np.lexsort((rows, hashes))
    rows, hashes = rows[order], hashes[order]
    fresh = np.ones(len(rows), dtype=bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return np.unique(hashes[fresh], return_counts=True)


def shortened(keys: np.ndarray, counts: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sketch of at most ``room`` counters: all counts lose the largest count that finds no room. What is lost per counter is the third value."""
    if len(keys) <= room:
        return keys, counts, 0
    loss = int(np.partition(counts, len(counts) - room - 1)[len(counts) - room - 1])
    kept = counts > loss
    return keys[kept], counts[kept] - loss, loss


def _sketch(size: int, room: int):
    """Arrow function: heavy n-grams of a partition by number of texts, and in a last row, without a hash, by how much each count may be short."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, lost = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0
        for part in _slices(batches):
            words = Words(part.column(0))
            at = np.flatnonzero(words.left >= size)
            new, times = _once(words.rows[at], words.spans(at, size))
            keys, place = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(place, weights=np.concatenate([counts, times]), minlength=len(keys)).astype(np.int64)
            keys, counts, loss = shortened(keys, counts, room)
            lost += loss
        yield pa.RecordBatch.from_arrays([pa.array([*keys.tolist(), None], pa.int64()), pa.array(np.append(counts, lost))], ["hash", "n"])
    return run


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
    return known[at] == hashes if len(known) else np.zeros(len(hashes), dtype=bool)


def _lengths(words: Words, levels: list[tuple[int, np.ndarray]], fewest: int) -> np.ndarray:
    """Length of the longest frequent phrase at every place, as far as the levels (highest length tested, hashes of frequent phrases) know it."""
    found = np.zeros(len(words.left), dtype=np.int64)
    reached = fewest - 1
    at = np.arange(len(found))
    for highest, known in levels:
        for size in range(reached + 1, highest + 1):
            at = at[words.left[at] >= size]
            at = at[_among(words.spans(at, size), known)]
            if not len(at):
                break
            found[at] = size
        reached = highest
    return found


def _tests(levels: list[tuple[int, np.ndarray]], fewest: int, low: int, high: int):
    """Arrow function: hashes of the phrases of ``low + 1`` to ``high`` words that go on a frequent one of ``low``, with their number of texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            words = Words(part.column(0))
            longest = _lengths(words, levels, fewest)
            at, hashes, rows = np.flatnonzero(longest == low) if low >= fewest else np.arange(len(longest)), [], []
            # A phrase of s words is tested only if both phrases of ``fewest`` words at its ends are frequent.
            last = longest >= fewest
            for size in range(low + 1, high + 1):
                at = at[words.left[at] >= size]
                at = at[last[at + size - fewest]] if low >= fewest else at
                if not len(at):
                    break
                hashes.append(words.spans(at, size))
                rows.append(words.rows[at])
            if hashes:
                keys, counts = _once(np.concatenate(rows), np.concatenate(hashes))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["hash", "n"])
    return run


def _ends(levels: list[tuple[int, np.ndarray]], fewest: int):
    """Arrow function: hashes of the longest frequent phrase at each place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            words = Words(part.column(0))
            longest = _lengths(words, levels, fewest)
            at = np.flatnonzero(longest)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(words.spans(at, longest[at])))], ["hash"])
    return run


def _inner(levels: list[tuple[int, np.ndarray]], fewest: int, ends: np.ndarray):
    """Arrow function: those of ``ends`` that stand inside a longer frequent phrase somewhere."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            words = Words(part.column(0))
            longest = _lengths(words, levels, fewest)
            before = np.concatenate([[0], longest[:-1]])
            at, covered = np.flatnonzero(longest), [np.zeros(0, dtype=np.int64)]
            # A phrase goes on to the right, or from the word before it; anything else that holds it also holds one of these.
            for size in range(fewest, int(longest.max(initial=0)) + 1):
                at = at[longest[at] >= size]
                hashes = np.unique(words.spans(at[(longest[at] > size) | (before[at] > size)], size))
                covered.append(hashes[_among(hashes, ends)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(covered))], ["hash"])
    return run


def _spelled(levels: list[tuple[int, np.ndarray]], fewest: int, inner: np.ndarray):
    """Arrow function: the longest frequent phrases of each text that stand in no longer one anywhere, once a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            words = Words(part.column(0))
            longest = _lengths(words, levels, fewest)
            at = np.flatnonzero(longest)
            hashes = words.spans(at, longest[at])
            keep = ~_among(hashes, inner)
            seen = {(row, h): i for row, h, i in zip(words.rows[at[keep]].tolist(), hashes[keep].tolist(), at[keep].tolist())}
            yield pa.RecordBatch.from_arrays([pa.array([words.text(i, int(longest[i])) for i in seen.values()], pa.string())], ["phrase"])
    return run


def _collected(rows: DataFrame) -> np.ndarray:
    """Sorted distinct hashes on the driver. Callers bound them: at most (words a document) / (share) phrases of one length can be frequent."""
    return np.sort(np.array([r.hash for r in rows.select("hash").distinct().toLocalIterator()], dtype=np.int64))


def phrase_leakage(docs: DataFrame, share: float = SHARE, fewest: int = FEWEST, text: str = "text") -> DataFrame:
    """``phrase, words, documents``: phrases of ``fewest`` words or more that stand in at least a share of all documents and in no longer such phrase.

    Words are runs of other than white space, compared as they stand; a phrase may cross line ends. ``documents`` is exact.

    Each task keeps a sketch of the n-grams of ``fewest`` words, twice the average number of words a document divided by ``share`` in size;
    the merged sketches miss no frequent one whatever the size of the corpus. Candidates are counted exactly, and so are longer phrases, in
    steps that double, where both their ends are frequent. Only hashes of frequent phrases come to the driver, and (words a document) / share
    of a length can exist. Null texts count as documents without words; copies of a document count as often as they stand.
    """
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    total, length = texts.agg(F.count("*"), F.sum(F.size(F.split("text", r"[ \t\n\x0B\f\r]+")))).first()
    least = max(2, int(np.ceil(share * total - 1e-9)))
    room = int(np.ceil(2 * (length or 0) / least)) + 1
    counted = cut_lineage(texts.mapInArrow(_sketch(fewest, room), "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n")))
    short = counted.where("hash is null").select("n").first()
    candidates = _collected(counted.where(F.col("hash").isNotNull() & (F.col("n") + (short.n if short else 0) >= least)))
    levels: list[tuple[int, np.ndarray]] = []
    low, step = fewest - 1, 1
    while True:
        # The first round recounts the candidates themselves; each later one doubles how many lengths it tests at once.
        tests = texts.mapInArrow(_tests(levels, fewest, low, low + step), "hash bigint, n bigint")
        if not levels:
            allowed = texts.sparkSession.sparkContext.broadcast(candidates)
            tests = tests.mapInArrow(_only(allowed), "hash bigint, n bigint")
        frequent = _collected(tests.groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
        if not len(frequent):
            break
        levels.append((low + step, frequent))
        low, step = low + step, step * 2
    if not levels:
        return texts.sparkSession.createDataFrame([], "phrase string, words int, documents bigint")
    ends = _collected(texts.mapInArrow(_ends(levels, fewest), "hash bigint"))
    inner = _collected(texts.mapInArrow(_inner(levels, fewest, ends), "hash bigint"))
    found = texts.mapInArrow(_spelled(levels, fewest, inner), "phrase string").groupBy("phrase").agg(F.count("*").alias("documents"))
    return found.select("phrase", F.size(F.split("phrase", " ")).alias("words"), "documents")


def _only(allowed):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_among(batch.column("hash").to_numpy(zero_copy_only=False), allowed.value)))
    return run
