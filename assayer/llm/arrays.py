"""Arrow batches as flat numpy arrays: bounded slices, word spans and rolling hashes shared by the operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE, ROWS = 1 << 20, 1024
U = np.uint64
BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=U) * U(2) + U(1)

# Word bytes: digits, a-z (after lowering A-Z) and every byte of a non-ASCII character.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True


def as_text(column) -> pa.Array:
    """One contiguous large-string array; nulls become empty texts."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(column.cast(pa.large_string()), "")


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the int64 offset of every row, the first being 0."""
    column = as_text(column)
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]] if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return values, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Row slices of at most ``limit`` text bytes and ``rows`` rows, so that what is held per row is bounded on short texts too; a longer
    single text is a slice of its own, never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(lengths), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = min(max(start + 1, int(np.searchsorted(ends, before + limit, "right"))), start + rows)
            yield batch.slice(start, stop - start)
            start = stop


def _powers(base: int, size: int, kept: dict = {}) -> np.ndarray:  # noqa: B006  the cache is shared on purpose
    if base not in kept or len(kept[base]) < size:
        steps = np.full(max(size, SLICE + 4096), U(base), dtype=U)
        steps[0] = U(1)
        kept[base] = np.cumprod(steps)
    return kept[base]


_HELD: dict = {}


def held_in_worker(key, build: Callable):
    """What ``build`` makes, kept in this worker for its next tasks; it holds one such object, the latest."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = build()
    return _HELD[key]


def release() -> None:
    """Give back what an earlier step left in this worker, which Spark uses again for the steps that follow: the object held, and memory
    that was freed but that the C library keeps (where it can be told to)."""
    _HELD.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of polynomial hashes over all 64 bits."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Running polynomial sums of a value sequence, so that any span hashes in constant time."""
    sums = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * _powers(BASE, len(values) + 1)[:len(values)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end), equal for equal contents wherever they stand."""
    inverse = _powers(pow(BASE, -1, 2**64), len(sums) + 1)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _TABLE[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word of lowered bytes; words never cross rows."""
    if not len(data):
        return (np.zeros(0, dtype=np.int64),) * 3
    inside = IS_WORD[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every full window of ``width`` values."""
    if len(values) < width:
        return values[:0]
    span, low = 1, values
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - span
    return np.minimum(low[:len(low) - rest], low[rest:]) if rest else low


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(start, start + length)`` for every pair."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """List array with ``counts`` consecutive values per row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)
