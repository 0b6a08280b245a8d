"""Fixed-size membership filters over 64-bit hashes, built by slices on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayer.llm.arrays import mix

U = np.uint64
SLICE_BITS = 5


def _cells(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Three bit numbers inside the slice that the low bits choose. Mixed anew: fingerprints are minima, so their high bits are alike."""
    base = (hashes & U((1 << SLICE_BITS) - 1)) << U(bits - SLICE_BITS)
    mask, mixed = U((1 << (bits - SLICE_BITS)) - 1), mix(hashes)
    return [(base | ((mixed >> U(shift)) & mask)).astype(np.int64) for shift in (0, 20, 40)]


def bits_for(count: int, most: int = 28) -> int:
    """Power of two with at least 16 bits an entry, between 2**16 and 2**most (32 MB); a fuller filter only passes more."""
    return int(min(most, max(16, np.ceil(np.log2(max(count, 1) * 16)))))


def build_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """Filter of ``2**bits`` bits over the single long column of ``hashes``.

    Each executor task fills the slices it owns, so what reaches the driver is the filter itself, bounded by
    ``bits`` whatever the row count. A filter answers "maybe" or "no"; exact joins decide afterwards.
    """
    name = hashes.columns[0]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = 1 << (bits - SLICE_BITS)
        for batch in batches:
            cells = np.concatenate(_cells(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U), bits)) if batch.num_rows else np.zeros(0, dtype=np.int64)
            part = cells >> (bits - SLICE_BITS)
            for k in np.unique(part):
                held.setdefault(int(k), np.zeros(size, dtype=bool))[cells[part == k] & (size - 1)] = True
        for k, cells in held.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "cells": pa.array([np.packbits(cells).tobytes()], pa.binary())})

    spread = hashes.select(name).repartition(1 << SLICE_BITS, F.col(name).bitwiseAND((1 << SLICE_BITS) - 1))
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    width = len(out) >> SLICE_BITS
    for row in spread.mapInArrow(fill, "part int, cells binary").toLocalIterator():
        out[row.part * width:(row.part + 1) * width] |= np.frombuffer(row.cells, dtype=np.uint8)
    return out


def maybe(cells: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    """True where the filter may hold the hash."""
    found = np.ones(len(hashes), dtype=bool)
    for cell in _cells(hashes, bits):
        found &= (cells[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
    return found
