"""Token counts that follow edits: a segment tree over the pre-tokens of each text, re-encoded only where an edit touches it."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from assayer.llm.arrays import flat, slices
from assayer.llm.tokens import WordEncoder, pre_tokens
from assayer.operators.redaction import ENTITIES

LEAF = 32
_EDIT = "array<struct<start bigint, length bigint, replacement string>>"
_TREE = "leaves int, bytes array<bigint>, tokens array<bigint>"
_COUNTS = f"text string, n_bytes bigint, n_before bigint, n_tokens bigint, n_edits bigint, n_encoded bigint, {_TREE}"


def build_tree(values: np.ndarray) -> np.ndarray:
    """Sums of a complete binary tree over the values: the root at 1, the children of i at 2i and 2i + 1, the leaves last."""
    width = 1 << max(len(values) - 1, 0).bit_length()
    tree = np.zeros(2 * width, dtype=np.int64)
    tree[width:width + len(values)] = values
    while width > 1:
        width //= 2
        tree[width:2 * width] = tree[2 * width:4 * width:2] + tree[2 * width + 1:4 * width:2]
    return tree


def locate(tree: np.ndarray, position: int) -> int:
    """Leaf that holds the position when the tree's sums are sizes."""
    node, width = 1, len(tree) // 2
    while node < width:
        node *= 2
        if position >= tree[node] and tree[node + 1]:
            position -= tree[node]
            node += 1
    return node - width


def before(tree: np.ndarray, leaf: int) -> int:
    """Sum of all leaves before one."""
    node, total = leaf + len(tree) // 2, 0
    while node > 1:
        if node & 1:
            total += int(tree[node - 1])
        node //= 2
    return total


def replace(tree: np.ndarray, first: int, values: np.ndarray) -> None:
    """Sets consecutive leaves and renews the sums above them only."""
    low, high = first + len(tree) // 2, first + len(tree) // 2 + len(values) - 1
    tree[low:high + 1] = values
    while low > 1:
        low, high = low // 2, high // 2
        tree[low:high + 1] = tree[2 * low:2 * high + 2:2] + tree[2 * low + 1:2 * high + 2:2]


def _leaf_sums(starts: np.ndarray, counts: np.ndarray, size: int, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and tokens of leaves whose first pieces are ``groups``; the first leaf begins at 0, blanks belong to the piece before them."""
    if not len(starts):
        return np.array([size]), np.array([0])
    edges = np.append(starts[groups], size)
    edges[0] = 0
    sums = np.concatenate([[0], np.cumsum(counts)])
    return np.diff(edges), np.diff(sums[np.append(groups, len(starts))])


def token_trees(completions: DataFrame, tokenizer: str, leaf: int = LEAF, text: str = "text") -> DataFrame:
    """Segment trees of completion texts: ``id, text, edits`` (where the input has them), ``n_tokens, leaves, bytes, tokens``.

    ``completions`` holds ``id``, ``text`` and possibly ``edits``; further columns are ignored. A leaf stands for ``leaf`` pre-tokens; ``bytes``
    and ``tokens`` are the trees' sums in heap order. Null texts are empty; an empty text is one leaf of nothing.
    """
    kind = completions.schema["id"].dataType.simpleString()
    given = "edits" in completions.columns
    chosen = completions.select("id", F.col(text).alias("text"), F.col("edits").cast(_EDIT) if given else F.lit(None).cast(_EDIT).alias("edits"))
    return chosen.mapInArrow(lambda batches: _planted(leaf)(batches, WordEncoder(tokenizer)), f"id {kind}, text string, edits {_EDIT}, n_tokens bigint, {_TREE}")


def _planted(leaf: int):
    """Step from ``id, text, edits`` to trees."""
    def run(batches: Iterator[pa.RecordBatch], encoder: WordEncoder) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, offsets = flat(part.column(1))
            starts, ends, rows = pre_tokens(data, offsets)
            counts = encoder.counts(data, starts, ends)
            edges = np.searchsorted(rows, np.arange(part.num_rows + 1))
            sizes, tokens, leaves = [], [], []
            for row in range(part.num_rows):
                low, high = edges[row], edges[row + 1]
                size, count = _leaf_sums(starts[low:high] - offsets[row], counts[low:high], int(offsets[row + 1] - offsets[row]), np.arange(0, high - low, leaf))
                sizes.append(build_tree(size))
                tokens.append(build_tree(count))
                leaves.append(len(size))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([int(t[1]) for t in tokens], pa.int64()), pa.array(leaves, pa.int32()), pa.array(sizes, pa.list_(pa.int64())), pa.array(tokens, pa.list_(pa.int64()))],
                                             names=["id", "text", "edits", "n_tokens", "leaves", "bytes", "tokens"])
    return run


def edit_tree(text: bytes, leaves: int, sizes: np.ndarray, tokens: np.ndarray, edits: list[tuple[int, int, bytes]], encoder: WordEncoder) -> tuple[bytes, int]:
    """The text after non-overlapping edits, later ones first, with both trees renewed in place; also the bytes that were encoded again.

    The region of an edit are the leaves it touches and at least one unchanged byte on either side, so that the cut at the region's edge, which
    depends on the two bytes beside it, is the same as before.
    """
    # What lies before ``cut`` is still the old text; the rest are pieces, the first one last. Slices are views, so an edit costs its region.
    old, cut, pieces, encoded = memoryview(text), len(text), [], 0
    for start, length, replacement in sorted(edits, reverse=True):
        first, last = locate(sizes, start), locate(sizes, max(start + length - 1, start))
        while first > 0 and before(sizes, first) >= start:
            first -= 1
        while last < leaves - 1 and before(sizes, last + 1) <= start + length:
            last += 1
        low, high = before(sizes, first), before(sizes, last) + int(sizes[last + len(sizes) // 2])
        base, near, reach = min(low, cut), [], cut
        if base < cut:
            near.append(old[base:min(high, cut)])
            if high < cut:
                pieces.append(old[high:cut])
        while reach < high:
            piece = pieces.pop()
            near.append(piece[:high - reach])
            if len(piece) > high - reach:
                pieces.append(piece[high - reach:])
            reach += len(near[-1])
        around = b"".join(near)
        region = around[low - base:start - base] + replacement + around[start + length - base:]
        data = np.frombuffer(region, dtype=np.uint8)
        begins, ends, _ = pre_tokens(data, np.array([0, len(data)]))
        counts = encoder.counts(data, begins, ends)
        slots = last - first + 1
        groups = np.unique(np.arange(slots) * len(begins) // slots) if len(begins) else begins
        size, count = _leaf_sums(begins, counts, len(region), groups)
        pad = np.zeros(slots - len(size), dtype=np.int64)
        replace(sizes, first, np.concatenate([size, pad]))
        replace(tokens, first, np.concatenate([count, pad]))
        pieces += [memoryview(p) for p in (region, around[:low - base]) if p]
        cut, encoded = base, encoded + len(region)
    return b"".join([old[:cut], *reversed(pieces)]), encoded


def apply_edits(trees: DataFrame, tokenizer: str) -> DataFrame:
    """Texts, counts and trees after the edits of each row.

    ``trees`` comes from ``token_trees``; ``edits`` lists ``start, length, replacement`` in bytes of the old UTF-8 text. Returns ``id, text, n_bytes,
    n_before, n_tokens, n_edits, n_encoded`` and the new ``leaves, bytes, tokens``. Only the touched leaves and a boundary byte on either side
    are encoded again (``n_encoded`` bytes); rows without edits are passed on as they are. No row moves to another task.

    Edits are taken by position; one that overlaps an earlier one or starts behind the end is left out, a longer one ends with the text, and
    ``n_edits`` counts those applied. An edit that cuts a character in two leaves its stray bytes as replacement characters in ``text``.
    Null edits are no edits; null replacements delete.
    """
    kind = trees.schema["id"].dataType.simpleString()
    chosen = trees.select("id", "text", F.col("edits").cast(_EDIT), "n_tokens", "leaves", "bytes", "tokens")
    return chosen.mapInArrow(lambda batches: _edited()(batches, WordEncoder(tokenizer)), f"id {kind}, {_COUNTS}")


def _edited():
    """Step from trees to edited trees."""
    def run(batches: Iterator[pa.RecordBatch], encoder: WordEncoder) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, edits, before_, leaves, sizes, tokens = (batch.column(i) for i in range(7))
            asked = np.flatnonzero(pc.fill_null(pc.list_value_length(edits), 0).to_numpy(zero_copy_only=False) > 0)
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64).copy()
            after, n_edits, n_encoded = before_.to_numpy(zero_copy_only=False).copy(), np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
            new: dict[int, tuple] = {}
            for row in asked.tolist():
                text, kept, end = (texts[row].as_py() or "").encode(), [], 0
                for e in sorted(edits[row].as_py(), key=lambda e: (e["start"], e["length"], e["replacement"] or "")):
                    if max(e["start"], 0) >= end and 0 <= e["start"] <= len(text):
                        length = min(max(e["length"], 0), len(text) - e["start"])
                        kept.append((e["start"], length, (e["replacement"] or "").encode()))
                        end = e["start"] + max(length, 1)
                size, count = np.array(sizes[row].as_py(), dtype=np.int64), np.array(tokens[row].as_py(), dtype=np.int64)
                text, n_encoded[row] = edit_tree(text, leaves[row].as_py(), size, count, kept, encoder)
                n_bytes[row], after[row], n_edits[row] = len(text), count[1], len(kept)
                new[row] = (text.decode("utf-8", "replace"), size, count)
            put = lambda column, k: pa.array([new[i][k] if i in new else v for i, v in enumerate(column.to_pylist())], column.type) if new else column
            yield pa.RecordBatch.from_arrays([ids, put(texts, 0), pa.array(n_bytes), before_, pa.array(after), pa.array(n_edits), pa.array(n_encoded), leaves, put(sizes, 1), put(tokens, 2)],
                                             names=["id", "text", "n_bytes", "n_before", "n_tokens", "n_edits", "n_encoded", "leaves", "bytes", "tokens"])
    return run


def redaction_edits(completions: DataFrame, text: str = "text") -> DataFrame:
    """``id, text, edits``: one edit for every e-mail address or phone number, which a tag replaces; of overlapping finds the earlier pattern wins."""
    kind = completions.schema["id"].dataType.simpleString()
    return completions.select("id", F.col(text).alias("text")).mapInArrow(_redactions(), f"id {kind}, text string, edits {_EDIT}")


def _redactions():
    """Step from ``id, text`` to ``id, text, edits``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        email, phone = (re.compile(ENTITIES[n], re.ASCII) for n in ("EMAIL_ADDRESS", "PHONE_NUMBER"))
        for batch in batches:
            column = batch.column(1)
            has_email = pc.fill_null(pc.match_substring(column, "@"), False).to_numpy(zero_copy_only=False)
            has_phone = pc.fill_null(pc.match_substring_regex(column, r"[0-9][)]?[ .-][0-9]{3}"), False).to_numpy(zero_copy_only=False)
            edits: list = [None] * batch.num_rows
            for row in np.flatnonzero(has_email | has_phone).tolist():
                value = column[row].as_py()
                taken = [(m.start(), m.end(), "<EMAIL_ADDRESS>") for m in email.finditer(value)]
                starts, ends = [a for a, _, _ in taken], [b for _, b, _ in taken]
                # The finds of a pattern do not overlap and stand in order, so one place tells whether another find meets one of them.
                phones = [(m.start(), m.end(), "<PHONE_NUMBER>") for m in phone.finditer(value) if bisect_right(ends, m.start()) == bisect_left(starts, m.end())]
                if taken or phones:
                    edits[row], at, size = [], 0, 0
                    for a, b, tag in sorted(taken + phones):
                        begin = size + len(value[at:a].encode())
                        at, size = b, begin + len(value[a:b].encode())
                        edits[row].append({"start": begin, "length": size - begin, "replacement": tag})
            shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("replacement", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), column, pa.array(edits, shape)], names=["id", "text", "edits"])
    return run


def redacted_counts(completions: DataFrame, tokenizer: str, leaf: int = LEAF, text: str = "text") -> DataFrame:
    """``apply_edits`` of ``token_trees`` of ``redaction_edits``, the three steps in one Python worker with one encoder."""
    kind = completions.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer)
        yield from _edited()(_planted(leaf)(_redactions()(slices(batches, "text")), encoder), encoder)

    return completions.select("id", F.col(text).alias("text")).mapInArrow(run, f"id {kind}, {_COUNTS}")
