"""Removal of long repeated byte spans: anchored segments, deep-shallow suffix sorting, earliest occurrence kept."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from assayer.llm.arrays import byte_values, flat, prefix_hashes, ranges, slices, sliding_minimum, span_hashes
from assayer.llm.membership import bits_for, build_filter, maybe
from assayer.llm.stored import stored

SPAN, GRAM, CROWD, SHALLOW, CHUNK = 100, 32, 32_768, 16, 20_000
PLACE = ["id", "row", "at"]
_LOW = (1 << 24) - 1
_BLOCK = 1 << 22


def _segments(data: np.ndarray, offsets: np.ndarray, span: int, gram: int):
    """Runs of starts that share an anchor: row, first start in the flat bytes, starts, anchor distance, anchor hash.

    The anchor of a ``span``-byte string is the rightmost of its smallest ``gram``-byte hashes, so equal strings have equal anchors at
    equal distances and every start belongs to exactly one segment.
    """
    found = []
    for low in range(0, max(len(data) - span + 1, 0), _BLOCK):
        part = data[low:low + _BLOCK + span - 1]
        sums, at = prefix_hashes(byte_values(part)), np.arange(len(part) - gram + 1)
        hashes = span_hashes(sums, at, at + gram)
        packed = (hashes & np.uint64(~_LOW & (2**64 - 1))) | (_LOW - at).astype(np.uint64)
        anchor = _LOW - (sliding_minimum(packed, span - gram + 1) & np.uint64(_LOW)).astype(np.int64)
        starts = np.arange(len(anchor)) + low
        rows = np.searchsorted(offsets, starts, "right") - 1 if len(offsets) > 2 else np.zeros(len(starts), dtype=np.int64)
        valid = starts + span <= offsets[rows + 1]
        starts, rows, anchor = starts[valid], rows[valid], anchor[valid]
        if not len(starts):
            continue
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (rows[1:] != rows[:-1])])
        first = np.flatnonzero(new)
        found.append((rows[first], starts[first], np.diff(np.append(first, len(starts))), anchor[first] + low - starts[first], hashes[anchor[first]]))
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 4 + (np.zeros(0, dtype=np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*found))


def _anchor_counts(texts: DataFrame, span: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            hashes, counts = np.unique(_segments(*flat(part.column(0)), span, gram)[4], return_counts=True)
            yield pa.RecordBatch.from_pydict({"anchor": pa.array(hashes.view(np.int64)), "n": pa.array(counts, pa.int64())})

    return texts.select("text").mapInArrow(run, "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n"))


def _binary(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[ranges(starts, lengths)])])


def _repeated_segments(texts: DataFrame, span: int, gram: int, cells, crowds, crowded: bool) -> DataFrame:
    """Segments whose anchor may occur again, with their bytes: those of crowded anchors, or all others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, offsets = flat(part.column(1))
            rows, starts, n, lead, hashes = _segments(data, offsets, span, gram)
            kept = maybe(*cells.value, hashes) & (maybe(*crowds.value, hashes) == crowded)
            rows, starts, n, lead, hashes = rows[kept], starts[kept], n[kept], lead[kept], hashes[kept]
            prints = span_hashes(prefix_hashes(byte_values(data)), starts, starts + n + span - 1)
            yield pa.RecordBatch.from_pydict({
                "id": part.column(0).take(pa.array(rows)), "row": part.column(2).take(pa.array(rows)), "at": pa.array(starts - offsets[rows]), "n": pa.array(n, pa.int32()), "lead": pa.array(lead, pa.int32()),
                "anchor": pa.array(hashes.view(np.int64)), "print": pa.array(prints.view(np.int64)), "bytes": _binary(data, starts, n + span - 1)})

    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, row bigint, at bigint, n int, lead int, anchor bigint, print bigint, bytes binary")


def _words(data: np.ndarray) -> np.ndarray:
    """Big-endian 8-byte word at every position; positions near the end are padded with zeros."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), dtype=np.uint64)
    for k in range(8):
        out |= padded[k:k + len(data)] << np.uint64(56 - 8 * k)
    return out


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Group number of every element by all keys."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def multikey_quicksort(words: np.ndarray, at: np.ndarray, groups: np.ndarray, depth: int) -> np.ndarray:
    """Rank of every suffix inside the order of groups, equal for members of a group that agree on their first ``depth`` bytes.

    All groups are split at once: each takes the middle member's next 8 bytes as pivot and falls into a lower, an equal and a higher part;
    only equal parts move on by 8 bytes. Single members and parts at ``depth`` rest.
    """
    order = np.argsort(groups, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], groups[order][1:] != groups[order][:-1]]))
    rank = np.empty(len(at), dtype=np.int64)
    rank[order] = np.repeat(first, np.diff(np.append(first, len(at))))
    level, active = np.zeros(len(at), dtype=np.int64), order if depth else order[:0]
    while len(active):
        active = active[np.argsort(rank[active], kind="stable")]
        own = rank[active]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        sizes = np.diff(np.append(first, len(active)))
        key = words[at[active] + level[active]]
        pivot = np.repeat(key[first + sizes // 2], sizes)
        lower, equal = key < pivot, key == pivot
        n_lower, n_equal = np.add.reduceat(lower, first, dtype=np.int64), np.add.reduceat(equal, first, dtype=np.int64)
        spread = lambda x: np.repeat(x, sizes)
        rank[active] = own + np.where(lower, 0, spread(n_lower) + np.where(equal, 0, spread(n_equal)))
        level[active] += 8 * equal
        members = np.where(lower, spread(n_lower), np.where(equal, spread(n_equal), spread(sizes - n_lower - n_equal)))
        active = active[(members > 1) & (level[active] < depth)]
    return rank


def blind_tries(words: np.ndarray, data: np.ndarray, at: np.ndarray, groups: np.ndarray, depth: int, span: int) -> np.ndarray:
    """Leaf numbers, equal for suffixes that agree on ``span`` bytes, below groups that agree on ``depth`` bytes.

    Every group grows its trie a level at a time: the members' common length with the group's leader gives the branching position, and
    members part by (position, byte) there. Inner nodes know these two only; bytes between branchings are not looked at again.
    """
    leaf = np.full(len(at), -1, dtype=np.int64)
    active, node, low, made = np.arange(len(at)), groups, np.full(len(at), depth, dtype=np.int64), 0
    while len(active):
        node = _dense(node)
        leaders = np.full(node.max() + 1, -1, dtype=np.int64)
        leaders[node[::-1]] = active[::-1]
        lead = leaders[node]
        common = low.copy()
        open_ = np.flatnonzero((lead != active) & (low < span))
        common[lead == active] = span
        while len(open_):
            a, b = words[at[active[open_]] + common[open_]], words[at[lead[open_]] + common[open_]]
            differ = a ^ b
            same = (differ == 0).astype(np.int64)  # leading equal bytes
            for k in range(1, 8):
                same += differ < np.uint64(1 << (64 - 8 * k))
            common[open_] += same
            open_ = open_[(same == 8) & (common[open_] < span)]
        common = np.minimum(common, span)
        ended = common >= span
        leaf[active[ended]] = made + node[ended]
        made += node.max() + 1
        rest = ~ended
        position = common[rest]
        byte = data[at[active[rest]] + position].astype(np.int64)
        node = _dense(node[rest], position, byte) if rest.any() else node[:0]
        active, low = active[rest], position + 1
    return leaf


def repeated_starts(data: np.ndarray, offsets: np.ndarray, n: np.ndarray, lead: np.ndarray, groups: np.ndarray, rank: np.ndarray, span: int = SPAN, shallow: int = SHALLOW):
    """Segment and start number of every start whose ``span`` bytes also stand at an earlier start of its group.

    ``rank`` orders the segments; ``lead`` is the distance from a segment's first start to its anchor, which first splits the groups.
    """
    shallow = min(shallow, span // 8 * 8)
    segment = np.repeat(np.arange(len(n)), n)
    step = ranges(np.zeros(len(n), dtype=np.int64), n.astype(np.int64))
    at = offsets[segment] + step
    order = np.lexsort((step, rank[segment]))
    segment, step, at = segment[order], step[order], at[order]
    words = _words(data)
    bucket = _dense(groups[segment], lead[segment] - step)
    crowd = np.bincount(bucket)[bucket] > 1
    segment, step, at, bucket = segment[crowd], step[crowd], at[crowd], bucket[crowd]
    sorted_groups = _dense(multikey_quicksort(words, at, bucket, shallow)) if len(at) else bucket
    crowd = np.bincount(sorted_groups)[sorted_groups] > 1 if len(at) else np.zeros(0, dtype=bool)
    segment, step, at, sorted_groups = segment[crowd], step[crowd], at[crowd], sorted_groups[crowd]
    if not len(at):
        return segment, step
    leaves = blind_tries(words, data, at, sorted_groups, shallow, span)
    # Members stand in the order of their documents and positions: all but the first of a leaf are repeats.
    _, first = np.unique(leaves, return_index=True)
    again = np.ones(len(leaves), dtype=bool)
    again[first] = False
    return segment[again], step[again]


def _runs(ids, row: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
    return pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (row, at, n))], ["id", "row", "at", "n"])


def _same_as_before(table: pa.Table, names: list[str]) -> np.ndarray:
    """True for every line that equals the line before it in all named columns; a null equals nothing."""
    same = np.zeros(table.num_rows, dtype=bool)
    for k, name in enumerate(names):
        column = table.column(name)
        equal = pc.fill_null(pc.equal(column.slice(1), column.slice(0, len(column) - 1)), False).to_numpy()
        same[1:] = equal if k == 0 else same[1:] & equal
    return same


def _sort_segments(span: int):
    """Arrow function over segments that arrive ordered by anchor: runs ``id, row, at, n`` of starts to drop."""
    def runs(table: pa.Table) -> pa.RecordBatch:
        table = table.sort_by([(c, "ascending") for c in ("anchor", "print", *PLACE)]).combine_chunks()
        # A row that stands several times is one text: its segments count once.
        table = table.filter(pa.array(~_same_as_before(table, ["anchor", "print", *PLACE]))).combine_chunks()
        anchor, prints, n, lead = (table.column(c).to_numpy().astype(np.int64) for c in ("anchor", "print", "n", "lead"))
        # Equal segments: all but the earliest repeat as a whole, and only the earliest goes on.
        copy = np.zeros(len(n), dtype=bool)
        copy[1:] = (anchor[1:] == anchor[:-1]) & (prints[1:] == prints[:-1]) & (n[1:] == n[:-1]) & (lead[1:] == lead[:-1])
        copies = table.filter(pa.array(copy)).select(["id", "row", "at", "n"])
        group = _dense(anchor)
        keep = np.flatnonzero(~copy & (np.bincount(group, weights=~copy) > 1)[group])
        batch = table.take(pa.array(keep)).combine_chunks()
        anchor, n, lead = anchor[keep], n[keep], lead[keep]
        if not len(keep):
            return _runs(copies.column("id"), *(copies.column(c).to_numpy() for c in ("row", "at", "n")))
        column = batch.column("bytes")
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(column.buffers()[2], dtype=np.uint8)
        order = pc.sort_indices(batch.select(PLACE), [(c, "ascending") for c in PLACE]).to_numpy()
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        segment, step = repeated_starts(data, offsets, n, lead, anchor, rank, span)
        order = np.lexsort((step, segment))
        segment, step = segment[order], step[order]
        first = np.flatnonzero(np.concatenate([[True], (segment[1:] != segment[:-1]) | (step[1:] != step[:-1] + 1)])) if len(segment) else segment
        lengths = np.diff(np.append(first, len(segment))) if len(segment) else segment
        ids = pa.concat_arrays([*copies.column("id").chunks, *batch.column("id").take(pa.array(segment[first])).chunks])
        row, at = batch.column("row").to_numpy()[segment[first]], batch.column("at").to_numpy()[segment[first]] + step[first]
        return _runs(ids, *(np.concatenate([copies.column(c).to_numpy(), x]) for c, x in (("row", row), ("at", at), ("n", lengths))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            anchors = batch.column("anchor").to_numpy()
            last = int(np.searchsorted(anchors, anchors[-1], "left"))  # the last anchor may go on in the next batch
            if last and size + last >= CHUNK:
                yield runs(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held, size = [], 0
                batch = batch.slice(last)
            elif held and size >= CHUNK and held[-1].column("anchor")[-1].as_py() != anchors[0]:
                yield runs(pa.Table.from_batches(held))
                held, size = [], 0
            held.append(batch)
            size += batch.num_rows
        if held:
            yield runs(pa.Table.from_batches(held))

    return run


def _starts(span: int):
    """Arrow function that takes segments of crowded anchors apart: one line per start with a 128-bit print of its string."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("bytes")
            offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
            data, n = np.frombuffer(column.buffers()[2], dtype=np.uint8), batch.column("n").to_numpy().astype(np.int64)
            segment, step = np.repeat(np.arange(len(n)), n), ranges(np.zeros(len(n), dtype=np.int64), n)
            at = offsets[segment] + step
            one = span_hashes(prefix_hashes(byte_values(data)), at, at + span)
            two = span_hashes(prefix_hashes(byte_values(data[::-1].copy())), len(data) - at - span, len(data) - at)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id").take(pa.array(segment)), "row": batch.column("row").take(pa.array(segment)),
                                              "at": pa.array(batch.column("at").to_numpy()[segment] + step), "one": pa.array(one.view(np.int64)), "two": pa.array(two.view(np.int64))})
    return run


def _place(*more: str):
    """Where a string starts, ordered as the sorted path orders it: null ids last, then by id, row key and position."""
    return F.struct(F.col("id").isNull().alias("none"), *PLACE, *more)


def _keyed(completions: DataFrame, text: str, carry: tuple[str, ...]) -> DataFrame:
    """``id, text, row`` and the carried columns. ``row`` tells rows of one id apart: a hash of the text, so that rows equal in both are one
    text; rows without an id are different texts and take a number each, which is written down so that every later scan sees the same."""
    rows = completions.select("id", F.col(text).alias("text"), *(F.col(c).alias(f"carried_{c}") for c in carry))
    order = ["id", "text", "row", *(f"carried_{c}" for c in carry)]
    named = rows.where(F.col("id").isNotNull()).withColumn("row", F.xxhash64("text")).select(*order)
    nameless = stored(rows.where(F.col("id").isNull()).withColumn("row", F.monotonically_increasing_id()).select(*order), "nameless")
    return named.unionByName(nameless)


def repeated_runs(texts: DataFrame, span: int = SPAN, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """Runs ``id, row, at, n``: the ``span`` bytes from each of the ``n`` starts from ``at`` on also start earlier. ``texts`` holds ``id, text, row``."""
    texts = texts.select("id", "text", "row")
    spark, kind = texts.sparkSession, texts.schema["id"].dataType.simpleString()
    anchors = stored(_anchor_counts(texts, span, gram).where(F.col("n") > 1), "anchors")
    bits = bits_for(anchors.count())
    cells = spark.sparkContext.broadcast((build_filter(anchors, bits), bits))
    crowded = anchors.where(F.col("n") > crowd)
    bits = bits_for(crowded.count(), most=24)
    crowds = spark.sparkContext.broadcast((build_filter(crowded, bits), bits))
    few = _repeated_segments(texts, span, gram, cells, crowds, False)
    runs = few.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sort_segments(span), f"id {kind}, row bigint, at bigint, n bigint")
    # Anchors of very many segments: equal segments meet as counts, the rest is split by string, so no task gathers an anchor.
    many = stored(_repeated_segments(texts, span, gram, cells, crowds, True), "segments")
    alike = ["anchor", "print", "n", "lead"]
    # The least place of a class leads it; a row that stands several times has one place, so it is neither its own copy nor split twice.
    leading = many.groupBy(*alike).agg(F.min(_place()).alias("first"))
    copies = many.drop("bytes").join(leading, alike).where(~_place().eqNullSafe(F.col("first"))).select("id", "row", "at", F.col("n").cast("bigint").alias("n"))
    firsts = many.groupBy(*alike).agg(F.min(_place("bytes")).alias("first")).select("first.id", "first.row", "first.at", "n", "first.bytes")
    strings = firsts.mapInArrow(_starts(span), f"id {kind}, row bigint, at bigint, one bigint, two bigint")
    owners = strings.groupBy("one", "two").agg(F.min(_place()).alias("first"), F.count("*").alias("members")).where(F.col("members") > 1)
    again = strings.join(owners, ["one", "two"]).where(~_place().eqNullSafe(F.col("first"))).select("id", "row", "at", F.lit(1).cast("bigint").alias("n"))
    return stored(copies.unionByName(runs).unionByName(again), "runs")


def _cut(kind: str, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, offsets = flat(part.column(1))
            sizes, spans, kept = [], [], []
            for row, (low, high, runs) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), part.column(2).to_pylist())):
                text, merged = data[low:high], []
                for r in sorted((r["at"], r["at"] + r["n"] + span - 1) for r in runs or []):
                    if merged and r[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], r[1])
                    else:
                        merged.append(list(r))
                edges = [0, *(x for r in merged for x in r), len(text)]
                sizes.append(len(text))
                spans.append([{"start": a, "end": b} for a, b in merged])
                kept.append(b"".join(text[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_pydict({"id": part.column(0), "n_bytes": pa.array(sizes, pa.int64()),
                                              "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.binary()),
                                              **dict(zip(part.schema.names[3:], part.columns[3:]))})
    return run


def drop_repeats(completions: DataFrame, span: int = SPAN, gram: int = GRAM, crowd: int = CROWD, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Completion texts without the bytes that repeat an earlier passage of at least ``span`` bytes.

    ``completions`` holds ``id`` and ``text``; further columns are ignored, but those named in ``carry`` follow their row. Returns
    ``id, n_bytes, spans, kept``: the size of the text in UTF-8, the maximal removed spans ``start, end`` (bytes), and the remaining bytes. A byte goes when it lies in a ``span``-byte string that
    also starts earlier, in a lower id or before it in the same text; strings are judged on the input, overlaps count, matches never cross texts.

    Every string is filed under its anchor, the smallest ``gram``-byte hash in it. Anchors that occur once are dropped where they arise.
    Equal segments collapse; the rest is sorted per anchor by deep-shallow sorting (multikey quicksort to a shallow depth, blind tries
    below), and each group of equal strings keeps its earliest start. Anchors with more than ``crowd`` segments are counted by segment and
    then by string instead, so a passage in a third of all texts never meets in one task.

    Null and empty texts have 0 bytes and no spans; shorter texts than ``span`` stay whole; of equal texts the lowest id stays. Rows equal in
    id and text are one text, which repeats nothing by standing twice: all of them get the same answer. Other rows that share an id are
    texts of their own, in the order of a hash of the text. Rows without an id are texts of their own too, after all ids. An empty table gives an empty result.
    """
    texts = _keyed(completions, text, carry)
    kind = texts.schema["id"].dataType.simpleString()
    per_row = repeated_runs(texts, span, gram, crowd).groupBy(F.col("id").alias("_id"), F.col("row").alias("_row")).agg(F.collect_set(F.struct("at", "n")).alias("runs"))
    carried = [f"carried_{c}" for c in carry]
    both = texts.join(per_row, F.col("id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left").select("id", "text", "runs", *carried)
    kinds = "".join(f", {c} {texts.schema[c].dataType.simpleString()}" for c in carried)
    found = both.mapInArrow(_cut(kind, span), f"id {kind}, n_bytes bigint, spans array<struct<start bigint, end bigint>>, kept binary{kinds}")
    return found.select("id", "n_bytes", "spans", "kept", *(F.col(f"carried_{c}").alias(c) for c in carry))
