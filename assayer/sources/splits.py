"""Records of quoted CSV files and of JSON arrays, read by several tasks a file.

Spark's text reader cuts a file at any byte range and deals whole lines (or whole pieces that end with ``}``) to its tasks. Whether a cut
lies inside quotes, and how deep inside brackets, is unknown to the task behind it. So a first pass summarises every range, the summaries
are folded in file order - one short row a range - and a second pass cuts records knowing the state at its start. Only a record that lies
across a cut, two fragments a range at most, is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from assayer.session import stored

_RANGE = ["file", "start"]
WHOLE, HEAD, THROUGH, TAIL = 0, 1, 2, 3


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """``file, start, at, value``: pieces between separators, the byte range they were dealt in and their order."""
    rows = spark.read.option("lineSep", separator).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value")


def _ordered(pieces: DataFrame, states: DataFrame) -> DataFrame:
    """Pieces with the state at the start of their range, in order. The states are one row a range, and stored, so that Spark knows their
    size: it sends them to the pieces while they are below its limit, and deals both out by range beyond it; the order holds either way."""
    return pieces.join(states, _RANGE).sortWithinPartitions(*_RANGE, "at")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _packed(rows: Iterator[tuple], schema: pa.Schema, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about ``size`` characters of the last column."""
    held, used = [], 0
    for row in rows:
        held.append(row)
        used += len(row[-1] or "") + 64
        if used > size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, used = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _mapped(pieces: DataFrame, function: Callable[[Iterator[tuple]], Iterator[tuple]], fields: list[tuple[str, pa.DataType]]) -> DataFrame:
    names = {pa.string(): "string", pa.int64(): "bigint", pa.int32(): "int", pa.bool_(): "boolean"}
    schema = pa.schema(fields)
    return pieces.mapInArrow(lambda batches: _packed(function(_rows(batches)), schema), ", ".join(f"{n} {names[t]}" for n, t in fields))


_PARTS = [("file", pa.string()), ("start", pa.int64()), ("at", pa.int64()), ("inside", pa.bool_()), ("kind", pa.int32()), ("text", pa.string())]


def _stitched(parts: DataFrame, glue: str) -> DataFrame:
    """``file, start, at, inside, text``: whole records, and fragments joined to the record they belong to. ``parts`` is read twice; only
    fragments meet again, keyed by the range in which their record begins."""
    cut = parts.where(F.col("kind") != WHOLE)
    order = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = cut.withColumn("owner", F.last(F.when(F.col("kind") == TAIL, F.struct("start", "at", "inside")), ignorenulls=True).over(order))
    # A record ends with its first head; what follows up to the next tail belongs to no record.
    ended = F.coalesce(F.sum((F.col("kind") == HEAD).cast("int")).over(Window.partitionBy("file", "owner").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    owned = owned.where("owner is not null").withColumn("ended", ended).where("ended = 0")
    joined = owned.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "text"))).alias("held"))
    text = F.array_join(F.transform("held", lambda p: p["text"]), glue)
    whole = parts.where(F.col("kind") == WHOLE).select("file", "start", "at", "inside", "text")
    return whole.unionByName(joined.select("file", "owner.start", "owner.at", "owner.inside", text.alias("text")))


class _Cutter:
    """Record under construction of one range: pieces so far, whether it began in this range, and the number of records before."""

    def __init__(self, key: tuple, open_: bool):
        self.key, self.held, self.began, self.n, self.inside = key, [], not open_, 0, None

    def close(self, glue: str) -> tuple:
        out = (*self.key, self.n, self.inside, WHOLE if self.began else HEAD, glue.join(self.held))
        self.held, self.began, self.n = [], True, self.n + 1
        return out

    def rest(self, glue: str) -> list[tuple]:
        return [(*self.key, self.n, self.inside, TAIL if self.began else THROUGH, glue.join(self.held))] if self.held else []


def _csv_records(rows: Iterator[tuple]) -> Iterator[tuple]:
    cutter, quoted = None, False
    for file, start, _, line, odd in rows:
        if cutter is None or cutter.key != (file, start):
            yield from cutter.rest("\n") if cutter else ()
            cutter, quoted = _Cutter((file, start), odd), odd
        cutter.held.append(line)
        quoted ^= line.count('"') & 1 == 1
        if not quoted:
            yield cutter.close("\n")
    yield from cutter.rest("\n") if cutter else ()


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, start, at, text``: records of CSV files with quoted line ends, one file by as many tasks as Spark has ranges for it.

    A record ends at a line end outside quotes, which an even number of quotes before it tells (a quote in a quoted field is doubled). ``at``
    numbers the records of a range, so ``start = 0 and at = 0`` is the first of its file. A carriage return before the line end goes.
    """
    lines = _pieces(spark, path, "\n")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    parity = lines.groupBy(*_RANGE).agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    states = stored(parity.select(*_RANGE, (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("odd")), "range-states")
    parts = _mapped(_ordered(lines, states), _csv_records, _PARTS)
    return _stitched(parts, "\n").select("file", "start", "at", F.regexp_replace("text", "\r$", "").alias("text"))


_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*("?)|[\[\]{}]', re.S)
_STRING_END = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
_BLANK = "\ufeff \t\r\n"


def _tokens(piece: str, quoted: bool) -> tuple[list[tuple[str, int]], bool]:
    """Brackets and strings with their places, outside the string that a piece begins in, and whether the piece ends inside a string."""
    at = 0
    if quoted:
        end = _STRING_END.match(piece)
        if end is None:
            return [], True
        at = end.end()
    found = list(_TOKEN.finditer(piece, at))
    return [(t[0], t.start()) for t in found], bool(found) and found[-1][0][0] == '"' and not found[-1][1]


def _json_summary(rows: Iterator[tuple]) -> Iterator[tuple]:
    """A row a range: for a start outside and inside a string, whether it ends inside one and by how much the depth grows; the first bracket."""
    key, state, first = None, None, None
    for file, start, _, piece in rows:
        if key != (file, start):
            if key is not None:
                yield (*key, state[0][0], state[0][1], state[1][0], state[1][1], first)
            key, state, first = (file, start), [[False, 0], [True, 0]], None
        first = first or piece.strip(_BLANK)[:1] or None
        for way in state:
            found, way[0] = _tokens(piece, way[0])
            way[1] += sum((token in "[{") - (token == "]") for token, _ in found) - (not way[0])
    if key is not None:
        yield (*key, state[0][0], state[0][1], state[1][0], state[1][1], first)


def _json_states(rows: Iterator[tuple]) -> Iterator[tuple]:
    """State at the start of every range, from the summaries in file order: inside a string, depth, and the depth of the rows' array."""
    file, quoted, depth, level = None, False, 0, 1
    for name, start, out_quoted, out_depth, in_quoted, in_depth, first in rows:
        if name != file:
            file, quoted, depth, level = name, False, 0, 2 if first == "{" else 1
        yield name, start, quoted, depth, level, None
        quoted, depth = (in_quoted, depth + in_depth) if quoted else (out_quoted, depth + out_depth)


def _json_elements(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Objects of the array at the level of the rows. ``inside`` tells whether that array is the right one; null: as at the start of the range.
    A last row of each range, without text, tells the same for its end."""
    cutter, quoted, depth, level, right = None, False, 0, 1, None

    def done():
        if cutter is not None:
            yield from cutter.rest("}")
            yield (*cutter.key, -1, right, WHOLE, None)

    for file, start, _, piece, was_quoted, was_depth, its_level in rows:
        if cutter is None or cutter.key != (file, start):
            yield from done()
            quoted, depth, level, right = was_quoted, was_depth, its_level, None
            cutter = _Cutter((file, start), depth > level)
        begin, name = 0 if depth > level else None, ""
        found, quoted = _tokens(piece, quoted)
        for token, at in found:
            if token in "[{":
                if token == "[" and depth == level - 1:
                    right = level == 1 or name == '"rows"'
                elif token == "{" and depth == level and begin is None:
                    begin, cutter.inside = at, right
                depth += 1
            elif token == "]":
                depth -= 1
                if depth == level - 1:
                    right = False
                elif depth == level and begin is not None:
                    # What was open at the start of the range was another list, not a row.
                    begin, cutter.held, cutter.began = None, [], True
            elif depth == 1:
                name = token
        if begin is not None:
            cutter.held.append(piece[begin:])
        depth -= not quoted
        if begin is not None and not quoted and depth == level:
            file_, start_, n, inside, kind, text = cutter.close("}")
            yield file_, start_, n, inside, kind, text + "}"
    yield from done()


def json_elements(spark: SparkSession, path: str) -> DataFrame:
    """``file, start, at, text``: the row objects of evaluation dumps, of a bare list or of the list under ``rows`` in an object, one dump a
    file. A dump without line ends is cut at its braces, so one large file is read by many tasks. Line ends inside objects become blanks."""
    pieces = _pieces(spark, path, "}")
    summary = _mapped(pieces, _json_summary, [("file", pa.string()), ("start", pa.int64()), ("out_quoted", pa.bool_()), ("out_depth", pa.int64()),
                                              ("in_quoted", pa.bool_()), ("in_depth", pa.int64()), ("first", pa.string())])
    in_order = summary.repartition("file").sortWithinPartitions(*_RANGE)
    states = _mapped(in_order, _json_states, [("file", pa.string()), ("start", pa.int64()), ("quoted", pa.bool_()), ("depth", pa.int64()), ("level", pa.int64()), ("none", pa.string())])
    parts = stored(_mapped(_ordered(pieces, stored(states.drop("none"), "range-states")), _json_elements, _PARTS), "dump-parts")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ends = stored(parts.where("at < 0").select(*_RANGE, F.coalesce(F.last("inside", ignorenulls=True).over(before), F.lit(False)).alias("entered")), "range-ends")
    found = _stitched(parts.where("at >= 0"), "}")
    known = found.where("inside is not null").unionByName(found.where("inside is null").join(ends, _RANGE).withColumn("inside", F.col("entered")).drop("entered"))
    return known.where("inside").select("file", "start", "at", F.translate("text", "\r\n", "  ").alias("text"))
