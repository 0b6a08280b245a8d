"""User-defined aggregates by group that combine before they meet, so that no task sees the rows of a whole group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

ROOM, SALTS = 10_000, 32


def map_groups(rows: DataFrame, keys: list[str], partial: Callable[[pa.Table], dict], merge: Callable[[dict, dict], dict], finish: Callable[[dict], dict],
               state: str, result: str, salts: int = SALTS) -> DataFrame:
    """``keys`` and ``result`` of every group: ``finish`` of the merged states that ``partial`` makes of Arrow tables of a group's rows.

    ``partial`` sees some rows of a group, never all of them by promise, and returns a state with the fields of ``state`` (DDL); ``merge``
    of two states must not depend on their order. A task holds a state for each of ``ROOM`` groups at most, then passes them on. States of a group
    meet in ``salts`` parts first. Null keys are a group; an empty table has no groups.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    fields, out = StructType.fromDDL(state).fieldNames(), StructType.fromDDL(result).fieldNames()
    partial_kind, final_kind = to_arrow_schema(StructType.fromDDL(f"{shape}, {state}")), to_arrow_schema(StructType.fromDDL(f"{shape}, {result}"))

    def table(states: dict, kind: pa.Schema) -> pa.Table:
        return pa.Table.from_pylist([dict(zip(keys, key)) | value for key, value in states.items()], kind)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, dict] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            # Rows by the number of their group, in one sort.
            numbered = pa.Table.from_batches([batch]).append_column("_row", pa.array(range(batch.num_rows)))
            groups = numbered.group_by(keys, use_threads=False).aggregate([("_row", "list")])
            for group in groups.to_pylist():
                key = tuple(group[k] for k in keys)
                new = partial(pa.Table.from_batches([batch.take(pa.array(group["_row_list"]))]))
                held[key] = merge(held[key], new) if key in held else new
            if len(held) > ROOM:
                yield from table(held, partial_kind).to_batches()
                held = {}
        yield from table(held, partial_kind).to_batches()

    def joined(part: pa.Table) -> tuple[tuple, dict]:
        listed = part.to_pylist()
        total = {f: listed[0][f] for f in fields}
        for row in listed[1:]:
            total = merge(total, {f: row[f] for f in fields})
        return tuple(listed[0][k] for k in keys), total

    def again(part: pa.Table) -> pa.Table:
        key, total = joined(part)
        return table({key: total}, partial_kind)

    def last(part: pa.Table) -> pa.Table:
        key, total = joined(part)
        return table({key: {f: v for f, v in finish(total).items() if f in out}}, final_kind)

    states = rows.mapInArrow(first, f"{shape}, {state}")
    salted = states.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    fewer = salted.groupBy(*keys, "_salt").applyInArrow(lambda part: again(part), f"{shape}, {state}")
    return fewer.groupBy(*keys).applyInArrow(lambda part: last(part), f"{shape}, {result}")
