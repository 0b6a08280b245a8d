"""Classes of similar unit vectors by cross-polytope hashing: tables and hash length follow the number of vectors at a fixed recall."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayer.operators.components import connected_components
from assayer.session import cut_lineage

# A hash is the largest of AXES random projections and its sign. A row of a table costs about as much as ROW_COST comparisons.
AXES, ROW_COST, CROWD, CORE = 64, 50, 2048, 32
_LINKS = "id bigint, leader bigint"


@functools.cache
def agreement(threshold: float, samples: int = 40_000) -> float:
    """Probability, at least, that one hash of two unit vectors with a cosine of ``threshold`` agrees, whatever their dimension.

    Projections of the two on a random axis are normal numbers with that correlation, so the probability is measured on such numbers, three
    standard errors to the safe side.
    """
    rng = np.random.default_rng(1)
    a = rng.standard_normal((samples, AXES))
    b = threshold * a + math.sqrt(max(1 - threshold**2, 0)) * rng.standard_normal((samples, AXES))
    share = float((_largest(a) == _largest(b)).mean())
    return share - 3 * math.sqrt(share * (1 - share) / samples)


def _largest(projections: np.ndarray) -> np.ndarray:
    """Number of the largest projection by size, twice, plus one where it is positive; over the last axis."""
    axis = np.abs(projections).argmax(axis=-1)
    return axis * 2 + (np.take_along_axis(projections, axis[..., None], -1)[..., 0] > 0)


def tables_for(count: int, threshold: float, recall: float) -> tuple[int, int]:
    """Hashes a table and number of tables: a pair at the threshold shares a bucket with probability ``recall``, and rows and comparisons
    of unrelated vectors together cost least at ``count`` vectors."""
    one = agreement(threshold)
    tables = lambda k: math.ceil(math.log(1 - recall) / math.log1p(-min(one**k, 1 - 1e-12)))
    cost = lambda k: tables(k) * (ROW_COST + count / float(2 * AXES) ** k)
    best = min(range(1, 8), key=cost)
    return best, tables(best)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _buckets(hashes: int, tables: int, seed: int):
    """Arrow function from ``id, v`` to one row a table: ``bucket, id, v``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes = None
        for batch in batches:
            step = max(1, (1 << 21) // (hashes * tables * AXES))
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                points = _matrix(part.column("v"))
                if axes is None:
                    axes = np.random.default_rng(seed).standard_normal((points.shape[1], tables * hashes * AXES))
                found = _largest((points @ axes).reshape(len(points), tables, hashes, AXES)).astype(np.int64)
                code = np.broadcast_to(np.arange(tables, dtype=np.int64), (len(points), tables)).copy()
                for k in range(hashes):
                    code = code * (2 * AXES) + found[:, :, k]
                row = np.repeat(np.arange(len(points)), tables)
                yield pa.RecordBatch.from_arrays([pa.array(code.reshape(-1)), part.column("id").take(pa.array(row)), part.column("v").take(pa.array(row))], ["bucket", "id", "v"])
    return run


class Joined:
    """Union of labels; a link is kept only where it joins two."""

    def __init__(self):
        self.over: dict = {}

    def top(self, x):
        while self.over.get(x, x) != x:
            self.over[x] = self.over.get(self.over[x], self.over[x])
            x = self.over[x]
        return x

    def add(self, a, b) -> bool:
        a, b = self.top(a), self.top(b)
        if a != b:
            self.over[a] = b
        return a != b


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    one, two = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64())], ["id", "leader"])


def _inside(threshold: float):
    """Arrow function over rows sorted by bucket: links that join the vectors of each bucket. A bucket is held at a time, in exact cosines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        known = Joined()  # links of one task serve all its buckets
        for batch in batches:
            part = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
            buckets = part.column("bucket").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(buckets[1:] != buckets[:-1]) + 1, [len(buckets)]]) if len(buckets) else np.array([0, 0])
            kept = part.slice(int(edges[-2]))
            if len(edges) > 2:
                yield _links(_met_inside(part.slice(0, int(edges[-2])), edges[:-1], known, threshold))
        if kept is not None and kept.num_rows:
            yield _links(_met_inside(kept, np.array([0, kept.num_rows]), known, threshold))
    return run


def _met_inside(part: pa.Table, edges: np.ndarray, known: Joined, threshold: float) -> list[tuple[int, int]]:
    points, ids, out = _matrix(part.column("v")), part.column("id").to_numpy(), []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a > 1:
            one, two = np.nonzero(np.triu(points[a:b] @ points[a:b].T >= threshold, 1))
            out += [(x, y) for x, y in zip(ids[a + one].tolist(), ids[a + two].tolist()) if known.add(x, y)]
    return out


def _across(threshold: float):
    """Arrow function over a block of rows and a block of members of one bucket: links at the threshold between different labels."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        if left.num_rows and right.num_rows:
            mine, theirs = (t.column("label").to_numpy() for t in (left, right))
            ids, others = left.column("id").to_numpy(), right.column("id").to_numpy()
            one, two = np.nonzero((_matrix(left.column("v")) @ _matrix(right.column("v")).T >= threshold) & (mine[:, None] != theirs[None]))
            known = Joined()
            out = [(int(ids[i]), int(others[j])) for i, j in zip(one.tolist(), two.tolist()) if known.add(mine[i], theirs[j])]
        return pa.Table.from_batches([_links(out)])
    return run


def _faced(rows: DataFrame, members: DataFrame, threshold: float, block: int) -> DataFrame:
    """Links between ``rows`` and ``members`` (``bucket, id, label, v``) of a bucket, dealt into blocks of about ``block`` by a hash of the id."""
    sizes = lambda frame, name: frame.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    parts = cut_lineage(sizes(rows, "rows_n").join(sizes(members, "members_n"), "bucket"))
    dealt = lambda frame, own, other: (frame.join(parts, "bucket").select("bucket", F.pmod(F.xxhash64("id"), F.col(f"{own}_n")).cast("int").alias(own),
                                                                           F.explode(F.sequence(F.lit(0), F.col(f"{other}_n") - 1)).alias(other), "id", "label", "v")
                                          .toDF("bucket", own, other, "id", "label", "v"))  # both sides may come from one table
    keys = ["bucket", "rows", "members"]
    return dealt(rows, "rows", "members").groupBy(*keys).cogroup(dealt(members, "members", "rows").groupBy(*keys)).applyInArrow(_across(threshold), _LINKS)


def _crowded(entries: DataFrame, sizes: DataFrame, links: DataFrame, threshold: float, block: int, core: int) -> DataFrame:
    """Links of buckets with more vectors than a task should compare with each other.

    Every member first meets a core of a few members. Then those in another class than most of their bucket meet all of it. A crowd of
    near copies costs a few comparisons a member, and no link that could join two classes is left out.
    """
    crowd = entries.join(sizes, "bucket")
    few = crowd.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) < F.lit(float(core << 20)) / F.col("n")).select("bucket", "id", F.col("id").alias("label"), "v")
    first = cut_lineage(links.unionByName(_faced(crowd.select("bucket", "id", F.col("id").alias("label"), "v"), few, threshold, block)))
    named = crowd.select("bucket", "id", "v").join(connected_components(first), "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("label"), "v")
    named = cut_lineage(named)
    most = named.groupBy("bucket", "label").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("most"))
    strays = named.join(most, "bucket").where(F.col("label") != F.col("most.label")).select("bucket", "id", "label", "v")
    return first.unionByName(_faced(strays, named, threshold, block))


def classes_of(vectors: DataFrame, threshold: float, recall: float, seed: int = 7, crowd: int = CROWD, core: int = CORE) -> DataFrame:
    """``id, component`` of unit vectors linked by a cosine of at least ``threshold``; vectors without a link are left out.

    ``vectors``: ``id bigint, v array<double>``; vectors of different lengths never meet. A pair at the threshold shares a bucket with
    probability ``recall`` or more; every link is checked in exact cosines inside the task that holds the bucket, which returns only links
    that join two vectors not joined yet. So what is shuffled is a row a table and vector, and pairs never are rows.
    """
    vectors, links = cut_lineage(vectors), None
    for size, count in [(r.size, r["count"]) for r in vectors.groupBy(F.size("v").alias("size")).count().collect()]:  # one row a vector length
        hashes, tables = tables_for(count, threshold, recall)
        entries = vectors.where(F.size("v") == size).mapInArrow(_buckets(hashes, tables, seed), "bucket bigint, id bigint, v array<double>")
        sizes = cut_lineage(entries.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > crowd))
        calm = entries if sizes.isEmpty() else entries.join(sizes, "bucket", "left_anti")
        found = calm.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_inside(threshold), _LINKS)
        found = found if sizes.isEmpty() else _crowded(entries, sizes, cut_lineage(found), threshold, crowd, core)
        links = found if links is None else links.unionByName(found)
    return connected_components(links if links is not None else vectors.select("id", F.col("id").alias("leader")))
