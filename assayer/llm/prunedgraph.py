"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard, searched with a beam."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from assayer.session import scratch_path

SHARD, DEGREE, BEAM, SLACK, BLOCK, SEED = 2000, 32, 64, 1.2, 1000, 11


def greedy_search(points: np.ndarray, edges: np.ndarray, queries: np.ndarray, start: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest nodes met for every query (columns by distance), and their squared distances; -1 where fewer were met.

    All queries walk side by side: each step opens the nearest node of a beam that is not open yet and adds its neighbours. A walk ends
    when every node of its beam is open. ``edges`` holds the neighbours of every node, padded with -1.
    """
    n, width = len(queries), edges.shape[1]
    nodes = np.full((n, beam), -1, dtype=np.int64)
    far = np.full((n, beam), np.inf)
    opened = np.zeros((n, beam), dtype=bool)
    nodes[:, 0], far[:, 0] = start, ((queries - points[start]) ** 2).sum(axis=1)
    seen = np.zeros((n, len(points)), dtype=bool)
    seen[:, start] = True
    active = np.arange(n)
    while len(active):
        waiting = np.where(opened[active] | (nodes[active] < 0), np.inf, far[active])
        best = waiting.argmin(axis=1)
        going = np.isfinite(waiting[np.arange(len(active)), best])
        active, best = active[going], best[going]
        if not len(active):
            break
        opened[active, best] = True
        near = edges[nodes[active, best]]
        rows = np.repeat(active, width).reshape(near.shape)
        fresh = (near >= 0) & ~seen[rows, near]
        seen[rows[fresh], near[fresh]] = True
        distance = np.full(near.shape, np.inf)
        who, which = np.nonzero(fresh)
        distance[who, which] = ((queries[active[who]] - points[near[who, which]]) ** 2).sum(axis=1)
        all_far = np.concatenate([far[active], distance], axis=1)
        order = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
        take = lambda a, b: np.take_along_axis(np.concatenate([a, b], axis=1), order, axis=1)
        nodes[active] = take(nodes[active], np.where(fresh, near, -1))
        opened[active] = take(opened[active], np.zeros(near.shape, dtype=bool))
        far[active] = np.take_along_axis(all_far, order, axis=1)
    return nodes, far


def robust_prune(points: np.ndarray, node: int, candidates: np.ndarray, degree: int, slack: float) -> np.ndarray:
    """Diverse neighbours: the nearest candidate stays and drops every candidate that is ``slack`` times nearer to it than to the node."""
    candidates = np.unique(candidates[(candidates >= 0) & (candidates != node)])
    distance = ((points[candidates] - points[node]) ** 2).sum(axis=1)
    order = np.argsort(distance, kind="stable")
    candidates, distance = candidates[order], distance[order]
    between = points[candidates] @ points[candidates].T
    norms = np.diag(between)
    between = norms[:, None] + norms[None, :] - 2 * between
    alive, kept = np.ones(len(candidates), dtype=bool), []
    for k in range(len(candidates)):
        if alive[k]:
            kept.append(k)
            if len(kept) == degree:
                break
            alive &= slack * slack * between[k] > distance
    return candidates[kept]


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, slack: float = SLACK, seed: int = SEED) -> tuple[np.ndarray, int]:
    """Edges (nodes, degree; -1 where unused) and the start node of a shard's graph.

    From a random graph, every point searches for itself and keeps a pruned set of the nodes it met; the reverse edges are added and
    pruned again. A first pass prunes strictly, a second with ``slack``, in groups of points that double in size.
    """
    n = len(points)
    rng = np.random.default_rng(seed)
    edges = np.full((n, degree), -1, dtype=np.int64)
    for node in range(n):
        some = rng.choice(n, size=min(degree // 2, n), replace=False)
        some = some[some != node]
        edges[node, :len(some)] = some
    start = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin()) if n else 0
    for relaxed in (1.0, slack):
        order, at, group = rng.permutation(n), 0, 64
        while at < n:
            own = order[at:at + group]
            met, _ = greedy_search(points, edges, points[own], start, beam)
            back: dict[int, list[int]] = {}
            for node, found in zip(own.tolist(), met):
                kept = robust_prune(points, node, np.concatenate([found, edges[node]]), degree, relaxed)
                edges[node] = -1
                edges[node, :len(kept)] = kept
                for other in kept.tolist():
                    back.setdefault(other, []).append(node)
            for node, more in back.items():
                both = np.unique(np.concatenate([edges[node][edges[node] >= 0], more]))
                if len(both) > degree:
                    both = robust_prune(points, node, both, degree, relaxed)
                edges[node] = -1
                edges[node, :len(both)] = both
            at, group = at + group, min(group * 2, 512)
    return edges, start


def nearest(vectors: DataFrame, queries: DataFrame, neighbours: int = 5, shard: int = SHARD, degree: int = DEGREE, beam: int = BEAM, slack: float = SLACK, block: int = BLOCK) -> DataFrame:
    """The nearest vectors of every query by cosine, found by graph search.

    ``vectors`` and ``queries`` hold ``vec_id`` and ``embedding``; further columns are ignored. The reference project keeps no vectors, so the
    operator is general. Returns ``query_id, rank, vec_id, score``: up to ``neighbours`` rows per query, nearest first, equal scores by the smaller
    ``vec_id``; a query never finds its own id. ``score`` is the cosine of the original vectors in double precision.

    Equal vectors share one node that remembers the smallest ids only, as many as a result can show, so a vector that fills a third of the
    table costs one node. Nodes are dealt by hash into shards of about ``shard``; each shard builds a robust-pruned graph in its task, and
    the graphs are stored. Queries are searched in blocks of ``block`` against each shard with a beam of ``beam`` nodes.

    Null or empty vectors, zero vectors and those with null or non-finite components take no part, neither as query nor as candidate; vectors
    meet only those of their own dimension; a query with too few candidates gets fewer rows; empty tables give an empty result.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    as_double = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    usable = lambda frame: frame.select("vec_id", as_double.alias("embedding")).where(F.coalesce(sound, F.lit(False)) & F.col("vec_id").isNotNull())
    rows = usable(vectors)
    digest = F.sha2(F.array_join(F.transform("embedding", lambda x: x.cast("string")), ","), 256)
    keyed = rows.withColumn("digest", digest)
    first = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("digest").orderBy("vec_id"))).where(F.col("nth") <= neighbours + 1)
    stored = scratch_path(spark, "nodes")
    first.write.parquet(stored)
    first = spark.read.parquet(stored)
    nodes = first.where("nth = 1").select("digest", "embedding", F.size("embedding").alias("dim"))
    count = nodes.count()
    shards = max(1, round(count / shard))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("digest", ignore_index=True)
        points = np.stack(part["embedding"].to_numpy())
        edges, start = build_graph(points / np.sqrt((points ** 2).sum(axis=1, keepdims=True)), degree, beam, slack)
        return pd.DataFrame({"shard": part["shard"], "dim": part["dim"], "digest": part["digest"], "embedding": part["embedding"], "edges": list(edges.astype(np.int32)), "start": np.arange(len(part)) == start})

    graph_path = scratch_path(spark, "graph")
    (dealt.groupBy("shard", "dim").applyInPandas(build, "shard int, dim int, digest string, embedding array<double>, edges array<int>, start boolean").write.parquet(graph_path))
    graph = spark.read.parquet(graph_path)
    asked = usable(queries).withColumn("digest", digest)
    distinct = asked.groupBy("digest").agg(F.first("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))
    blocks = max(1, -(-distinct.count() // block))
    facing = distinct.withColumn("block", F.pmod(F.xxhash64("digest", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    held = graph.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(part: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(wanted):
            return pd.DataFrame({"query": [], "digest": [], "score": []})
        part = part.sort_values("digest", ignore_index=True)
        raw, asked_raw = np.stack(part["embedding"].to_numpy()), np.stack(wanted["embedding"].to_numpy())
        norm, asked_norm = np.sqrt((raw ** 2).sum(axis=1)), np.sqrt((asked_raw ** 2).sum(axis=1))
        met, _ = greedy_search(raw / norm[:, None], np.stack(part["edges"].to_numpy()).astype(np.int64), asked_raw / asked_norm[:, None], int(np.flatnonzero(part["start"])[0]), beam)
        who, which = np.nonzero(met >= 0)
        node = met[who, which]
        score = np.einsum("ij,ij->i", asked_raw[who], raw[node]) / (asked_norm[who] * norm[node])
        found = pd.DataFrame({"query": wanted["digest"].to_numpy()[who], "digest": part["digest"].to_numpy()[node], "score": score})
        # Ties at the edge stay, so that the ids decide them.
        return found[found.groupby("query")["score"].rank(method="min", ascending=False) <= neighbours + 1]

    shape = "query string, digest string, score double"
    found = held.groupBy("shard", "block", "dim").cogroup(facing.groupBy("shard", "block", "dim")).applyInPandas(search, shape)
    best = found.withColumn("place", F.rank().over(Window.partitionBy("query").orderBy(F.desc("score")))).where(F.col("place") <= neighbours + 1).drop("place")
    named = best.join(first.select("digest", "vec_id"), "digest").select("query", "vec_id", "score")
    per_query = named.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("nth") <= neighbours + 1).drop("nth")
    answers = asked.select(F.col("vec_id").alias("query_id"), F.col("digest").alias("query")).join(per_query, "query").where(F.col("query_id") != F.col("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= neighbours)
