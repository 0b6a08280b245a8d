"""Exact, fuzzy and semantic deduplication."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from assayer.operators.components import bucket_classes
from assayer.operators.crosspolytope import classes_of
from assayer.session import stored

# Documented parameters.
JACCARD, COSINE, RECALL = 0.8, 0.85, 0.9999


def exact_dedup(docs: DataFrame, method: str = "md5") -> DataFrame:
    """``doc_id, keeper, copies``: identical texts share the lowest id, and so do null texts. Counts combine before the shuffle."""
    digest = F.md5("text") if method == "md5" else F.sha2("text", 256)
    groups = docs.groupBy(digest.alias("same")).agg(F.min("doc_id").alias("keeper"), F.count("*").alias("copies"))
    return docs.select("doc_id", digest.alias("digest")).join(groups, F.col("digest").eqNullSafe(F.col("same"))).select("doc_id", "keeper", "copies")


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words in order; null for a null text."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.xxhash64(w))


def shingle_sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple]:
    """``id`` and distinct 64-bit hashes of the word n-grams in order, of each row with words; a shorter text is one shingle."""
    import numpy as np

    lists = batch.column("words")
    words, ends = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
    for key, start, end in zip(batch.column("id").to_pylist(), ends[:-1], ends[1:]):
        if end > start:
            size = min(n, end - start)
            mixed = np.full(end - start - size + 1, size, dtype=np.uint64)
            for k in range(size):
                mixed = (mixed ^ words[start + k:end - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
            yield key, np.unique(mixed.view(np.int64))


def frequent_shingles(worded: DataFrame, n: int, most: int) -> list[int]:
    """About the ``most`` most frequent shingles, the commonest first. Each task counts in a table of bounded size, from which the
    rarest go as it fills (Misra and Gries); the tables are summed."""
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        keys, seen = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        for batch in batches:
            sets = [members for _, members in shingle_sets(batch, n)]
            fresh, times = np.unique(np.concatenate([keys[:0], *sets]), return_counts=True)
            merged, at = np.unique(np.concatenate([keys, fresh]), return_inverse=True)
            seen = np.bincount(at, weights=np.concatenate([seen, times]), minlength=len(merged)).astype(np.int64)
            keys = merged
            if len(keys) > 4 * most:
                seen = seen - np.partition(seen, -4 * most)[-4 * most]
                keys, seen = keys[seen > 0], seen[seen > 0]
        keys, seen = keys[seen > 1], seen[seen > 1]
        if len(keys) > most:
            chosen = np.argpartition(-seen, most)[:most]
            keys, seen = keys[chosen], seen[chosen]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(seen)], names=["shingle", "n"])

    summed = worded.mapInArrow(counts, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    return [r.shingle for r in summed.orderBy(F.desc("n"), "shingle").limit(most).collect()]


def rare_prefixes(worded: DataFrame, n: int, common: list[int], threshold: float) -> DataFrame:
    """``id, size, parity, first``: of each set its size, its rarest members, as many as two sets at the threshold cannot avoid to share
    one of, and one bit a member (about), the parity of the members that fall on it.

    ``common`` lists the most frequent shingles, the commonest first; they come last in the order, whatever else is shared.
    """
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        order = np.argsort(np.asarray(common, dtype=np.int64), kind="stable")
        values = np.asarray(common, dtype=np.int64)[order]
        for batch in batches:
            out = []
            for key, members in shingle_sets(batch, n):
                at = np.minimum(np.searchsorted(values, members), max(len(values) - 1, 0))
                rank = np.where(values[at] == members, len(order) - order[at], 0) if len(values) else np.zeros(len(members), dtype=np.int64)
                kept = len(members) - math.ceil(threshold * len(members) - 1e-9) + 1
                bits = max(64, 1 << (len(members) - 1).bit_length())
                parity = np.packbits(np.bincount(members & (bits - 1), minlength=bits) & 1 == 1, bitorder="little").tobytes()
                out.append((key, len(members), parity, members[np.argsort(rank, kind="stable")[:kept]]))
            columns = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=kind) for c, kind in zip(columns, (batch.schema.field("id").type, pa.int32(), pa.binary(), pa.list_(pa.int64())))],
                                             names=["id", "size", "parity", "first"])

    kind = worded.schema["id"].dataType.simpleString()
    return worded.mapInArrow(prefixes, f"id {kind}, size int, parity binary, first array<bigint>")


def whole_sets(worded: DataFrame, n: int) -> DataFrame:
    """``id, shingles`` of each text with words."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*shingle_sets(batch, n))) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], type=batch.schema.field("id").type), pa.array(columns[1], type=pa.list_(pa.int64()))], names=["id", "shingles"])

    return worded.mapInArrow(sets, f"id {worded.schema['id'].dataType.simpleString()}, shingles array<bigint>")


def may_be_near(threshold: float):
    """Whether two sets can reach the threshold, by sizes and parities: each bit that differs tells of at least one member that is not shared."""
    share = (1 - threshold) / (1 + threshold)

    @F.pandas_udf("boolean")
    def near(size: pd.Series, parity: pd.Series, its_size: pd.Series, its_parity: pd.Series) -> pd.Series:
        out = []
        for m, mine, n, theirs in zip(size, parity, its_size, its_parity):
            a, b = sorted((mine, theirs), key=len)
            wide, bits = int.from_bytes(b, "little"), 8 * len(b)
            while bits > 8 * len(a):
                bits //= 2
                wide = (wide >> bits) ^ (wide & ((1 << bits) - 1))
            out.append((int.from_bytes(a, "little") ^ wide).bit_count() <= share * (m + n) + 1e-6)
        return pd.Series(out, dtype=bool)

    return near


def jaccard_links(worded: DataFrame, sizes: DataFrame, n: int, threshold: float):
    """Verifier by the exact Jaccard similarity of the shingle sets. Sizes and parities go first; whole sets are made only of the texts
    that have a pair left."""
    def verify(pairs: DataFrame) -> DataFrame:
        mine = sizes.select("id", F.col("size").alias("m"), F.col("parity").alias("p"))
        theirs = sizes.select(F.col("id").alias("leader"), F.col("size").alias("n"), F.col("parity").alias("q"))
        kept = pairs.join(mine, "id").join(theirs, "leader").where(may_be_near(threshold)("m", "p", "n", "q"))
        kept = stored(kept.select("id", "leader"), "possible-links")
        needed = stored(kept.select("id").union(kept.select("leader")).distinct(), "needed-texts")
        sets = stored(whole_sets(worded.join(needed, "id", "left_semi"), n), "whole-sets")
        joined = kept.join(sets.select("id", F.col("shingles").alias("s")), "id").join(sets.select(F.col("id").alias("leader"), F.col("shingles").alias("t")), "leader")
        shared = F.size(F.array_intersect("s", "t"))
        return joined.where(shared / (F.size("s") + F.size("t") - shared) >= threshold).select("id", "leader")
    return verify


def fuzzy_dedup(docs: DataFrame, threshold: float = JACCARD, shingle: int = 3, common: int = 65536, among: DataFrame | None = None) -> DataFrame:
    """``doc_id, cluster``: classes of texts whose shingle sets reach the Jaccard threshold, without loss.

    Exact copies collapse first. Two sets at the threshold share one of their first shingles in any common order, so only
    these prefixes are indexed. The order is rare before common: about the ``common`` most frequent shingles, a list of bounded
    size, come last, the others go by hash. Buckets hold the sizes of a few neighbouring steps of a geometric scale. Two entries of a
    bucket only meet if their sizes allow it and what is left of both sets behind them suffices. Every
    link is verified on the whole sets. Texts without words are copies of equal texts only. With ``among``, a stored list of ``doc_id``,
    only these documents take part; the list meets digests and prefixes, so that no text moves for it.
    """
    digests = docs.select("doc_id", F.md5("text").alias("text"))
    if among is not None:
        digests = digests.join(among.select("doc_id"), "doc_id", "left_semi")
    alone = digests.where(F.col("text").isNull()).select("doc_id", F.col("doc_id").alias("keeper"))
    mapping = stored(exact_dedup(digests.where(F.col("text").isNotNull())).select("doc_id", "keeper").unionByName(alone), "exact-copies")
    worded = docs.select(F.col("doc_id").alias("id"), word_hashes(F.col("text")).alias("words"))
    first = rare_prefixes(worded, shingle, frequent_shingles(worded, shingle, common), threshold)
    # Copies are left out here and not before, where their texts would have to move.
    first = stored(first.join(mapping.where(F.col("doc_id") == F.col("keeper")).select(F.col("doc_id").alias("id")), "id", "left_semi"), "rare-prefixes")
    # Step k of a size is its logarithm to the base 1/t, in fours. Sizes that differ by less than the threshold lie in the same or the next
    # four; a set enters the next one only if a larger one there could be its like.
    at = F.log(F.col("size").cast("double")) / F.log(F.lit(1 / threshold)) / 4
    steps = F.array_distinct(F.array(F.floor(at), F.floor(at + 0.25 + 1e-6)))
    entries = first.select("id", "size", F.explode(steps).alias("step"), "first").select("id", "size", "step", F.posexplode("first").alias("place", "shingle"))
    entries = entries.select("id", F.xxhash64("shingle", "step").alias("bucket"), F.struct("size", (F.col("size") - F.col("place")).alias("left")).alias("about"))

    def meets(a: Column, b: Column) -> Column:
        fits = F.least(a["size"], b["size"]) >= threshold * F.greatest(a["size"], b["size"]) - 1e-6
        return fits & ((1 + threshold) * F.least(a["left"], b["left"]) >= threshold * (a["size"] + b["size"]) - 1e-6)

    clusters = bucket_classes(entries, jaccard_links(worded, first, shingle, threshold), meets=meets)
    named = mapping.join(clusters.select(F.col("id").alias("keeper"), "component"), "keeper", "left")
    return named.select("doc_id", F.coalesce("component", "keeper").alias("cluster"))


def unit_vectors(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """``id, v``: vectors of length one in double precision, scaled by their largest component first; null and zero vectors, and those
    with a null, infinite or undefined component, are left out."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    most = F.array_max(F.transform("v", lambda x: F.abs(x)))
    sound = vectors.select(F.col(id).alias("id"), wide.alias("v")).where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    scaled = sound.withColumn("most", most).where("most > 0").select("id", F.transform("v", lambda x: x / F.col("most")).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))
    return scaled.withColumn("length", length).select("id", F.transform("v", lambda x: x / F.col("length")).alias("v"))


def semantic_dedup(vectors: DataFrame, threshold: float = COSINE, recall: float = RECALL) -> DataFrame:
    """``vec_id, cluster``: classes of vectors linked by a cosine of at least ``threshold``, the lowest id naming each.

    Equal vectors collapse first. The others meet in the buckets of hash tables whose number and hash length follow the number of vectors
    (``crosspolytope.classes_of``); ``recall`` is the probability that a pair at the threshold meets. Vectors without a direction stay alone.
    """
    digest = F.xxhash64("embedding")
    keepers = vectors.groupBy(digest.alias("digest"), "embedding").agg(F.min("vec_id").alias("keeper"))
    same = (F.col("d") == F.col("digest")) & F.col("e").eqNullSafe(F.col("embedding"))
    mapping = vectors.select("vec_id", digest.alias("d"), F.col("embedding").alias("e")).join(keepers, same).select("vec_id", F.when(F.col("e").isNull(), F.col("vec_id")).otherwise(F.col("keeper")).alias("keeper"))
    clusters = classes_of(unit_vectors(keepers, "keeper", "embedding"), threshold, recall)
    named = mapping.join(clusters.select(F.col("id").alias("keeper"), "component"), "keeper", "left")
    return named.select("vec_id", F.coalesce("component", "keeper").alias("cluster"))
