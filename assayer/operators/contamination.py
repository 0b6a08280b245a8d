"""Overlap of documents with benchmark texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def ngrams(tokens: Column, n: int) -> Column:
    """Distinct 64-bit hashes of the word n-grams."""
    grams = F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.xxhash64(F.slice(tokens, i, n)))
    return F.when(F.size(tokens) >= n, F.array_distinct(grams))


def _exploded(rows: DataFrame, key: str, n: int) -> DataFrame:
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    listed = rows.select(key, tokens.alias("tokens"))
    return listed.select(key, F.explode(ngrams(F.col("tokens"), n)).alias("gram"))


def overlap(docs: DataFrame, benchmark: DataFrame, n: int = 8) -> DataFrame:
    """``doc_id, item_id, hits, share``: share of an item's n-grams found in a document.

    Every n-gram is mapped to the set of all items that hold it, so an item inside another one loses nothing. Hits are
    counted per (document, set) first and the sets are expanded after the count, so a gram of many items does not
    multiply the documents' grams. The benchmark side is broadcast by Spark only while it is below the session's limit.
    """
    grams = _exploded(benchmark, "item_id", n)
    owners = grams.groupBy("gram").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    sizes = grams.groupBy("item_id").agg(F.count("*").alias("owned"))
    sets = _exploded(docs, "doc_id", n).join(owners, "gram").groupBy("doc_id", "items").agg(F.count("*").alias("n"))
    hits = sets.select("doc_id", F.explode("items").alias("item_id"), "n").groupBy("doc_id", "item_id").agg(F.sum("n").alias("hits"))
    return hits.join(sizes, "item_id").select("doc_id", "item_id", "hits", (F.col("hits") / F.col("owned")).alias("share"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 8, share: float = 0.5) -> DataFrame:
    """Documents that hold less than ``share`` of every benchmark item."""
    dirty = overlap(docs, benchmark, n).where(F.col("share") >= share).select("doc_id").distinct()
    return docs.join(dirty, "doc_id", "left_anti")
