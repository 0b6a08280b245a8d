"""A training corpus from raw documents: language, near copies, repeated passages, benchmark leaks, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer.llm import crossparse, minhash, packing, suffixes, winnowing
from assayer.llm.queries import fold, read, tokenizer_file
from assayer.llm.stored import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _key():
    """The number of a document; one without a number goes by its text, under a key above 2**62, which no numbering reaches."""
    return F.coalesce("doc_id", F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 2))


def _without(docs: DataFrame, gone: DataFrame, label: str) -> DataFrame:
    """Documents whose key is not in ``gone``; the list is stored first, so that Spark knows its size and can leave the texts in place."""
    listed = stored(gone.select(F.col("id").alias("_gone")), label)
    return docs.join(listed, _key() == F.col("_gone"), "left_anti").select(*COLUMNS)


def _once(docs: DataFrame) -> DataFrame:
    """Every document once: rows equal in key and text collapse. Keys and hashes alone are counted; texts move only where rows repeat."""
    hashed = docs.withColumn("_key", _key()).withColumn("_hash", F.xxhash64("text"))
    again = stored(hashed.groupBy("_key", "_hash").agg(F.count("*").alias("n")).where("n > 1").select("_key", "_hash"), "repeated-rows")
    if again.isEmpty():
        return docs
    single = hashed.join(again, ["_key", "_hash"], "left_anti").select(*COLUMNS)
    several = hashed.join(again, ["_key", "_hash"], "left_semi").groupBy("_key", "_hash").agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return single.unionByName(several.select("row.*"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(_key().alias("id"), "text")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters; null texts and texts without letters (``und``) go. A text in a language or script that no label teaches
    gets the nearest label and stays."""
    samples = crossparse.language_samples(docs.where(fold(3) != 1), text="text")
    found = crossparse.identify_language(_texts(docs), samples, text="text")
    return _without(docs, found.where("lang_pred = 'und'"), "unknown-language")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The lowest document of every class of near copies; a document whose row stands several times stays once."""
    docs = _once(docs)
    return _without(docs, minhash.near_classes(_texts(docs)).where("id <> keeper"), "near-copies")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 100 bytes that stand earlier in the corpus; a text of nothing else goes. Bytes of a cut character go with its passage."""
    found = suffixes.drop_repeats(docs.select(F.col("doc_id").alias("id"), "text", "lang", "source"), carry=("lang", "source")).where("n_bytes = 0 or length(kept) > 0")
    whole = F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("�"), F.lit(""))
    text = F.when(F.size("spans") > 0, whole).otherwise(F.col("kept").cast("string"))
    kept = found.select(F.col("id").alias("doc_id"), text.alias("text"), "lang", "source")
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten-word window with the benchmark."""
    bench = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return _without(docs, winnowing.contamination(_texts(docs), bench, text="text").where("n_hit > 0"), "leaks")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs.select(F.col("doc_id").alias("id"), "text"), tokenizer_file("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES = [("language", language), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("benchmark_leaks", benchmark_leaks), ("packed", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each stored before the next reads it."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


# SQL cannot express the language, near-copy and packing stages; tests compare every stage with brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": (run, ORACLE_SQL)}
