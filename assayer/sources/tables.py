"""Readers and writers of puzzles, chats, evaluation dumps, history and general formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from assayer.functions.markers import COMMON_WORDS
from assayer.functions.text import route_type
from assayer.operators.joins import first_per_key
from assayer.session import scratch_path
from assayer.sources.splits import csv_records, json_elements

CHAT_SCHEMA = T.StructType([
    T.StructField("messages", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))),
    T.StructField("_meta", T.StructType([
        T.StructField("source", T.StringType()), T.StructField("puzzle_type", T.StringType()), T.StructField("rule_kinds", T.ArrayType(T.StringType())),
        T.StructField("difficulty", T.StringType()), T.StructField("is_unique_rule", T.BooleanType()), T.StructField("unique_bit_count", T.IntegerType())])),
])


def read_puzzles(spark: SparkSession, path: str, first_per_answer: bool = False) -> DataFrame:
    """Quoted multi-line CSV of ``id, prompt, answer`` with the routed type; optionally the first row per (type, answer).

    Files have a header line. One file is read by several tasks (``splits.csv_records``); blank records are skipped.
    """
    records = csv_records(spark, path).where((F.col("start") > 0) | (F.col("at") > 0)).where(F.trim("text") != "")
    cells = F.from_csv("text", F.lit("id string, prompt string, answer string"), {"quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"})
    typed = records.select(cells.alias("row")).select("row.*").withColumn("type", route_type(F.col("prompt")))
    return first_per_key(typed, ["type", "answer"], "id") if first_per_answer else typed


def write_puzzles(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def read_chats(spark: SparkSession, path: str) -> DataFrame:
    """One chat per line; blank and malformed lines are dropped, missing tags become ``unknown`` or empty."""
    rows = spark.read.schema(CHAT_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    meta = F.col("_meta")
    return rows.select("messages", F.coalesce(meta["source"], F.lit("unknown")).alias("source"), F.coalesce(meta["puzzle_type"], F.lit("unknown")).alias("type"),
                       F.coalesce(meta["rule_kinds"], F.array().cast("array<string>")).alias("rule_kinds"))


def write_chats(rows: DataFrame, clean: str, full: str) -> None:
    """Messages only as JSON lines, and everything as Parquet; the second is written first and read back for the first,
    so the dataset is computed once."""
    rows.write.parquet(full)
    rows.sparkSession.read.parquet(full).select("messages").write.json(clean)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation dump as rows: documents with ``rows`` (wrapped) and bare lists of row objects, also mixed in one folder, a document a file.

    One document is read by several tasks (``splits.json_elements``); its rows are kept as compressed JSON lines in the shared folder, from
    which Spark infers their columns.
    """
    lines = scratch_path(spark, "dump-rows")
    json_elements(spark, path).select("text").write.option("compression", "lz4").text(lines)
    return spark.read.json(lines)


def summarise_run(rows: DataFrame, run: str, run_date: str, external_score: float | None = None) -> DataFrame:
    """One history line of a run: totals and a map of per-type counters. ``rows``: ``type, ok``."""
    per_type = rows.groupBy("type").agg(F.count("*").alias("n"), F.count_if("ok").alias("correct"))
    entry = F.struct("type", F.struct("correct", "n", (F.col("correct") / F.col("n")).alias("acc")).alias("cell"))
    # The types of a run are a short fixed list, so the collected map stays small whatever the number of rows.
    return per_type.agg(F.lit(run).alias("run"), F.sum("n").alias("n_samples"), (F.sum("correct") / F.sum("n")).alias("local_total_acc"),
                        F.lit(external_score).cast("double").alias("external_score"), F.map_from_entries(F.collect_list(entry)).alias("per_type"),
                        F.lit(run_date).alias("run_date"))


def read_vocabulary(spark: SparkSession, path: str, fallback: Sequence[str] = COMMON_WORDS) -> DataFrame:
    """Distinct trimmed lower-case lines together with a fallback list."""
    lines = spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where(F.col("word") != "")
    return lines.union(spark.createDataFrame([(w,) for w in fallback], "word string")).distinct()


def first_existing(spark: SparkSession, patterns: Sequence[str]) -> str | None:
    """First path, in pattern order and then by name, that exists on the session's file systems."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    seen: set[str] = set()
    for pattern in patterns:
        path = jvm.org.apache.hadoop.fs.Path(pattern)
        matches = path.getFileSystem(conf).globStatus(path)
        for name in sorted(str(m.getPath()) for m in (matches or [])):
            if name not in seen:
                seen.add(name)
                return name
    return None


def read_first_match(spark: SparkSession, patterns: Sequence[str]) -> DataFrame:
    path = first_existing(spark, patterns)
    if path is None:
        raise FileNotFoundError(f"none of {list(patterns)} exists")
    return read_chats(spark, path)


def read_table(spark: SparkSession, path: str, kind: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return {"parquet": reader.parquet, "json": reader.json, "csv": reader.option("header", True).csv}[kind](path)


def write_table(rows: DataFrame, path: str, kind: str) -> None:
    writer = rows.write.option("header", True) if kind == "csv" else rows.write
    getattr(writer, kind)(path)


def from_items(spark: SparkSession, items: Sequence[dict], schema: str) -> DataFrame:
    return spark.createDataFrame(list(items), schema)


def from_range(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n)


def from_pandas(spark: SparkSession, frame) -> DataFrame:
    return spark.createDataFrame(frame)
