"""Run history with one line per run, whatever is repeated or breaks off: rows are staged, and a manifest makes them count."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _write_whole(spark: SparkSession, path: str, text: str) -> None:
    """File that is there with all its text or not at all: written beside its place, then renamed. A file in its place stays."""
    system, place = _files(spark, path)
    if system.exists(place):
        return
    _, beside = _files(spark, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
    out = system.create(beside)
    out.write(bytearray(text, "utf-8"))
    out.close()
    if not system.rename(beside, place):  # somebody else was first
        system.delete(beside, False)


def append_history(summary: DataFrame, path: str) -> None:
    """Append run summaries. A run of a day counts once: the first append that ends wins, a repeated or half-written one changes nothing.

    ``summary``: ``run, run_date`` and further columns. Rows go to a folder of their own below ``path/runs``; then a manifest for each run, named by
    a digest of run and day, points to it. Readers follow the manifests (``read_history``).
    """
    spark, name = summary.sparkSession, uuid.uuid4().hex
    summary.write.parquet(f"{path}/runs/{name}")
    for row in spark.read.parquet(f"{path}/runs/{name}").select("run", F.col("run_date").cast("string").alias("run_date")).distinct().collect():  # runs of one append
        key = hashlib.md5(json.dumps([row.run, row.run_date]).encode()).hexdigest()
        _write_whole(spark, f"{path}/commits/{key}.json", json.dumps({"run": row.run, "run_date": row.run_date, "files": name}))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all committed runs; rows without a manifest are not there."""
    system, place = _files(spark, f"{path}/commits")
    if not system.exists(place) or not any(not f.getPath().getName().startswith(".") for f in system.listStatus(place)):
        raise FileNotFoundError(f"no run is committed below {path}")
    commits = spark.read.schema("run string, run_date string, files string").json(f"{path}/commits/*.json")
    known = commits.select(F.col("run").alias("_run"), F.col("run_date").alias("_date"), F.col("files").alias("_files"))
    rows = spark.read.option("mergeSchema", True).parquet(*[f"{path}/runs/{r.files}" for r in commits.select("files").distinct().collect()])  # folders of the history
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    held = rows.withColumn("_folder", folder)
    return held.join(known, F.col("run").eqNullSafe(F.col("_run")) & F.col("run_date").cast("string").eqNullSafe(F.col("_date")) & (F.col("_folder") == F.col("_files"))).drop("_run", "_date", "_files", "_folder")
