"""Session helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only where the setting is absent on a local master (tests) is a fresh temporary folder made, and it is then used for the
    whole session. On a cluster a folder of one machine would lose files, so the setting is required there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="assayer-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """New, unused path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting that holds inside the block; the one before, or none, comes back after it."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _batches(spark: SparkSession):
    """Python gets rows in Arrow batches of some 4 MB instead of 64: a batch is held by the executor and by the worker at once, in every task."""
    return _setting(spark, _BATCH, str(BATCH_BYTES))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on reliable storage so iterative plans stay short and survive executor loss."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    with _batches(spark):
        return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the cluster's shared folder and read again: lost executors cost nothing, and its shuffle files are removed at once."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    with _setting(spark, _CLEANUP, "true"), _batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Repartition by a key only when the scan has fewer tasks than the cluster has slots.

    Large inputs come with many splits and pass through unchanged, without a shuffle.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots, key)
