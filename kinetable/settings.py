"""Session settings every job here relies on; all can be changed at run time."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SESSION_SETTINGS = {
    # Parquet timestamps carry no zone.
    "spark.sql.session.timeZone": "UTC",
    # Join sides are never broadcast by hint: Spark measures a side after its
    # shuffle and only then picks a broadcast, so a side that grows with the
    # data falls back to a shuffled join, whose hot partitions are split.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings above to a running session and return it."""
    for key, value in SESSION_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor sees, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="kinetable-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Write an intermediate table once, so the steps that share it do not redo it.

    It lands in the shared folder, where it outlives lost executors.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()
