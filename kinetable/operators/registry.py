"""Registry, job and worker tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEARTBEAT_SECONDS = 30


def prune_vanished(datasets: DataFrame, live: DataFrame, cells: DataFrame) -> DataFrame:
    """Registry without rows of the scanned cells whose path is gone."""
    scanned = datasets.join(cells.select("cell_name").distinct(), "cell_name", "left_semi")
    gone = scanned.join(live.select("path"), "path", "left_anti").select("path")
    return datasets.join(gone, "path", "left_anti")


def changed_datasets(live: DataFrame, stored: DataFrame) -> DataFrame:
    """Live datasets whose change time is not stored or differs from the stored one."""
    old = stored.select("path", F.col("info_mtime").alias("_old"))
    return live.join(old, "path", "left").where(
        F.col("_old").isNull() | ~F.col("_old").eqNullSafe(F.col("info_mtime"))).drop("_old")


def list_jobs(
    jobs: DataFrame, *, type: str | None = None, status: str | None = None,
    dataset_id: int | None = None, since: str | None = None, limit: int | None = None,
) -> DataFrame:
    """Newest jobs first, each condition optional; all of them without a limit."""
    if type is not None:
        jobs = jobs.where(F.col("type") == type)
    if status is not None:
        jobs = jobs.where(F.col("status") == status)
    if dataset_id is not None:
        jobs = jobs.where(F.get_json_object("payload", "$.dataset_id") == str(dataset_id))
    if since is not None:
        jobs = jobs.where(F.col("updated_at") >= F.to_timestamp(F.lit(since)))
    newest = jobs.orderBy(F.desc("id"))
    return newest if limit is None else newest.limit(limit)


def worker_status(
    controls: DataFrame, heartbeats: DataFrame, as_of: Column, ttl: int = HEARTBEAT_SECONDS
) -> DataFrame:
    """Workers with their last heartbeat; stale without one or when it is too old."""
    age = F.unix_micros(as_of) - F.unix_micros("last_beat_at")
    return controls.join(heartbeats, "worker_id", "left").withColumn(
        "stale", F.coalesce(age > ttl * 1_000_000, F.lit(True)))
