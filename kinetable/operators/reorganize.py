"""Split, delete, sync, merge and reindex datasets; files and videos they refer to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.functions import playback
from kinetable.functions.serials import serial_join_key
from kinetable.operators.ordered import int_block, ordered_scan, row_position
from kinetable.settings import checkpointed

EP = ("dataset_key", "episode_index")
CHUNK_SIZE = 1000


def semi_select(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (episodes or frames) of the listed episodes."""
    return rows.join(ids.select(*EP).distinct(), list(EP), "left_semi")


def anti_delete(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (episodes or frames) of all other episodes."""
    return rows.join(ids.select(*EP).distinct(), list(EP), "left_anti")


def sync_new_episodes(selected: DataFrame, destination: DataFrame) -> DataFrame:
    """Selected episodes whose serial the destination does not hold yet."""
    keyed = selected.withColumn("_jk", serial_join_key(F.col("Serial_number"), *map(F.col, EP)))
    there = destination.where(F.coalesce(F.col("Serial_number") != "", F.lit(False))).select(
        F.col("Serial_number").alias("_jk")).distinct()
    return keyed.join(there, "_jk", "left_anti").drop("_jk")


def sync_counts(selected: DataFrame, destination: DataFrame) -> DataFrame:
    """Created and skipped episodes per source dataset; all may be skipped."""
    created = sync_new_episodes(selected, destination).groupBy("dataset_key").agg(
        F.count("*").alias("created"))
    return selected.groupBy("dataset_key").agg(F.count("*").alias("_n")).join(
        created, "dataset_key", "left").select(
        "dataset_key", F.coalesce("created", F.lit(0).cast("bigint")).alias("created"),
        (F.col("_n") - F.coalesce("created", F.lit(0))).alias("skipped_duplicates"))


def merge_compat(catalog: DataFrame, *groups: str) -> DataFrame:
    """Whether the datasets of a group agree on frame rate and robot type."""
    differ = lambda c: F.max(c).eqNullSafe(F.min(c)) & ((F.count(c) == 0) | (F.count(c) == F.count("*")))
    return catalog.groupBy(*groups).agg(
        F.count("*").alias("datasets"), differ("fps").alias("same_fps"),
        differ("robot_type").alias("same_robot"),
    ).withColumn("compatible", F.col("same_fps") & F.col("same_robot"))


def reindex_episodes(
    episodes: DataFrame, *, order: Sequence[str] = ("episode_index",), block: Column | None = None,
    chunk_size: int = CHUNK_SIZE, key: str = "dataset_key",
) -> DataFrame:
    """Number episodes 0..n-1 per dataset in order and lay their frames end to end.

    The old id stays in ``old_episode_index``; chunk and file follow the new id,
    in the data shard and in every camera.
    """
    block = int_block(order[-1]) if block is None else block
    scanned = ordered_scan(
        episodes, keys=[key], order=list(order), block=block,
        totals={"_id": F.lit(1).cast("bigint"), "_from": F.col("length").cast("bigint")},
    )
    shard = {"chunk_index": F.floor(F.col("_id") / chunk_size), "file_index": F.col("_id") % chunk_size}
    placed = scanned.withColumns({
        "old_episode_index": F.col("episode_index"),
        "dataset_from_index": F.col("_from"),
        "dataset_to_index": F.col("_from") + F.col("length").cast("bigint"),
    }).withColumn("episode_index", F.col("_id"))
    changed = {c: value for c in placed.columns for name, value in shard.items()
               if c == name or c.endswith(f"/{name}")}
    changed |= {n: v for n, v in shard.items() if n not in changed}
    return placed.withColumns({c: v.cast("bigint") for c, v in changed.items()}).drop("_id", "_from")


def reindex_frames(
    frames: DataFrame, episodes: DataFrame, order: Sequence[str] = ("frame_index",), dense: bool = False
) -> DataFrame:
    """Frames of reindexed episodes with their new episode, frame and dataset-wide index.

    Frames of other episodes are dropped. Where the frame index already counts
    from 0 without holes, ``dense`` saves the ordering.
    """
    ids = episodes.select(
        "dataset_key", F.col("old_episode_index").alias("episode_index"),
        F.col("episode_index").alias("_new"), F.col("dataset_from_index").alias("_from"))
    kept = frames.join(ids, list(EP))
    placed = kept.withColumn("_p", F.col("frame_index")) if dense else row_position(
        kept, keys=list(EP), order=list(order), block=int_block(order[0]), out="_p")
    return placed.withColumns({
        "episode_index": F.col("_new"), "frame_index": F.col("_p"),
        "index": F.col("_from") + F.col("_p"),
    }).drop("_new", "_from", "_p")


def merged_tasks(tasks: DataFrame, targets: DataFrame) -> DataFrame:
    """Tasks of merged datasets: equal texts become one, numbered by first appearance.

    ``targets`` maps ``dataset_key`` to ``target`` and its place ``source_order``.
    Returns ``(target, dataset_key, task_index, task, new_task_index)``.
    """
    placed = tasks.join(targets, "dataset_key")
    first = placed.groupBy("target", "task").agg(
        F.min(F.struct("source_order", "task_index")).alias("_at")
    ).select("target", "task", "_at.source_order", "_at.task_index")
    numbered = row_position(
        first, keys=["target"], order=["source_order", "task_index"],
        block=F.col("source_order"), out="new_task_index",
    ).select("target", "task", "new_task_index")
    return placed.select("target", "dataset_key", "task_index", "task").join(
        numbered, ["target", "task"])


def merge_datasets(
    episodes: DataFrame, tasks: DataFrame, targets: DataFrame
) -> DataFrame:
    """Episodes of several datasets as one, in source order, reindexed and with united tasks."""
    mapped = checkpointed(
        merged_tasks(tasks, targets).select("dataset_key", "task_index", "new_task_index"))
    joined = episodes.join(targets, "dataset_key").join(mapped, ["dataset_key", "task_index"], "left")
    moved = joined.withColumn("task_index", F.coalesce("new_task_index", "task_index")).drop(
        "new_task_index")
    block = F.struct(F.col("source_order").alias("source"), int_block("episode_index").alias("part"))
    return reindex_episodes(
        moved, order=("source_order", "episode_index"), block=block, key="target",
    ).withColumnRenamed("dataset_key", "source_dataset")


def referenced_files(episodes: DataFrame) -> DataFrame:
    """Distinct data and video shards that episodes with file locations point to."""
    zero = F.lit(0).cast("bigint")
    data = episodes.select(
        "dataset_key", F.lit("data").alias("kind"), F.lit(None).cast("string").alias("camera"),
        F.coalesce("data_chunk_index", zero).alias("chunk"),
        F.coalesce("data_file_index", zero).alias("file"))
    video = episodes.select("dataset_key", F.explode("videos").alias("camera", "_v")).select(
        "dataset_key", F.lit("video").alias("kind"), "camera", F.col("_v.chunk").alias("chunk"),
        F.col("_v.file").alias("file")).where("chunk is not null and file is not null")
    return data.unionByName(video).distinct()


def video_window(
    locations: DataFrame, cameras: DataFrame, files: DataFrame | None = None
) -> DataFrame:
    """Playable window and file of each episode and video feature of its dataset.

    ``cameras`` holds ``(dataset_key, camera)``. Without an entry of its own a
    camera uses the data shard. With ``files`` only existing videos stay.
    """
    entry = F.try_element_at("videos", F.col("camera"))
    rows = locations.join(cameras.select("dataset_key", "camera"), "dataset_key").withColumn("_v", entry)
    absent = F.col("_v").isNull()
    shard = lambda own, data: F.when(absent, F.col(data)).otherwise(F.col(f"_v.{own}"))
    out = rows.select(
        *EP, "camera", playback.camera_label(F.col("camera")).alias("label"),
        playback.video_path(
            F.col("camera"), shard("chunk", "data_chunk_index"), shard("file", "data_file_index")
        ).alias("path"),
        playback.window_start(F.col("_v.from_ts")).alias("from_timestamp"),
        playback.window_end(F.col("_v.from_ts"), F.col("_v.to_ts")).alias("to_timestamp"),
    )
    return out if files is None else out.join(
        files.select("dataset_key", "path"), ["dataset_key", "path"], "left_semi")
