"""Everything a validation reads, from dataset folders: a listing, footers, and the few columns the rules need."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetable.functions.text import dataset_key
from kinetable.operators.validation import KEY, DatasetTables
from kinetable.settings import checkpointed
from kinetable.sources.catalog import parse_info
from kinetable.sources.datasets import EPISODE_SHARD, FRAME_SHARD, TASK_SHARD, shards_of_datasets, tasks_of_datasets
from kinetable.sources.files import footers, root_table, text_files, walk, without_scheme

_EPISODE_NUMBERS = ("episode_index", "dataset_from_index", "dataset_to_index", "data/chunk_index", "data/file_index")
_FRAME_NUMBERS = ("episode_index", "index", "task_index")


def dataset_tables(spark: SparkSession, roots: Sequence[str] | DataFrame) -> DatasetTables:
    """The tables of all given datasets; one that has no folder is listed as such.

    Row counts and columns come from the footers and sizes from the listing, so the quick rules read no data page
    but those of two episode columns. Files that can't be read are in ``shards`` with their error only.
    """
    root = without_scheme(F.col("root"))
    base = root_table(spark, roots).select(root.alias("dataset_path"), dataset_key(root).alias(KEY)).distinct()
    listed = checkpointed(walk(spark, base.select(F.col("dataset_path").alias("root"))).select(
        dataset_key(F.col("root")).alias(KEY), F.col("root").alias("dataset_path"), "path", "is_dir", "size",
        F.substring("path", F.length("root") + 2, F.length("path")).alias("below")))
    own = listed.where(~F.col("is_dir") & ~F.col("below").rlike(r"(^|/)[._][^/]*$"))
    # a shard that Spark wrote is a folder of files
    files = own.select(KEY, F.regexp_replace("below", r"(\.parquet)/[^/]*$", "$1").alias("path"), "size").groupBy(
        KEY, "path").agg(F.sum("size").alias("size"))
    kind = F.when(F.col("path").rlike(EPISODE_SHARD), "episodes").when(F.col("path").rlike(FRAME_SHARD), "data").when(
        F.col("path").rlike(TASK_SHARD), "tasks")
    parquet = own.withColumn("kind", kind).where("kind IS NOT NULL").select(KEY, "kind", "path")
    found = footers(parquet)
    shards = checkpointed(parquet.join(found, "path").select(
        KEY, "kind", "path", F.transform("columns", lambda c: c["name"]).alias("columns"), "rows", "error"))
    readable = lambda k: found.where("error IS NULL").join(parquet.where(F.col("kind") == k).select("path"), "path", "left_semi")

    episodes = shards_of_datasets(spark, readable("episodes"), EPISODE_SHARD, [*_EPISODE_NUMBERS, "task_index", "tasks"], "shard_columns array<string>")
    frames = shards_of_datasets(spark, readable("data"), FRAME_SHARD, _FRAME_NUMBERS, "shard_columns array<string>")
    tasks = tasks_of_datasets(spark, readable("tasks"))
    return DatasetTables(
        _catalog(spark, base, listed), shards, files, _numbers(tasks, ("task_index",)).select(KEY, "task_index", "task"),
        _episodes(episodes), _numbers(frames, _FRAME_NUMBERS), base.join(_folders(listed), KEY, "left").na.fill(False))


def _numbers(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns as numbers, NULL where no shard has them."""
    number = lambda n: (F.col(f"`{n}`") if n in rows.columns else F.lit(None)).try_cast("long").alias(n)
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c not in names], *[number(n) for n in names])


def _episodes(rows: DataFrame) -> DataFrame:
    rows = _numbers(rows, (*_EPISODE_NUMBERS, "task_index"))
    kinds = dict(rows.dtypes)
    tasks = F.col("tasks") if kinds.get("tasks") == "array<string>" else F.array(F.col("tasks").cast("string")) if "tasks" in kinds else (
        F.lit(None).cast("array<string>"))
    return rows.withColumn("tasks", tasks)


def _folders(listed: DataFrame) -> DataFrame:
    folder = lambda name: F.coalesce(F.bool_or(F.col("is_dir") & (F.col("below") == name)), F.lit(False))
    return listed.groupBy(KEY).agg(F.lit(True).alias("there"), folder("meta/episodes").alias("episode_folder"), folder("data").alias("data_folder"))


def _catalog(spark: SparkSession, base: DataFrame, listed: DataFrame) -> DataFrame:
    texts = text_files(spark, listed.where(F.col("below") == "meta/info.json").where("not is_dir").select("path"))
    documents = texts.select(F.regexp_replace("path", "/meta/info\\.json$", "").alias("dataset_path"), F.col("value").alias("info_text"))
    total = lambda name: F.get_json_object("info_text", f"$.{name}").try_cast("long").alias(name)
    claimed = documents.select("dataset_path", total("total_episodes"), total("total_frames"))
    known = parse_info(documents).drop(KEY, "total_episodes", "total_frames").join(claimed, "dataset_path")
    return base.join(known, "dataset_path", "left").select(
        KEY, "info_keys", "fps", "total_episodes", "total_frames", "features", "video_path")
