"""Legacy annotation files: one JSON map of episode index to grade and tags per dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetable.functions.text import dataset_key
from kinetable.sources.files import text_files, walk

_ENTRIES = "map<string,struct<grade:string,tags:array<string>>>"


def sidecar_name(name, path):
    """File name of a dataset's sidecar: its name and 16 hex digits of its path hash."""
    return F.concat(name, F.lit("_"), dataset_key(path), F.lit(".json"))


def read_sidecars(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.read.option("wholetext", "true").text(pattern).select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file_name"), "value"
    )


def scan_sidecars(spark: SparkSession, folder: str, datasets: DataFrame) -> DataFrame:
    """``(dataset_path, dataset_key, value)`` of the datasets that have a sidecar in a folder.

    A sidecar belongs to the dataset whose name and path give its file name; no other file is opened.
    """
    listed = walk(spark, [folder], into=F.lit(False)).where("not is_dir").select(F.col("name").alias("file_name"), "path")
    path = F.col("dataset_path")
    named = datasets.select("dataset_path", dataset_key(path).alias("dataset_key"),
                            sidecar_name(F.element_at(F.split(path, "/"), -1), path).alias("file_name"))
    found = named.join(listed, "file_name").drop("file_name")
    return found.join(text_files(spark, found), "path").select("dataset_path", "dataset_key", "value")


def explode_sidecar(sidecars: DataFrame, *keys: str) -> DataFrame:
    """One row per annotated episode from the JSON text in ``value``; corrupt text adds none."""
    return (
        sidecars.select(*keys, F.explode(F.from_json("value", _ENTRIES)).alias("_k", "_a"))
        .select(
            *keys,
            F.col("_k").try_cast("bigint").alias("episode_index"),
            F.col("_a.grade").alias("grade"),
            F.coalesce("_a.tags", F.array().cast("array<string>")).alias("tags"),
        )
    )
