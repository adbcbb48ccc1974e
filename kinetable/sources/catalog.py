"""Dataset catalog: info documents, cells, column lists and chartable fields."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetable.functions.text import dataset_key
from kinetable.model import (
    CHARTABLE_COLUMNS, FEATURE, SYSTEM_EPISODE_COLUMNS, SYSTEM_INFO_KEYS,
)
from kinetable.sources.files import text_files, walk

_INFO_SUFFIX = "/meta/info.json"


def parse_info(info: DataFrame) -> DataFrame:
    """Catalog rows from info documents; text that is not a JSON object is skipped.

    Expects ``dataset_path`` and ``info_text``. Scalar system keys become columns,
    features a map, and every other key goes into ``custom`` as text.
    """
    text = F.rtrim("info_text", F.lit("\u0000"))
    fields = F.from_json(text, "map<string,string>")
    features = F.from_json(fields["features"], T.MapType(T.StringType(), FEATURE))
    return (
        info.withColumn("_f", fields)
        .where(F.col("_f").isNotNull())
        .select(
            "*",
            dataset_key(F.col("dataset_path")).alias("dataset_key"),
            F.coalesce(F.col("_f")["fps"].try_cast("double"), F.lit(0.0)).alias("fps"),
            F.coalesce(F.col("_f")["total_episodes"].try_cast("bigint"), F.lit(0)).alias("total_episodes"),
            F.col("_f")["total_frames"].try_cast("bigint").alias("total_frames"),
            F.col("_f")["robot_type"].alias("robot_type"),
            F.col("_f")["video_path"].alias("video_path"),
            features.alias("features"),
            F.map_filter("_f", lambda k, v: ~k.isin(*SYSTEM_INFO_KEYS)).alias("custom"),
            F.map_keys("_f").alias("info_keys"),
        )
        .drop("_f", "info_text")
    )


def drop_nested_datasets(catalog: DataFrame) -> DataFrame:
    """Keep only outermost datasets: none of a kept path's parent folders is a dataset."""
    parts = F.split("dataset_path", "/")
    parents = catalog.select("dataset_path", F.explode(
        F.transform(
            F.sequence(F.lit(1), F.size(parts) - 1),
            lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
        )
    ).alias("parent"))
    nested = parents.join(
        catalog.select(F.col("dataset_path").alias("parent")), "parent", "left_semi"
    ).select("dataset_path").distinct()
    return catalog.join(nested, "dataset_path", "left_anti")


def place_in_cells(catalog: DataFrame, pattern: str = "cell*") -> DataFrame:
    """Add mount root, cell and the dataset name relative to its cell.

    The cell is the first folder on the path whose name matches the pattern.
    """
    name = pattern.replace(".", r"\.").replace("*", "[^/]*").replace("?", "[^/]")
    shape = f"^(.*?)/({name})/(.+)$"
    at = lambda i: F.regexp_extract("dataset_path", shape, i)
    return catalog.where(F.col("dataset_path").rlike(shape)).select(
        "*", at(1).alias("mount_root"), at(2).alias("cell_name"), at(3).alias("name")
    )


def scan_info(spark: SparkSession, roots: Sequence[str] | DataFrame) -> DataFrame:
    """``(dataset_path, info_text)`` of all datasets below the roots, whatever their depth.

    A folder with an info document is a dataset and is not entered, so datasets inside of others are never listed.
    """
    found = walk(spark, roots, accept=[_INFO_SUFFIX[1:]]).where("accepted").select("folder").distinct()
    texts = text_files(spark, found.select(F.concat("folder", F.lit(_INFO_SUFFIX)).alias("path")))
    return texts.select(F.regexp_replace("path", _INFO_SUFFIX + "$", "").alias("dataset_path"), F.col("value").alias("info_text"))


def scan_catalog(spark: SparkSession, roots: Sequence[str] | DataFrame, pattern: str = "cell*") -> DataFrame:
    """Datasets found at any depth below the cells of the given roots."""
    return place_in_cells(parse_info(scan_info(spark, roots)), pattern)


def scan_cells(catalog: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Datasets per (mount_root, cell_name); listed cells without any count 0."""
    counts = catalog.groupBy("mount_root", "cell_name").agg(F.count("*").alias("dataset_count"))
    if cells is None:
        return counts
    return (
        cells.select("mount_root", "cell_name").distinct()
        .join(counts, ["mount_root", "cell_name"], "left")
        .withColumn("dataset_count", F.coalesce("dataset_count", F.lit(0).cast("bigint")))
    )


def column_inventory(catalog: DataFrame, episode_columns: DataFrame | None = None) -> DataFrame:
    """One row per dataset and info key or feature, marked as system or not.

    ``episode_columns`` optionally adds ``(dataset_key, name, dtype)`` rows of
    the episode tables.
    """
    keys = catalog.select("dataset_key", F.explode("info_keys").alias("name")).select(
        "dataset_key", F.lit("info").alias("kind"), "name", F.lit(None).cast("string").alias("dtype"),
        F.col("name").isin(*SYSTEM_INFO_KEYS).alias("is_system"),
    )
    features = catalog.select("dataset_key", F.explode("features").alias("name", "_v")).select(
        "dataset_key", F.lit("feature").alias("kind"), "name", F.col("_v.dtype").alias("dtype"),
        F.lit(False).alias("is_system"),
    )
    result = keys.unionByName(features)
    if episode_columns is not None:
        result = result.unionByName(episode_columns.select(
            "dataset_key", F.lit("episode").alias("kind"), "name", "dtype",
            F.col("name").isin(*SYSTEM_EPISODE_COLUMNS).alias("is_system"),
        ))
    return result


def available_fields(episode_columns: DataFrame) -> DataFrame:
    """Fields that can be charted per dataset.

    Listed episode columns if present, grade and tags always, the collection
    date when the dataset carries serials.
    """
    present = episode_columns.where(F.col("name").isin(*CHARTABLE_COLUMNS)).select(
        "dataset_key", "name", "dtype", F.col("name").isin(*SYSTEM_EPISODE_COLUMNS).alias("is_system")
    )
    fixed = F.array(
        F.struct(F.lit("grade").alias("name"), F.lit("string").alias("dtype")),
        F.struct(F.lit("tags").alias("name"), F.lit("list[string]").alias("dtype")),
    )
    always = episode_columns.select("dataset_key").distinct().select(
        "dataset_key", F.inline(fixed)
    )
    dated = episode_columns.where(F.col("name") == "Serial_number").select(
        "dataset_key", F.lit("collection_date").alias("name"), F.lit("date").alias("dtype")
    ).distinct()
    return present.unionByName(
        always.unionByName(dated).withColumn("is_system", F.lit(False))
    )


def schema_columns(df: DataFrame, skip: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """Names and reported types of a table's columns."""
    reported = {"bigint": "int64", "int": "int32", "double": "float64", "float": "float32",
                "boolean": "bool", "array<string>": "list<element: string>"}
    return [
        (f.name, reported.get(f.dataType.simpleString(), f.dataType.simpleString()))
        for f in df.schema if f.name not in skip
    ]


def check_custom_key(key: str) -> None:
    if key in SYSTEM_INFO_KEYS:
        raise ValueError(f"system key {key!r} cannot be changed")


def info_update(catalog: DataFrame, key: str, value: str | None) -> DataFrame:
    """Set one custom info key on every given dataset; a NULL value removes it."""
    check_custom_key(key)
    rest = F.map_filter("custom", lambda k, v: k != F.lit(key))
    if value is None:
        return catalog.withColumn("custom", rest)
    return catalog.withColumn("custom", F.map_concat(rest, F.create_map(F.lit(key), F.lit(value))))


def info_delete(catalog: DataFrame, key: str) -> DataFrame:
    """Remove one custom info key; an absent key changes nothing."""
    return info_update(catalog, key, None)


def dataset_summary(catalog: DataFrame) -> DataFrame:
    """Episode total, robot type, frame rate and number of features per dataset."""
    return catalog.select(
        "dataset_key", "total_episodes", "robot_type", "fps",
        F.coalesce(F.size("features"), F.lit(0)).cast("bigint").alias("feature_count"),
    )


def info_json(values: Mapping[str, object]) -> str:
    """Info document text for a sink."""
    import json

    return json.dumps(dict(values), ensure_ascii=False, indent=2)
