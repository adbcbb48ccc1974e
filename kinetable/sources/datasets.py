"""Readers for dataset folders: episodes, tasks, frames and their fingerprints."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetable.functions.text import dataset_key
from kinetable.model import TASK_TEXT_COLUMNS
from kinetable.sources.files import footers, plain_path, walk, without_scheme

FRAME_FILES = "data/chunk-*/file-*.parquet"
_WIDER = {
    frozenset({"int", "bigint"}): "bigint",
    frozenset({"float", "double"}): "double",
    frozenset({"int", "double"}): "double",
    frozenset({"bigint", "double"}): "double",
}


def read_shards(spark: SparkSession, paths: Sequence[str], merge: bool = False) -> DataFrame:
    """Read Parquet paths whose columns may differ; missing ones become NULL.

    One path is a single scan with the columns of its first file, or of all its
    files with ``merge``, which opens every footer once. Differing integer and
    floating widths are widened before the union.
    """
    option = "true" if merge else "false"
    frames = [spark.read.option("mergeSchema", option).parquet(path) for path in paths]
    result = frames[0]
    for frame in frames[1:]:
        result = union_widened(result, frame)
    return result


def union_widened(left: DataFrame, right: DataFrame) -> DataFrame:
    """Union by name; absent columns are NULL and numeric widths are reconciled."""
    types = {f.name: f.dataType.simpleString() for f in left.schema}
    for field in right.schema:
        mine, theirs = types.get(field.name), field.dataType.simpleString()
        if mine is None or mine == theirs:
            continue
        wide = _WIDER.get(frozenset({mine, theirs}))
        if wide:
            left = left.withColumn(f"{field.name}", F.col(f"`{field.name}`").cast(wide))
            right = right.withColumn(f"{field.name}", F.col(f"`{field.name}`").cast(wide))
    return left.unionByName(right, allowMissingColumns=True)


# which files below a dataset are its shards; Spark writes a folder in place of a file
EPISODE_SHARD = r"/meta/episodes/chunk-[^/]*/file-[^/]*\.parquet(/[^/]*\.parquet)?$"
FRAME_SHARD = r"/data/chunk-[^/]*/file-[^/]*\.parquet(/[^/]*\.parquet)?$"
TASK_SHARD = r"/meta/tasks\.parquet(/[^/]*\.parquet)?$"


def dataset_files(spark: SparkSession, roots: Sequence[str] | DataFrame, *folders: str) -> DataFrame:
    """``(dataset_path, path, size, mtime_us)`` of all files of datasets, or of those below some of their folders.

    ``roots`` are paths or a table with a column ``root``, such as a catalog gives.
    """
    into = None
    if folders:
        below = F.substring("path", F.length("root") + 2, F.length("path"))
        into = F.exists(F.array(*[F.lit(f) for f in folders]), lambda f: below.startswith(f) | f.startswith(below))
    return walk(spark, roots, into=into).where("not is_dir").select(
        F.col("root").alias("dataset_path"), "path", "size", "mtime_us")


def wider(one: str, two: str) -> str | None:
    """The type that holds the values of both, by the name Spark has for it."""
    if one == two:
        return one
    if one.startswith("array<") and two.startswith("array<"):
        inner = wider(one[6:-1], two[6:-1])
        return inner and f"array<{inner}>"
    return _WIDER.get(frozenset({one, two}))


def scan_shards(spark: SparkSession, shards: DataFrame, columns: Sequence[str] | None = None) -> DataFrame | None:
    """Rows of many Parquet files whose columns differ; None without any.

    ``shards`` has ``path`` and its footer (see `files.footers`). Files with equal columns are one scan, so the
    plan grows with the number of schemas and not of files. Absent columns are NULL; ``shard_columns`` names those
    that the file has, because an absent column is not the same as a NULL. Numbers of different width are widened;
    other differences are an error, as is a file that can't be read.
    """
    per = shards.groupBy("columns").agg(F.collect_list("path").alias("paths"), F.max("error").alias("error")).collect()
    broken = [r.error for r in per if r.columns is None]
    if broken:
        raise ValueError(f"unreadable Parquet file: {broken[0]}")
    kinds: dict[str, str] = {}
    for group in per:
        for field in group.columns:
            kind = wider(kinds.get(field.name, field.dtype), field.dtype)
            if kind is None:
                raise ValueError(f"column {field.name!r} is {kinds[field.name]} and {field.dtype}")
            kinds[field.name] = kind
    names = [c for c in kinds if columns is None or c in columns]
    names += [c for c in columns or () if c not in kinds]
    parts = []
    for group in sorted(per, key=lambda g: min(g.paths)):
        own = {f.name: f.dtype for f in group.columns}
        schema = ", ".join(f"`{n}` {t}" for n, t in own.items())
        rows = spark.read.schema(schema).parquet(*sorted(group.paths))
        cast = lambda n: (F.col(f"`{n}`") if n in own else F.lit(None)).cast(kinds.get(n, "string")).alias(n)
        parts.append(rows.select(
            *[cast(n) for n in names], F.array(*[F.lit(n) for n in own]).alias("shard_columns"),
            plain_path().alias("shard_path"), F.col("_metadata.row_index").alias("shard_row")))
    return reduce(DataFrame.unionByName, parts) if parts else None


def shards_of_datasets(
    spark: SparkSession, found: DataFrame, shard: str, columns: Sequence[str] | None, empty: str, keyed: bool = True
) -> DataFrame:
    """Rows of the shards whose footers are given, with the dataset each belongs to."""
    rows = scan_shards(spark, found, columns)
    if rows is None:
        return spark.createDataFrame([], f"dataset_path string, {'dataset_key string, ' if keyed else ''}{empty}")
    rest = [c for c in rows.columns if c not in ("dataset_path", *(["dataset_key"] if keyed else []))]
    path = F.regexp_replace("shard_path", shard, "")
    key = [dataset_key(path).alias("dataset_key")] if keyed else []
    return rows.select(path.alias("dataset_path"), *key, *[F.col(f"`{c}`") for c in rest])


def _of_datasets(spark, roots, folder, shard, columns, empty, keyed=True) -> DataFrame:
    listed = dataset_files(spark, roots, folder).where(F.col("path").rlike(shard))
    return shards_of_datasets(spark, footers(listed), shard, columns, empty, keyed)


def scan_episodes(
    spark: SparkSession, roots: Sequence[str] | DataFrame, columns: Sequence[str] | None = None, keyed: bool = False
) -> DataFrame:
    """Episode metadata of datasets, each row with its dataset, its place and the columns its shard has.

    A dataset without shards adds no rows; no shards at all gives an empty table
    that still has ``episode_index``. ``keyed`` adds ``dataset_key``.
    """
    return _of_datasets(spark, roots, "meta/episodes", EPISODE_SHARD, columns, "episode_index bigint", keyed)


def scan_dataset_frames(spark: SparkSession, roots: Sequence[str] | DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Frames of datasets, each row with its dataset, its place and the columns its shard has."""
    return _of_datasets(spark, roots, "data", FRAME_SHARD, columns, "episode_index bigint, frame_index bigint")


def scan_frames(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, merge: bool = False
) -> DataFrame:
    """Frames of a dataset folder (or of Parquet files), with their physical position.

    ``shard_path`` and ``shard_row`` order rows that share a frame index. Only
    the asked columns are read. ``merge`` opens every footer, for shards that
    differ in their columns, such as partly stamped ones.
    """
    source = path if path.endswith(".parquet") else f"{path.rstrip('/')}/{FRAME_FILES}"
    df = read_shards(spark, [source], merge)
    chosen = [F.col(f"`{c}`") for c in (columns or df.columns)]
    return df.select(
        *chosen,
        F.col("_metadata.file_path").alias("shard_path"),
        F.col("_metadata.row_index").alias("shard_row"),
    )


def resolve_task_text_column(
    schema: T.StructType, index_columns: Sequence[str] = ()
) -> str | None:
    """Name of the column that holds the task text, or None.

    ``index_columns`` are the pandas index names of the file footer.
    """
    names = schema.names
    known = [c for c in TASK_TEXT_COLUMNS if c in names]
    indexed = [c for c in index_columns if c in names and c != "task_index"]
    texts = [
        f.name for f in schema
        if isinstance(f.dataType, T.StringType) and f.name != "task_index"
    ]
    only_text = texts if len(texts) == 1 else []
    return next(iter([*known, *indexed, *only_text]), None)


def task_text(columns: Column, index_columns: Column) -> Column:
    """The same for footers as rows: the name of a file's text column, or NULL."""
    named = F.transform(columns, lambda c: c["name"])
    known = F.filter(F.array(*[F.lit(c) for c in TASK_TEXT_COLUMNS]), lambda c: F.array_contains(named, c))
    indexed = F.filter(index_columns, lambda c: F.array_contains(named, c) & (c != "task_index"))
    texts = F.transform(F.filter(columns, lambda c: (c["dtype"] == "string") & (c["name"] != "task_index")), lambda c: c["name"])
    only = F.when(F.size(texts) == 1, texts).otherwise(F.array().cast("array<string>"))
    return F.get(F.concat(known, indexed, only), F.lit(0))


def scan_tasks(spark: SparkSession, roots: str | Sequence[str] | DataFrame) -> DataFrame:
    """Tasks of one or many datasets with their text under ``task``; a missing file is empty.

    Which column holds the text is decided for each file. Those of many say which dataset they belong to.
    """
    one = isinstance(roots, str)
    listed = dataset_files(spark, [roots] if one else roots, "meta").where(F.col("path").rlike(TASK_SHARD))
    rows = tasks_of_datasets(spark, footers(listed))
    return rows.drop("dataset_path", "dataset_key") if one else rows


def tasks_of_datasets(spark: SparkSession, shards: DataFrame) -> DataFrame:
    """Tasks of the files whose footers are given."""
    found = shards.withColumn("text", task_text(F.col("columns"), F.col("index_columns")))
    rows = scan_shards(spark, found)
    if rows is None:
        return spark.createDataFrame([], "dataset_path string, dataset_key string, task_index bigint, task string")
    # the few names that occur; every row knows its file's columns, so the choice is made again from these
    names = sorted({r.text for r in found.select("text").distinct().collect() if r.text})
    of_file = found.select(without_scheme(F.col("path")).alias("shard_path"), F.col("text").alias("_text"))
    value = F.coalesce(*[F.when(F.col("_text") == n, F.col(f"`{n}`").cast("string")) for n in names]) if names else F.lit(None).cast("string")
    rest = [c for c in rows.columns if c not in {*names, "task", "task_index", "shard_columns", "shard_row", "shard_path"}]
    root = F.regexp_replace("shard_path", TASK_SHARD, "")
    return rows.join(of_file, "shard_path").select(
        root.alias("dataset_path"), dataset_key(root).alias("dataset_key"), "task_index", value.alias("task"),
        *[F.col(f"`{c}`") for c in rest])


def file_inventory(spark: SparkSession, pattern: str, root: str) -> DataFrame:
    """Path relative to ``root``, size and change time of every matching file.

    Only the listing is used; the contents column is pruned from the scan.
    """
    files = spark.read.format("binaryFile").load(pattern)
    base = "^.*" + _quote(root.rstrip("/")) + "/"
    return files.select(
        F.regexp_replace("path", base, "").alias("path"),
        F.col("length").alias("size"),
        F.unix_micros("modificationTime").alias("mtime_us"),
    )


def _quote(text: str) -> str:
    return "\\Q" + text + "\\E"


def dataset_fingerprint(files: DataFrame, *keys: str) -> DataFrame:
    """One digest per dataset over (path, size, change time) of its files.

    Each file is hashed on its own and the hashes are added up, so the order
    the files are read in does not matter and no list is collected.
    """
    digest = F.xxhash64("path", "size", "mtime_us").cast("decimal(38,0)")
    return (
        files.groupBy(*keys)
        .agg(
            F.count("*").alias("files"),
            F.sum("size").alias("bytes"),
            F.max("mtime_us").alias("newest_us"),
            F.sum(digest).alias("_sum"),
        )
        .withColumn(
            "fingerprint",
            F.sha2(F.concat_ws("|", "files", "bytes", "newest_us", F.col("_sum").cast("string")), 256),
        )
        .drop("_sum")
    )
