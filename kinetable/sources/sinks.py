"""Writers. Every one writes to a new path and refuses an existing one.

A whole dataset is written to a staging folder beside its place and moved there in one step, so a run that fails
or is killed leaves no half of it. Files are written under names of their own first: a task that runs again replaces
what it wrote.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetable.functions.grades import grade_norm
from kinetable.model import COLUMN_TYPES
from kinetable.settings import checkpointed
from kinetable.sources.datasets import EPISODE_SHARD, FRAME_SHARD, dataset_files, shards_of_datasets
from kinetable.sources.catalog import info_json
from kinetable.sources.files import exists, file_system, footers, local, remove_folder, text_files

MANIFEST = "path string, rows long, bytes long"
_HIDDEN = ("shard_columns", "shard_path", "shard_row", "dataset_path")


def annotated_episodes(episodes: DataFrame, updates: DataFrame, *keys: str) -> DataFrame:
    """Episodes with grade and tags replaced where an update exists.

    Both columns move to the end as text and text list; reasons are not written.
    """
    new = updates.select(
        *keys, F.struct(F.col("grade").alias("g"), F.col("tags").alias("t")).alias("_u")
    )
    old = lambda name, kind: (
        F.col(name) if name in episodes.columns else F.lit(None)
    ).cast(kind)
    merged = episodes.join(new, list(keys), "left")
    found = F.col("_u").isNotNull()
    rest = [F.col(f"`{c}`") for c in episodes.columns if c not in ("grade", "tags")]
    return merged.select(
        *rest,
        F.when(found, F.col("_u.g")).otherwise(old("grade", "string")).alias("grade"),
        F.when(found, F.col("_u.t")).otherwise(old("tags", "array<string>")).alias("tags"),
    )


def add_column(episodes: DataFrame, name: str, dtype: str, value: object) -> DataFrame:
    """Add one constant column of an allowed type."""
    if name in episodes.columns:
        raise ValueError(f"column {name!r} already exists")
    if dtype not in COLUMN_TYPES:
        raise ValueError(f"unknown column type {dtype!r}")
    return episodes.withColumn(name, F.lit(value).cast(COLUMN_TYPES[dtype]))


def write_new(df: DataFrame, path: str, *partitions: str) -> None:
    """Write Parquet to a path that must not exist yet."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def export_dataset(
    kept: DataFrame, frames: DataFrame, path: str, *, keys: list[str], chunk: str = "chunk_index"
) -> None:
    """Write kept episodes in their chunk layout and only the frames that belong to them."""
    write_new(kept, f"{path}/episodes", chunk)
    owned = frames.join(kept.select(*keys), keys, "left_semi")
    write_new(owned, f"{path}/data")


# --- whole datasets -----------------------------------------------------------

@contextmanager
def staged(path: str) -> Iterator[str]:
    """A folder to write to; it becomes ``path`` when the block ends well, and is deleted otherwise."""
    path = path.rstrip("/")
    if exists(path):
        raise ValueError(f"output path already exists: {path}")
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    system, place = file_system(staging)
    system.create_dir(place, recursive=True)
    try:
        yield staging
        if exists(path):
            raise ValueError(f"output path already exists: {path}")
        system.move(place, file_system(path)[1])
    finally:
        remove_folder(staging)


def _put(target: str, write: Callable[[str], None]) -> int:
    """Write a file beside its place, move it there and return its size."""
    system, place = file_system(target)
    system.create_dir(place.rpartition("/")[0], recursive=True)
    part = f"{place}.part-{uuid.uuid4().hex}"
    write(part)
    system.move(part, place)
    return system.get_file_info(place).size


def write_text(target: str, text: str) -> None:
    system, _ = file_system(target)

    def write(part: str) -> None:
        with system.open_output_stream(part, compression=None) as out:
            out.write(text.encode())

    _put(target, write)


def write_shards(rows: DataFrame, root: str, *, path: str = "path", order: Sequence[str] = ()) -> DataFrame:
    """Write every group of rows with the same ``path`` as one Parquet file below ``root``; the manifest.

    One file is written by one task, so a path is to hold no more than a shard does. Rows that say which columns
    their shard has (``shard_columns``) are written with these only.
    """
    hidden, names = {path, *_HIDDEN}, rows.columns

    def write(table: pa.Table) -> pa.Table:
        import pyarrow.parquet as pq

        table = table.rename_columns(names)
        if order:
            table = table.sort_by([(c, "ascending") for c in order])
        name = table.column(path)[0].as_py()
        own = table.column("shard_columns")[0].as_py() if "shard_columns" in table.column_names else None
        kept = [c for c in own if c in table.column_names] if own else [c for c in table.column_names if c not in hidden]
        target = f"{root.rstrip('/')}/{name}"
        system, _ = file_system(target)
        size = _put(target, lambda part: pq.write_table(table.select(kept), part, filesystem=system))
        return pa.table({"path": [name], "rows": pa.array([table.num_rows], pa.int64()), "bytes": pa.array([size], pa.int64())})

    # grouped columns can't have dots in their names
    plain = rows.toDF(*[f"c{i}" for i in range(len(names))])
    return checkpointed(plain.groupBy(f"c{names.index(path)}").applyInArrow(write, MANIFEST))


def write_files(rows: DataFrame, root: str) -> DataFrame:
    """Write ``value`` (text or bytes) of every row as the file ``path`` below ``root``; the manifest."""
    out = pa.schema([("path", pa.string()), ("rows", pa.int64()), ("bytes", pa.int64())])

    def put(name: str, value: bytes) -> int:
        system, _ = file_system(root)

        def write(part: str) -> None:
            with system.open_output_stream(part, compression=None) as into:
                into.write(value)

        return _put(f"{root.rstrip('/')}/{name}", write)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, values = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.nulls(len(names), pa.int64()),
                 pa.array([put(n, v) for n, v in zip(names, values)], pa.int64())], schema=out)

    # however few tasks the rows come from: a file costs calls to the store, not bytes
    tasks = rows.sparkSession.sparkContext.defaultParallelism * 4
    dealt = rows.select("path", F.col("value").cast("binary").alias("value")).repartition(tasks, F.xxhash64("path"))
    return checkpointed(dealt.mapInArrow(run, MANIFEST))


def copy_files(plan: DataFrame) -> DataFrame:
    """Copy ``source`` to ``target`` for every row, each by one task and block by block; the manifest."""
    out = pa.schema([("path", pa.string()), ("rows", pa.int64()), ("bytes", pa.int64())])

    def copy(source: str, target: str) -> int:
        system, place = file_system(source)
        there, _ = file_system(target)

        def write(part: str) -> None:
            with system.open_input_stream(place, compression=None) as read, there.open_output_stream(part, compression=None) as into:
                while block := read.read(8 << 20):
                    into.write(block)

        return _put(target, write)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, target in zip(*[c.to_pylist() for c in batch.columns]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([target]), pa.array([None], pa.int64()), pa.array([copy(source, target)], pa.int64())], schema=out)

    tasks = plan.sparkSession.sparkContext.defaultParallelism * 4
    dealt = plan.select("source", "target").distinct().repartition(tasks, F.xxhash64("target"))
    return checkpointed(dealt.mapInArrow(run, MANIFEST))


def referenced_shards(episodes: DataFrame) -> DataFrame:
    """``(folder, chunk, file)`` of the data and video files that episodes refer to, ``folder`` being ``data`` or
    ``videos/<camera>``. A data number that is not there counts as 0; a camera without numbers has no file."""
    number = lambda name: (F.col(f"`{name}`") if name in episodes.columns else F.lit(None)).cast("long")
    data = lambda name: F.coalesce(number(f"data/{name}"), F.lit(0).cast("long"))
    cameras = sorted({c.rpartition("/")[0] for c in episodes.columns if c.startswith("videos/")})
    place = lambda folder, chunk, file: F.struct(F.lit(folder).alias("folder"), chunk.alias("chunk"), file.alias("file"))
    places = [place("data", data("chunk_index"), data("file_index")),
              *[place(c, number(f"{c}/chunk_index"), number(f"{c}/file_index")) for c in cameras]]
    return episodes.select(F.inline(F.array(*places))).where("chunk IS NOT NULL AND file IS NOT NULL").distinct()


def copy_plan(source: str, target: str, files: DataFrame, referenced: DataFrame) -> DataFrame:
    """Which files of a dataset (``path``) are copied: those that are referred to, and the tasks."""
    below = F.substring("path", len(source.rstrip("/")) + 2, 2**31 - 1)
    shape = r"^(data|videos/.*)/chunk-(\d+)/file-(\d+)\.[^/]*$"
    part = lambda i: F.regexp_extract("below", shape, i)
    named = files.select("path", below.alias("below")).select(
        "path", "below", part(1).alias("folder"), part(2).try_cast("long").alias("chunk"), part(3).try_cast("long").alias("file"))
    kept = named.join(referenced, ["folder", "chunk", "file"], "left_semi").unionByName(
        named.where(F.col("below") == "meta/tasks.parquet"))
    return kept.select(F.col("path").alias("source"), F.concat(F.lit(target.rstrip("/") + "/"), "below").alias("target"))


def export_folder(
    spark: SparkSession, source: str, target: str, exclude: Sequence[str], by_index: DataFrame | None = None
) -> dict[str, int]:
    """Export a dataset folder without the episodes of some grades, in the same layout; the new totals.

    Annotations (``by_index``: ``episode_index, grade``) overrule stored grades unless their grade is NULL. Episode
    files are written anew with the rows that stay, files without any are left out; data and video files that kept
    episodes refer to are copied whole. The info document gets the new number of episodes.
    """
    source, target = local(source).rstrip("/"), local(target)
    listed = checkpointed(dataset_files(spark, [source]))
    episodes = shards_of_datasets(
        spark, footers(listed.where(F.col("path").rlike(EPISODE_SHARD))), EPISODE_SHARD, None, "episode_index bigint")
    if by_index is None:
        by_index = spark.createDataFrame([], "episode_index bigint, grade string")
    stored = F.col("grade") if "grade" in episodes.columns else F.lit(None).cast("string")
    graded = episodes.join(by_index.where("grade IS NOT NULL").select("episode_index", F.col("grade").alias("_new")),
                           "episode_index", "left").withColumn("_grade", F.coalesce("_new", stored))
    out = grade_norm(F.col("_grade")).isin(*[g.strip().lower() for g in exclude])
    kept = checkpointed(graded.where(~F.coalesce(out, F.lit(False))).drop("_new", "_grade"))
    total = kept.count()
    with staged(target) as staging:
        at = F.regexp_replace(F.substring("shard_path", len(source) + 2, 2**31 - 1), r"(\.parquet)/[^/]*$", "$1")
        if "shard_path" in kept.columns:
            write_shards(kept.drop("dataset_key").withColumn("_at", at), staging, path="_at", order=["shard_row"])
            copy_files(copy_plan(source, staging, listed, referenced_shards(kept)))
        info = text_files(spark, listed.where(F.col("path").endswith("/meta/info.json"))).first()
        document = json.loads(info.value.rstrip("\0")) if info and info.value else {}
        write_text(f"{staging}/meta/info.json", info_json(document | {"total_episodes": total}))
        missing = episodes.count() - total
    return {"total_episodes": total, "excluded_count": missing}
