"""Rule reports: do the episodes, frames, tasks and files of a dataset agree?

Every rule is one row per dataset ``(dataset_key, rule_no, rule, passed, message)``;
the verdict is the first rule that fails.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.model import (
    REQUIRED_EPISODE_COLUMNS, REQUIRED_FRAME_COLUMNS, REQUIRED_INFO_KEYS, TASK_TEXT_COLUMNS,
)
from kinetable.operators.ordered import int_block, ordered_scan, row_position

KEY = "dataset_key"
LOADER_SKIPPED = "Full partial: dataset OK, official loader skipped"


@dataclass(frozen=True)
class DatasetTables:
    """What a validation reads.

    ``catalog``: one row per dataset with info_keys, fps, total_episodes,
    total_frames, features, video_path (see the catalog source), or NULLs where the
    info document cannot be read.
    ``shards``: ``(dataset_key, kind, path, columns)`` from the file footers, kind
    episodes, data or tasks; with ``rows`` too, nothing is read to count rows, and with
    ``error`` unreadable files are told. ``files``: ``(dataset_key, path, size)``.
    ``tasks``, ``episodes``, ``frames``: rows of all datasets. Episodes may say which
    columns their shard has (``shard_columns``). ``folders``: ``(dataset_key,
    dataset_path, there, episode_folder, data_folder)``, if datasets are folders.
    """

    catalog: DataFrame
    shards: DataFrame
    files: DataFrame
    tasks: DataFrame
    episodes: DataFrame
    frames: DataFrame
    folders: DataFrame | None = None


def row_counts(tables: DatasetTables, kind: str, rows: DataFrame, name: str) -> DataFrame:
    """Rows per dataset: by the footers if they are known, else counted."""
    if "rows" not in tables.shards.columns:
        return rows.groupBy(KEY).agg(F.count("*").alias(name))
    return tables.shards.where(F.col("kind") == kind).groupBy(KEY).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias(name))


def range_tiling(episodes: DataFrame, totals: DataFrame) -> DataFrame:
    """Whether frame ranges start at 0, follow each other and end at the row count.

    ``totals``: ``(dataset_key, data_rows)``. Counts broken ranges and gaps.
    """
    scanned = ordered_scan(
        episodes.select(KEY, "dataset_from_index", "dataset_to_index"),
        keys=[KEY], order=["dataset_from_index", "dataset_to_index"],
        block=int_block("dataset_from_index"), carries={"_prev": F.col("dataset_to_index")},
    )
    start, end = F.col("dataset_from_index"), F.col("dataset_to_index")
    per = scanned.groupBy(KEY).agg(
        F.count_if((start < 0) | (end <= start)).alias("broken"),
        F.count_if(F.coalesce("_prev", F.lit(0)) != start).alias("gaps"),
        F.max(end).alias("range_end"))
    return per.join(totals, KEY, "full_outer").select(
        KEY, F.coalesce("broken", F.lit(0).cast("bigint")).alias("broken"),
        F.coalesce("gaps", F.lit(0).cast("bigint")).alias("gaps"),
        F.coalesce("range_end", F.lit(0).cast("bigint")).alias("range_end"),
        F.coalesce("data_rows", F.lit(0).cast("bigint")).alias("data_rows"))


def index_contiguity(frames: DataFrame) -> DataFrame:
    """Whether the frame index of each dataset is 0..n-1 without repeats.

    n distinct values from 0 to n-1 can only be that. Values are marked in
    bitmaps of 32,768 bits before the shuffle, so frames themselves do not move.
    """
    bits = frames.groupBy(KEY, F.bitmap_bucket_number("index").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("index")).alias("_bits"), F.count("index").alias("_n"),
        F.min("index").alias("_lo"), F.max("index").alias("_hi"))
    return bits.groupBy(KEY).agg(
        F.sum("_n").alias("frames"), (F.sum("_n") - F.sum(F.bitmap_count("_bits"))).alias("repeated"),
        F.min("_lo").alias("first"), F.max("_hi").alias("last"),
    ).withColumn("contiguous", (F.col("repeated") == 0) & (F.col("first") == 0)
                 & (F.col("last") == F.col("frames") - 1))


def frame_owner(frames: DataFrame, episodes: DataFrame) -> DataFrame:
    """Add ``owner_episode``: the episode whose range [from, to) holds the frame index.

    Ranges do not overlap, so the owner is the last range starting at or before
    the frame; range starts and frames are scanned together in index order.
    """
    starts = episodes.select(
        KEY, F.col("dataset_from_index").alias("index"), F.lit(True).alias("_start"),
        F.col("episode_index").alias("_episode"), F.col("dataset_to_index").alias("_end"))
    both = frames.unionByName(starts, allowMissingColumns=True).withColumn(
        # a range start comes before the frame of the same index
        "_at", F.col("index") * 2 + F.when(F.col("_start"), 0).otherwise(1))
    owned = ordered_scan(
        both, keys=[KEY], order=["_at"], block=int_block("index"),
        carries={"_own": F.col("_episode"), "_own_end": F.col("_end")},
    ).where(F.col("_start").isNull())
    inside = F.col("index") < F.col("_own_end")
    return owned.withColumn("owner_episode", F.when(inside, F.col("_own"))).drop(
        "_start", "_episode", "_end", "_at", "_own", "_own_end")


def frame_references(
    frames: DataFrame, episodes: DataFrame, episode_tasks: DataFrame
) -> DataFrame:
    """Frames outside every range, with another episode index, or with a foreign task.

    ``episode_tasks``: ``(dataset_key, episode_index, task_index)``.
    """
    slim = frames.select(KEY, "index", "episode_index", "task_index")
    owned = frame_owner(slim, episodes)
    allowed = episode_tasks.select(
        KEY, F.col("episode_index").alias("owner_episode"), "task_index", F.lit(True).alias("_ok")).distinct()
    # frames of one episode and task are counted before they meet the task list
    counted = owned.withColumn("_own", F.col("episode_index").eqNullSafe(F.col("owner_episode"))).groupBy(
        KEY, "owner_episode", "task_index", "_own").agg(F.count("*").alias("n"))
    checked = counted.join(allowed, [KEY, "owner_episode", "task_index"], "left")
    outside = F.col("owner_episode").isNull()
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return checked.groupBy(KEY).agg(
        F.sum("n").alias("frames"),
        total(outside).alias("outside"),
        total(~outside & ~F.col("_own")).alias("wrong_episode"),
        total(~outside & F.col("_own") & F.col("_ok").isNull()).alias("wrong_task"))


def episode_task_sets(episodes: DataFrame, tasks: DataFrame) -> DataFrame:
    """Task indexes of each episode; ``task_index`` is NULL for an unknown or missing text."""
    if "shard_columns" in episodes.columns and {"task_index", "tasks"} <= set(episodes.columns):
        # shards differ: each is judged by the column it has
        indexed = F.array_contains("shard_columns", "task_index")
        return episode_task_sets(episodes.where(indexed).drop("tasks", "shard_columns"), tasks).unionByName(
            episode_task_sets(episodes.where(~indexed).drop("task_index", "shard_columns"), tasks))
    if "task_index" in episodes.columns:
        return episodes.select(KEY, "episode_index", "task_index", F.lit(None).cast("string").alias("task"))
    texts = episodes.select(KEY, "episode_index", F.explode_outer("tasks").alias("task"))
    known = tasks.groupBy(KEY, "task").agg(F.max("task_index").alias("task_index"))
    return texts.join(known, [KEY, "task"], "left").select(KEY, "episode_index", "task_index", "task")


def task_set_check(tasks: DataFrame, episode_tasks: DataFrame) -> DataFrame:
    """Whether task ids are 0..n-1 and exactly those the episodes use."""
    listed = tasks.groupBy(KEY).agg(
        F.count("*").alias("task_count"), F.count_distinct("task_index").alias("_d"),
        F.min("task_index").alias("_lo"), F.max("task_index").alias("_hi"))
    used = episode_tasks.where(F.col("task_index").isNotNull()).select(KEY, "task_index").distinct()
    ids = tasks.select(KEY, "task_index").distinct()
    differing = (
        ids.withColumn("_a", F.lit(1)).join(used.withColumn("_b", F.lit(1)), [KEY, "task_index"], "full_outer")
        .groupBy(KEY).agg(F.count_if(F.col("_b").isNull()).alias("unused"),
                          F.count_if(F.col("_a").isNull()).alias("unlisted")))
    dense = (F.col("_d") == F.col("task_count")) & (F.col("_lo") == 0) & (F.col("_hi") == F.col("task_count") - 1)
    zero = F.lit(0).cast("bigint")
    return listed.join(differing, KEY, "full_outer").select(
        KEY, F.coalesce("task_count", zero).alias("task_count"),
        F.coalesce(dense, F.lit(False)).alias("dense"),
        F.coalesce("unused", zero).alias("unused"), F.coalesce("unlisted", zero).alias("unlisted"),
    ).withColumn("passed", F.col("dense") & (F.col("unused") == 0) & (F.col("unlisted") == 0))


def expected_video_paths(episodes: DataFrame, catalog: DataFrame) -> DataFrame:
    """Distinct paths from each dataset's template, video features and episode shards.

    Placeholders are ``{video_key}``, ``{chunk_index}`` and ``{file_index}``, the
    numbers optionally zero-padded as in ``{chunk_index:03d}``.
    """
    keys = catalog.where(F.col("video_path").isNotNull()).select(
        KEY, "video_path", F.explode(F.map_entries("features")).alias("_f")
    ).where(F.col("_f.value.dtype") == "video").select(KEY, "video_path", F.col("_f.key").alias("video_key"))
    shards = episodes.select(
        KEY, F.col("`data/chunk_index`").alias("chunk"), F.col("`data/file_index`").alias("file")).distinct()
    text = F.replace("video_path", F.lit("{video_key}"), F.col("video_key"))
    for name, column in (("chunk_index", "chunk"), ("file_index", "file")):
        plain = F.col(column).cast("string")
        width = F.regexp_extract("video_path", "\\{" + name + r":0(\d+)d\}", 1).try_cast("int")
        padded = F.lpad(plain, F.greatest(F.coalesce(width, F.lit(0)), F.length(plain)), F.lit("0"))
        text = F.replace(text, F.lit("{" + name + "}"), plain)
        text = F.replace(
            text, F.concat(F.lit("{" + name + ":0"), F.coalesce(width.cast("string"), F.lit("")), F.lit("d}")),
            padded)
    return shards.join(keys, KEY).select(KEY, text.alias("path")).distinct()


def missing_videos(expected: DataFrame, files: DataFrame) -> DataFrame:
    """Expected files that do not exist or are empty."""
    found = files.select(KEY, "path", "size")
    return expected.join(found, [KEY, "path"], "left").where(
        F.col("size").isNull() | (F.col("size") == 0)).select(
        KEY, "path", F.when(F.col("size").isNull(), "missing").otherwise("empty").alias("problem"))


def _lacking(columns: Column, required: tuple[str, ...]) -> Column:
    return F.array_sort(F.array_except(F.array(*[F.lit(c) for c in required]), columns))


def _rule(df: DataFrame, number: float, name: str, passed: Column, message: Column | str) -> DataFrame:
    text = F.lit(message) if isinstance(message, str) else message
    ok = F.coalesce(passed, F.lit(False))
    return df.select(KEY, F.lit(number).alias("rule_no"), F.lit(name).alias("rule"),
                     ok.alias("passed"), F.when(~ok, text).alias("message"))


def quick_rules(tables: DatasetTables) -> DataFrame:
    """Quick rules; a dataset is whatever the catalog lists."""
    base = tables.catalog.select(
        KEY, "info_keys", "fps", "total_episodes", "total_frames", "features", "video_path")
    has = lambda pattern: F.count_if(F.col("path").rlike(pattern))
    videos = F.col("path").rlike(r"^videos/.*\.mp4$")
    files = tables.files.groupBy(KEY).agg(
        has(r"^meta/info\.json$").alias("info_files"), has(r"^meta/tasks\.parquet$").alias("task_files"),
        has(r"^meta/episodes/chunk-[^/]*/file-[^/]*\.parquet$").alias("episode_files"),
        has(r"^data/chunk-[^/]*/file-[^/]*\.parquet$").alias("data_files"),
        F.count_if(videos).alias("video_files"))
    episode_lack = F.concat(
        _lacking(F.col("columns"), REQUIRED_EPISODE_COLUMNS),
        F.when(F.arrays_overlap("columns", F.array(F.lit("task_index"), F.lit("tasks"))),
               F.array().cast("array<string>")).otherwise(F.array(F.lit("task_index"))))
    task_text = F.arrays_overlap("columns", F.array(*[F.lit(c) for c in TASK_TEXT_COLUMNS])) | (
        F.size("columns") == 2)
    # the first shard, by path, that lacks something speaks for the dataset
    lack = (
        F.when(F.col("kind") == "episodes", episode_lack)
        .when(F.col("kind") == "data", _lacking(F.col("columns"), REQUIRED_FRAME_COLUMNS))
        .when(F.array_contains("columns", "task_index") & task_text, F.array().cast("array<string>"))
        .otherwise(F.array(F.lit("task"))))
    shards = tables.shards.withColumn("_lack", F.array_join(lack, ", ")).groupBy(KEY).agg(*[
        F.min_by(F.struct("path", "_lack"), F.when(
            (F.col("kind") == kind) & (F.col("_lack") != ""), F.col("path"))).alias(f"{kind}_lack")
        for kind in ("tasks", "episodes", "data")])
    count = lambda kind, name: row_counts(tables, kind, getattr(tables, "frames" if kind == "data" else kind), name)
    data_rows = count("data", "data_rows")
    tiling = range_tiling(tables.episodes, data_rows)
    row = (
        base.join(files, KEY, "left").join(shards, KEY, "left")
        .join(count("tasks", "task_rows"), KEY, "left")
        .join(count("episodes", "episode_rows"), KEY, "left")
        .join(tiling, KEY, "left")
        .na.fill(0, ["info_files", "task_files", "episode_files", "data_files", "video_files",
                     "task_rows", "episode_rows", "data_rows", "broken", "gaps", "range_end"])
    )
    no_lack = lambda kind: F.col(f"{kind}_lack").isNull()
    lack_text = lambda kind: F.format_string(
        f"{kind.removesuffix('s')} parquet %s missing columns %s", F.col(f"{kind}_lack.path"), F.col(f"{kind}_lack._lack"))
    video_features = F.exists(
        F.coalesce(F.map_values("features"), F.array().cast(
            "array<struct<dtype:string,shape:array<bigint>,names:array<string>>>")),
        lambda f: f["dtype"] == "video")
    is_video = F.coalesce(F.col("video_path") != "", F.lit(False)) | video_features
    missing_keys = _lacking(F.col("info_keys"), REQUIRED_INFO_KEYS)
    rules = [
        ("info_file", F.col("info_files") > 0, "missing required file meta/info.json"),
        ("task_file", F.col("task_files") > 0, "missing required file meta/tasks.parquet"),
        ("episode_files", F.col("episode_files") > 0, "no episode parquet files under meta/episodes"),
        ("data_files", F.col("data_files") > 0, "no data parquet files under data"),
        ("info_readable", F.col("info_keys").isNotNull(), "could not read meta/info.json"),
        ("info_keys", F.size(missing_keys) == 0,
         F.concat(F.lit("missing info.json keys "), F.array_join(missing_keys, ", "))),
        ("task_columns", no_lack("tasks"), "tasks.parquet missing required columns"),
        ("task_rows", F.col("task_rows") > 0, "tasks.parquet must contain at least 1 task"),
        ("episode_columns", no_lack("episodes"), lack_text("episodes")),
        ("data_columns", no_lack("data"), lack_text("data")),
        ("totals", F.col("total_episodes").isNotNull() & F.col("total_frames").isNotNull(),
         "invalid info.json totals"),
        ("total_episodes", F.col("total_episodes") > 0, "info total_episodes must be at least 1 episode"),
        ("total_frames", F.col("total_frames") > 0, "info total_frames must be at least 1 frame"),
        ("episode_rows", F.col("episode_rows") > 0, "episode parquet must contain at least 1 episode"),
        ("data_rows", F.col("data_rows") > 0, "data parquet must contain at least 1 frame"),
        ("episode_total", F.col("episode_rows") == F.col("total_episodes"), F.format_string(
            "info total_episodes=%d but episodes parquet has %d rows", "total_episodes", "episode_rows")),
        ("frame_total", F.col("data_rows") == F.col("total_frames"), F.format_string(
            "info total_frames=%d but data parquet has %d rows", "total_frames", "data_rows")),
        ("range_shape", F.col("broken") == 0, "invalid episode index ranges"),
        ("range_tiling", F.col("gaps") == 0,
         F.format_string("data rows %d do not match episode ranges", "data_rows")),
        ("range_end", F.col("range_end") == F.col("data_rows"), F.format_string(
            "data rows %d do not match episode range end %d", "data_rows", "range_end")),
        ("videos", ~is_video | (F.col("video_files") > 0),
         "video dataset requires at least one videos/**/*.mp4"),
    ]
    return _stack(row, rules, 1)


def _stack(row: DataFrame, rules: list, first_no: int) -> DataFrame:
    """One row per rule from a table with one row per dataset."""
    checks = [
        F.struct(
            F.lit(i).alias("rule_no"), F.lit(name).alias("rule"),
            F.coalesce(ok, F.lit(False)).alias("passed"),
            (F.lit(text) if isinstance(text, str) else text).alias("message"))
        for i, (name, ok, text) in enumerate(rules, start=first_no)
    ]
    return row.select(KEY, F.inline(F.array(*checks))).withColumn(
        "message", F.when(~F.col("passed"), F.col("message")))


def folder_rules(tables: DatasetTables) -> DataFrame:
    """What can be wrong before a file is read: folders that are missing and files without a footer.

    Numbers place them between the quick rules; of a file that can't be read and one that lacks columns the first
    by path speaks.
    """
    unreadable = tables.shards.where(F.col("error").isNotNull())
    lacking = tables.shards.where(F.col("error").isNull() & (F.col("kind") == "episodes") & (F.array_join(F.concat(
        _lacking(F.col("columns"), REQUIRED_EPISODE_COLUMNS), F.when(
            F.arrays_overlap("columns", F.array(F.lit("task_index"), F.lit("tasks"))), F.array().cast("array<string>")
        ).otherwise(F.array(F.lit("task_index")))), "") != "")).groupBy(KEY).agg(F.min("path").alias("lack"))
    first = unreadable.groupBy(KEY).agg(*[
        F.min(F.when(F.col("kind") == kind, F.struct("path", "error"))).alias(kind) for kind in ("tasks", "episodes", "data")])
    row = tables.folders.join(first, KEY, "left").join(lacking, KEY, "left")
    text = lambda kind: F.format_string(
        f"could not read {kind.removesuffix('s')} parquet %s (%s)", F.col(f"{kind}.path"), F.col(f"{kind}.error"))
    rules = [
        (0.5, "dataset_folder", F.col("there"), F.concat(F.lit("missing dataset directory "), "dataset_path")),
        (2.4, "episode_folder", F.col("episode_folder"), "missing required directory meta/episodes"),
        (2.6, "data_folder", F.col("data_folder"), "missing required directory data"),
        (6.5, "task_readable", F.col("tasks").isNull(), F.format_string("could not read meta/tasks.parquet (%s)", "tasks.error")),
        (8.5, "episode_readable", F.col("episodes").isNull() | F.coalesce(F.col("lack") < F.col("episodes.path"), F.lit(False)), text("episodes")),
        (9.5, "data_readable", F.col("data").isNull(), text("data")),
    ]
    return reduce(DataFrame.unionByName, [_rule(row, *r) for r in rules])


def full_rules(tables: DatasetTables) -> DataFrame:
    """Rules beyond the quick ones: tasks, frame references and video files."""
    sets = episode_task_sets(tables.episodes, tables.tasks)
    unresolved = sets.where(F.col("task_index").isNull()).groupBy(KEY).agg(
        F.count_if(F.col("task").isNull()).alias("empty_lists"), F.min("task").alias("unknown_task"))
    tasks = task_set_check(tables.tasks, sets).select(KEY, F.col("passed").alias("tasks_ok"))
    contiguous = index_contiguity(tables.frames).select(KEY, "contiguous")
    refs = frame_references(tables.frames, tables.episodes, sets).drop("frames")
    videos = missing_videos(expected_video_paths(tables.episodes, tables.catalog), tables.files).groupBy(KEY).agg(
        F.min_by(F.struct("path", "problem"), "path").alias("_video"))
    row = reduce(lambda a, b: a.join(b, KEY, "left"),
                 [unresolved, tasks, contiguous, refs, videos], tables.catalog.select(KEY))
    none = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    rules = [
        ("episode_task_lists", none("empty_lists"), "episode tasks list is empty"),
        ("episode_task_known", F.col("unknown_task").isNull(),
         F.format_string("unknown episode task '%s'", "unknown_task")),
        ("task_sets", F.col("tasks_ok"), "task index mismatch between tasks.parquet and episodes"),
        ("index_contiguity", F.col("contiguous"), "data index reference mismatch"),
        ("index_references", none("outside"), "data index reference mismatch"),
        ("episode_references", none("wrong_episode"), "data episode reference mismatch"),
        ("task_references", none("wrong_task"), "data task reference mismatch"),
        ("video_files", F.col("_video").isNull(), F.when(
            F.col("_video.problem") == "missing", F.concat(F.lit("missing video file "), F.col("_video.path"))
        ).otherwise(F.concat(F.lit("video file is not accessible "), F.col("_video.path")))),
    ]
    return _stack(row, rules, 101)


def verdict(rules: DataFrame, mode: str, rows: DataFrame) -> DataFrame:
    """Status and summary per dataset: the first failed rule, or passed. ``rows``: ``(dataset_key, _rows)``."""
    failed = ~F.col("passed")
    per = rules.groupBy(KEY).agg(
        F.min_by("message", F.when(failed, F.col("rule_no"))).alias("_m"), F.count_if(failed).alias("_n"))
    passed = F.format_string(f"{mode} passed: %d episodes, 0 warnings", F.coalesce("_rows", F.lit(0)))
    return per.join(rows, KEY, "left").select(
        KEY, F.when(F.col("_n") == 0, "passed").otherwise("failed").alias("status"),
        F.when(F.col("_n") == 0, passed).otherwise(
            F.concat(F.lit(f"{mode} failed: "), "_m")).alias("summary"))


def _all_quick(tables: DatasetTables) -> DataFrame:
    rules = quick_rules(tables)
    return rules if tables.folders is None else rules.unionByName(folder_rules(tables))


def quick_validate(tables: DatasetTables) -> DataFrame:
    return verdict(_all_quick(tables), "Quick", row_counts(tables, "episodes", tables.episodes, "_rows"))


def full_validate(tables: DatasetTables) -> DataFrame:
    """Quick rules come first; the deeper ones decide only when those pass.

    No loader is run on the files, so the best outcome is partial.
    """
    rules = _all_quick(tables).unionByName(full_rules(tables))
    sound = F.col("status") == "passed"
    return verdict(rules, "Full", row_counts(tables, "episodes", tables.episodes, "_rows")).select(
        KEY, F.when(sound, "partial").otherwise(F.col("status")).alias("status"),
        F.when(sound, LOADER_SKIPPED).otherwise(F.col("summary")).alias("summary"))
