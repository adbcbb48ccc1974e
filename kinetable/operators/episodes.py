"""Episode rows, file locations, selections and id ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.functions.grades import grade_key
from kinetable.functions.serials import created_at
from kinetable.operators.ordered import int_block, row_position, runs

EP = ("dataset_key", "episode_index")


def _or_zero(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(0).cast("bigint")
    return F.coalesce(F.col(f"`{name}`").cast("bigint"), F.lit(0).cast("bigint"))


def resolve_episode_row(episodes: DataFrame, tasks: DataFrame) -> DataFrame:
    """Stored episode rows with task text, frame count from the range, and creation date.

    A table without ``task_index`` takes the first entry of ``tasks`` and looks
    its index up; an unknown text gets 0.
    """
    lookup = tasks.select("dataset_key", F.col("task_index").alias("_ti"), F.col("task").alias("_tx"))
    if "task_index" in episodes.columns:
        rows = episodes.withColumn("_ti", F.coalesce(F.col("task_index").cast("bigint"), F.lit(0)))
        joined = rows.join(lookup, ["dataset_key", "_ti"], "left").withColumn(
            "_text", F.coalesce("_tx", F.lit("")))
    else:
        first = lookup.groupBy("dataset_key", "_tx").agg(F.min("_ti").alias("_ti"))
        rows = episodes.withColumn("_tx", F.get("tasks", F.lit(0)))
        joined = rows.join(first, ["dataset_key", "_tx"], "left").withColumns({
            "_ti": F.coalesce("_ti", F.lit(0).cast("bigint")), "_text": F.coalesce("_tx", F.lit(""))})
    start, end = _or_zero(episodes, "dataset_from_index"), _or_zero(episodes, "dataset_to_index")
    text_or_null = lambda name: (
        F.col(name) if name in episodes.columns else F.lit(None).cast("string")).alias(name)
    tags = F.col("tags") if "tags" in episodes.columns else F.lit(None).cast("array<string>")
    return joined.select(
        *EP,
        (end - start).alias("length"),
        F.col("_ti").alias("task_index"),
        F.col("_text").alias("task_instruction"),
        _or_zero(episodes, "data/chunk_index").alias("chunk_index"),
        _or_zero(episodes, "data/file_index").alias("file_index"),
        start.alias("dataset_from_index"),
        end.alias("dataset_to_index"),
        text_or_null("grade"),
        F.coalesce(tags, F.array().cast("array<string>")).alias("tags"),
        text_or_null("reason"),
        created_at(text_or_null("Serial_number")).alias("created_at"),
        text_or_null("raw_recording"),
        text_or_null("Serial_number"),
    )


def camera_keys(df: DataFrame) -> list[str]:
    """Cameras that have columns in an episode table."""
    parts = [c.split("/") for c in df.columns if c.startswith("videos/")]
    return sorted({"/".join(p[1:-1]) for p in parts if len(p) > 2})


def episode_file_location(episodes: DataFrame) -> DataFrame:
    """Data shard of each episode and a camera map of video shards and time windows.

    A camera is in the map when its chunk or file is known.
    """
    def entry(camera: str) -> Column:
        field = lambda name, kind: (
            F.col(f"`videos/{camera}/{name}`") if f"videos/{camera}/{name}" in episodes.columns
            else F.lit(None)).cast(kind)
        chunk, file = field("chunk_index", "bigint"), field("file_index", "bigint")
        place = F.struct(
            F.coalesce(chunk, F.lit(0).cast("bigint")).alias("chunk"),
            F.coalesce(file, F.lit(0).cast("bigint")).alias("file"),
            field("from_timestamp", "double").alias("from_ts"),
            field("to_timestamp", "double").alias("to_ts"),
        )
        return F.when(chunk.isNotNull() | file.isNotNull(),
                      F.struct(F.lit(camera).alias("key"), place.alias("value")))

    entries = [entry(c) for c in camera_keys(episodes)]
    videos = F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull())) if entries else (
        F.lit(None).cast("map<string,struct<chunk:bigint,file:bigint,from_ts:double,to_ts:double>>"))
    return episodes.select(
        *EP,
        _or_zero(episodes, "data/chunk_index").alias("data_chunk_index"),
        _or_zero(episodes, "data/file_index").alias("data_file_index"),
        _or_zero(episodes, "dataset_from_index").alias("dataset_from_index"),
        _or_zero(episodes, "dataset_to_index").alias("dataset_to_index"),
        videos.alias("videos"),
    )


def latest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last one by shard order wins."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*order)).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.`{c}`").alias(c) for c in rest])


def curate_filter(
    df: DataFrame, length: tuple[int, int] | None = None, tag: str | None = None
) -> DataFrame:
    """Length in [low, high) and a carried tag, each optional."""
    if length:
        df = df.where((F.col("length") >= length[0]) & (F.col("length") < length[1]))
    return df.where(F.array_contains("tags", tag)) if tag is not None else df


def grade_filter(df: DataFrame, choice: str) -> DataFrame:
    """All episodes, those without a grade, or one exact grade."""
    if choice == "all":
        return df
    if choice == "ungraded":
        return df.where(F.coalesce(F.col("grade") == "", F.lit(True)))
    return df.where(F.col("grade") == choice)


def episodes_for_grade_key(df: DataFrame, key: str) -> DataFrame:
    """Episodes of one grade card; the ungraded card also holds unknown grades."""
    wanted = "(ungraded)" if key in ("(ungraded)", "ungraded") else key.strip().lower()
    return df.where(grade_key(F.col("grade")) == wanted)


def _any_grade(grades: Sequence[str]) -> Column:
    return F.coalesce("grade", F.lit("Ungraded")).isin(*grades)


def _any_tag(tags: Sequence[str]) -> Column:
    return F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, tags))), F.lit(False))


def out_filter(df: DataFrame, grades: Sequence[str], tags: Sequence[str]) -> DataFrame:
    """Any chosen grade and any chosen tag; an empty choice does not constrain."""
    if grades:
        df = df.where(_any_grade(grades))
    return df.where(_any_tag(tags)) if tags else df


def delete_filter(
    df: DataFrame, grades: Sequence[str] = (), tags: Sequence[str] = ()
) -> DataFrame:
    """Episodes to delete by grade or by tag, never both; an empty choice matches none."""
    if grades and tags:
        raise ValueError("choose by grade or by tag")
    if grades:
        return df.where(_any_grade(grades))
    return df.where(_any_tag(tags)) if tags else df.where(F.lit(False))


def delete_guard(df: DataFrame, chosen: DataFrame) -> DataFrame:
    """Per dataset: how many would go, and whether that is refused (none or all)."""
    totals = df.groupBy("dataset_key").agg(F.count("*").alias("episodes"))
    picks = chosen.groupBy("dataset_key").agg(F.count("*").alias("matched"))
    return totals.join(picks, "dataset_key", "left").select(
        "dataset_key", "episodes", F.coalesce("matched", F.lit(0).cast("bigint")).alias("matched")
    ).withColumn("refused", (F.col("matched") == 0) | (F.col("matched") == F.col("episodes")))


def reason_regex_select(
    df: DataFrame, grade: str, pattern: str, ids: Sequence[int] = (), limit: int | None = None
) -> DataFrame:
    """Listed ids, or a grade whose reason matches without regard to case; first ``limit`` rows."""
    if ids:
        df = df.where(F.col("episode_index").isin(*ids))
    else:
        df = df.where(
            (F.col("grade") == grade) & F.coalesce("reason", F.lit("")).rlike(f"(?i){pattern}"))
    return df if limit is None else df.orderBy(*EP).limit(limit)


def point_lookup(df: DataFrame, **keys: object) -> DataFrame:
    """The rows of one key; none means it does not exist."""
    for name, value in keys.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def distinct_tags(df: DataFrame) -> DataFrame:
    """Distinct tags per dataset."""
    return df.select("dataset_key", F.explode("tags").alias("tag")).distinct()


def episode_ranges(ids: DataFrame, keys: Sequence[str] = ("dataset_key",)) -> DataFrame:
    """Runs of consecutive episode ids as ``(keys, start, end)``."""
    unique = ids.select(*keys, "episode_index").distinct().withColumn("_run", F.lit(1))
    return runs(unique, keys=list(keys), pos="episode_index", label="_run").drop("_run")


def episode_ranges_text(
    ids: DataFrame, per_line: int, keys: Sequence[str] = ("dataset_key",)
) -> DataFrame:
    """Ranges as text such as ``0-3, 7, 9-10``, in lines of ``per_line`` ranges.

    The last line of a key may be shorter, so no text grows without bound; for
    one row to a range take :func:`episode_ranges`.
    """
    label = F.when(F.col("start") == F.col("end"), F.col("start").cast("string")).otherwise(
        F.concat_ws("-", "start", "end"))
    placed = row_position(
        episode_ranges(ids, keys).withColumn("label", label),
        keys=list(keys), order=["start"], block=int_block("start"), out="_p",
    )
    line = placed.withColumn("line", F.floor(F.col("_p") / per_line))
    return line.groupBy(*keys, "line").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("_p", "label"))), lambda r: r["label"]),
            ", ",
        ).alias("ranges"),
        F.count("*").alias("range_count"),
    )
