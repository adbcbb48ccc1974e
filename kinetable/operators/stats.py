"""Per-dataset grade statistics and the registry questions asked of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetable.functions.grades import grade_key, grade_norm, has_grade
from kinetable.model import GRADES, UNGRADED
from kinetable.operators.annotations import EP, last_of_shards

STAT_COLUMNS = (
    "graded_count", "good_count", "normal_count", "bad_count", "total_duration_sec",
    "good_duration_sec", "normal_duration_sec", "bad_duration_sec",
)


def _frames(df: DataFrame) -> Column:
    """Stored length, else the frame range, else 0.

    Rows that know the columns of their shard (``shard_columns``) are judged by these: a length that is NULL counts 0,
    a shard without lengths has its ranges.
    """
    whole = lambda name: F.coalesce(F.col(name).cast("bigint"), F.lit(0))
    span = lambda: F.greatest(whole("dataset_to_index") - whole("dataset_from_index"), F.lit(0))
    sources = [(("length",), lambda: whole("length")), (("dataset_from_index", "dataset_to_index"), span)]
    here = [(names, value) for names, value in sources if set(names) <= set(df.columns)]
    if "shard_columns" not in df.columns:
        return here[0][1]() if here else F.lit(0)
    found = F.lit(0)
    for names, value in reversed(here):
        has = F.size(F.array_intersect("shard_columns", F.array(*[F.lit(n) for n in names]))) == len(names)
        found = F.when(has, value()).otherwise(found)
    return found


def dataset_grade_summary(resolved: DataFrame, catalog: DataFrame) -> DataFrame:
    """Grade counts and seconds per dataset over all its episodes.

    Frames are summed first and divided once; a frame rate of 0 divides by 1.
    """
    grade = F.when(has_grade(F.col("grade")), grade_norm(F.col("grade")))
    frames = _frames(resolved)
    sums = [F.count_if(grade == g).alias(f"{g}_count") for g in GRADES]
    sums += [F.sum(F.when(grade == g, frames)).alias(f"_{g}") for g in GRADES]
    totals = resolved.groupBy("dataset_key").agg(F.sum(frames).alias("_total"), *sums)
    rate = F.when(F.col("fps") > 0, F.col("fps")).otherwise(F.lit(1.0))
    seconds = lambda name: (F.coalesce(F.col(name), F.lit(0)) / rate)
    return totals.join(catalog.select("dataset_key", "fps"), "dataset_key", "left").select(
        "dataset_key",
        (F.col("good_count") + F.col("normal_count") + F.col("bad_count")).alias("graded_count"),
        "good_count", "normal_count", "bad_count",
        seconds("_total").alias("total_duration_sec"),
        *[seconds(f"_{g}").alias(f"{g}_duration_sec") for g in GRADES],
    )


def refresh_stats(
    bridge: DataFrame, annotations: DataFrame, episodes: DataFrame, catalog: DataFrame
) -> DataFrame:
    """Cached statistics: exact grades over owned serials, seconds of annotated episodes only.

    Without a positive frame rate all seconds are 0. Of rows that share an id the last by shard counts.
    """
    episodes = last_of_shards(episodes)
    owned = bridge.join(
        annotations.select("serial_number", "grade", F.lit(True).alias("annotated")),
        "serial_number", "left",
    ).join(episodes.select(*EP, _frames(episodes).alias("_frames")), list(EP), "left")
    frames = F.when(F.col("annotated"), F.coalesce("_frames", F.lit(0)))
    sums = [F.count_if(F.coalesce(F.col("grade") == g, F.lit(False))).alias(f"{g}_count") for g in GRADES]
    sums += [F.sum(F.when(F.col("grade") == g, frames)).alias(f"_{g}") for g in GRADES]
    totals = owned.groupBy("dataset_key").agg(
        F.count("grade").alias("graded_count"), F.sum(frames).alias("_total"), *sums)
    rate = F.when(F.col("fps") > 0, F.col("fps"))
    seconds = lambda name: F.coalesce(F.col(name) / rate, F.lit(0.0))
    return catalog.select("dataset_key", "fps").join(totals, "dataset_key", "left").select(
        "dataset_key",
        *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in STAT_COLUMNS[:4]],
        seconds("_total").alias("total_duration_sec"),
        *[seconds(f"_{g}").alias(f"{g}_duration_sec") for g in GRADES],
    )


def grade_summary_cards(episodes: DataFrame, catalog: DataFrame) -> DataFrame:
    """Count, seconds and share per grade card, every card present for every dataset."""
    frames = F.when(F.col("fps") > 0, F.col("length") / F.col("fps")).otherwise(F.lit(0.0))
    keyed = (
        episodes.groupBy("dataset_key", grade_key(F.col("grade")).alias("grade_key"))
        .agg(F.count("*").alias("count"), F.sum("length").alias("length"))
    )
    cards = catalog.select(
        "dataset_key", "fps",
        F.explode(F.array(*[F.lit(g) for g in (*GRADES, UNGRADED)])).alias("grade_key"),
    )
    count = F.coalesce("count", F.lit(0).cast("bigint"))
    total = F.sum(count).over(Window.partitionBy("dataset_key"))  # four cards each
    return (
        cards.join(keyed, ["dataset_key", "grade_key"], "left").withColumn("total", total)
        .select(
            "dataset_key", "grade_key", count.alias("count"),
            F.coalesce(frames, F.lit(0.0)).alias("seconds"), "total",
            F.when(F.col("total") > 0, F.floor(count / F.col("total") * 100 + 0.5))
            .otherwise(F.lit(0).cast("bigint")).alias("percent"),
        )
    )


def grade_counts_raw(recordings: DataFrame, annotations: DataFrame) -> DataFrame:
    """Graded, good, normal and bad counts over the recordings of each raw task."""
    serial = F.concat(F.lit("raw:"), F.concat_ws("/", "cell_task", "serial"))
    marked = recordings.select("cell_task", serial.alias("serial_number")).distinct().join(
        annotations.where(F.col("grade").isNotNull()).select("serial_number", "grade"),
        "serial_number", "left",
    )
    return marked.groupBy("cell_task").agg(
        F.count("grade").alias("graded_count"),
        *[F.count_if(F.coalesce(F.col("grade") == g, F.lit(False))).alias(f"{g}_count") for g in GRADES],
    )


def with_stats(datasets: DataFrame, stats: DataFrame) -> DataFrame:
    """Datasets with their cached statistics, 0 where there are none yet."""
    joined = datasets.join(stats, "dataset_key", "left")
    return joined.withColumns({
        c: F.coalesce(F.col(c), F.lit(0).cast(stats.schema[c].dataType))
        for c in STAT_COLUMNS if c in stats.columns
    })


def registry_search(
    datasets: DataFrame, stats: DataFrame, *, robot_type: str | None = None,
    cell: str | None = None, min_episodes: int | None = None, min_good_ratio: float | None = None,
) -> DataFrame:
    """Datasets matching all given conditions."""
    if robot_type is not None:
        datasets = datasets.where(F.col("robot_type") == robot_type)
    if cell is not None:
        datasets = datasets.where(F.col("cell_name") == cell)
    if min_episodes is not None:
        datasets = datasets.where(F.col("total_episodes") >= min_episodes)
    found = with_stats(datasets, stats)
    if min_good_ratio is not None:
        ratio = F.when(
            F.col("graded_count") > 0, F.col("good_count") / F.col("graded_count")).otherwise(0.0)
        found = found.where(ratio >= min_good_ratio)
    return found
