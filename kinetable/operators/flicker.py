"""Localised brightness flicker in camera frames.

Tile rows hold ``(keys, frame_no, tile, luminance)``; ``frame_no`` is the 0-based
position of a frame in its episode's window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetable.operators.ordered import exact_median, int_block
from kinetable.settings import checkpointed

VIDEO = ("dataset_key", "episode_index", "camera")
FRAMES_PER_BLOCK = 16_384
# fixed values: smallest delta, MAD multiple, largest share of spiking tiles
MIN_TILE_DELTA = 12.0
MAD_MULTIPLE = 8.0
MAX_TILE_SHARE = 0.5
ZERO_MAD = 1e-6
BAD_REASON = "auto-bad: localized head/ZED camera luminance flicker"


def is_flicker_camera(camera: Column, dtype: Column) -> Column:
    """Video features of head or ZED cameras."""
    return (dtype == "video") & F.lower(camera).rlike("head|zed")


def frame_delta(tiles: DataFrame, keys: Sequence[str] = VIDEO) -> DataFrame:
    """Absolute change of each tile since the previous frame, in single precision.

    A long video is cut into blocks of frames; the last frame of a block is
    repeated at the head of the next, so every frame meets its predecessor.
    """
    here = int_block("frame_no", FRAMES_PER_BLOCK)
    closes = F.col("frame_no") % FRAMES_PER_BLOCK == FRAMES_PER_BLOCK - 1
    rows = tiles.select(
        *keys, "tile", "frame_no", F.col("luminance").cast("float").alias("luminance"),
        F.explode(F.when(closes, F.array(here, here + 1)).otherwise(F.array(here))).alias("_block"),
    ).withColumn("_own", F.col("_block") == here)
    order = Window.partitionBy(*keys, "tile", "_block").orderBy("frame_no")
    return (
        rows.withColumn("_before", F.lag("luminance").over(order))
        .where(F.col("_own") & F.col("_before").isNotNull())
        .select(*keys, "frame_no", "tile", F.abs(F.col("luminance") - F.col("_before")).alias("delta"))
    )


def flicker_threshold(deltas: DataFrame, keys: Sequence[str] = VIDEO) -> DataFrame:
    """Median and median absolute deviation of all tile deltas, and the spike threshold.

    The medians, one row per video, are written before the deviations are ranked.
    """
    keys = list(keys)
    median = checkpointed(exact_median(
        deltas.withColumn("delta", F.col("delta").cast("double")), keys=keys, value="delta", out="median"))
    off = deltas.join(median, keys).withColumn(
        "_off", F.abs(F.col("delta").cast("double") - F.col("median")))
    mad = exact_median(off, keys=keys, value="_off", out="_mad")
    largest = deltas.groupBy(*keys).agg(F.max("delta").cast("double").alias("max_delta"))
    spread = F.when(F.col("_mad") == 0, F.lit(ZERO_MAD)).otherwise(F.col("_mad"))
    return median.join(mad, keys).join(largest, keys).withColumn("mad", spread).select(
        *keys, "median", "mad", "max_delta",
        F.greatest(F.lit(MIN_TILE_DELTA), F.col("median") + MAD_MULTIPLE * F.col("mad")).alias("threshold"),
    )


def flicker_spikes(
    deltas: DataFrame, thresholds: DataFrame, tile_count: int, keys: Sequence[str] = VIDEO
) -> DataFrame:
    """Frames where some tiles, but at most half of them, jump above the threshold."""
    over = deltas.join(thresholds.select(*keys, "threshold"), list(keys)).where("delta > threshold")
    return (
        over.groupBy(*keys, "frame_no").agg(F.count("*").alias("spiking_tiles"))
        .where(F.col("spiking_tiles") / tile_count <= MAX_TILE_SHARE)
    )


def flicker_verdict(
    tiles: DataFrame, tile_count: int = 16, keys: Sequence[str] = VIDEO
) -> DataFrame:
    """One row per video: matched, number of spikes, first and last spike, largest delta.

    Deltas are ranked twice and compared once, so they are written first.
    """
    keys = list(keys)
    deltas = checkpointed(frame_delta(tiles, keys))
    thresholds = checkpointed(flicker_threshold(deltas, keys))
    found = flicker_spikes(deltas, thresholds, tile_count, keys).groupBy(*keys).agg(
        F.count("*").alias("spike_count"),
        F.min("frame_no").alias("first_spike"), F.max("frame_no").alias("last_spike"))
    videos = tiles.select(*keys).distinct()
    return videos.join(thresholds, keys, "left").join(found, keys, "left").select(
        *keys,
        F.col("spike_count").isNotNull().alias("matched"),
        F.coalesce("spike_count", F.lit(0).cast("bigint")).alias("spike_count"),
        "first_spike", "last_spike",
        F.coalesce("max_delta", F.lit(0.0)).alias("max_delta"),
    )


def expected_cameras(episodes: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each episode with every head or ZED camera of its dataset, in feature order."""
    cameras = catalog.select("dataset_key", F.posexplode(F.map_entries("features")).alias("rank", "_f")).where(
        is_flicker_camera(F.col("_f.key"), F.col("_f.value.dtype"))
    ).select("dataset_key", "rank", F.col("_f.key").alias("camera"))
    return episodes.select("dataset_key", "episode_index", "videos").join(cameras, "dataset_key")


def flicker_scan(
    cameras: DataFrame, verdicts: DataFrame, errors: DataFrame
) -> DataFrame:
    """Per expected camera: matched, or the warning why it was not inspected.

    ``cameras`` comes from ``expected_cameras``; ``errors`` holds decode errors
    per video. An episode is done at its first match, so later cameras are not
    reported.
    """
    place = F.try_element_at("videos", F.col("camera"))
    looked = (
        cameras.withColumn("_here", place.isNotNull()).drop("videos")
        .join(verdicts.select(*VIDEO, "matched"), list(VIDEO), "left")
        .join(errors.select(*VIDEO, "error"), list(VIDEO), "left")
    )
    usable = F.col("_here") & F.col("error").isNull()
    rows = looked.withColumns({
        "matched": usable & F.coalesce("matched", F.lit(False)),
        "warning": F.when(~F.col("_here"), F.format_string(
            "episode %d: missing video location for %s", "episode_index", "camera"))
        .when(F.col("error").isNotNull(), F.format_string(
            "episode %d: cannot decode %s: %s", "episode_index", "camera", "error")),
    })
    # a group here is the few cameras of one episode
    episode = Window.partitionBy("dataset_key", "episode_index")
    first = F.min(F.when(F.col("matched"), F.col("rank"))).over(episode)
    return rows.withColumn("_first", first).where(
        F.col("_first").isNull() | (F.col("rank") <= F.col("_first"))
    ).select(*VIDEO, "rank", "matched", "warning")


def flicker_scan_summary(scan: DataFrame) -> DataFrame:
    """Inspected and matched episodes and warnings per dataset."""
    episodes = scan.groupBy("dataset_key", "episode_index").agg(
        F.bool_or("matched").alias("m"), F.count("warning").alias("w"))
    return episodes.groupBy("dataset_key").agg(
        F.count("*").alias("inspected"), F.count_if("m").alias("matched"), F.sum("w").alias("warnings"))


def flicker_mark_bad(
    matched: DataFrame, episodes: DataFrame, allow: Sequence[str] = ("normal",)
) -> DataFrame:
    """Matched episodes: eligible when their grade may be overwritten, else why they are skipped."""
    keys = ["dataset_key", "episode_index"]
    current = matched.select(*keys).distinct().join(episodes.select(*keys, "grade"), keys, "left")
    eligible = F.coalesce(F.lower("grade").isin(*[g.lower() for g in allow]), F.lit(False))
    skipped = F.concat(F.lit("grade "), F.coalesce("grade", F.lit("None")), F.lit(" is not eligible"))
    return current.select(
        *keys, eligible.alias("eligible"),
        F.when(eligible, F.lit("bad")).otherwise(F.col("grade")).alias("grade"),
        F.when(~eligible, skipped).alias("skipped_reason"),
    )
