"""Gripper cycles: where a close-to-open movement ends, and the stamps for it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.operators.ordered import int_block, ordered_scan

EP = ("dataset_key", "episode_index")
# fixed values: gripper positions in the state vector, and the two thresholds
LEFT_GRIPPER = 7
RIGHT_GRIPPER = 15
CLOSED = 0.5
OPEN = 0.8
STAMPS = ("is_terminal", "is_last")


def gripper_event(value: Column, closed: float = CLOSED, opened: float = OPEN) -> Column:
    """0 below the closed threshold, 1 above the open one, NULL between and for NaN.

    Compared in single precision, as the states are stored.
    """
    v = value.cast("float")
    limit = lambda x: F.lit(x).cast("float")
    return F.when(F.isnan(v), None).when(v < limit(closed), 0).when(v > limit(opened), 1)


def _arms(frames: DataFrame, left: Column | None, right: Column | None) -> tuple[Column, Column]:
    """Gripper readings of both arms, from the state vector unless given."""
    state = F.col("`observation.state`") if "observation.state" in frames.columns else F.lit(None)
    return (
        (F.get(state, F.lit(LEFT_GRIPPER)) if left is None else left).alias("_l"),
        (F.get(state, F.lit(RIGHT_GRIPPER)) if right is None else right).alias("_r"),
    )


def cycle_ends(
    frames: DataFrame, *, left: Column | None = None, right: Column | None = None,
    order: Sequence[str] = ("frame_index",), keys: Sequence[str] = EP,
    closed: float = CLOSED, opened: float = OPEN,
) -> DataFrame:
    """Add ``is_cycle_end``: a gripper opens after its last event was closing, on either arm."""
    one, other = _arms(frames, left, right)
    events = frames.withColumns({
        "_left": gripper_event(one, closed, opened), "_right": gripper_event(other, closed, opened)})
    seen = ordered_scan(
        events, keys=list(keys), order=list(order), block=int_block("frame_index"),
        carries={"_left_before": F.col("_left"), "_right_before": F.col("_right")},
    )
    ends = lambda arm: F.coalesce(
        (F.col(arm) == 1) & (F.col(f"{arm}_before") == 0), F.lit(False))
    return seen.withColumn("is_cycle_end", ends("_left") | ends("_right")).drop(
        "_left", "_right", "_left_before", "_right_before")


def stamp_cycles(
    frames: DataFrame, *, overwrite: bool = False,
    order: Sequence[str] = ("frame_index", "shard_path", "shard_row"),
    left: Column | None = None, right: Column | None = None,
    closed: float = CLOSED, opened: float = OPEN,
) -> DataFrame:
    """Frames with ``is_terminal`` and ``is_last`` appended.

    Frames of an episode are ordered across shards; rows sharing a frame index
    keep their physical order, and ``order`` names one row of an episode. Stamped
    input is refused unless overwritten. Only the gripper readings are sorted;
    the frames themselves meet the few stamped rows in one join.
    """
    if set(STAMPS) & set(frames.columns) and not overwrite:
        raise ValueError("already_stamped")
    bare = frames.drop(*STAMPS)
    slim = bare.select(*EP, *order, *_arms(bare, left, right))
    marks = cycle_ends(
        slim, left=F.col("_l"), right=F.col("_r"), order=order, closed=closed, opened=opened
    ).where("is_cycle_end").select(*EP, *order, F.lit(True).alias("is_terminal"))
    last = bare.groupBy(*EP).agg(F.max(F.struct(*order)).alias("_last")).select(
        *EP, "_last.*", F.lit(True).alias("is_last"))
    row = [*EP, *order]
    stamps = marks.join(last, row, "full_outer")
    stamped = bare.join(stamps, row, "left")
    columns = [F.col(f"`{c}`") for c in bare.columns]
    return stamped.select(*columns, *[F.coalesce(c, F.lit(False)).alias(c) for c in STAMPS])


def stamp_counts(stamped: DataFrame) -> DataFrame:
    """Episodes, terminal frames and last frames per dataset."""
    per_episode = stamped.groupBy(*EP).agg(
        F.count_if("is_terminal").alias("t"), F.count_if("is_last").alias("l"))
    return per_episode.groupBy("dataset_key").agg(
        F.count("*").alias("episodes_processed"),
        F.sum("t").alias("is_terminal_count"),
        F.sum("l").alias("is_last_count"),
    )


def stamp_state(frames: DataFrame) -> DataFrame:
    """Whether any shard is stamped, and the terminal count of the first stamped shard.

    In a merged read, shards without the columns hold NULL.
    """
    have = [c for c in STAMPS if c in frames.columns]
    datasets = frames.select("dataset_key").distinct()
    if not have:
        return datasets.select(
            "dataset_key", F.lit(False).alias("stamped"), F.lit(0).cast("bigint").alias("terminal_sample"))
    terminal = F.coalesce("is_terminal", F.lit(False)) if "is_terminal" in have else F.lit(False)
    shards = frames.groupBy("dataset_key", "shard_path").agg(
        F.bool_or(F.coalesce(*have).isNotNull()).alias("_has"), F.count_if(terminal).alias("_n"))
    return shards.groupBy("dataset_key").agg(
        F.bool_or("_has").alias("stamped"),
        F.coalesce(
            F.min_by("_n", F.when(F.col("_has"), F.col("shard_path"))), F.lit(0).cast("bigint")
        ).alias("terminal_sample"),
    )
