"""Frame slices, scalar series, observation/action pairs and their divergence."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetable.operators.ordered import int_block, row_position, runs
from kinetable.settings import checkpointed

EP = ("dataset_key", "episode_index")
# fixed values: divergence levels and the shortest severe run, in frames
MODERATE_RATIO = 0.15
SEVERE_RATIO = 0.30
MIN_SEVERE_RUN = 5
TERMINAL_FLAGS = ("is_terminal", "is_last")


def index_range_slice(frames: DataFrame, start: int, stop: int, shard: str | None = None) -> DataFrame:
    """Frames with start <= index < stop; by position in the shard if there are none.

    The range reaches the Parquet scan as a pushed filter. ``shard`` is the end of the path of the only file
    that is looked at, such as the data file an episode names; without it positions are those in any file.
    """
    if shard is not None:
        frames = frames.where(F.col("shard_path").endswith(shard))
    by_position = frames.where(
        (F.col("shard_row") >= max(0, start)) & (F.col("shard_row") < max(0, stop)))
    if "index" not in frames.columns:
        return by_position
    hits = frames.where((F.col("index") >= start) & (F.col("index") < stop))
    return hits.unionByName(by_position.where(~hits.exists()))


def sort_frames(frames: DataFrame) -> DataFrame:
    """Frames in frame order, when they carry one."""
    return frames.orderBy("frame_index") if "frame_index" in frames.columns else frames


def series_columns(features: Mapping[str, str], schema: T.StructType) -> tuple[list[str], list[str]]:
    """State and action columns of a dataset, from feature name -> dtype and the schema."""
    shown = [c for c, dtype in features.items() if dtype not in ("image", "video") and c in schema.names]
    return (
        [c for c in shown if c.startswith("observation.")],
        [c for c in shown if c.startswith("action")],
    )


def _element_of(name: str, alone: Column) -> Callable[[Column, Column], Column]:
    """(series, value) of a vector element; an only element keeps the column's name."""
    indexed = lambda i: F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]"))
    return lambda v, i: F.struct(
        F.when(alone, F.lit(name)).otherwise(indexed(i)).alias("series"), v.cast("double").alias("value"))


def _entries(df: DataFrame, columns: Sequence[str]) -> Column:
    """Array of (series, value) of one frame over scalar and vector columns."""
    parts = []
    for name in columns:
        col, dtype = F.col(f"`{name}`"), df.schema[name].dataType
        if isinstance(dtype, T.ArrayType):
            parts.append(F.transform(col, _element_of(name, F.size(col) == 1)))
        else:
            parts.append(F.array(F.struct(F.lit(name).alias("series"), col.cast("double").alias("value"))))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def explode_series(
    frames: DataFrame, columns: Sequence[str], keys: Sequence[str] = (*EP, "frame_index")
) -> DataFrame:
    """Long form ``(keys, series, value)``; vectors longer than 1 become ``name[i]``."""
    return frames.select(*keys, F.inline(_entries(frames, columns)))


def unify_key(series: Column) -> Column:
    """Pairing name of a series: a trailing ``[i]``, else the name without its prefix."""
    index = F.regexp_extract(series, r"(\[\d+\])$", 1)
    bare = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(series, r"^observation\.state\.?", ""), r"^observation\.", ""),
        r"^action\.?", "")
    return F.when(index != "", index).otherwise(bare)


def pair_state_action(
    frames: DataFrame, states: Sequence[str], actions: Sequence[str],
    keys: Sequence[str] = (*EP, "frame_index"),
) -> DataFrame:
    """Observation and action values of the same frame under their shared key.

    Both sides sit in one frame row, so pairing needs no join. Of action series
    that share a key the last column wins.
    """
    named = lambda columns: F.transform(
        _entries(frames, columns),
        lambda e: F.struct(unify_key(e["series"]).alias("key"), e["value"].alias("value")))
    matches = lambda o: F.filter(F.col("_act"), lambda a: a["key"] == o["key"])
    paired = F.transform(F.col("_obs"), lambda o: F.struct(
        o["key"].alias("key"), o["value"].alias("obs"),
        F.get(F.reverse(matches(o)), F.lit(0)).alias("_a")))
    return (
        frames.select(*keys, named(states).alias("_obs"), named(actions).alias("_act"))
        .select(*keys, F.inline(paired))
        .where(F.col("_a").isNotNull())
        .select(*keys, "key", "obs", F.col("_a.value").alias("act"))
    )


def pair_vectors(
    frames: DataFrame, state: str, action: str, keys: Sequence[str] = (*EP, "frame_index")
) -> DataFrame:
    """The same for one state and one action vector: element i with element i."""
    zipped = F.arrays_zip(
        F.col(f"`{state}`").alias("obs"), F.col(f"`{action}`").alias("act"))
    return frames.select(*keys, F.posexplode(zipped).alias("_i", "_z")).where(
        F.col("_z.obs").isNotNull() & F.col("_z.act").isNotNull()
    ).select(
        *keys, F.format_string("[%d]", "_i").alias("key"),
        F.col("_z.obs").cast("double").alias("obs"), F.col("_z.act").cast("double").alias("act"),
    )


def divergence_bands(
    pairs: DataFrame, keys: Sequence[str] = (*EP, "key"), pos: str = "frame_index"
) -> DataFrame:
    """Runs of frames whose observation and action differ by a share of the value range.

    More than 0.30 is severe, more than 0.15 moderate. Severe runs below five
    frames count as moderate, then touching runs of one level merge. A series
    without any range has no bands. ``pos`` counts frames from 0 without holes.
    """
    spread = lambda c: F.max(c) - F.min(c)
    ranges = pairs.groupBy(*keys).agg(F.greatest(spread("obs"), spread("act")).alias("_range"))
    ratio = F.abs(F.col("act") - F.col("obs")) / F.col("_range")
    level = F.when(ratio > SEVERE_RATIO, "severe").when(ratio > MODERATE_RATIO, "moderate")
    levels = (
        pairs.join(ranges.where("_range > 0"), list(keys))
        .select(*keys, pos, level.alias("level"))
        .where(F.col("level").isNotNull())
    )
    return _merge_bands(levels, list(keys), pos)


def _merge_bands(levels: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Bands from frame levels: runs, short severe ones softened, runs again."""
    bands = runs(levels, keys=keys, pos=pos, label="level")
    short = (F.col("level") == "severe") & (F.col("end") - F.col("start") + 1 < MIN_SEVERE_RUN)
    softened = bands.withColumn("level", F.when(short, F.lit("moderate")).otherwise(F.col("level")))
    return runs(softened, keys=keys, pos="start", end="end", label="level")


def vector_divergence_bands(frames: DataFrame, state: str, action: str, pos: str = "frame_index") -> DataFrame:
    """The same for one state and one action vector, element i with element i.

    Ranges are aggregated before the shuffle and come back to each frame as one
    array; only elements that differ enough leave the frame as rows.
    """
    spread = lambda c: F.max(c) - F.min(c)
    # as many entries per episode as the vectors have elements
    ranges = (
        pair_vectors(frames, state, action).groupBy(*EP, "key")
        .agg(F.greatest(spread("obs"), spread("act")).alias("r"))
        .groupBy(*EP).agg(F.map_from_entries(F.collect_list(F.struct("key", "r"))).alias("_ranges"))
    )
    zipped = F.arrays_zip(F.col(f"`{state}`").alias("o"), F.col(f"`{action}`").alias("a"))
    key = lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("]"))
    ratio = lambda e: F.abs(e["a"].cast("double") - e["o"].cast("double")) / F.nullif(e["r"], F.lit(0.0))
    level = lambda x: F.when(x > SEVERE_RATIO, "severe").when(x > MODERATE_RATIO, "moderate")
    measured = F.transform(zipped, lambda e, i: F.struct(
        key(i).alias("key"), e["o"].alias("o"), e["a"].alias("a"),
        F.try_element_at("_ranges", key(i)).alias("r")))
    marked = F.filter(
        F.transform(measured, lambda e: F.struct(e["key"].alias("key"), level(ratio(e)).alias("level"))),
        lambda e: e["level"].isNotNull())
    levels = frames.select(*EP, pos, F.col(f"`{state}`"), F.col(f"`{action}`")).join(
        ranges, list(EP)).select(*EP, pos, F.inline(marked))
    return _merge_bands(levels, [*EP, "key"], pos)


def robot_layout(joints: Column, features: Sequence[Mapping[str, object]]) -> Column:
    """Vector in layout order: the selected joint, or the feature's constant.

    ``features`` are the entries of a robot profile layout, each with a
    ``selector`` or a ``constant``.
    """
    value = lambda f: (
        F.lit(float(f["constant"])) if "constant" in f else F.try_element_at(joints, F.lit(f["selector"])))
    return F.array(*[value(f).cast("float") for f in features])


def layout_order(arms: Sequence[Mapping], exclude: Sequence[str] = ()) -> list[str]:
    """Joint names of a profile: per arm its joints, then its gripper; excluded ones left out."""
    return [
        j for arm in arms for j in (*arm["arm_joints"], *arm["gripper_joints"]) if j not in exclude
    ]


def terminal_frames(frames: DataFrame, keys: Sequence[str] = EP) -> DataFrame:
    """0-based position and time of each flagged frame of an episode.

    The flag is ``is_terminal`` if the frames carry it, else ``is_last``.
    """
    flag = next((c for c in TERMINAL_FLAGS if c in frames.columns), None)
    if flag is None:
        return frames.select(*keys, F.lit(0).cast("bigint").alias("position"), "timestamp").where("false")
    # written once: the blocks and the frames in them are two readings
    slim = checkpointed(frames.select(*keys, "frame_index", "timestamp", flag))
    placed = row_position(
        slim, keys=list(keys), order=["frame_index"], block=int_block("frame_index"), out="position")
    return placed.where(F.col(flag)).select(*keys, "position", "timestamp")
