"""Annotations joined onto episodes, the four overlay policies, and grade updates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.functions.grades import (
    clean_tags, grade_norm, has_grade, kept_reason, valid_grade_update,
)
from kinetable.functions.serials import serial_join_key
from kinetable.operators.episodes import latest_rows

EP = ("dataset_key", "episode_index")
SHARD_PLACE = ("shard_path", "shard_row")


def _empty_tags() -> Column:
    return F.array().cast("array<string>")


def annotation_by_index(bridge: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotations of each dataset keyed by episode, through the serial bridge."""
    return bridge.join(annotations, "serial_number").select(
        *EP, "serial_number", "grade", F.coalesce("tags", _empty_tags()).alias("tags"), "reason"
    )


def annotation_by_serial(episodes: DataFrame, annotations: DataFrame) -> DataFrame:
    """Each episode with the annotation of its serial, if any, in ``by_serial``.

    Episodes without a serial get keys of their own, so they do not gather in
    one task.
    """
    keyed = episodes.withColumn("_jk", serial_join_key(F.col("Serial_number"), *map(F.col, EP)))
    side = annotations.select(
        F.col("serial_number").alias("_jk"), _payload().alias("by_serial")
    )
    return keyed.join(side, "_jk", "left").drop("_jk")


def _payload() -> Column:
    return F.struct("grade", F.coalesce("tags", _empty_tags()).alias("tags"), "reason")


def _with_index(episodes: DataFrame, by_index: DataFrame) -> DataFrame:
    side = by_index.select(*EP, _payload().alias("by_index"))
    return episodes.join(side, list(EP), "left")


def _column(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _take(df: DataFrame, chosen: Column, out_reason: bool = True) -> DataFrame:
    """Replace grade, tags and reason wherever an annotation was chosen."""
    found = chosen.isNotNull()
    pick = lambda name, old: F.when(found, chosen[name]).otherwise(old)
    changed = {
        "grade": pick("grade", _column(df, "grade", "string")),
        "tags": pick("tags", F.coalesce(_column(df, "tags", "array<string>"), _empty_tags())),
    }
    if out_reason:
        changed["reason"] = pick("reason", _column(df, "reason", "string"))
    return df.withColumns(changed)


def resolve_episode_list(
    episodes: DataFrame, by_index: DataFrame, annotations: DataFrame
) -> DataFrame:
    """Listing policy: index first, serial only on a miss; a found row replaces, NULL grade too."""
    both = _with_index(annotation_by_serial(episodes, annotations), by_index)
    chosen = F.coalesce("by_index", "by_serial")
    return _take(both, chosen).drop("by_index", "by_serial")


def resolve_distribution(
    episodes: DataFrame, by_index: DataFrame, annotations: DataFrame
) -> DataFrame:
    """Distribution policy: serial first, then index; episodes known only to annotations stay."""
    known = episodes.select(
        *EP, "grade", "tags", "Serial_number", F.lit(True).alias("_known")
    )
    side = by_index.select(*EP, _payload().alias("by_index"))
    both = known.join(side, list(EP), "full_outer")
    both = annotation_by_serial(both, annotations)
    chosen = F.when(F.col("_known"), F.coalesce("by_serial", "by_index")).otherwise(F.col("by_index"))
    return _take(both, chosen, out_reason=False).select(
        *EP, "grade", "tags", F.coalesce("_known", F.lit(False)).alias("in_parquet")
    )


def db_only_annotations(episodes: DataFrame, by_index: DataFrame) -> DataFrame:
    """Annotations whose episode is not in the tables."""
    return by_index.join(episodes.select(*EP), list(EP), "left_anti")


def resolve_export(episodes: DataFrame, by_index: DataFrame) -> DataFrame:
    """Export policy: by index only, and a NULL grade leaves the stored one."""
    both = _with_index(episodes, by_index)
    return both.withColumn("grade", F.coalesce("by_index.grade", "grade")).drop("by_index")


def last_of_shards(episodes: DataFrame) -> DataFrame:
    """One row per episode, the last by shard; rows without a place in a shard are as they are."""
    if not set(SHARD_PLACE) <= set(episodes.columns):
        return episodes
    return latest_rows(episodes, EP, SHARD_PLACE)


def first_serial_owner(episodes: DataFrame, order: Sequence[str] = ("episode_index",)) -> DataFrame:
    """Serial bridge: the first episode of each non-empty serial in a dataset."""
    named = episodes.where(F.coalesce(F.col("Serial_number") != "", F.lit(False)))
    # a single number as order keeps this a hash aggregate
    first = F.min("episode_index") if tuple(order) == ("episode_index",) else F.min_by("episode_index", F.struct(*order))
    return named.groupBy("dataset_key", F.col("Serial_number").alias("serial_number")).agg(
        first.alias("episode_index")).select(*EP, "serial_number")


def resolve_summary(
    episodes: DataFrame, legacy: DataFrame, annotations: DataFrame,
    order: Sequence[str] = ("episode_index",),
) -> DataFrame:
    """Summary policy: stored grade, then a non-null legacy one, then the serial's annotation.

    Only the first episode of a serial takes its annotation; a NULL grade there clears.
    Of rows that share an id the last by shard counts, but each may own a serial;
    episodes that only the legacy annotations know stay, with their grade alone.
    """
    if set(SHARD_PLACE) <= set(episodes.columns):
        order = SHARD_PLACE
    old = legacy.where(F.col("grade").isNotNull()).select(*EP, F.col("grade").alias("_legacy"))
    owned = first_serial_owner(episodes, order).join(
        annotations.select("serial_number", F.struct("grade").alias("_ann")), "serial_number"
    ).select(*EP, "_ann")
    return (
        last_of_shards(episodes).join(old, list(EP), "full_outer").join(owned, list(EP), "left")
        .withColumn("grade", F.when(F.col("_ann").isNotNull(), F.col("_ann.grade")).otherwise(
            F.coalesce("_legacy", "grade")))
        .drop("_legacy", "_ann")
    )


def insert_if_absent(
    legacy: DataFrame, bridge: DataFrame, annotations: DataFrame
) -> DataFrame:
    """Annotations plus legacy rows of serials that have none; existing rows win."""
    return annotations.unionByName(
        migrated_rows(legacy, bridge, annotations), allowMissingColumns=True
    )


def migrated_rows(legacy: DataFrame, bridge: DataFrame, annotations: DataFrame) -> DataFrame:
    """Legacy rows that would be inserted; the lowest episode wins inside one serial."""
    with_serial = legacy.join(bridge, list(EP)).groupBy("serial_number").agg(
        F.min_by(F.struct("grade", "tags", "reason"), F.struct(*EP)).alias("_a")
    )
    fresh = with_serial.join(annotations.select("serial_number"), "serial_number", "left_anti")
    return fresh.select("serial_number", "_a.grade", "_a.tags", "_a.reason")


def migration_counts(legacy: DataFrame, bridge: DataFrame, annotations: DataFrame) -> DataFrame:
    """Per dataset: legacy rows, those without a serial, and those already annotated."""
    marked = (
        legacy.join(bridge, list(EP), "left")
        .withColumn("_jk", serial_join_key(F.col("serial_number"), *map(F.col, EP)))
        .join(annotations.select(F.col("serial_number").alias("_jk"), F.lit(True).alias("_has")),
              "_jk", "left")
    )
    return marked.groupBy("dataset_key").agg(
        F.count("*").alias("legacy_rows"),
        F.count_if(F.col("serial_number").isNull()).alias("no_serial"),
        F.count_if(F.col("_has")).alias("already_annotated"),
    )


def merge_upsert(
    current: DataFrame, new: DataFrame, keys: Sequence[str],
    when: Column | None = None, order: Column | None = None,
) -> DataFrame:
    """Rows of ``new`` replace or join those of ``current``; the result is a full new table.

    ``when`` limits replacement by a condition on the current row (``old.*``).
    Columns that ``new`` lacks keep their current value. Of several rows of
    ``new`` with one key the last in ``order`` counts (by default the greatest
    of their values), so a key stays one row.
    """
    columns = [c for c in current.columns if c not in keys]
    have = current.select(*keys, F.struct(*columns).alias("old"))
    incoming = [c for c in new.columns if c not in keys]
    row = F.struct(*incoming)
    # maps have no order of their own
    kinds = dict(new.dtypes)
    has_map = any("map<" in kinds[c] for c in incoming)
    if order is None and has_map:
        order = F.struct(*[F.to_json(F.struct(c)) if "map<" in kinds[c] else F.col(c) for c in incoming])
    come = new.groupBy(*keys).agg((F.max(row) if order is None else F.max_by(row, order)).alias("new"))
    both = have.join(come, list(keys), "full_outer")
    take = F.col("new").isNotNull()
    if when is not None:
        take = take & (F.col("old").isNull() | F.coalesce(when, F.lit(False)))
    values = [
        (F.when(take, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")) if c in incoming
         else F.col(f"old.{c}")).alias(c)
        for c in columns
    ]
    return both.select(*keys, *values)


def grade_updates(updates: DataFrame) -> DataFrame:
    """Checked grade updates: tags trimmed, reason cleared next to good or no grade.

    ``valid`` marks rows that may be applied; ``keep_tags`` those without tags,
    which leave the old ones.
    """
    return updates.select(
        "*", valid_grade_update(F.col("grade"), F.col("reason")).alias("valid"),
        F.col("tags").isNull().alias("keep_tags"),
    ).withColumns({
        "reason": kept_reason(F.col("grade"), F.col("reason")),
        "tags": clean_tags(F.col("tags")),
    })


def apply_grade_updates(
    annotations: DataFrame, updates: DataFrame, bridge: DataFrame
) -> DataFrame:
    """Upsert valid updates keyed by episode onto annotations keyed by serial.

    If episodes of several datasets have one serial, the last dataset and
    episode by key and index decides.
    """
    ready = grade_updates(updates).where("valid").join(bridge, list(EP))
    joined = ready.join(
        annotations.select("serial_number", F.col("tags").alias("_old")), "serial_number", "left"
    )
    new = joined.select(
        "serial_number", "grade",
        F.when(F.col("keep_tags"), F.coalesce("_old", _empty_tags())).otherwise(F.col("tags"))
        .alias("tags"),
        "reason", F.struct(*EP).alias("_at"),
    )
    last = new.groupBy("serial_number").agg(F.max_by(F.struct("grade", "tags", "reason"), "_at").alias("_row"))
    return merge_upsert(annotations, last.select("serial_number", "_row.*"), ["serial_number"])


def bulk_grade(
    annotations: DataFrame, episodes: DataFrame, bridge: DataFrame,
    grade: str, reason: str | None, updated_at: Column,
) -> DataFrame:
    """Give all listed episodes one grade and reason; their tags stay."""
    serials = episodes.select(*EP).distinct().join(bridge, list(EP)).select("serial_number").distinct()
    new = serials.select(
        "serial_number",
        F.lit(grade).alias("grade"),
        kept_reason(F.lit(grade), F.lit(reason)).alias("reason"),
        updated_at.alias("updated_at"),
    )
    merged = merge_upsert(annotations, new, ["serial_number"])
    return merged.withColumn("tags", F.coalesce("tags", _empty_tags()))


def unmapped_episodes(episodes: DataFrame, bridge: DataFrame) -> DataFrame:
    """Episodes that cannot be graded because they own no serial."""
    return episodes.select(*EP).distinct().join(bridge.select(*EP), list(EP), "left_anti")


def undo_groups(before: DataFrame) -> DataFrame:
    """Previous grade and reason per episode, with the size of each restore group.

    Ungraded episodes form the group to clear.
    """
    groups = before.groupBy("dataset_key", "grade", "reason").agg(F.count("*").alias("group_size"))
    graded = F.col("grade").isNotNull()
    return groups.select(
        "dataset_key", F.when(graded, F.col("grade")).alias("grade"),
        F.when(graded, F.col("reason")).alias("reason"),
        graded.alias("restore"), "group_size",
    ).groupBy("dataset_key", "restore", "grade", "reason").agg(
        F.sum("group_size").alias("group_size")
    )


def undo_members(before: DataFrame) -> DataFrame:
    """Each episode with the restore group it belongs to."""
    graded = F.col("grade").isNotNull()
    return before.select(
        *EP, graded.alias("restore"), "grade", F.when(graded, F.col("reason")).alias("reason")
    )


def export_filter(episodes: DataFrame, exclude: Sequence[str]) -> DataFrame:
    """Drop episodes whose normalised grade is excluded; ungraded ones stay."""
    listed = [g.strip().lower() for g in exclude]
    grade = F.when(has_grade(F.col("grade")), grade_norm(F.col("grade")))
    return episodes.where(~F.coalesce(grade.isin(*listed), F.lit(False)))
