"""Repairs and checks around recording serials."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.functions.grades import has_grade
from kinetable.operators.annotations import first_serial_owner
from kinetable.operators.ordered import int_block, ordered_scan, row_position
from kinetable.settings import checkpointed

EP = ("dataset_key", "episode_index")


def _named(episodes: DataFrame) -> DataFrame:
    return episodes.where(F.coalesce(F.col("Serial_number") != "", F.lit(False)))


def duplicate_serials(episodes: DataFrame) -> DataFrame:
    """Episodes dropped from the bridge: their serial belongs to an earlier episode."""
    owner = first_serial_owner(episodes).withColumnRenamed("episode_index", "kept_episode")
    return (
        _named(episodes).select(*EP, F.col("Serial_number").alias("serial_number"))
        .join(owner, ["dataset_key", "serial_number"])
        .where(F.col("episode_index") != F.col("kept_episode"))
        .select("dataset_key", "serial_number", "kept_episode",
                F.col("episode_index").alias("dropped_episode"))
    )


def serial_summary(episodes: DataFrame) -> DataFrame:
    """Rows, distinct serials, duplicated serials and their episodes per dataset."""
    per_serial = _named(episodes).groupBy("dataset_key", "Serial_number").agg(F.count("*").alias("n"))
    groups = per_serial.groupBy("dataset_key").agg(
        F.count("*").alias("unique_serials"),
        F.count_if(F.col("n") > 1).alias("duplicate_groups"),
        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("duplicate_episodes"),
    )
    rows = episodes.groupBy("dataset_key").agg(
        F.count("*").alias("rows"), F.count_if(has_grade(F.col("grade"))).alias("graded_rows"))
    zero = F.lit(0).cast("bigint")
    return rows.join(groups, "dataset_key", "left").select(
        "dataset_key", "rows", "graded_rows",
        *[F.coalesce(c, zero).alias(c)
          for c in ("unique_serials", "duplicate_groups", "duplicate_episodes")],
    )


def unique_serials(episodes: DataFrame) -> DataFrame:
    """Give every episode of a repeated serial its own name ``serial_1``, ``serial_2``, ...

    The k-th episode of a serial gets the k-th number not already used by some
    other serial. A taken number t stands after t minus (taken numbers up to t)
    free ones, so the k-th free number is k plus the taken ones with fewer than
    k free numbers before them: a running count, no loop.
    """
    named = _named(episodes).select(*EP, F.col("Serial_number").alias("serial"))
    sizes = checkpointed(named.groupBy("dataset_key", "serial").agg(F.count("*").alias("_n")))
    repeated = sizes.where("_n > 1").select("dataset_key", "serial")
    single = sizes.where("_n = 1").select("dataset_key", "serial")

    parsed = single.select(
        "dataset_key",
        F.regexp_extract("serial", r"^(.*)_([1-9]\d{0,17})$", 1).alias("base"),
        F.regexp_extract("serial", r"^(.*)_([1-9]\d{0,17})$", 2).try_cast("bigint").alias("number"),
    ).where(F.col("number").isNotNull())
    taken = parsed.join(
        repeated.withColumnRenamed("serial", "base"), ["dataset_key", "base"], "left_semi")
    taken = row_position(
        taken, keys=["dataset_key", "base"], order=["number"], block=int_block("number"), out="_i",
    ).select(
        "dataset_key", F.col("base").alias("serial"),
        (F.col("number") - F.col("_i") - 1).alias("_at"), F.lit(1).alias("_kind"),
        F.lit(1).cast("bigint").alias("_one"), F.lit(None).cast("bigint").alias("episode_index"),
    )
    members = named.join(repeated, ["dataset_key", "serial"], "left_semi")
    members = row_position(
        members, keys=["dataset_key", "serial"], order=["episode_index"],
        block=int_block("episode_index"), out="_k",
    ).select(
        "dataset_key", "serial", (F.col("_k") + 1).alias("_at"), F.lit(0).alias("_kind"),
        F.lit(0).cast("bigint").alias("_one"), "episode_index",
    )
    both = checkpointed(members.unionByName(taken))
    counted = ordered_scan(
        both, keys=["dataset_key", "serial"], order=["_at", "_kind", "episode_index"],
        block=int_block("_at"), totals={"_before": F.col("_one")},
    ).where("_kind = 0")
    renamed = counted.select(
        *EP, F.concat_ws("_", "serial", F.col("_at") + F.col("_before")).alias("_new"))
    return episodes.join(renamed, list(EP), "left").withColumn(
        "new_serial", F.coalesce("_new", "Serial_number")).drop("_new")


def reason_reattach(renamed: DataFrame, old_annotations: DataFrame) -> DataFrame:
    """New annotations after renaming: one per graded episode.

    The old reason goes to the first episode of its serial whose grade equals
    the old grade; other episodes get none. ``renamed`` has ``new_serial``.
    """
    old = old_annotations.where(F.coalesce(F.col("reason") != "", F.lit(False))).select(
        F.col("serial_number").alias("Serial_number"), F.col("grade").alias("_g"),
        F.col("reason").alias("_reason"))
    graded = _named(renamed).where(has_grade(F.col("grade")))
    heirs = (
        graded.select(*EP, "Serial_number", "grade").join(old, "Serial_number")
        .where(F.col("grade") == F.col("_g"))
        .groupBy("dataset_key", "Serial_number")
        .agg(F.min("episode_index").alias("episode_index"), F.first("_reason").alias("_reason"))
    )
    return graded.join(heirs.drop("Serial_number"), list(EP), "left").select(
        *EP, F.col("new_serial").alias("serial_number"), "grade",
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.col("_reason").alias("reason"), F.col("Serial_number").alias("old_serial"),
    )


def reattach_counts(new: DataFrame, old_annotations: DataFrame, bridge: DataFrame) -> DataFrame:
    """Old reasons that found an episode, and those that did not, per dataset."""
    owned = bridge.join(
        old_annotations.where(F.coalesce(F.col("reason") != "", F.lit(False))).select("serial_number"),
        "serial_number", "left_semi").select("dataset_key", "serial_number")
    found = new.where(F.col("reason").isNotNull()).select(
        "dataset_key", F.col("old_serial").alias("serial_number")).distinct().withColumn(
        "_found", F.lit(True))
    return owned.join(found, ["dataset_key", "serial_number"], "left").groupBy("dataset_key").agg(
        F.count_if("_found").alias("recovered"), F.count_if(F.col("_found").isNull()).alias("orphaned"))


def serial_collisions(
    replacements: DataFrame, bridge: DataFrame, annotations: DataFrame
) -> DataFrame:
    """Replacement serials owned by another dataset, or annotated but not owned by their own."""
    wanted = replacements.select("dataset_key", "serial_number").distinct()
    owners = bridge.groupBy("serial_number").agg(
        F.min("dataset_key").alias("_low"), F.max("dataset_key").alias("_high"))
    others = wanted.join(owners, "serial_number").where(
        (F.col("_low") != F.col("dataset_key")) | (F.col("_high") != F.col("dataset_key"))
    ).select("dataset_key", "serial_number")
    homeless = wanted.join(annotations.select("serial_number"), "serial_number", "left_semi").join(
        bridge.select("dataset_key", "serial_number"), ["dataset_key", "serial_number"], "left_anti"
    ).select("dataset_key", "serial_number")
    return others.unionByName(homeless).distinct()


def last_state_by_serial(converted: DataFrame) -> DataFrame:
    """Highest converted serial and the number of converted ones per task."""
    return converted.groupBy("cell_task").agg(
        F.max("serial").alias("last_serial"), F.count("*").alias("converted_count"))


def serial_set_digest(
    serials: DataFrame, key: str = "cell_task", keys: DataFrame | None = None
) -> DataFrame:
    """SHA-256 over the distinct serials of each key in order, one per line.

    ``keys`` adds keys without serials, which have the digest of an empty text.

    A hash of one text is sequential by nature; the sorted serials are fed to
    it one by one, so no set is held in memory whatever its size.
    """
    import hashlib

    ordered = serials.select(key, "serial").distinct().repartition(key).sortWithinPartitions(key, "serial")

    def digest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, count = None, None, 0
        for part in parts:
            done = []
            for name, group in part.groupby(key, sort=False):
                if name != current:
                    if state is not None:
                        done.append((current, count, state.hexdigest()))
                    current, state, count = name, hashlib.sha256(), 0
                state.update("".join(s + "\n" for s in group["serial"]).encode())
                count += len(group)
            yield pd.DataFrame(done, columns=[key, "serials", "digest"])
        if state is not None:
            yield pd.DataFrame([(current, count, state.hexdigest())], columns=[key, "serials", "digest"])

    found = ordered.mapInPandas(digest, f"{key} string, serials bigint, digest string")
    if keys is None:
        return found
    return keys.select(key).distinct().join(found, key, "left").select(
        key, F.coalesce("serials", F.lit(0).cast("bigint")).alias("serials"),
        F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("digest"))
