"""Curation states: detected recordings on their way from bronze to silver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.model import STALE_REASON
from kinetable.operators.annotations import merge_upsert

REASON_LENGTH = 1000
SILVER_LAYOUT = "{root}/silver_label_data/{cell}/{task}/{serial}"


def discover_bronze(files: DataFrame, root: str, layout: str = SILVER_LAYOUT) -> DataFrame:
    """Bronze recordings from paths ``bronze/cell/task/serial`` relative to the root.

    ``layout`` says where the silver copy goes.
    """
    part = lambda i: F.regexp_extract("path", r"^bronze/([^/]+)/([^/]+)/([^/]+)$", i)
    rows = files.where(F.col("path").rlike(r"^bronze/[^/]+/[^/]+/[^/]+$")).select(
        part(3).alias("serial_number"), part(1).alias("cell"), part(2).alias("task"),
        F.concat(F.lit(f"{root}/"), "path").alias("bronze_path"))
    template = F.lit(layout.replace("{root}", root))
    for field, column in (("cell", "cell"), ("task", "task"), ("serial", "serial_number")):
        template = F.replace(template, F.lit("{" + field + "}"), F.col(column))
    return rows.withColumn("silver_path", template)


def upsert_detected(states: DataFrame, detected: DataFrame, now: Column) -> DataFrame:
    """Add detected recordings; known ones change only while still just detected."""
    new = detected.select(
        "serial_number", "cell", "task", "bronze_path", "silver_path",
        F.lit("bronze_detected").alias("state"), F.lit(None).cast("string").alias("failure_reason"),
        F.lit(None).cast("timestamp").alias("processing_started_at"),
        F.lit(False).alias("retry_required"), now.alias("updated_at"))
    # a recording can turn up under two tasks; the last path in name order wins
    one_each = new.groupBy("serial_number").agg(F.max_by(
        F.struct(*[c for c in new.columns if c != "serial_number"]), "bronze_path").alias("_r")
    ).select("serial_number", "_r.*")
    have = [c for c in one_each.columns if c in states.columns]
    return merge_upsert(
        states, one_each.select(*have), ["serial_number"],
        when=F.col("old.state") == "bronze_detected")


def stale_timeout(states: DataFrame, as_of: Column, seconds: int = 3600) -> DataFrame:
    """Fail recordings that have been processing for longer than the timeout."""
    limit = F.timestamp_micros(F.unix_micros(as_of) - F.lit(seconds * 1_000_000))
    stale = F.coalesce(
        (F.col("state") == "silver_processing") & (F.col("processing_started_at") < limit), F.lit(False))
    return states.withColumn("_stale", stale).withColumns({
        "state": F.when(F.col("_stale"), "silver_failed").otherwise(F.col("state")),
        "failure_reason": F.when(F.col("_stale"), STALE_REASON).otherwise(F.col("failure_reason")),
        "retry_required": F.col("retry_required") | F.col("_stale"),
        "updated_at": F.when(F.col("_stale"), as_of).otherwise(F.col("updated_at")),
    }).withColumnRenamed("_stale", "went_stale")


def eligible_batch(states: DataFrame, limit: int | None = None) -> DataFrame:
    """Detected recordings, oldest first, at most ``limit`` of them."""
    ready = states.where("state = 'bronze_detected'")
    return ready if limit is None else ready.orderBy("updated_at", "serial_number").limit(limit)


def finish_batch(
    states: DataFrame, results: DataFrame, now: Column, reason_length: int = REASON_LENGTH
) -> DataFrame:
    """Processed recordings become ready, those with an error failed and to be retried.

    ``results`` holds ``(serial_number, error)``, error NULL on success; the state
    shows the first ``reason_length`` characters of an error.
    """
    done = results.select("serial_number", F.lit(True).alias("_done"), F.col("error").alias("_err"))
    joined = states.join(done, "serial_number", "left")
    ok = F.col("_done") & F.col("_err").isNull()
    bad = F.col("_done") & F.col("_err").isNotNull()
    keep = lambda name: F.col(name)
    return joined.withColumns({
        "state": F.when(ok, "silver_ready").when(bad, "silver_failed").otherwise(keep("state")),
        "failure_reason": F.when(ok, None).when(
            bad, F.substring("_err", 1, reason_length)).otherwise(keep("failure_reason")),
        "retry_required": F.when(ok, False).when(bad, True).otherwise(keep("retry_required")),
        "processing_started_at": F.when(F.col("_done"), now).otherwise(keep("processing_started_at")),
        "updated_at": F.when(F.col("_done"), now).otherwise(keep("updated_at")),
    }).drop("_done", "_err")


def silver_bridge(states: DataFrame) -> DataFrame:
    """Serial bridge rows of ready recordings: each is episode 0 of its own dataset."""
    return states.where("state = 'silver_ready'").select(
        F.col("silver_path").alias("dataset_path"), F.lit(0).cast("bigint").alias("episode_index"),
        "serial_number")


def medallion_step(
    states: DataFrame, detected: DataFrame, outcomes: DataFrame, as_of: Column,
    timeout: int = 3600, limit: int | None = None,
) -> DataFrame:
    """One batch from bronze to silver: time out, take in, pick the eligible, record outcomes.

    ``outcomes`` says for each serial how moving its files went; only picked
    recordings use it, and one without an outcome counts as moved.
    """
    timed = stale_timeout(states, as_of, timeout).drop("went_stale")
    known = upsert_detected(timed, detected, as_of)
    picked = eligible_batch(known, limit).select("serial_number")
    results = picked.join(outcomes, "serial_number", "left").select("serial_number", "error")
    return finish_batch(known, results, as_of)


def drop_legacy_state(
    states: DataFrame, old: str, new: str, column: str
) -> DataFrame:
    """Rename one state value and drop a column that is no longer used."""
    renamed = F.when(F.col("state") == old, new).otherwise(F.col("state"))
    return states.withColumn("state", renamed).drop(column)


def drop_info_key(datasets: DataFrame, source: str, key: str) -> DataFrame:
    """Remove one key from the features map of datasets that came from a source."""
    match = F.coalesce(F.try_element_at("features", F.lit("source")) == source, F.lit(False))
    return datasets.withColumn("features", F.when(
        match, F.map_filter("features", lambda k, v: k != key)).otherwise(F.col("features")))
