"""Conversion bookkeeping: progress, pending recordings, partitions and state checks.

State comes as two tables: one row per task (``cell_task, converted_count,
failed_count, retry_count, last_serial, last_updated``) and one row per
unfinished recording (``cell_task, serial, status`` failed or transient, with its
retry counters), so a task of any size is joined, never held as one list.
``explode_state`` reads both from the JSON state document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetable.functions.serials import strict_recording_date
from kinetable.functions.text import canonical_digest, slug
from kinetable.model import MANUAL_RETRY_ERROR, SERIAL_PATTERN
from kinetable.operators.ordered import row_position
from kinetable.settings import checkpointed

TASK_SERIAL = ("cell_task", "serial")
MINUTE = 13  # length of YYYYMMDD_HHMM


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0).cast("bigint"))


def progress_full_outer(state: DataFrame, totals: DataFrame, outputs: DataFrame) -> DataFrame:
    """Every task of state or raw totals with its output count where one is known."""
    return state.join(totals, "cell_task", "full_outer").join(
        outputs.select("cell_task", F.col("episodes").alias("output_episodes")), "cell_task", "left")


def convert_progress(state: DataFrame, totals: DataFrame, outputs: DataFrame) -> DataFrame:
    """Total, done, pending, failed and retry counts per task; tasks without recordings vanish."""
    rows = progress_full_outer(state, totals, outputs)
    done = F.greatest(F.lit(0), F.least(
        _zero("total"), F.coalesce("output_episodes", "converted_count", F.lit(0))))
    return (
        rows.select(
            "cell_task", _zero("total").alias("total"), done.cast("bigint").alias("done"),
            _zero("failed_count").alias("failed"), _zero("retry_count").alias("retry"),
            "last_updated")
        .where((F.col("total") != 0) | (F.col("done") != 0))
        .withColumn("pending", F.greatest(F.lit(0).cast("bigint"),
                                          F.col("total") - F.col("done") - F.col("failed")))
    )


def progress_summary(progress: DataFrame) -> DataFrame:
    """Totals over all tasks, the overall share and the summary line."""
    sums = progress.agg(
        F.count("*").alias("tasks"),
        *[F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c)
          for c in ("total", "done", "pending", "failed")])
    return sums.select(
        "*",
        F.when(F.col("total") > 0, F.floor(F.col("done") / F.col("total") * 100 + 0.5))
        .otherwise(F.lit(0).cast("bigint")).alias("percent"),
        F.format_string("%d tasks | %d recordings | %d done | %d pending | %d failed",
                        "tasks", "total", "done", "pending", "failed").alias("summary"))


def progress_mismatch(state: DataFrame, totals: DataFrame, outputs: DataFrame) -> DataFrame:
    """Tasks whose state count and output count differ."""
    return progress_full_outer(state, totals, outputs).select(
        "cell_task", _zero("converted_count").alias("state_count"), "output_episodes"
    ).where(F.col("output_episodes").isNotNull() & (F.col("output_episodes") != F.col("state_count")))


def progress_with_validation(progress: DataFrame, validations: DataFrame) -> DataFrame:
    """Progress with the last quick and full validation of each task."""
    result = progress
    for mode in ("quick", "full"):
        one = validations.where(F.col("mode") == mode).groupBy("cell_task").agg(
            F.max_by(F.struct("status", "summary", "checked_at"), "checked_at").alias("_v"))
        result = result.join(one, "cell_task", "left").withColumns({
            f"{mode}_status": F.coalesce("_v.status", F.lit("not_run")),
            f"{mode}_summary": F.coalesce("_v.summary", F.lit("Not validated")),
            f"{mode}_checked_at": F.col("_v.checked_at"),
        }).drop("_v")
    return result


def pending_set(raw: DataFrame, serials: DataFrame) -> DataFrame:
    """Recordings still to convert, and failed ones whose retry is due.

    ``serials`` has status converted, failed, transient or retry_due per
    (cell_task, serial). A retry counts only while its recording exists. The
    result says which of the two a recording is.
    """
    # both tables are read once, and meet in one aggregate
    no, yes = F.lit(False), F.lit(True)
    there = raw.select(*TASK_SERIAL, yes.alias("there"), no.alias("blocked"), no.alias("due"))
    marks = serials.select(*TASK_SERIAL, no.alias("there"), F.col("status").isin("converted", "failed", "transient").alias("blocked"),
                           (F.col("status") == "retry_due").alias("due"))
    per = there.unionByName(marks).groupBy(*TASK_SERIAL).agg(*[
        F.coalesce(F.bool_or(c), no).alias(c) for c in ("there", "blocked", "due")])
    return per.where("there and (due or not blocked)").select(*TASK_SERIAL, F.col("due").alias("retry"))


def retry_first_queue(pending: DataFrame) -> DataFrame:
    """Queue position of each pending recording: due retries first, then the rest by serial."""
    first = F.when(F.col("retry"), F.lit("0")).otherwise(F.lit("1"))
    # written once: the blocks and the rows in them are two readings
    keyed = checkpointed(pending.withColumn("_first", first))
    return row_position(
        keyed, keys=["cell_task"], order=["_first", "serial"],
        # the minute in front of a serial never decreases along the serial order
        block=F.concat("_first", F.substring("serial", 1, MINUTE)), out="position",
    ).drop("_first")


def tasks_with_failures(raw: DataFrame, scan_failures: DataFrame) -> DataFrame:
    """Recordings per task, tasks known only from scan failures included with 0."""
    counts = raw.groupBy("cell_task").agg(F.count("*").alias("recordings"))
    tasks = raw.select("cell_task").unionByName(scan_failures.select("cell_task")).distinct()
    return tasks.join(counts, "cell_task", "left").withColumn("recordings", _zero("recordings"))


def unresolved_set(requested: DataFrame, outputs: DataFrame, failed: DataFrame) -> DataFrame:
    """Requested recordings that are neither in the output nor failed for good."""
    done = outputs.select(*TASK_SERIAL).unionByName(failed.select(*TASK_SERIAL))
    return requested.select(*TASK_SERIAL).join(done, list(TASK_SERIAL), "left_anti")


def run_verdict(before_after: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Verdict of a conversion run per task: regressed, no_progress or ok.

    ``before_after`` has state and output counts before and after the run.
    """
    left = unresolved.groupBy("cell_task").agg(F.count("*").alias("unresolved"))
    rows = before_after.join(left, "cell_task", "left").withColumn("unresolved", _zero("unresolved"))
    still = (F.col("after_count") == F.col("before_count")) & (
        F.col("after_output") <= F.col("before_output"))
    return rows.withColumn("verdict", F.when(
        F.col("after_count") < F.col("before_count"), "regressed"
    ).when(still & (F.col("unresolved") > 0), "no_progress").otherwise("ok"))


def subset_check(converted: DataFrame, raw: DataFrame) -> DataFrame:
    """Per task: converted serials that have no recording, and those listed twice."""
    alien = converted.select(*TASK_SERIAL).distinct().join(
        raw.select(*TASK_SERIAL), list(TASK_SERIAL), "left_anti").groupBy("cell_task").agg(
        F.count("*").alias("not_in_raw"))
    twice = converted.groupBy(*TASK_SERIAL).agg(F.count("*").alias("n")).groupBy("cell_task").agg(
        F.count_if(F.col("n") > 1).alias("repeated"))
    return twice.join(alien, "cell_task", "left").withColumn("not_in_raw", _zero("not_in_raw")).withColumn(
        "passed", (F.col("not_in_raw") == 0) & (F.col("repeated") == 0))


_STATE_ENTRY = (
    "map<string,struct<converted_count:bigint,failed_serials:array<string>,"
    "transient_failed:map<string,struct<attempt_count:bigint,first_failed_at:double,"
    "next_retry_at:double,last_error:string>>,last_serial:string,last_updated:string>>"
)
RETRY_FIELDS = ("attempt_count", "first_failed_at", "next_retry_at", "last_error")


def explode_state(documents: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Task rows and recording rows of a JSON state document; corrupt text gives none."""
    entries = documents.select(F.explode(F.from_json(column, _STATE_ENTRY)).alias("cell_task", "e"))
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("bigint")
    tasks = entries.select(
        "cell_task", F.coalesce("e.converted_count", F.lit(0).cast("bigint")).alias("converted_count"),
        size("e.failed_serials").alias("failed_count"), size("e.transient_failed").alias("retry_count"),
        "e.last_serial", "e.last_updated")
    failed = entries.select("cell_task", F.explode("e.failed_serials").alias("serial")).select(
        *TASK_SERIAL, F.lit("failed").alias("status"))
    waiting = entries.select("cell_task", F.explode("e.transient_failed").alias("serial", "t")).select(
        *TASK_SERIAL, F.lit("transient").alias("status"), *[F.col(f"t.{f}").alias(f) for f in RETRY_FIELDS])
    return tasks, waiting.unionByName(failed, allowMissingColumns=True)


def retry_all_failed(unfinished: DataFrame, now: Column) -> DataFrame:
    """Turn failed recordings into retries with fresh counters.

    A recording that was failed and waiting at once keeps only the fresh entry.
    """
    named = unfinished.where((F.col("status") != "failed") | F.coalesce(F.col("serial") != "", F.lit(False)))
    was_failed = F.col("status") == "failed"
    fresh = {"attempt_count": F.lit(0).cast("bigint"), "first_failed_at": now.cast("double"),
             "next_retry_at": F.lit(0.0), "last_error": F.lit(MANUAL_RETRY_ERROR)}
    entries = named.select(*TASK_SERIAL, was_failed.alias("_f"), F.struct(*[
        F.when(was_failed, v).otherwise(F.col(k)).alias(k) for k, v in fresh.items()]).alias("_e"))
    return entries.groupBy(*TASK_SERIAL).agg(
        F.max_by("_e", F.col("_f").cast("int")).alias("_e"), F.bool_or("_f").alias("reset")
    ).select(*TASK_SERIAL, F.lit("transient").alias("status"), "reset", "_e.*")


# --- recordings grouped by what they recorded ------------------------------

_CARD = (
    "robot_type string, fps string, joint_names array<string>, action_order array<string>, "
    "action_joint_order map<string,array<string>>, action_topics_map map<string,string>, "
    "camera_topic_map map<string,string>"
)


def recording_signature(card: Column) -> Column:
    """Fields of a parsed metacard that shape the converted output, in name order."""
    texts = lambda field: F.coalesce(card[field], F.array().cast("array<string>"))
    keys = lambda field: F.coalesce(
        F.array_sort(F.map_keys(card[field])), F.array().cast("array<string>"))
    orders = F.map_from_entries(F.array_sort(F.map_entries(card["action_joint_order"])))
    return F.struct(
        F.coalesce(orders, F.create_map().cast("map<string,array<string>>")).alias("action_joint_order"),
        texts("action_order").alias("action_order"),
        keys("action_topics_map").alias("action_topic_names"),
        keys("camera_topic_map").alias("camera_names"),
        F.coalesce(card["fps"].try_cast("double").try_cast("bigint"), F.lit(0)).alias("fps"),
        texts("joint_names").alias("joint_names"),
        F.coalesce(card["robot_type"], F.lit("")).alias("robot_type"),
    )


def with_signature(recordings: DataFrame) -> DataFrame:
    """Recordings with their signature, its digest and the short form that is shown; NULL for unreadable metacards.

    Each ``inline`` of one struct keeps a step from being worked out again by
    every column and filter that uses it.
    """
    once = lambda column, name: F.inline(F.array(F.struct(column.alias(name))))
    readable = F.json_object_keys("metacard").isNotNull()
    cards = recordings.select("*", once(F.when(readable, F.from_json("metacard", _CARD)), "_card"))
    signed = cards.select("*", once(F.when(
        F.col("_card").isNotNull(), recording_signature(F.col("_card"))), "signature")).drop("_card")
    signed = signed.select("*", once(F.when(
        F.col("signature").isNotNull(), canonical_digest(F.col("signature"))), "signature_digest"))
    return signed.withColumn("signature_id", F.substring("signature_digest", 1, 8))


def signature_groups(recordings: DataFrame) -> DataFrame:
    """Groups of equal signature per task, largest first, with where each one goes.

    The largest group stays (the one met first in name order on a tie); others
    move to ``<task>__<robot>__<signature>``, with the whole signature if its first
    digits are those of another group of the task.
    """
    signed = with_signature(recordings).where(F.col("signature_id").isNotNull())
    # one row per group; counted, ranked and compared below
    groups = checkpointed(signed.groupBy("cell_task", "signature_digest").agg(
        F.count("*").alias("recordings"), F.min("serial").alias("first_serial"),
        F.min("signature.robot_type").alias("robot_type")))
    kept = top_group(groups)
    numbered = row_position(
        groups.withColumn("_rank", -F.col("recordings")), keys=["cell_task"],
        order=["_rank", "signature_digest"],
        # many groups may be of one size; signatures spread evenly by their first digits
        block=F.struct("_rank", F.substring("signature_digest", 1, 2).alias("_sig")), out="position",
    ).drop("_rank").withColumn("signature_id", F.substring("signature_digest", 1, 8))
    # groups that share eight digits are two or three, so the window is as small
    alike = F.count("*").over(Window.partitionBy("cell_task", "signature_id")) > 1
    numbered = numbered.withColumn("_sign", F.when(alike, F.col("signature_digest")).otherwise(F.col("signature_id")))
    moved = F.concat("cell_task", F.lit("__"), slug(F.col("robot_type")), F.lit("__"), "_sign")
    return numbered.join(kept, "cell_task").select(
        "cell_task", "signature_id", "robot_type", "recordings", "position",
        (F.col("signature_digest") == F.col("keep")).alias("keep_in_source"),
        F.when(F.col("signature_digest") == F.col("keep"), F.col("cell_task")).otherwise(moved)
        .alias("destination"))


def top_group(groups: DataFrame) -> DataFrame:
    """Largest group per task; of equal ones the group whose first recording comes first."""
    size_then_name = F.struct((-F.col("recordings")).alias("size"), "first_serial")
    return groups.groupBy("cell_task").agg(F.min_by("signature_digest", size_then_name).alias("keep"))


def invalid_metacards(recordings: DataFrame) -> DataFrame:
    return with_signature(recordings).where(F.col("signature_id").isNull()).select(*TASK_SERIAL)


def date_groups(recordings: DataFrame) -> DataFrame:
    """Recordings grouped by date, newest first, undated last.

    ``group_order`` and ``item_order`` carry the order; items keep ``item_no`` order.
    """
    dated = recordings.select("cell_task", "serial", "item_no",
                              strict_recording_date(F.col("serial")).alias("date"))
    # days count down, so the newest comes first; undated recordings come last
    dated = dated.withColumn("_day", F.coalesce(-F.unix_date(F.to_date("date")), F.lit(2**31 - 1)))
    groups = dated.groupBy("cell_task", "date", "_day").agg(F.count("*").alias("group_size"))
    placed = row_position(
        groups, keys=["cell_task"], order=["_day"], block=F.floor(F.col("_day") / 365), out="group_order")
    items = row_position(
        dated.withColumn("_date", F.coalesce("date", F.lit(""))), keys=["cell_task", "_date"],
        order=["item_no"], block=F.floor(F.col("item_no") / 65_536), out="item_order",
    ).drop("_date", "date")
    return items.join(placed, ["cell_task", "_day"]).drop("_day")


# --- partitions and state after a partition ---------------------------------

def partition_cover(partitions: DataFrame, recordings: DataFrame) -> DataFrame:
    """Whether partitions cover the recordings of a task exactly once.

    ``partitions``: ``(cell_task, digest, contract, serial)`` with the contract as
    compact name-ordered JSON; ``recordings``: ``(cell_task, serial, digest, status)``.
    """
    bad_digest = (F.sha2("contract", 256) != F.col("digest")) | ~F.col("digest").rlike("^[0-9a-f]{64}$")
    per_serial = partitions.groupBy(*TASK_SERIAL).agg(
        F.count("*").alias("n"), F.min("digest").alias("expected"),
        F.bool_or(bad_digest).alias("bad_digest"),
        F.bool_or(~F.col("serial").rlike(SERIAL_PATTERN)).alias("bad_serial"))
    listed = recordings.groupBy(*TASK_SERIAL).agg(
        F.count("*").alias("m"), F.min("digest").alias("given"),
        F.bool_or(F.col("status") != "resolved").alias("not_resolved"))
    both = per_serial.join(listed, list(TASK_SERIAL), "full_outer")
    return both.groupBy("cell_task").agg(
        F.count_if(F.col("n") > 1).alias("overlapping"),
        F.count_if("bad_digest").alias("wrong_digest"),
        F.count_if("bad_serial").alias("bad_serials"),
        F.count_if(F.coalesce(F.col("m") > 1, F.lit(False)) | F.coalesce("not_resolved", F.lit(False)))
        .alias("bad_recordings"),
        F.count_if(~F.col("expected").eqNullSafe(F.col("given"))).alias("differing"),
        F.count("*").alias("serials"),
    ).withColumn("valid", (
        F.col("overlapping") + F.col("wrong_digest") + F.col("bad_serials")
        + F.col("bad_recordings") + F.col("differing")) == 0)


def state_reconcile(failures: DataFrame, partitions: DataFrame, converted: DataFrame) -> DataFrame:
    """Failures that remain after recordings moved into their partitions.

    ``failures``: ``(cell_task, serial, status, payload)``; ``partitions`` maps each
    ``(source_task, serial)`` to the ``task`` that holds it now; ``converted`` lists
    output serials. Failures of moved or converted recordings are cleared; in a
    destination, ``foreign`` marks those outside its partition, which is an error.
    """
    homes = partitions.select(F.col("task").alias("cell_task"), "serial", F.lit(True).alias("_home"))
    sources = partitions.select(F.col("source_task").alias("cell_task")).distinct().withColumn(
        "_source", F.lit(True))
    moved = partitions.where("task <> source_task").select(
        F.col("source_task").alias("cell_task"), "serial")
    rows = (
        failures.join(converted.select(*TASK_SERIAL), list(TASK_SERIAL), "left_anti")
        .join(moved, list(TASK_SERIAL), "left_anti")
        .join(homes, list(TASK_SERIAL), "left").join(sources, "cell_task", "left")
    )
    return rows.select(
        *TASK_SERIAL, "status", "payload",
        (F.col("_home").isNull() & F.col("_source").isNull()).alias("foreign")).distinct()


def reconciled_counts(tasks: DataFrame, converted: DataFrame) -> DataFrame:
    """Converted count and last serial of each task in scope; '' without output."""
    per_task = converted.select(*TASK_SERIAL).distinct().groupBy("cell_task").agg(
        F.count("*").alias("converted_count"), F.max("serial").alias("last_serial"))
    return tasks.join(per_task, "cell_task", "left").select(
        "cell_task", _zero("converted_count").alias("converted_count"),
        F.coalesce("last_serial", F.lit("")).alias("last_serial"))


STATE_FIELDS = ("converted_count", "last_serial", "last_updated", "failed_set", "transient_set")


def state_fields(tasks: DataFrame, unfinished: DataFrame) -> DataFrame:
    """One comparable value per task and field; serial sets as count and sum of hashes.

    Row hashes are added up, so a set of any size is compared without a list.
    """
    digest = F.xxhash64("serial", *[c for c in RETRY_FIELDS if c in unfinished.columns]).cast("decimal(38,0)")
    part = lambda status: F.concat_ws(
        ":", F.count_if(F.col("status") == status),
        F.coalesce(F.sum(F.when(F.col("status") == status, digest)), F.lit(0).cast("decimal(38,0)")))
    sets = unfinished.groupBy("cell_task").agg(
        part("failed").alias("failed_set"), part("transient").alias("transient_set"))
    return tasks.join(sets, "cell_task", "left").select(
        "cell_task", F.col("converted_count").cast("string").alias("converted_count"),
        "last_serial", "last_updated",
        *[F.coalesce(c, F.lit("0:0")).alias(c) for c in ("failed_set", "transient_set")])


def three_way_check(
    current: DataFrame, before: DataFrame, desired: DataFrame, fields: tuple[str, ...] = STATE_FIELDS
) -> DataFrame:
    """Whether each task's current state may be replaced.

    Every field must equal its value before or as desired; an absent task is
    fine when it is absent in either of the two. Takes tables of ``state_fields``.
    """
    packed = lambda df, name: df.select("cell_task", F.struct(*fields).alias(name))
    rows = packed(current, "c").join(packed(before, "b"), "cell_task", "full_outer").join(
        packed(desired, "d"), "cell_task", "full_outer")
    same = lambda f: F.col(f"c.{f}").eqNullSafe(F.col(f"b.{f}")) | F.col(f"c.{f}").eqNullSafe(F.col(f"d.{f}"))
    absent = F.col("b").isNull() | F.col("d").isNull()
    all_fields = same(fields[0])
    for name in fields[1:]:
        all_fields = all_fields & same(name)
    whole = F.col("c").eqNullSafe(F.col("b")) | F.col("c").eqNullSafe(F.col("d"))
    admissible = F.when(F.col("c").isNull(), absent).when(absent, whole).otherwise(all_fields)
    return rows.select("cell_task", admissible.alias("admissible"))


def compose_scope(current: DataFrame, desired: DataFrame, scope: DataFrame) -> DataFrame:
    """State with the tasks in scope replaced by their desired rows and all others untouched."""
    outside = current.join(scope.select("cell_task"), "cell_task", "left_anti")
    inside = desired.join(scope.select("cell_task"), "cell_task", "left_semi")
    return outside.unionByName(inside.select(*outside.columns))
