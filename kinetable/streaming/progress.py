"""Live conversion progress: what each task of a log is doing, folded from its events.

No fold is needed. Only the last event of each kind decides the
state of a task, and those are plain aggregates; the one thing that reaches
across tasks, a task losing its entry when the next one starts, is added as an
event of its own beforehand. A stream keeps those decisive events and applies the
same rules to them and each new batch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinetable.functions.serials import serial_from_recording, task_from_recording
from kinetable.operators.ordered import int_block, ordered_scan
from kinetable.settings import checkpointed
from kinetable.sources.files import remove_folder

FLASH_MS = 500
EVENT_SCHEMA = "log string, pos long, task string, type string, index long, total long, serial string, ms long"


def _ms(ts: str) -> Column:
    return F.unix_millis(F.to_timestamp(ts))


def task_events(events: DataFrame, log: str = "log", pos: str = "line_no") -> DataFrame:
    """Events that belong to a task, under ``_task``."""
    task = F.when(
        F.col("type").isin("converting", "finalizing", "finalized"), F.nullif("task", F.lit(""))
    ).when(F.col("type").isin("recording_start", "converted", "failed"),
           task_from_recording(F.col("recording")))
    return events.withColumn("_task", task).where(F.col("_task").isNotNull()).select(
        F.col(log).alias("log"), F.col(pos).alias("pos"), F.col("_task").alias("task"), "type",
        "index", "total", serial_from_recording(F.col("recording")).alias("serial"),
        _ms("ts").alias("ms"))


def displaced_tasks(events: DataFrame) -> DataFrame:
    """Synthetic ``displaced`` events: a task still converting when another one starts.

    The task started last is the active one until it is finalizing or
    finalized; the next start of another task removes it if it is still active.
    """
    moves = events.where(F.col("type").isin("converting", "finalizing", "finalized"))
    started = F.when(F.col("type") == "converting", F.struct("task", "pos"))
    before = ordered_scan(
        moves, keys=["log"], order=["pos"], block=int_block("pos"), carries={"_prev": started})
    ended = F.when(F.col("type") != "converting", F.col("pos"))
    own = ordered_scan(
        before.withColumn("_subject", F.when(
            F.col("type") == "converting", F.col("_prev.task")).otherwise(F.col("task"))),
        keys=["log", "_subject"], order=["pos"], block=int_block("pos"), carries={"_ended": ended})
    return own.where(
        (F.col("type") == "converting") & F.col("_prev").isNotNull()
        & (F.col("_prev.task") != F.col("task"))
        & (F.coalesce("_ended", F.lit(-1)) < F.col("_prev.pos"))
    ).select("log", "pos", F.col("_prev.task").alias("task"), F.lit("displaced").alias("type"))


def live_progress(events: DataFrame, log: str = "log", pos: str = "line_no") -> DataFrame:
    """State of every task after all events of its log, in order of position."""
    own = checkpointed(task_events(events, log, pos))
    return _state(own.unionByName(displaced_tasks(own), allowMissingColumns=True))


def _state(rows: DataFrame) -> DataFrame:
    """State of every task from `task_events` and `displaced_tasks`, all of them or the decisive ones."""
    at = lambda *kinds: F.max(F.when(F.col("type").isin(*kinds), F.col("pos")))
    payload = lambda kind, *cols: F.max_by(
        F.struct(*cols), F.when(F.col("type") == kind, F.col("pos")))
    last = rows.groupBy("log", "task").agg(
        at("converting").alias("c"), at("finalized").alias("d"), at("displaced").alias("x"),
        at("finalizing").alias("z"), at("recording_start").alias("r"), at("converted").alias("k"),
        at("failed").alias("f"),
        payload("recording_start", "index", "total", "serial", "ms").alias("rec"),
        F.max_by("ms", F.when(F.col("type") == "failed", F.col("pos"))).alias("f_ms"))
    never = F.lit(-1).cast("bigint")
    p = lambda name: F.coalesce(F.col(name), never)
    # a finalizing line after the end of a task changes nothing
    base = F.greatest(p("c"), p("d"), p("x"))
    done = (p("d") == base) & (p("d") >= 0)
    z = F.when(~done & (p("z") > base), p("z")).otherwise(never)
    reset = F.greatest(base, z)
    state = last.withColumns({"_reset": reset, "_z": z, "_done": done})
    phase = (
        F.when(F.col("_z") >= 0, "finalizing").when(F.col("_done"), "done")
        .when((p("c") == F.col("_reset")) & (p("c") >= 0), "converting")
        .when(p("r") > F.col("_reset"), "converting"))
    # a failure before the task has an entry again, after losing it, leaves no flash
    revived = rows.join(
        state.where(p("f") > p("x")).where(p("x") >= p("c")).select("log", "task", p("x").alias("_x")),
        ["log", "task"]
    ).where(F.col("type").isin("recording_start", "finalizing", "finalized") & (F.col("pos") > F.col("_x"))
            ).groupBy("log", "task").agg(F.min("pos").alias("_first"))
    seen = F.when(p("c") > p("x"), p("f") > p("c")).otherwise(
        F.col("_first").isNotNull() & (p("f") > F.col("_first")))
    running = p("r") > F.col("_reset")
    return (
        state.join(revived, ["log", "task"], "left").withColumn("phase", phase)
        .where(F.col("phase").isNotNull())
        .select(
            "log", "task", "phase",
            F.when(running, F.col("rec.index")).alias("recording_index"),
            F.when(running, F.col("rec.total")).alias("recording_total"),
            F.when(running, F.col("rec.serial")).alias("recording_serial"),
            F.when(running & (p("k") < p("r")), F.col("rec.ms")).alias("started_ms"),
            F.when(seen, F.col("f_ms") + FLASH_MS).alias("flash_until_ms"))
    )


def active_tasks(events: DataFrame, log: str = "log", pos: str = "line_no") -> DataFrame:
    """The task each log is converting now, if any: the last started one unless it ended."""
    own = task_events(events, log, pos)
    started = own.where("type = 'converting'").groupBy("log").agg(
        F.max_by("task", "pos").alias("task"), F.max("pos").alias("_at"))
    ended = own.where("type in ('finalizing', 'finalized')").groupBy("log", "task").agg(
        F.max("pos").alias("_end"))
    return started.join(ended, ["log", "task"], "left").where(
        F.col("_end").isNull() | (F.col("_end") < F.col("_at"))).select("log", "task")


def live_done(progress: DataFrame, live: DataFrame) -> DataFrame:
    """Progress with the done count a running task shows, and its percentage.

    A task that several logs run shows the farthest of them.
    """
    now = live.select(
        F.col("task").alias("cell_task"), "phase", "recording_index", "recording_total")
    rows = progress.join(now, "cell_task", "left")
    projected = F.greatest(F.lit(0), F.col("total") - F.col("recording_total")) + F.greatest(
        F.lit(0), F.col("recording_index") - 1)
    moving = (F.col("phase") == "converting") & (F.col("recording_total") > 0) & (
        F.col("recording_index").isNotNull()) & (F.col("total") > 0)
    shown = F.when(moving, F.least(F.col("total"), F.greatest(F.col("done"), projected))).otherwise(
        F.col("done"))
    farthest = rows.groupBy(*progress.columns).agg(F.max(shown).alias("live_done"))
    return farthest.withColumn(
        "percent", F.when(F.col("total") > 0, F.floor(F.col("live_done") / F.col("total") * 100 + 0.5))
        .otherwise(F.lit(0).cast("bigint")))


# --- the same on a stream ------------------------------------------------------

def decisive(rows: DataFrame) -> DataFrame:
    """The events of a log that can still decide something, whatever comes after them.

    That is the last one of each kind of each task, and the first that gives a task an entry, at all or after another
    one displaced it. Everything `live_progress` derives are last positions and that first one, so it says the same of
    these events as of all of them.
    """
    columns = [c for c in rows.columns if c not in ("log", "task", "type")]
    last = rows.groupBy("log", "task", "type").agg(F.max_by(F.struct(*columns), "pos").alias("_e"))
    gone = rows.where("type = 'displaced'").groupBy("log", "task").agg(F.max("pos").alias("_x"))
    back = rows.join(gone, ["log", "task"], "left").where(
        F.col("type").isin("recording_start", "finalizing", "finalized") & (F.col("pos") > F.coalesce("_x", F.lit(-1))))
    first = back.groupBy("log", "task").agg(F.min_by(F.struct("type", *columns), "pos").alias("_e"))
    names = ["log", "task", "type", *columns]
    return last.select("log", "task", "type", "_e.*").select(*names).unionByName(
        first.select("log", "task", "_e.*").select(*names)).distinct()


def progress_step(kept: DataFrame, new: DataFrame) -> DataFrame:
    """Decisive events after a batch, from those before it and the batch's `task_events`.

    A task is displaced where a new line starts another one; kept lines have been judged in their batch.
    """
    # of logs without new lines nothing changes
    both = kept.unionByName(new)
    moves = both.where("type <> 'displaced'").join(new.select("log").distinct(), "log", "left_semi")
    starts = new.where("type = 'converting'").select("log", "pos")
    fresh = displaced_tasks(moves).join(starts, ["log", "pos"], "left_semi")
    return decisive(both.unionByName(fresh, allowMissingColumns=True))


@dataclass(frozen=True)
class ProgressStore:
    """Decisive events of all logs in a folder, one table a batch.

    A batch reads the table of the one before it and replaces its own, so a batch that runs again changes nothing.
    """

    spark: SparkSession
    folder: str

    def path(self, batch: int) -> str:
        return f"{self.folder.rstrip('/')}/events/{batch}"

    def load(self, batch: int) -> DataFrame:
        """The events after a batch; before the first one there are none."""
        if batch < 0:
            return self.spark.createDataFrame([], EVENT_SCHEMA)
        return self.spark.read.schema(EVENT_SCHEMA).parquet(self.path(batch))

    def step(self, batch: int, events: DataFrame, idle: int | None = None, log: str = "log", pos: str = "pos") -> DataFrame:
        """Take in a batch of events; the tasks of the logs it has events of.

        Logs without an event for ``idle`` seconds before the newest one are dropped. Tables older than the one a
        repeated batch would read are deleted.
        """
        new = checkpointed(task_events(events, log, pos))
        rows = progress_step(self.load(batch - 1), new)
        if idle is not None:
            recent = rows.groupBy("log").agg(F.max("ms").alias("_ms"))
            newest = recent.agg(F.max("_ms")).first()[0]
            recent = recent.where(F.col("_ms") >= F.lit(newest) - idle * 1000)
            rows = rows.join(recent.select("log"), "log", "left_semi")
        rows.select(*[c.split()[0] for c in EVENT_SCHEMA.split(", ")]).write.mode("overwrite").parquet(self.path(batch))
        remove_folder(self.path(batch - 2))
        now = self.load(batch)
        return _state(now.join(new.select("log").distinct(), "log", "left_semi"))


def run_progress_stream(
    events: DataFrame, folder: str, checkpoint: str, emit: Callable[[DataFrame, int], None], *,
    idle: int | None = None, log: str = "log", pos: str = "pos", every: str | None = None,
) -> StreamingQuery:
    """Follow events: after each batch ``emit`` gets the tasks of every log that had events, and the batch number.

    Runs until the source is drained, or for good with a trigger interval ``every``.
    """
    store = ProgressStore(events.sparkSession, folder)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return events.writeStream.foreachBatch(
        lambda batch, number: emit(store.step(number, batch, idle, log, pos), number)
    ).option("checkpointLocation", checkpoint).trigger(**trigger).start()


# --- job progress document -----------------------------------------------------

def progress_fields(events: DataFrame) -> DataFrame:
    """Events as the fields they set in a job's progress document.

    ``set`` names the fields of an event; only those overwrite, also with NULL.
    """
    kind = F.col("type")
    phase = F.when(kind.isin("finalizing", "finalized"), kind).otherwise(F.lit("converting"))
    fields = {
        "converting": {"cell_task": "task", "pending_recordings": "count"},
        "recording_start": {"recording": "recording", "recording_index": "index", "recording_total": "total"},
        "converted": {"last_converted_recording": "recording", "last_frames": "frames", "last_duration": "duration"},
        "failed": {"last_failed_recording": "recording", "last_error_code": "error_code", "last_error": "reason"},
        "finalizing": {"cell_task": "task"},
        "finalized": {"cell_task": "task"},
    }
    entries = F.lit(None).cast("array<struct<field:string,value:string>>")
    for name, mapping in fields.items():
        values = F.array(F.struct(F.lit("phase").alias("field"), phase.alias("value")), *[
            F.struct(F.lit(f).alias("field"), F.col(c).cast("string").alias("value"))
            for f, c in mapping.items()])
        entries = F.when(kind == name, values).otherwise(entries)
    return events.withColumn("_set", entries)


def job_progress_fold(events: DataFrame, log: str = "log", pos: str = "line_no") -> DataFrame:
    """Progress document of each log, one row per field that was ever set.

    The last event that sets a field decides, even when it sets NULL.
    """
    sets = progress_fields(events).select(F.col(log).alias("log"), F.col(pos).alias("pos"), F.inline("_set"))
    return sets.groupBy("log", "field").agg(
        F.max_by(F.struct("value"), "pos")["value"].alias("value"))
