"""Converter logs as a stream of typed events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinetable.functions.logline import log_event, log_prefix
from kinetable.sources.log_tail import register


def log_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Typed events of log lines; noise and unparseable lines are dropped.

    Works on a batch table and on a stream alike. Each step is an ``inline`` of
    one struct, so the patterns run once per line however many of the
    fields, or filters on them, are used later.
    """
    keep = [c for c in lines.columns if c != column]
    once = lambda struct: F.inline(F.array(struct))
    parts = lines.select(*keep, once(log_prefix(F.col(column))).alias("_ts", "_level", "_msg"))
    events = parts.where(F.col("_ts").isNotNull()).select(
        *keep, once(log_event(F.col("_ts"), F.col("_level"), F.col("_msg"))))
    return events.where(F.col("type").isNotNull())


def log_lines(spark: SparkSession, folder: str, stream: bool = True, **options: object) -> DataFrame:
    """``log, pos, value`` of the files of a folder: what is there, or as a stream also what is appended."""
    register(spark)
    reader = (spark.readStream if stream else spark.read).format("log_tail")
    return reader.options(**options).load(folder)


def source_log_stream(spark: SparkSession, folder: str, tail: int | None = None) -> DataFrame:
    """Stream of events from growing log files, each with its log and position.

    ``tail`` lets a new stream begin with the last lines of each file that is there.
    """
    return log_events(log_lines(spark, folder, **({} if tail is None else {"tail": tail})))


def write_events(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append events to Parquet until the folder is drained."""
    return (
        events.writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(availableNow=True).start()
    )


def event_counts(events: DataFrame, *keys: str) -> DataFrame:
    """Converted recordings as ok and failed ones as fail, per key."""
    return events.groupBy(*keys).agg(
        F.count_if(F.col("type") == "converted").alias("ok"),
        F.count_if(F.col("type") == "failed").alias("fail"))
