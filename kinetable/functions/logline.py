"""Converter log lines as typed events, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: the line formats, first match wins --------------------
PREFIX = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\s+\[(\w+)\]\s*(.*)"
CONVERTED = r"Converted:\s+(.+?)\s+\((\d+)\s+frames(?:,\s+([\d.]+)s)?\)"
FAILED = r"Failed\s+\[(\w+)\]:\s+(.+?):\s+(.*)"
CONVERTING = r"Converting\s+(.+?):\s+(\d+)\s+new recordings"
RECORDING = r"Recording:\s+(.+?)\s+\((\d+)\s+of\s+(\d+)\)"
FINALIZING = r"Finalizing:\s+(.+)$"
FINALIZED = r"Finalized:\s+(.+)$"
SCAN = r"(\d+)\s+tasks?\s+with\s+(\d+)\s+pending"
# --------------------------------------------------------------------------

EVENT_FIELDS = {
    "type": "string", "ts": "string", "recording": "string", "frames": "bigint",
    "duration": "double", "error_code": "string", "reason": "string", "task": "string",
    "count": "bigint", "index": "bigint", "total": "bigint", "tasks": "bigint",
    "pending": "bigint", "message": "string",
}


def _event(kind: Column | str, ts: Column, **fields: Column) -> Column:
    fields = {"type": F.lit(kind) if isinstance(kind, str) else kind, "ts": ts, **fields}
    return F.struct(*[
        fields.get(name, F.lit(None)).try_cast(dtype).alias(name)
        for name, dtype in EVENT_FIELDS.items()
    ])


def log_prefix(line: Column) -> Column:
    """Time, level and message of a log line, NULL without them.

    Tracebacks, details on indented lines and other noise carry no time in front.
    """
    part = lambda i: F.regexp_extract(line, PREFIX, i)
    return F.when(line.rlike(PREFIX), F.struct(
        part(1).alias("ts"), part(2).alias("level"), F.trim(part(3)).alias("msg")))


def log_event(ts: Column, level: Column, msg: Column) -> Column:
    """Event struct of a log message, NULL when it is no event."""
    got = lambda pattern, i: F.regexp_extract(msg, pattern, i)
    # the word a pattern cannot do without is looked for first: it is much cheaper
    fits = lambda word, pattern: msg.contains(word) & msg.rlike(pattern)
    return (
        F.when(fits("Converted:", CONVERTED), _event(
            "converted", ts, recording=got(CONVERTED, 1), frames=got(CONVERTED, 2),
            duration=F.nullif(got(CONVERTED, 3), F.lit("")).try_cast("double"),
        ))
        .when(fits("Failed", FAILED), _event(
            "failed", ts, error_code=got(FAILED, 1), recording=got(FAILED, 2), reason=got(FAILED, 3),
        ))
        .when(fits("Converting", CONVERTING), _event(
            "converting", ts, task=got(CONVERTING, 1), count=got(CONVERTING, 2),
        ))
        .when(fits("Recording:", RECORDING), _event(
            "recording_start", ts, recording=got(RECORDING, 1), index=got(RECORDING, 2),
            total=got(RECORDING, 3),
        ))
        .when(fits("Finalizing:", FINALIZING), _event("finalizing", ts, task=F.trim(got(FINALIZING, 1))))
        .when(fits("Finalized:", FINALIZED), _event("finalized", ts, task=F.trim(got(FINALIZED, 1))))
        .when(fits("pending", SCAN), _event("scan", ts, tasks=got(SCAN, 1), pending=got(SCAN, 2)))
        .when((level == "WARNING") & F.lower(msg).contains("anomal"), _event("warning", ts, message=msg))
        .when(level.isin("INFO", "ERROR"), _event(F.lower(level), ts, message=msg))
    )
