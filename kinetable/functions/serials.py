"""Dates and paths read out of recording serials. The four date rules differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinetable.model import SERIAL_PATTERN, UNKNOWN_DATE

_EIGHT_DIGITS = r"^(\d{4})(\d{2})(\d{2})"


def _dashed(text: Column) -> Column:
    part = lambda i: F.regexp_extract(text, _EIGHT_DIGITS, i)
    return F.when(text.rlike(_EIGHT_DIGITS), F.concat_ws("-", part(1), part(2), part(3)))


def created_at(serial: Column) -> Column:
    """Leading eight digits as a date; dashes are dropped, underscores end the digits."""
    return _dashed(F.translate(F.replace(F.trim(serial), F.lit("-"), F.lit("")), "_", " "))


def raw_created_at(serial: Column) -> Column:
    """Date of a well-formed recording serial, else NULL."""
    return F.when(serial.rlike(SERIAL_PATTERN), _dashed(serial))


def collection_date(serial: Column) -> Column:
    """Date label of the collection-date distribution; dashes and underscores are dropped."""
    return F.coalesce(_dashed(F.translate(F.trim(serial), "-_", "")), F.lit(UNKNOWN_DATE))


def strict_recording_date(serial: Column) -> Column:
    """Date of an exact ``YYYYMMDD_HHMMSS`` serial that is a real UTC time from year 1000 on."""
    shaped = serial.rlike(r"^[1-9]\d{7}_\d{6}$")
    real = F.try_to_timestamp(F.when(shaped, serial), F.lit("yyyyMMdd_HHmmss"))
    return F.when(real.isNotNull(), _dashed(serial))


def task_from_recording(recording: Column) -> Column:
    """Everything before the last slash; NULL without one or when nothing precedes it."""
    task = F.regexp_extract(recording, r"^(.+)/[^/]*$", 1)
    return F.when(task != "", task)


def serial_from_recording(recording: Column) -> Column:
    """Everything after the last slash; NULL when empty or without a slash."""
    serial = F.regexp_extract(recording, r"/([^/]*)$", 1)
    return F.when(serial != "", serial)


def serial_join_key(serial: Column, *row_id: Column) -> Column:
    """Join key that spreads missing serials over tasks; those never match a real serial."""
    own = F.concat_ws("\u0000", F.lit(""), *[c.cast("string") for c in row_id])
    return F.coalesce(F.when(serial != "", serial), own)
