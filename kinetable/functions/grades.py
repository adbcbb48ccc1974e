"""Grade normalisation rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinetable.model import GRADES, UNGRADED


def grade_norm(grade: Column) -> Column:
    """Trimmed, lower-case grade."""
    return F.lower(F.trim(grade))


def grade_key(grade: Column) -> Column:
    """good / normal / bad; everything else, unknown values included, is ungraded."""
    norm = grade_norm(grade)
    return F.when(norm.isin(*GRADES), norm).otherwise(F.lit(UNGRADED))


def grade_label(grade: Column) -> Column:
    """Label of the grade distribution: only NULL and '' count as ungraded."""
    return F.when(grade.isNull() | (grade == ""), F.lit(UNGRADED)).otherwise(grade_norm(grade))


def has_grade(grade: Column) -> Column:
    """True for a non-empty grade."""
    return F.coalesce(grade != "", F.lit(False))


def valid_grade_update(grade: Column, reason: Column) -> Column:
    """A grade is one of the three, and normal or bad need a non-blank reason."""
    reasoned = F.coalesce(F.trim(reason) != "", F.lit(False))
    return grade.isNull() | (
        grade.isin(*GRADES) & (~grade.isin("bad", "normal") | reasoned)
    )


def kept_reason(grade: Column, reason: Column) -> Column:
    """A reason stays only next to a normal or bad grade."""
    return F.when(grade.isin("bad", "normal"), reason)


def clean_tags(tags: Column) -> Column:
    """Trim tags and drop the blank ones."""
    return F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t != "")
