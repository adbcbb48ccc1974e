"""Registration of queries with their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetable.plans.checks import check
from kinetable.plans.shapes import Shapes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of the supplied shapes; ``sql`` is its independent check."""

    def register(build: Callable[[Shapes], DataFrame]):
        key = name or build.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = lambda spark, folder: build(Shapes(spark, folder))
        if sql:
            CHECKS[key] = check(sql)
        return build

    return register


def r6(column: str | Column) -> Column:
    """Rounded to six places for comparison."""
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


def joined(column: str | Column) -> Column:
    """Array as text."""
    return F.array_join(F.col(column) if isinstance(column, str) else column, "|")
