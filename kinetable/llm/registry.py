"""Registered corpus queries and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinetable.settings import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(table: str, sql: str | None = None):
    """Register a function of one supplied table; ``sql`` is its independent check."""

    def register(build: Callable[[DataFrame], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(read(spark, folder, table))

        QUERIES[build.__name__] = run
        if sql:
            CHECKS[build.__name__] = sql
        return build

    return register


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{table}.parquet")
