"""Totals of distributions, labels of numbers, and statistics over shards that differ."""

from __future__ import annotations

import random
import struct

from pyspark.sql import functions as F

from kinetable.functions.text import double_text
from kinetable.operators import annotations as ann
from kinetable.operators import distributions as dist
from kinetable.operators import stats


def test_doubles_are_spelled_as_usual(spark):
    random.seed(1)
    values = [0.0, -0.0, 1e-5, 1.5e-7, 1e-4, 0.00012, 1e7, 12345678.5, 1e15, 123456789012345.6, 1e16, -3e100,
              float("nan"), float("inf"), float("-inf"), 100.0, 0.1, 1e21, 2.0, 7.0]
    values += [struct.unpack("d", random.randbytes(8))[0] for _ in range(500)] + [round(random.uniform(-1e9, 1e9), random.randint(0, 6)) for _ in range(500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", double_text(F.col("v")).alias("t"))
    for r in df.collect():
        want = repr(values[r.i])
        # the JVM may write a digit more than needed; place and shape are the same, and it reads as the same number
        assert r.t == want or float(r.t) == values[r.i] and ("e" in r.t) == ("e" in want) and len(r.t) <= len(want) + 17, (r.t, want)
        assert r.i >= 20 or r.t == want, (r.t, want)


def test_totals(spark):
    df = spark.createDataFrame([("a", 1e-5, "good", ["x", "x"]), ("a", None, "", []), ("b", 2.0, None, None)],
                               "dataset_key string, v double, grade string, tags array<string>")
    rows = lambda out: sorted((r.dataset_key, r.label, r["count"], r.total) for r in out.collect())
    assert rows(dist.dist_categorical(df, "v")) == [("a", "(null)", 1, 2), ("a", "1e-05", 1, 2), ("b", "2.0", 1, 1)]
    assert rows(dist.dist_grade(df)) == [("a", "(ungraded)", 1, 2), ("a", "good", 1, 2), ("b", "(ungraded)", 1, 1)]
    assert rows(dist.dist_tags(df)) == [("a", "(no tags)", 1, 2), ("a", "x", 2, 2), ("b", "(no tags)", 1, 1)]


def test_an_absent_column_is_not_a_null(spark):
    df = spark.createDataFrame(
        [("a", 1, None, 3, 8, None, ["length", "Serial_number"]), ("a", 2, 4, 3, 8, "20240102_1", ["length", "Serial_number"]),
         ("a", 3, None, 3, 8, None, ["dataset_from_index", "dataset_to_index"]), ("a", 4, None, None, None, None, [])],
        "dataset_key string, episode_index long, length long, dataset_from_index long, dataset_to_index long, Serial_number string, shard_columns array<string>")
    rows = df.withColumn("grade", F.lit("good"))
    catalog = spark.createDataFrame([("a", 1.0)], "dataset_key string, fps double")
    assert stats.dataset_grade_summary(rows, catalog).first().total_duration_sec == 4 + 5
    dates = {r.label: (r["count"], r.total) for r in dist.dist_collection_date(df).collect()}
    assert dates == {"(unknown)": (1, 2), "2024-01-02": (1, 2)}
    assert dist.dist_collection_date(df.drop("Serial_number", "shard_columns")).count() == 0


def test_summary_takes_the_last_row_and_legacy_only_episodes(spark):
    rows = spark.createDataFrame([("a", 1, "bad", 10, "s", "f0", 0), ("a", 1, "good", 20, None, "f1", 0), ("a", 2, None, 5, "s", "f1", 1)],
                                 "dataset_key string, episode_index long, grade string, length long, Serial_number string, shard_path string, shard_row long")
    old = spark.createDataFrame([("a", 2, "normal"), ("a", 9, "bad"), ("a", 8, None)], "dataset_key string, episode_index long, grade string")
    marks = spark.createDataFrame([("s", None)], "serial_number string, grade string")
    out = {r.episode_index: (r.grade, r.length) for r in ann.resolve_summary(rows, old, marks).collect()}
    assert out == {1: (None, 20), 2: ("normal", 5), 9: ("bad", None)}
