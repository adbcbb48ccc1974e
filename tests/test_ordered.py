"""Blockwise scans against plain loops, with blocks small enough to be crossed often."""

from __future__ import annotations

import random
import statistics

from pyspark.sql import functions as F

from kinetable.operators import ordered


def _random_rows(seed: int, n: int = 300):
    rng = random.Random(seed)
    # one key holds most rows
    return [(rng.choice("aaaab"), i, rng.choice([None, 1, 2, 3])) for i in range(n)]


def test_scan_totals_and_carries_cross_blocks(spark):
    data = _random_rows(1)
    df = spark.createDataFrame(data, "k string, i long, v long")
    got = ordered.ordered_scan(
        df, keys=["k"], order=["i"], block=ordered.int_block("i", 7),
        totals={"total": F.coalesce("v", F.lit(0))}, carries={"before": F.col("v")},
        carries_with_current={"upto": F.col("v")})
    state = {}
    want = {}
    for k, i, v in data:
        total, last = state.get(k, (0, None))
        want[i] = (total, last, v if v is not None else last)
        state[k] = (total + (v or 0), v if v is not None else last)
    assert {r.i: (r.total, r.before, r.upto) for r in got.collect()} == want


def test_position_is_the_rank_inside_the_key(spark):
    data = _random_rows(2)
    df = spark.createDataFrame(data, "k string, i long, v long")
    got = ordered.row_position(df, keys=["k"], order=["i"], block=ordered.int_block("i", 5), out="p")
    seen: dict[str, int] = {}
    want = {}
    for k, i, _ in data:
        want[i] = seen.get(k, 0)
        seen[k] = want[i] + 1
    assert {r.i: r.p for r in got.collect()} == want


def _runs(pairs):
    out = []
    for pos, label in pairs:
        if out and out[-1][2] == label and out[-1][1] + 1 == pos:
            out[-1][1] = pos
        else:
            out.append([pos, pos, label])
    return [tuple(r) for r in out]


def test_runs_merge_across_blocks(spark):
    rng = random.Random(3)
    for block in (1, 4, 1000):
        label, data = "x", []
        for i in range(200):
            if rng.random() < 0.2:
                label = rng.choice("xy")
            if rng.random() > 0.1:
                data.append((i, label))
        df = spark.createDataFrame([("k", *d) for d in data], "k string, pos long, lab string")
        got = ordered.runs(df, keys=["k"], pos="pos", label="lab", rows_per_block=block)
        assert sorted((r.start, r.end, r.lab) for r in got.collect()) == _runs(data)


def test_runs_of_spans_merge_when_they_touch(spark):
    spans = [("k", 0, 9, "x"), ("k", 10, 11, "x"), ("k", 12, 30, "y"), ("k", 32, 33, "y"), ("k", 34, 40, "y")]
    df = spark.createDataFrame(spans, "k string, a long, z long, lab string")
    got = ordered.runs(df, keys=["k"], pos="a", end="z", label="lab", rows_per_block=8)
    assert sorted((r.start, r.end) for r in got.collect()) == [(0, 11), (12, 30), (32, 40)]


def test_exact_median_equals_statistics_median(spark):
    rng = random.Random(4)
    groups = {
        "even": [rng.random() * 100 for _ in range(50)], "odd": [rng.random() for _ in range(33)],
        "same": [7.5] * 40, "zero": [0.0] * 9 + [1e-9], "two": [1.0, 4.0], "one": [3.25],
    }
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    got = {r.k: r.m for r in ordered.exact_median(df, keys=["k"], value="v", out="m").collect()}
    assert got == {k: statistics.median(vs) for k, vs in groups.items()}


def test_a_hot_key_is_spread_over_tasks(spark):
    """One key with all rows: as planned, no task may hold more than a small share of them."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("i"))
        out = ordered.row_position(df, keys=["k"], order=["i"], block=ordered.int_block("i", 100), out="p")
        shares = out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum("p").alias("s")).collect()
        assert max(r.n for r in shares) < 20_000 / 4
        assert sum(r.n for r in shares) == 20_000 and sum(r.s for r in shares) == 20_000 * 19_999 / 2
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
