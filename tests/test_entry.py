"""Registration, and some queries of each kind next to their SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, table

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ("annotation_by_index", "dist_histogram", "reindex_episodes", "divergence_bands", "stamp_cycles",
          "frame_references", "signature_groups", "pending_set", "merge_upsert", "dense_remap")


def test_every_query_has_a_check_but_the_fingerprint():
    assert set(entry.QUERIES) - set(entry.CHECKS) == {"dataset_fingerprint"}


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns[:2] == ["dataset_key", "graded_count"] and out.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    result = db.execute(entry.oracle_sql()[name])
    want = table([d[0] for d in result.description], result.fetchall())
    assert table(df.columns, [tuple(r) for r in df.collect()]) == want


def test_no_plan_pairs_everything_with_everything(spark):
    for name in ("resolve_distribution", "grade_summary_cards", "frame_episode_interval_join", "referenced_files",
                 "index_range_slice", "dist_histogram", "pending_set"):
        plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_filters_and_columns_reach_the_scan(spark):
    plan = entry.queries()["index_range_slice"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(event_id,1200)" in plan and "props" not in plan
