"""Grades, dates, distributions, overlays and filters on hand-written rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kinetable.functions import grades, playback, serials, text
from kinetable.operators import annotations as ann
from kinetable.operators import distributions as dist
from kinetable.operators import episodes as ep
from kinetable.operators import stats
from kinetable.sources import sinks

EPISODE = ("dataset_key string, episode_index long, length long, task_index long, grade string, "
           "Serial_number string, tags array<string>")


@pytest.fixture(scope="module")
def six(spark):
    data = [(100, "good"), (200, "good"), (150, "bad"), (300, None), (250, "normal"), (180, "good")]
    return spark.createDataFrame(
        [("d", i, n, 0, g, f"20260101_00000{i}", None) for i, (n, g) in enumerate(data)], EPISODE)


def _labels(df, *cols):
    return {tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]]: r["count"] for r in df.collect()}


def test_length_histogram(six):
    out = dist.dist_auto(six, "length").collect()
    assert sum(r["count"] for r in out) == 6 and {r.total for r in out} == {6}
    assert max(r.bin for r in out) == 19 and min(r.bin for r in out) == 0


def test_histogram_edges(spark):
    vals = [0.0, 5.0, 9.99, 10.0, 100.0, None, float("nan")]
    df = spark.createDataFrame([("d", v) for v in vals] + [("one", 4.0), ("one", 4.0), ("none", None)],
                               "dataset_key string, v double")
    out = dist.dist_histogram(df, "v")
    assert _labels(out, "dataset_key", "bin") == {
        ("d", 0): 1, ("d", 1): 2, ("d", 2): 1, ("d", 19): 1, ("one", 0): 2}
    assert {r.dataset_key: r.total for r in out.collect()} == {"d": 7, "one": 2}
    assert [r.label for r in out.where("dataset_key = 'one'").collect()] == ["4.0"]


def test_unknown_field_is_refused(six):
    with pytest.raises(ValueError):
        dist.dist_auto(six, "nope")


def test_boolean_labels(spark):
    df = spark.createDataFrame([("d", True), ("d", False), ("d", None)], "dataset_key string, b boolean")
    assert _labels(dist.dist_auto(df, "b"), "label") == {"True": 1, "False": 1, "(null)": 1}


def test_grade_distribution(six):
    assert _labels(dist.dist_grade(six), "label") == {"good": 3, "bad": 1, "normal": 1, "(ungraded)": 1}


def test_null_annotation_clears_grade_in_distribution(spark, six):
    notes = spark.createDataFrame([("20260101_000000", None, None, None)],
                                  "serial_number string, grade string, tags array<string>, reason string")
    bridge = ann.first_serial_owner(six)
    by_index = ann.annotation_by_index(bridge, notes)
    out = ann.resolve_distribution(six, by_index, notes)
    assert _labels(dist.dist_grade(out), "label") == {"good": 2, "bad": 1, "normal": 1, "(ungraded)": 2}
    kept = ann.resolve_export(six, by_index)
    assert kept.where("episode_index = 0").first().grade == "good"


def test_grade_follows_serial_after_reindexing(spark, six):
    notes = spark.createDataFrame([("20260101_000002", "good", ["x"], None)],
                                  "serial_number string, grade string, tags array<string>, reason string")
    turned = six.withColumn("episode_index", 5 - F.col("episode_index"))
    out = ann.resolve_episode_list(turned, ann.annotation_by_index(ann.first_serial_owner(turned), notes), notes)
    assert out.where("episode_index = 3").first().grade == "good"
    assert out.where("episode_index = 2").first().grade is None


def test_grade_keys(spark):
    names = ["good", "bad", None, "normal", "undefined", "", "   ", " GOOD "]
    df = spark.createDataFrame([("d", i, g) for i, g in enumerate(names)],
                               "dataset_key string, episode_index long, grade string")
    ids = lambda key: sorted(r.episode_index for r in ep.episodes_for_grade_key(df, key).collect())
    assert ids("good") == [0, 7] and ids("normal") == [3] and ids("bad") == [1]
    assert ids("(ungraded)") == ids("ungraded") == [2, 4, 5, 6]
    labels = _labels(dist.dist_grade(df), "label")
    assert labels["(ungraded)"] == 2 and labels[""] == 1 and labels["undefined"] == 1


def test_no_tags_label_replaces_a_real_tag(spark):
    df = spark.createDataFrame([("d", ["(no tags)", "a", "a"]), ("d", []), ("d", None), ("e", ["(no tags)"])],
                               "dataset_key string, tags array<string>")
    assert _labels(dist.dist_tags(df), "dataset_key", "label") == {
        ("d", "(no tags)"): 2, ("d", "a"): 2, ("e", "(no tags)"): 1}


def test_serial_dates(spark):
    df = spark.createDataFrame([(s,) for s in (
        "20260226_170029", "20260230_170029", "20260226_246099", "legacy-name", "2026_0115", "2026-01-15_x", None)], "s string")
    c = F.col("s")
    out = df.select(serials.strict_recording_date(c).alias("a"), serials.created_at(c).alias("b"),
                    serials.collection_date(c).alias("c"), serials.raw_created_at(c).alias("d")).collect()
    assert [r.a for r in out] == ["2026-02-26", None, None, None, None, None, None]
    assert [r.b for r in out] == ["2026-02-26", "2026-02-30", "2026-02-26", None, None, "2026-01-15", None]
    assert [r.c for r in out][3:] == ["(unknown)", "2026-01-15", "2026-01-15", "(unknown)"]
    assert [r.d for r in out] == ["2026-02-26", "2026-02-30", "2026-02-26", None, None, None, None]


def test_slug_and_paths(spark):
    df = spark.createDataFrame([("__a b--c__",), ("###",), ("",)], "s string")
    assert [r[0] for r in df.select(text.slug(F.col("s"))).collect()] == ["a_b_c", "unknown", "unknown"]
    rec = spark.createDataFrame([("cell/task/s",), ("/s",), ("plain",), ("a/",)], "r string")
    out = rec.select(serials.task_from_recording(F.col("r")), serials.serial_from_recording(F.col("r"))).collect()
    assert [tuple(r) for r in out] == [("cell/task", "s"), (None, "s"), (None, None), ("a", None)]


def test_ranges_text(spark):
    ids = [0, 1, 2, 3, 7, 9, 10]
    df = spark.createDataFrame([("d", i) for i in ids], "dataset_key string, episode_index long")
    assert ep.episode_ranges_text(df, per_line=1000).first().ranges == "0-3, 7, 9-10"


def test_grade_updates(spark):
    df = spark.createDataFrame(
        [("d", 0, "bad", None, None), ("d", 1, "normal", " ", []), ("d", 2, "good", "why", [" a ", " "]),
         ("d", 3, "Good", None, None), ("d", 4, "bad", "torn", None), ("d", 5, None, "x", None)],
        "dataset_key string, episode_index long, grade string, reason string, tags array<string>")
    out = {r.episode_index: r for r in ann.grade_updates(df).collect()}
    assert [out[i].valid for i in range(6)] == [False, False, True, False, True, True]
    assert out[2].reason is None and out[2].tags == ["a"] and out[4].reason == "torn"
    assert out[5].reason is None and out[4].keep_tags


def test_merge_upsert_keeps_absent_columns_and_honours_the_condition(spark, rows):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, v int, w string")
    new = spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int")
    assert rows(ann.merge_upsert(old, new, ["k"])) == [("a", 1, "x"), ("b", 9, "y"), ("c", 3, None)]
    held = ann.merge_upsert(old, new, ["k"], when=F.col("old.w") == "x")
    assert rows(held) == [("a", 1, "x"), ("b", 2, "y"), ("c", 3, None)]


def test_filters(six):
    ids = lambda df: sorted(r.episode_index for r in df.collect())
    tagged = six.withColumn("tags", F.when(F.col("episode_index") < 2, F.array(F.lit("t"))).otherwise(
        F.array().cast("array<string>")))
    assert ids(ep.curate_filter(tagged, (100, 200))) == [0, 2, 5]
    assert ids(ep.out_filter(tagged, ["Ungraded", "good"], ["t"])) == [0, 1]
    assert ids(ep.out_filter(tagged, [], [])) == [0, 1, 2, 3, 4, 5]
    assert ids(ep.delete_filter(tagged)) == []
    assert ids(ep.delete_filter(tagged, tags=["t"])) == [0, 1]
    with pytest.raises(ValueError):
        ep.delete_filter(tagged, ["good"], ["t"])
    assert ep.delete_guard(tagged, tagged).first().refused
    assert ids(ann.export_filter(six, [" BAD "])) == [0, 1, 3, 4, 5]


def test_summary_durations(spark, six):
    catalog = lambda fps: spark.createDataFrame([("d", fps)], "dataset_key string, fps double")
    by_fps = stats.dataset_grade_summary(six, catalog(10.0)).first()
    assert by_fps.total_duration_sec == 118.0 and by_fps.good_duration_sec == 48.0 and by_fps.graded_count == 5
    assert stats.dataset_grade_summary(six, catalog(0.0)).first().total_duration_sec == 1180.0


def test_registry_search(spark):
    datasets = spark.createDataFrame(
        [("1", "ds_good", "cell_a", "so100", 100), ("2", "ds_mixed", "cell_a", "so100", 50), ("3", "ds_small", "cell_b", "koch", 5)],
        "dataset_key string, name string, cell_name string, robot_type string, total_episodes long")
    st = spark.createDataFrame([("1", 100, 80), ("2", 50, 20)], "dataset_key string, graded_count long, good_count long")
    names = lambda **q: sorted(r.name for r in stats.registry_search(datasets, st, **q).collect())
    assert names() == ["ds_good", "ds_mixed", "ds_small"]
    assert names(cell="cell_a", min_good_ratio=0.5) == ["ds_good"]
    assert names(robot_type="koch", min_good_ratio=0.0) == ["ds_small"]
    assert names(min_episodes=50) == ["ds_good", "ds_mixed"]


def test_playback(spark):
    df = spark.createDataFrame([(1.0, 3.0, 60, 30.0, None), (1.0, float("nan"), 60, 30.0, None), (1.0, None, 0, 0.0, 9.0),
                                (5.0, 2.0, None, None, 4.0)], "s double, e double, n int, f double, d double")
    b = playback.boundary(*[F.col(c) for c in "senfd"])
    out = df.select(b.alias("b"), playback.playable_end(F.col("s"), b, F.col("f")).alias("p")).collect()
    assert [r.b for r in out] == [3.0, 3.0, 9.0, None]
    assert [None if r.p is None else round(r.p, 4) for r in out] == [2.9667, 2.9667, 9.0, None]


def test_file_location_and_rows_without_columns(spark):
    df = spark.createDataFrame([("d", 0, 3, None), ("d", 1, None, None)],
                               "dataset_key string, episode_index long, `videos/cam/chunk_index` long, `videos/cam/file_index` long")
    out = {r.episode_index: r for r in ep.episode_file_location(df).collect()}
    assert out[0].videos["cam"].chunk == 3 and out[0].videos["cam"].file == 0
    assert out[1].videos == {} and out[1].dataset_to_index == 0
    tasks = spark.createDataFrame([("d", 0, "pick")], "dataset_key string, task_index long, task string")
    row = ep.resolve_episode_row(df.select("dataset_key", "episode_index").withColumn("tasks", F.array(F.lit("place"))), tasks).first()
    assert row.task_index == 0 and row.task_instruction == "place" and row.tags == [] and row.length == 0


def test_columns_can_be_added_once(six):
    with pytest.raises(ValueError):
        sinks.add_column(six, "grade", "string", "x")
    with pytest.raises(ValueError):
        sinks.add_column(six, "extra", "decimal", 1)
    assert sinks.add_column(six, "extra", "float64", 1).schema["extra"].dataType.simpleString() == "double"
