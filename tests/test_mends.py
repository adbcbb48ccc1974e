"""Cases that earlier versions got wrong: limits that cut, keys that met, values without an order."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import functions as F

from kinetable.functions.luminance import tile_luminance, tile_means
from kinetable.functions.text import repo_id
from kinetable.operators import annotations as ann
from kinetable.operators import conversion, curation, episodes, frames, registry, tasks
from kinetable.operators import distributions as dist
from kinetable.streaming import curation as curation_stream
from kinetable.streaming import progress


def test_all_jobs_without_a_limit(spark):
    jobs = spark.range(1500).select("id", F.lit("merge").alias("type"), F.lit("queued").alias("status"), F.lit("{}").alias("payload"),
                                    F.current_timestamp().alias("updated_at"))
    assert registry.list_jobs(jobs).count() == 1500 and [r.id for r in registry.list_jobs(jobs, limit=2).collect()] == [1499, 1498]


def test_more_ranges_than_a_line_holds(spark):
    ids = spark.range(2500).select(F.lit("d").alias("dataset_key"), (F.col("id") * 2).alias("episode_index"))
    lines = episodes.episode_ranges_text(ids, 1000).orderBy("line").collect()
    assert [r.range_count for r in lines] == [1000, 1000, 500] and lines[2].ranges.endswith("4996, 4998")


def test_two_signatures_with_the_same_eight_digits(spark, monkeypatch):
    rows = spark.createDataFrame(
        [("c/t", f"s{i}", d) for i, d in enumerate(["aaaaaaaa11", "aaaaaaaa11", "aaaaaaaa11", "aaaaaaaa22", "aaaaaaaa33", "bbbbbbbb44"])],
        "cell_task string, serial string, signature_digest string")
    signed = rows.withColumns({"signature_id": F.substring("signature_digest", 1, 8), "signature": F.struct(F.lit("so 100").alias("robot_type"))})
    monkeypatch.setattr(conversion, "with_signature", lambda recordings: signed)
    got = {r.destination for r in conversion.signature_groups(rows).collect()}
    assert got == {"c/t", "c/t__so_100__aaaaaaaa22", "c/t__so_100__aaaaaaaa33", "c/t__so_100__bbbbbbbb"}


def test_a_value_of_many_digits_has_a_bin(spark):
    df = spark.createDataFrame([("d", 0.0), ("d", 1e21)], "dataset_key string, v double")
    assert {r.bin: r["count"] for r in dist.dist_histogram(df, "v").collect()} == {0: 1, 19: 1}


def test_a_serial_in_two_datasets_is_one_annotation(spark):
    bridge = spark.createDataFrame([("a", 0, "s"), ("b", 4, "s")], "dataset_key string, episode_index long, serial_number string")
    updates = spark.createDataFrame([("a", 0, "good", None, ["x"]), ("b", 4, "bad", "why", ["y"])],
                                    "dataset_key string, episode_index long, grade string, reason string, tags array<string>")
    marks = spark.createDataFrame([], "serial_number string, grade string, tags array<string>, reason string")
    out = ann.apply_grade_updates(marks, updates, bridge).collect()
    assert [(r.serial_number, r.grade, r.reason) for r in out] == [("s", "bad", "why")]


def test_conflicting_renames_are_told(spark):
    table = spark.createDataFrame([("d", 0, "pick"), ("d", 1, "pick"), ("d", 2, "put")], "dataset_key string, task_index long, task string")
    ask = spark.createDataFrame([("d", 0, "grab"), ("d", 0, "grab"), ("d", 1, "hold"), ("d", 2, "lay"), ("d", 2, "set")],
                                "dataset_key string, current_task_index long, instruction string")
    preview = ask.withColumns({"action": F.lit("shared"), "problem": F.lit(None).cast("string")})
    assert sorted(map(tuple, tasks.rename_rejects(table, preview).collect())) == [
        ("d", 0, "grab", "ambiguous_text"), ("d", 1, "hold", "ambiguous_text"), ("d", 2, "lay", "conflicting_texts"), ("d", 2, "set", "conflicting_texts")]
    renamed, _ = tasks.apply_shared_rename(table, spark.createDataFrame([("d", 0)], "dataset_key string, episode_index long"), preview)
    assert {r.task_index: r.task for r in renamed.collect()} == {0: "grab", 1: "hold", 2: "put"}


def test_an_unknown_task_index_is_told(spark):
    table = spark.createDataFrame([("d", 0, "pick"), ("e", 1, "put")], "dataset_key string, task_index long, task string")
    assert [tuple(r) for r in tasks.unknown_tasks(table, 1).collect()] == [("d", 1, "task_not_found")]


def test_a_task_in_two_logs_shows_the_farthest(spark):
    base = spark.createDataFrame([("t", 10, 2)], "cell_task string, total long, done long")
    live = spark.createDataFrame([("a", "t", "converting", 4, 6), ("b", "t", "converting", 6, 6)],
                                 "log string, task string, phase string, recording_index bigint, recording_total bigint")
    assert [(r.live_done, r.percent) for r in progress.live_done(base, live).collect()] == [(9, 90)]


def test_upsert_of_maps(spark):
    now = spark.createDataFrame([("k", {"a": "1"})], "key string, m map<string,string>")
    new = spark.createDataFrame([("k", {"a": "2"}), ("k", {"a": "3"}), ("n", None)], "key string, m map<string,string>")
    assert {r.key: r.m for r in ann.merge_upsert(now, new, ["key"]).collect()} == {"k": {"a": "3"}, "n": None}


def test_slice_by_position_looks_at_one_file(spark):
    df = spark.createDataFrame([(f"/d/file-{f:03d}.parquet", i) for f in (0, 1) for i in range(5)], "shard_path string, shard_row long")
    got = frames.index_range_slice(df, 1, 3, shard="file-001.parquet").collect()
    assert sorted(tuple(r) for r in got) == [("/d/file-001.parquet", 1), ("/d/file-001.parquet", 2)]


def test_repository_names(spark):
    df = spark.createDataFrame([("/x/a b, c.d_e-f/",), ("/",), ("one",)], "t string")
    assert [r[0] for r in df.select(repo_id(F.col("t"))).collect()] == ["local/a-b--c.d_e-f", "local/dataset", "local/one"]


def test_tiles_of_mixed_shapes_in_one_batch(spark):
    draw = np.random.default_rng(3)
    images = [draw.integers(0, 256, shape, np.uint8) for shape in [(8, 8), (9, 13), (8, 8, 3), (8, 8), (7, 5, 4), (2, 9), (8, 8, 2)]]
    rows = [(i, *im.shape[:2], 1 if im.ndim == 2 else im.shape[2], bytearray(im.tobytes())) for i, im in enumerate(images)]
    rows += [(90, 8, 8, 1, None), (91, 8, 8, 1, bytearray(b"short")), (92, None, 8, 1, bytearray(b"")), (93, 0, 0, 1, bytearray(b""))]
    df = spark.createDataFrame(rows, "id long, height int, width int, channels int, pixels binary").coalesce(1)
    got = {}
    for r in tile_luminance(df, keys=["id"], rows=4, cols=4).collect():
        got.setdefault(r.id, {})[r.tile] = r.error if r.tile < 0 else r.luminance
    for i in range(5):
        plain = images[i] if images[i].ndim == 2 else images[i][..., :3].astype(np.float64) @ [0.299, 0.587, 0.114]
        edges = lambda n: [n * k // 4 for k in range(5)]
        ys, xs = edges(plain.shape[0]), edges(plain.shape[1])
        want = [plain[ys[a]:ys[a + 1], xs[b]:xs[b + 1]].mean() for a in range(4) for b in range(4)]
        assert np.allclose([got[i][t] for t in range(16)], want, atol=1e-3)
        assert np.allclose(tile_means(images[i], 4, 4).ravel(), want, atol=1e-3)
    assert got[5] == {-1: "frame is smaller than the tile grid"} and got[6] == {-1: "colour frames need three channels"}
    assert got[90] == {-1: "no pixels"} and got[91][-1].startswith("cannot reshape") and set(got[92]) == set(got[93]) == {-1}


SCHEMA = ("serial_number string, cell string, task string, bronze_path string, silver_path string, state string, failure_reason string, "
          "processing_started_at timestamp, retry_required boolean, updated_at timestamp")


def test_medallion_batches_that_repeat_and_a_clock(spark, tmp_path):
    store = curation_stream.StateStore(spark, str(tmp_path / "s"), SCHEMA)
    none = lambda: spark.createDataFrame([], "serial_number string, error string")
    found = lambda n: curation.discover_bronze(spark.createDataFrame([(f"bronze/c/t/s{n}",)], "path string"), "/d")
    store.step(0, found(1), none(), 3600, None)
    store.step(1, found(2), none(), 3600, None)
    view = lambda n: sorted((r.serial_number, r.state) for r in store.load(n).collect())
    first = view(1)
    store.step(1, found(2), none(), 3600, None)
    assert view(1) == first == [("s1", "silver_ready"), ("s2", "silver_ready")]

    # a recording that hangs fails while no detection comes
    store.load(1).withColumns({"state": F.lit("silver_processing"), "processing_started_at": F.current_timestamp() - F.expr("interval 1 hour")}
                              ).write.parquet(str(tmp_path / "seed"))
    late = curation_stream.StateStore(spark, str(tmp_path / "t"), SCHEMA)
    spark.read.parquet(str(tmp_path / "seed")).write.parquet(late.path(-1))
    object.__setattr__(late, "load", lambda b: spark.read.schema(SCHEMA).parquet(late.path(b)))
    (tmp_path / "in").mkdir()
    quiet = curation.discover_bronze(spark.readStream.schema("path string").json(str(tmp_path / "in")), "/d")
    query = curation_stream.follow_medallion(quiet, late, none, str(tmp_path / "c"), timeout=60, beat=1)
    end = time.time() + 60
    while time.time() < end and not (query.lastProgress or {}).get("batchId", -1) >= 0:
        time.sleep(0.5)
    query.stop()
    batch = max(int(p.name) for p in (tmp_path / "t/states").iterdir() if p.name != "-1" and (p / "_SUCCESS").exists())
    assert {r.state for r in late.load(batch).collect()} == {"silver_failed"}


def test_stacked_scans_read_their_input_once(spark):
    import __spark_entry__ as entry

    for name, most in (("pending_set", 2), ("retry_first_queue", 4), ("terminal_frames", 2)):
        plan = entry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") <= most, name


def test_the_entry_lives_without_a_library_of_the_corpus_part():
    import subprocess
    import sys

    code = ("import sys; sys.modules['zstandard'] = None\nimport __spark_entry__ as e\n"
            "assert len(e.queries()) > 150 and not any(n.startswith('op1_') for n in e.queries())")
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
