"""Reorganizing, serial repair, tasks, conversion state, validation, and files on disk."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from kinetable.operators import annotations as ann
from kinetable.operators import conversion, curation, reorganize, serials, tasks, validation
from kinetable.sources import catalog, datasets, recordings, sidecar, sinks

EP = "dataset_key string, episode_index long"


def test_keep_two_of_five(spark):
    eps = spark.createDataFrame([("d", e, e + 2) for e in range(5)], EP + ", length long")
    ids = eps.where("episode_index in (1, 3)")
    kept = reorganize.reindex_episodes(reorganize.semi_select(eps, ids))
    got = sorted((r.episode_index, r.old_episode_index, r.dataset_from_index, r.dataset_to_index) for r in kept.collect())
    assert got == [(0, 1, 0, 3), (1, 3, 3, 8)]
    assert sorted(r.episode_index for r in reorganize.anti_delete(eps, ids).collect()) == [0, 2, 4]
    frames = spark.createDataFrame([("d", e, f, 0) for e in range(5) for f in range(e + 2)], EP + ", frame_index long, index long")
    moved = reorganize.reindex_frames(frames, kept)
    assert sorted(r["index"] for r in moved.collect()) == list(range(8))


def test_merge_unites_tasks(spark):
    eps = spark.createDataFrame([("a", 0, 5, 0), ("a", 1, 5, 1), ("b", 0, 3, 0), ("b", 1, 3, 1)], EP + ", length long, task_index long")
    tk = spark.createDataFrame([("a", 0, "pick"), ("a", 1, "place"), ("b", 0, "place"), ("b", 1, "push")], "dataset_key string, task_index long, task string")
    targets = spark.createDataFrame([("b", "m", 0), ("a", "m", 1)], "dataset_key string, target string, source_order long")
    out = reorganize.merge_datasets(eps, tk, targets).orderBy("episode_index").collect()
    assert [(r.source_dataset, r.old_episode_index, r.dataset_from_index, r.task_index) for r in out] == [
        ("b", 0, 0, 0), ("b", 1, 3, 1), ("a", 0, 6, 2), ("a", 1, 11, 0)]


def test_sync_skips_known_serials(spark):
    src = spark.createDataFrame([("s", 0, "x"), ("s", 1, "y"), ("s", 2, None)], EP + ", Serial_number string")
    dst = spark.createDataFrame([("t", 0, "x"), ("t", 1, None), ("t", 2, "")], EP + ", Serial_number string")
    assert tuple(reorganize.sync_counts(src, dst).first()) == ("s", 2, 1)
    assert tuple(reorganize.sync_counts(src, src).where("dataset_key = 's'").first())[1:] == (1, 2)


def _renamed(pairs):
    groups = {}
    for ep, s in pairs:
        if s:
            groups.setdefault(s, []).append(ep)
    used = {s for s, eps in groups.items() if len(eps) == 1}
    out = {}
    for s, eps in groups.items():
        n = 0
        for ep in sorted(eps):
            if len(eps) == 1:
                out[ep] = s
                continue
            n = next(k for k in range(n + 1, 10_000) if f"{s}_{k}" not in used)
            out[ep] = f"{s}_{n}"
    return out


def test_unique_serials_equal_a_loop(spark):
    rng = random.Random(5)
    data, want = [], {}
    pool = ["A", "B", "A_1", "A_2", "A_3", "A_5", "A_1_1", "A_02", "B_1", "A_7", "A_8", None, ""]
    for d in range(60):
        pairs = [(e, rng.choice(pool[:3] if rng.random() < 0.5 else pool)) for e in range(rng.randint(1, 14))]
        data += [(f"d{d}", e, s) for e, s in pairs]
        want.update({(f"d{d}", e): s for e, s in _renamed(pairs).items()})
    df = spark.createDataFrame(data, EP + ", Serial_number string")
    out = serials.unique_serials(df).collect()
    assert {(r.dataset_key, r.episode_index): r.new_serial for r in out if r.Serial_number} == want
    assert all(r.new_serial == r.Serial_number for r in out if not r.Serial_number)


def test_one_serial_may_hold_most_rows(spark, monkeypatch):
    from kinetable.operators import ordered

    monkeypatch.setattr(serials, "int_block", lambda c: ordered.int_block(c, 50))
    df = spark.createDataFrame([("d", e, "S") for e in range(400)] + [("d", 900, "S_7")], EP + ", Serial_number string")
    out = {r.episode_index: r.new_serial for r in serials.unique_serials(df).collect()}
    assert out[0] == "S_1" and out[5] == "S_6" and out[6] == "S_8" and out[399] == "S_401" and out[900] == "S_7"


def test_first_episode_owns_the_serial(spark, rows):
    df = spark.createDataFrame([("d", 3, "x"), ("d", 1, "x"), ("d", 2, None), ("d", 4, ""), ("e", 9, "x")], EP + ", Serial_number string")
    assert rows(ann.first_serial_owner(df)) == [("d", 1, "x"), ("e", 9, "x")]
    assert rows(serials.duplicate_serials(df)) == [("d", "x", 1, 3)]


def test_serial_digest(spark):
    df = spark.createDataFrame([("t", "b"), ("t", "a"), ("t", "a")], "cell_task string, serial string")
    out = serials.serial_set_digest(df).first()
    assert out.digest == hashlib.sha256(b"a\nb\n").hexdigest() and out.serials == 2
    tasks_ = spark.createDataFrame([("t",), ("empty",)], "cell_task string")
    both = {r.cell_task: r for r in serials.serial_set_digest(df, keys=tasks_).collect()}
    assert both["empty"].digest == hashlib.sha256(b"").hexdigest() and both["t"].serials == 2


def test_signature_reads_odd_frame_rates(spark):
    cards = [json.dumps({"fps": 29.97}), json.dumps({"fps": 29}), json.dumps({"fps": None}), json.dumps({})]
    df = spark.createDataFrame([("t", f"s{i}", c) for i, c in enumerate(cards)], "cell_task string, serial string, metacard string")
    got = [r.signature.fps for r in conversion.with_signature(df).orderBy("serial").collect()]
    assert got == [29, 29, 0, 0]


def test_instruction_preview_and_apply(spark):
    tk = spark.createDataFrame([("d", 0, "pick"), ("d", 1, "place")], "dataset_key string, task_index long, task string")
    eps = spark.createDataFrame([("d", 0, 0), ("d", 1, 0), ("d", 2, 1)], EP + ", task_index long")
    frames = spark.createDataFrame([("d", 0, 0), ("d", 2, 1), ("d", 9, 7)], EP + ", task_index long")
    ask = lambda e, text, mode: tasks.instruction_preview(
        spark.createDataFrame([("d", e, text, mode)], EP + ", instruction string, mode string"), eps, tk)
    seen = {(e, t, m): ask(e, t, m).first() for e, t, m in [
        (0, "pick", "episode"), (0, "place", "episode"), (2, "fold", "episode"), (0, "grab", "shared"), (0, "place", "shared"), (8, "x", "episode")]}
    assert seen[0, "pick", "episode"].action == "no_op"
    assert (seen[0, "place", "episode"].action, seen[0, "place", "episode"].target_task_index) == ("reuse", 1)
    assert (seen[2, "fold", "episode"].action, seen[2, "fold", "episode"].affected) == ("create", 1)
    assert (seen[0, "grab", "shared"].action, seen[0, "grab", "shared"].affected) == ("shared", 2)
    assert seen[0, "place", "shared"].problem == "instruction_duplicate"
    assert seen[8, "x", "episode"].problem == "episode_not_found"
    t2, e2, f2 = tasks.apply_episode_instructions(tk, eps, frames, ask(2, "fold", "episode"))
    assert sorted((r.task_index, r.task) for r in t2.collect()) == [(0, "pick"), (1, "fold")]
    assert sorted((r.episode_index, r.task_index) for r in e2.collect()) == [(0, 0), (1, 0), (2, 1)]
    assert sorted((r.episode_index, r.task_index) for r in f2.collect()) == [(0, 0), (2, 1), (9, 7)]
    lists = eps.drop("task_index").withColumn("tasks", F.array(F.lit("pick"), F.lit("place")))
    preview = tasks.instruction_preview(spark.createDataFrame([("d", 0, "grab", "shared")], EP + ", instruction string, mode string"), lists, tk)
    t3, e3 = tasks.apply_shared_rename(tk, lists, preview)
    assert {r.task for r in t3.collect()} == {"grab", "place"} and e3.first().tasks == ["grab", "place"]
    single = tasks.instruction_preview(spark.createDataFrame([("d", 0, "grab", "episode")], EP + ", instruction string, mode string"), lists, tk)
    assert single.first().problem == "multi_task_episode"


def test_pending(spark, rows):
    raw = spark.createDataFrame([("t", "persisted"), ("t", "pending")], "cell_task string, serial string")
    state = spark.createDataFrame([("t", "persisted", "converted"), ("t", "persisted", "transient"), ("t", "gone", "retry_due")],
                                  "cell_task string, serial string, status string")
    assert rows(conversion.pending_set(raw, state)) == [("t", "pending", False)]
    due = state.unionByName(spark.createDataFrame([("t", "persisted", "retry_due")], state.schema))
    queue = conversion.retry_first_queue(conversion.pending_set(raw, due)).collect()
    assert sorted((r.position, r.serial) for r in queue) == [(0, "persisted"), (1, "pending")]


def test_state_document_and_retry(spark, rows):
    doc = {"t": {"converted_count": 2, "failed_serials": ["a", "b", "b", ""], "last_serial": "c", "last_updated": "u",
                 "transient_failed": {"b": {"attempt_count": 3, "first_failed_at": 5.0, "next_retry_at": 6.0, "last_error": "e"},
                                      "k": {"attempt_count": 1, "first_failed_at": 1.0, "next_retry_at": 2.0, "last_error": "f"}}}}
    df = spark.createDataFrame([(json.dumps(doc),), ("{broken",)], "value string")
    per_task, unfinished = conversion.explode_state(df)
    assert [tuple(r)[:4] for r in per_task.collect()] == [("t", 2, 4, 2)]
    out = {r.serial: r for r in conversion.retry_all_failed(unfinished, F.lit(9.0)).collect()}
    assert set(out) == {"a", "b", "k"}
    assert (out["b"].attempt_count, out["b"].first_failed_at, out["b"].last_error) == (0, 9.0, "manual retry requested from UI")
    assert (out["k"].attempt_count, out["k"].reset) == (1, False)


def test_progress(spark, rows):
    state = spark.createDataFrame([("a", 5, 1, 2, "u"), ("gone", 3, 0, 0, None)],
                                  "cell_task string, converted_count long, failed_count long, retry_count long, last_updated string")
    totals = spark.createDataFrame([("a", 4), ("new", 2)], "cell_task string, total long")
    outputs = spark.createDataFrame([("a", 3)], "cell_task string, episodes long")
    got = conversion.convert_progress(state, totals, outputs).select("cell_task", "total", "done", "failed", "retry", "pending")
    assert rows(got) == [("a", 4, 3, 1, 2, 0), ("new", 2, 0, 0, 0, 2)]
    assert conversion.progress_summary(conversion.convert_progress(state, totals, outputs)).first().summary == (
        "2 tasks | 6 recordings | 3 done | 2 pending | 1 failed")
    assert rows(conversion.progress_mismatch(state, totals, outputs)) == [("a", 5, 3)]


def test_three_way(spark):
    fields = ", ".join(f"{f} string" for f in conversion.STATE_FIELDS)
    row = lambda task, **kw: (task, *[kw.get(f, "0") for f in conversion.STATE_FIELDS])
    make = lambda *r: spark.createDataFrame(list(r), f"cell_task string, {fields}")
    before = make(row("same"), row("done"), row("mixed"), row("clash"), row("dropped"))
    desired = make(row("same", last_serial="9"), row("done", last_serial="9"), row("mixed", last_serial="9", converted_count="1"),
                   row("clash", last_serial="9"), row("fresh"))
    current = make(row("same"), row("done", last_serial="9"), row("mixed", last_serial="9"), row("clash", last_serial="5"))
    got = {r.cell_task: r.admissible for r in conversion.three_way_check(current, before, desired).collect()}
    assert got == {"same": True, "done": True, "mixed": True, "clash": False, "dropped": True, "fresh": True}


def test_signature_of_metacards(spark):
    card = lambda **kw: json.dumps({"robot_type": "r-1", "fps": 30, "joint_names": ["j"], "camera_topic_map": {"b": 1, "a": 2},
                                    "action_joint_order": {"y": ["2"], "x": ["1"]}, **kw})
    data = [("t", "s1", card()), ("t", "s2", card(fps=15)), ("t", "s3", card(note="ignored")), ("t", "s4", "nope")]
    df = spark.createDataFrame(data, "cell_task string, serial string, metacard string")
    payload = {"robot_type": "r-1", "fps": 30, "joint_names": ["j"], "action_order": [], "action_joint_order": {"x": ["1"], "y": ["2"]},
               "action_topic_names": [], "camera_names": ["a", "b"]}
    want = hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:8]
    groups = {r.signature_id: r for r in conversion.signature_groups(df).collect()}
    assert groups[want].recordings == 2 and groups[want].keep_in_source and groups[want].position == 0
    other = next(r for k, r in groups.items() if k != want)
    assert other.destination == f"t__r_1__{other.signature_id}"
    assert conversion.invalid_metacards(df).first().serial == "s4"


def test_medallion(spark):
    schema = ("serial_number string, cell string, task string, bronze_path string, silver_path string, state string, failure_reason string, "
              "processing_started_at timestamp, retry_required boolean, updated_at timestamp")
    now = F.to_timestamp(F.lit("2026-01-02 00:00:00"))
    old = spark.createDataFrame([("s1", "c", "t", "b", "x", "silver_processing", None, None, False, None)], schema).withColumn(
        "processing_started_at", F.to_timestamp(F.lit("2026-01-01 00:00:00")))
    files = spark.createDataFrame([("bronze/c/t/s2",), ("bronze/c/t/s3",), ("bronze/c/t",), ("other/c/t/s4",)], "path string")
    outcomes = spark.createDataFrame([("s3", "x" * 2000)], "serial_number string, error string")
    found = curation.discover_bronze(files, "/d", "{root}/out/{cell}/{task}/{serial}")
    out = {r.serial_number: r for r in curation.medallion_step(old, found, outcomes, now).collect()}
    assert out["s1"].state == "silver_failed" and out["s1"].failure_reason == "silver_processing timeout"
    assert out["s2"].state == "silver_ready" and out["s2"].silver_path == "/d/out/c/t/s2"
    assert out["s3"].state == "silver_failed" and len(out["s3"].failure_reason) == 1000 and out["s3"].retry_required


# --- validation: start valid, break one thing -------------------------------------

@pytest.fixture(scope="module")
def valid(spark):
    sql = spark.sql
    info = sql("""select 'd' dataset_key, array('features','fps','total_episodes','total_frames') info_keys, 30.0D fps, 2L total_episodes, 5L total_frames,
        map('cam', named_struct('dtype', 'video', 'shape', array(3L), 'names', cast(null as array<string>))) features,
        'videos/{video_key}/chunk-{chunk_index:03d}/file-{file_index:03d}.mp4' video_path""")
    shards = sql("""select 'd' dataset_key, kind, path, columns from values
        ('tasks', 'meta/tasks.parquet', array('task_index', 'task')),
        ('episodes', 'meta/episodes/chunk-000/file-000.parquet', array('data/chunk_index','data/file_index','dataset_from_index','dataset_to_index','episode_index','task_index')),
        ('data', 'data/chunk-000/file-000.parquet', array('episode_index','frame_index','index','task_index','timestamp')) t(kind, path, columns)""")
    files = sql("""select 'd' dataset_key, path, 10L size from values ('meta/info.json'), ('meta/tasks.parquet'), ('meta/episodes/chunk-000/file-000.parquet'),
        ('data/chunk-000/file-000.parquet'), ('videos/cam/chunk-000/file-000.mp4'), ('videos/cam/chunk-000/file-001.mp4') t(path)""")
    tk = sql("select 'd' dataset_key, i task_index, concat('t', i) task from values (0L), (1L) t(i)")
    eps = sql("""select 'd' dataset_key, * from values (0L, 0L, 0L, 0L, 2L, 0L), (1L, 0L, 1L, 2L, 5L, 1L)
        t(episode_index, `data/chunk_index`, `data/file_index`, dataset_from_index, dataset_to_index, task_index)""")
    frames = sql("""select 'd' dataset_key, * from values (0L,0L,0L,0L),(1L,1L,0L,0L),(2L,0L,1L,1L),(3L,1L,1L,1L),(4L,2L,1L,1L)
        t(index, frame_index, episode_index, task_index)""")
    return dict(catalog=info, shards=shards, files=files, tasks=tk, episodes=eps, frames=frames)


def _check(valid, full=False, **changed):
    tables = validation.DatasetTables(**{k: changed.get(k, lambda df: df)(v) for k, v in valid.items()})
    return tuple((validation.full_validate if full else validation.quick_validate)(tables).first())[1:]


def test_valid_dataset(valid):
    assert _check(valid) == ("passed", "Quick passed: 2 episodes, 0 warnings")
    assert _check(valid, full=True) == ("partial", "Full partial: dataset OK, official loader skipped")


@pytest.mark.parametrize("table,change,message", [
    ("files", lambda d: d.where("path <> 'meta/info.json'"), "missing required file meta/info.json"),
    ("files", lambda d: d.where("path not like 'data/%'"), "no data parquet files under data"),
    ("catalog", lambda d: d.withColumn("info_keys", F.array(F.lit("fps"))), "missing info.json keys features, total_episodes, total_frames"),
    ("catalog", lambda d: d.withColumn("total_episodes", F.lit(0).cast("bigint")), "info total_episodes must be at least 1 episode"),
    ("catalog", lambda d: d.withColumn("total_frames", F.lit(9).cast("bigint")), "info total_frames=9 but data parquet has 5 rows"),
    ("tasks", lambda d: d.where("false"), "tasks.parquet must contain at least 1 task"),
    ("shards", lambda d: d.withColumn("columns", F.when(F.col("kind") == "data", F.array(F.lit("index"))).otherwise(F.col("columns"))),
     "data parquet data/chunk-000/file-000.parquet missing columns episode_index, frame_index, task_index, timestamp"),
    ("episodes", lambda d: d.where("episode_index = 0"), "info total_episodes=2 but episodes parquet has 1 rows"),
    ("episodes", lambda d: d.withColumn("dataset_to_index", F.col("dataset_from_index")), "invalid episode index ranges"),
    ("episodes", lambda d: d.withColumn("dataset_from_index", F.col("dataset_from_index") + F.when(F.col("episode_index") == 1, 1).otherwise(0)),
     "data rows 5 do not match episode ranges"),
    ("episodes", lambda d: d.withColumn("dataset_to_index", F.least("dataset_to_index", F.lit(4))), "data rows 5 do not match episode range end 4"),
    ("files", lambda d: d.where("path not like 'videos/%'"), "video dataset requires at least one videos/**/*.mp4"),
])
def test_quick_breaks(valid, table, change, message):
    assert _check(valid, **{table: change}) == ("failed", f"Quick failed: {message}")


@pytest.mark.parametrize("table,change,message", [
    ("tasks", lambda d: d.withColumn("task_index", F.col("task_index") + 1), "task index mismatch between tasks.parquet and episodes"),
    ("frames", lambda d: d.withColumn("index", F.greatest("index", F.lit(1))), "data index reference mismatch"),
    ("frames", lambda d: d.withColumn("episode_index", F.lit(0)), "data episode reference mismatch"),
    ("frames", lambda d: d.withColumn("task_index", F.lit(0)), "data task reference mismatch"),
    ("files", lambda d: d.where("path not like '%file-001.mp4'"), "missing video file videos/cam/chunk-000/file-001.mp4"),
    ("files", lambda d: d.withColumn("size", F.when(F.col("path").endswith("file-000.mp4"), 0).otherwise(F.col("size"))),
     "video file is not accessible videos/cam/chunk-000/file-000.mp4"),
])
def test_full_breaks(valid, table, change, message):
    assert _check(valid, full=True, **{table: change}) == ("failed", f"Full failed: {message}")


def test_multi_task_lists(spark, valid):
    lists = lambda names: lambda d: d.drop("task_index").withColumn("tasks", names)
    both = F.array(F.lit("t0"), F.lit("t1"))
    assert _check(valid, full=True, episodes=lists(both))[0] == "partial"
    assert _check(valid, full=True, episodes=lists(F.array(F.lit("zz"))))[1] == "Full failed: unknown episode task 'zz'"
    assert _check(valid, full=True, episodes=lists(F.array().cast("array<string>")))[1] == "Full failed: episode tasks list is empty"


# --- files ------------------------------------------------------------------------------

def test_scan_catalog_from_disk(spark, tmp_path, rows):
    def put(path, text):
        (tmp_path / path).mkdir(parents=True)
        (tmp_path / path / "meta").mkdir()
        (tmp_path / path / "meta" / "info.json").write_text(text)

    good = json.dumps({"fps": 30, "robot_type": "so100", "total_episodes": 3, "features": {"a": {"dtype": "video", "shape": [1]}}, "owner": "x"})
    put("cell001/one", good + "\x00\x00")
    put("cell001/group/two", good)
    put("cell001/group/two/inner", good)
    put("cell001/bad", "{")
    put("not_a_cell/three", good)
    put("cell002/deep/er/four", good)
    found = catalog.scan_catalog(spark, [str(tmp_path)])
    assert rows(found.select("cell_name", "name")) == [("cell001", "group/two"), ("cell001", "one"), ("cell002", "deep/er/four")]
    one = found.where("name = 'one'").first()
    assert one.custom == {"owner": "x"} and one.features["a"].dtype == "video" and one.fps == 30
    assert one.dataset_key == hashlib.sha256(str(tmp_path / "cell001" / "one").encode()).hexdigest()[:16]
    assert {r.cell_name: r.dataset_count for r in catalog.scan_cells(found).collect()} == {"cell001": 2, "cell002": 1}
    with pytest.raises(ValueError):
        catalog.info_update(found, "fps", "1")


def test_episodes_of_differing_shards(spark, tmp_path):
    one = spark.createDataFrame([(1, 10)], "episode_index long, length int")
    two = spark.createDataFrame([(2, 20, "s")], "episode_index long, length long, Serial_number string")
    sinks.write_new(one, f"{tmp_path}/a/meta/episodes/chunk-000/file-000.parquet")
    sinks.write_new(two, f"{tmp_path}/b/meta/episodes/chunk-000/file-000.parquet")
    out = datasets.scan_episodes(spark, [f"{tmp_path}/a", f"{tmp_path}/b", f"{tmp_path}/none"])
    assert sorted((r.episode_index, r.length, r.Serial_number) for r in out.collect()) == [(1, 10, None), (2, 20, "s")]
    assert datasets.scan_episodes(spark, [f"{tmp_path}/none"]).columns == ["dataset_path", "episode_index"]
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_new(one, f"{tmp_path}/a/meta/episodes/chunk-000/file-000.parquet")


def test_task_text_column(spark, tmp_path):
    import pandas as pd

    find = lambda ddl, idx=(): datasets.resolve_task_text_column(spark.createDataFrame([], ddl).schema, idx)
    assert find("task_index long, task string, x string") == "task"
    assert find("task_index long, __index_level_0__ string, x string") == "__index_level_0__"
    assert find("task_index long, words string") == "words"
    assert find("task_index long, a string, b string") is None
    assert find("task_index long, a string, b string", ["b"]) == "b"
    (tmp_path / "meta").mkdir()
    frame = pd.DataFrame({"task_index": [0], "note": ["n"]}, index=pd.Index(["pick"], name="instruction"))
    frame.to_parquet(tmp_path / "meta" / "tasks.parquet")
    assert datasets.scan_tasks(spark, str(tmp_path)).first().task == "pick"
    assert datasets.scan_tasks(spark, str(tmp_path / "none")).count() == 0


def test_fingerprint_changes_with_a_file(spark, tmp_path):
    (tmp_path / "a.parquet").write_bytes(b"1")
    stamp = lambda: datasets.dataset_fingerprint(
        datasets.file_inventory(spark, f"{tmp_path}/*.parquet", str(tmp_path)).withColumn("k", F.lit(1)), "k").first().fingerprint
    first = stamp()
    assert first == stamp()
    (tmp_path / "b.parquet").write_bytes(b"22")
    assert first != stamp()


def test_sidecar_and_raw_names(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"3": {"grade": "good", "tags": ["a"]}, "4": {"grade": None}}))
    (tmp_path / "y.json").write_text("{oops")
    out = sidecar.explode_sidecar(sidecar.read_sidecars(spark, f"{tmp_path}/*.json"), "file_name")
    assert sorted((r.episode_index, r.grade, r.tags) for r in out.collect()) == [(3, "good", ["a"]), (4, None, [])]
    raw = spark.createDataFrame([("c/t", "20260101_000002", '{"task_name": "own"}'), ("c/t", "20260101_000001", "{bad"), ("c/u/v", "s", "{}")],
                                "cell_task string, serial string, metacard string")
    eps = {(r.cell_task, r.episode_index): r for r in recordings.raw_as_episodes(raw).collect()}
    assert eps["c/t", 0].task_instruction == "t" and eps["c/t", 1].task_instruction == "own"
    assert eps["c/u/v", 0].task_instruction == "v" and eps["c/u/v", 0].Serial_number == "raw:c/u/v/s"
