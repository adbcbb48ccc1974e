"""Dataset folders on disk: listings, footers, many datasets at once, validation and export."""

from __future__ import annotations

import json
import os
import uuid

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import table
from kinetable.functions.text import dataset_key
from kinetable.operators import conversion, validation
from kinetable.plans import folder_queries
from kinetable.sources import catalog, datasets, files, folders, recordings, sidecar, sinks

CAMERA = "observation.images.cam"


def put(root, name, table):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table(table) if isinstance(table, dict) else table, path)


def dataset(root, count=3, **changes):
    """A sound dataset of ``count`` episodes of two frames each, two of them in the first data file."""
    n = 2 * count
    info = {"fps": 10, "features": {CAMERA: {"dtype": "video"}}, "total_episodes": count, "total_frames": n, "robot_type": "r",
            "video_path": "videos/{video_key}/chunk-{chunk_index:03d}/file-{file_index:03d}.mp4"} | changes.get("info", {})
    (root / "meta").mkdir(parents=True, exist_ok=True)
    (root / "meta/info.json").write_text(json.dumps(info))
    put(root, "meta/tasks.parquet", changes.get("tasks", {"task_index": [0, 1], "task": ["pick", "place"]}))
    rows = list(range(count))
    put(root, "meta/episodes/chunk-000/file-000.parquet", {
        "episode_index": rows, "task_index": [i % 2 for i in rows], "length": [2] * count,
        "dataset_from_index": [2 * i for i in rows], "dataset_to_index": [2 * i + 2 for i in rows],
        "data/chunk_index": [0] * count, "data/file_index": [i // 2 for i in rows],
        f"videos/{CAMERA}/chunk_index": [0] * count, f"videos/{CAMERA}/file_index": [i // 2 for i in rows]} | changes.get("episodes", {}))
    for file in range((count + 1) // 2):
        index = list(range(4 * file, min(n, 4 * file + 4)))
        put(root, f"data/chunk-000/file-{file:03d}.parquet", {
            "episode_index": [i // 2 for i in index], "frame_index": [i % 2 for i in index], "index": index,
            "task_index": [i // 2 % 2 for i in index], "timestamp": [i / 10 for i in index]})
        video = root / f"videos/{CAMERA}/chunk-000/file-{file:03d}.mp4"
        video.parent.mkdir(parents=True, exist_ok=True)
        video.write_bytes(b"v")
    return str(root)


BREAKS = {
    "sound": (None, "Quick passed: 3 episodes, 0 warnings", "Full partial: dataset OK, official loader skipped"),
    "gone": (None, "missing dataset directory {root}", None),
    "no_info": (lambda r: os.remove(r / "meta/info.json"), "missing required file meta/info.json", None),
    "no_tasks": (lambda r: os.remove(r / "meta/tasks.parquet"), "missing required file meta/tasks.parquet", None),
    "no_episode_folder": (lambda r: os.rename(r / "meta/episodes", r / "meta/other"), "missing required directory meta/episodes", None),
    "no_data_folder": (lambda r: os.rename(r / "data", r / "other"), "missing required directory data", None),
    "no_episode_files": (lambda r: os.remove(r / "meta/episodes/chunk-000/file-000.parquet"), "no episode parquet files under meta/episodes", None),
    "bad_info": (lambda r: (r / "meta/info.json").write_text("{"), "could not read meta/info.json", None),
    "bad_totals": (lambda r: dataset(r, info={"total_frames": "many"}), "invalid info.json totals", None),
    "wrong_total": (lambda r: dataset(r, info={"total_frames": 7}), "info total_frames=7 but data parquet has 6 rows", None),
    "no_column": (lambda r: put(r, "data/chunk-000/file-001.parquet", {"index": [4, 5]}),
                  "data parquet {root}/data/chunk-000/file-001.parquet missing columns episode_index, frame_index, task_index, timestamp", None),
    "no_videos": (lambda r: os.rename(r / "videos", r / "films"), "video dataset requires at least one videos/**/*.mp4", None),
    "gap": (lambda r: _gap(r), "data rows 6 do not match episode ranges", None),
    "foreign_task": (lambda r: put(r, "data/chunk-000/file-001.parquet", {
        "episode_index": [2, 2], "frame_index": [0, 1], "index": [4, 5], "task_index": [0, 7], "timestamp": [0.4, 0.5]}),
        "Quick passed: 3 episodes, 0 warnings", "Full failed: data task reference mismatch"),
    "lost_video": (lambda r: os.remove(r / f"videos/{CAMERA}/chunk-000/file-001.mp4"), "Quick passed: 3 episodes, 0 warnings",
                   f"Full failed: missing video file videos/{CAMERA}/chunk-000/file-001.mp4"),
    "empty_video": (lambda r: (r / f"videos/{CAMERA}/chunk-000/file-001.mp4").write_bytes(b""), "Quick passed: 3 episodes, 0 warnings",
                    f"Full failed: video file is not accessible videos/{CAMERA}/chunk-000/file-001.mp4"),
}


def _gap(root):
    put(root, "meta/episodes/chunk-000/file-000.parquet", {
        "episode_index": [0, 1, 2], "task_index": [0, 1, 0], "dataset_from_index": [0, 2, 5], "dataset_to_index": [2, 4, 6],
        "data/chunk_index": [0, 0, 0], "data/file_index": [0, 0, 1]})


UNREADABLE = {"tasks": "meta/tasks.parquet", "episode": "meta/episodes/chunk-000/file-000.parquet", "data": "data/chunk-000/file-001.parquet"}


def test_validation_of_folders_with_one_break_each(spark, tmp_path):
    roots = {}
    for name, (change, *_) in BREAKS.items():
        root = tmp_path / name
        roots[name] = str(root)
        if name != "gone":
            dataset(root)
        if change:
            change(root)
    for kind, file in UNREADABLE.items():
        roots[kind] = dataset(tmp_path / kind)
        (tmp_path / kind / file).write_bytes(b"PAR1 not really")
    tables = folders.dataset_tables(spark, list(roots.values()))
    names = spark.createDataFrame(list(roots.items()), "name string, root string").select("name", dataset_key(F.col("root")).alias("dataset_key"))
    of = lambda df: {r.name: r.summary for r in df.join(names, "dataset_key").collect()}
    quick, full = of(validation.quick_validate(tables)), of(validation.full_validate(tables))
    assert set(quick) == set(full) == set(roots)
    for name, (_, want, deep) in BREAKS.items():
        want = want.replace("{root}", roots[name])
        assert quick[name] == (want if want.startswith("Quick") else f"Quick failed: {want}"), name
        assert full[name] == (deep or f"Full failed: {want}"), name
    assert quick["tasks"].startswith("Quick failed: could not read meta/tasks.parquet (")
    for kind in ("episode", "data"):
        assert quick[kind].startswith(f"Quick failed: could not read {kind} parquet {roots[kind]}/{UNREADABLE[kind]} ("), quick[kind]


def test_quick_rules_read_footers_and_two_columns_only(spark, tmp_path):
    tables = folders.dataset_tables(spark, [dataset(tmp_path / "a")])
    plan = validation.quick_rules(tables)._jdf.queryExecution().executedPlan().toString()
    reads = [line for line in plan.split("\n") if "FileScan parquet" in line]
    assert reads and all(r.endswith("ReadSchema: struct<dataset_from_index:bigint,dataset_to_index:bigint>") for r in reads)


def test_a_thousand_datasets_of_three_schemas(spark, tmp_path):
    wide = [pa.table({"episode_index": [0, 1], "length": pa.array([5, 6], pa.int32())}),
            pa.table({"episode_index": [0, 1], "length": [7.5, None], "Serial_number": ["a", None]}),
            pa.table({"episode_index": [0, 1], "grade": ["good", None]})]
    roots = []
    for i in range(1000):
        put(tmp_path / f"d {i}+x", "meta/episodes/chunk-000/file-000.parquet", wide[i % 3])
        roots.append(str(tmp_path / f"d {i}+x"))
    found = datasets.scan_episodes(spark, roots, keyed=True)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 3
    assert dict(found.dtypes)["length"] == "double"
    got = found.groupBy("dataset_path").agg(
        F.count("*").alias("n"), F.sum("length").alias("length"), F.bool_and(F.array_contains("shard_columns", "grade")).alias("graded")).collect()
    assert {r.dataset_path for r in got} == set(roots)
    for r in got:
        i = int(r.dataset_path.rpartition("d ")[2][:-2])
        assert (r.n, r.length, r.graded) == (2, (11.0, 7.5, None)[i % 3], i % 3 == 2)
    assert found.select("dataset_key").distinct().count() == 1000


def test_frames_and_tasks_of_many_datasets(spark, tmp_path):
    roots = [dataset(tmp_path / "a"), dataset(tmp_path / "b", 5, tasks={"task_index": [0], "words": ["go"]})]
    frames = datasets.scan_dataset_frames(spark, roots, ["episode_index", "index"])
    assert sorted(map(tuple, frames.groupBy("dataset_path").agg(F.count("*"), F.sum("index")).collect())) == [(roots[0], 6, 15), (roots[1], 10, 45)]
    tasks = datasets.scan_tasks(spark, roots + [str(tmp_path / "none")])
    assert sorted((r.dataset_path, r.task_index, r.task) for r in tasks.collect()) == [(roots[0], 0, "pick"), (roots[0], 1, "place"), (roots[1], 0, "go")]
    with pytest.raises(ValueError, match="unreadable"):
        (tmp_path / "a/data/chunk-000/file-000.parquet").write_bytes(b"x")
        datasets.scan_dataset_frames(spark, roots)
    put(tmp_path / "b", "meta/episodes/chunk-000/file-001.parquet", {"episode_index": ["one"]})
    with pytest.raises(ValueError, match="episode_index"):
        datasets.scan_episodes(spark, roots)


def test_recordings_and_their_progress(spark, tmp_path):
    raw, done = tmp_path / "raw", tmp_path / "out"

    def recording(path, card='{"task_name": "t"}', first=True):
        folder = raw / path
        folder.mkdir(parents=True)
        (folder / "metacard.json").write_bytes(card if isinstance(card, bytes) else card.encode())
        if first:
            (folder / f"{folder.name}_0.mcap").write_bytes(b"m")

    recording("cell1/pick/20240101_000001")
    recording("cell1/pick/20240101_000002", "not json")
    recording("cell1/pick/20240101_000003", first=False)
    recording("cell1/pick/20240101_000001/inner/20240101_000009")
    recording("cell1/sort/blue/20240101_000004", b"\xff")
    recording("cell2/idle/20240101_000005")
    recording("loose")
    found = recordings.scan_recordings(spark, [str(raw)])
    assert sorted((r.cell_task, r.serial, r.task_name) for r in recordings.list_recordings(found).collect()) == [
        ("cell1/pick", "20240101_000001", "t"), ("cell1/pick", "20240101_000002", ""), ("cell1/sort/blue", "20240101_000004", ""),
        ("cell2/idle", "20240101_000005", "t")]
    assert sorted((r.name, r["count"]) for r in recordings.list_tasks(found, "cell1").collect()) == [("pick", 2), ("sort/blue", 1)]

    put(done / "cell1/pick", "meta/episodes/chunk-000/file-000.parquet", {"episode_index": [0]})
    put(done / "cell1/pick", "meta/episodes/chunk-001/file-000.parquet", {"episode_index": [1, 2]})
    (done / "cell1/sort/blue/meta/episodes").mkdir(parents=True)
    (done / "cell1/sort/blue/meta/info.json").write_text('{"total_episodes": 9}')
    (done / "cell2/idle/meta").mkdir(parents=True)
    (done / "cell2/idle/meta/info.json").write_text('{"total_episodes": 4}')
    counts = recordings.output_counts(spark, str(done), found)
    assert {r.cell_task: r.episodes for r in counts.collect()} == {"cell1/pick": 3, "cell1/sort/blue": 9}
    (done / "cell1/pick/meta/episodes/chunk-001/file-000.parquet").write_bytes(b"broken")
    (done / "cell1/pick/meta/info.json").write_text('{"total_episodes": 1}\0\0')
    counts = recordings.output_counts(spark, str(done), found)
    assert {r.cell_task: r.episodes for r in counts.collect()} == {"cell1/pick": 1, "cell1/sort/blue": 9}
    state = spark.createDataFrame([], "cell_task string, converted_count long, failed_count long, retry_count long, last_serial string, last_updated string")
    progress = conversion.convert_progress(state, recordings.raw_totals(found), counts)
    assert {r.cell_task: (r.total, r.done) for r in progress.collect()}["cell1/pick"] == (2, 1)


def right_with_few_on_disk(spark, tmp_path, monkeypatch, name):
    """The query against its SQL, with 50 recordings at a time; how many were on disk at each scan."""
    scan, counts, folder = recordings.scan_recordings, [], "/root/testdata/sf0.001"

    def counted(session, roots):
        counts.append(len(list(tmp_path.rglob("*.mcap"))))
        return scan(session, roots)

    monkeypatch.setattr(recordings, "scan_recordings", counted)
    monkeypatch.setattr(folder_queries, "RECORDINGS_AT_ONCE", 50, raising=False)
    monkeypatch.setattr(folder_queries, "scratch", lambda s: str(tmp_path / uuid.uuid4().hex))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet'")
    result = db.execute(entry.oracle_sql()[name])
    want = table([d[0] for d in result.description], result.fetchall())
    df = entry.queries()[name](spark, folder)
    assert table(df.columns, [tuple(r) for r in df.collect()]) == want
    assert len(counts) == 4 and max(counts) < 100, counts


def test_recordings_make_place_for_the_next(spark, tmp_path, monkeypatch):
    right_with_few_on_disk(spark, tmp_path, monkeypatch, "scan_recordings")


def test_progress_of_recordings_that_make_place(spark, tmp_path, monkeypatch):
    right_with_few_on_disk(spark, tmp_path, monkeypatch, "convert_progress_from_folders")


def test_sidecars_belong_to_datasets_by_name(spark, tmp_path):
    import hashlib

    one = "/mnt/cell1/one"
    name = f"one_{hashlib.sha256(one.encode()).hexdigest()[:16]}.json"
    (tmp_path / name).write_text('{"3": {"grade": "good", "tags": ["x"]}}')
    (tmp_path / "one_0000000000000000.json").write_text('{"4": {"grade": "bad"}}')
    rows = sidecar.scan_sidecars(spark, str(tmp_path), spark.createDataFrame([(one,), ("/mnt/cell1/two",)], "dataset_path string"))
    got = sidecar.explode_sidecar(rows, "dataset_path").collect()
    assert [(r.dataset_path, r.episode_index, r.grade, r.tags) for r in got] == [(one, 3, "good", ["x"])]


def test_export_of_a_folder(spark, tmp_path):
    root = tmp_path / "src"
    dataset(root, 5, info={"note": "é"}, episodes={"grade": ["good", " BAD ", None, "bad", "good"]})
    put(root, "meta/episodes/chunk-001/file-000.parquet", {"episode_index": [9], "grade": ["bad"]})
    target = tmp_path / "new" / "out"
    marks = spark.createDataFrame([(3, "normal"), (4, "bad"), (0, None)], "episode_index long, grade string")
    assert sinks.export_folder(spark, str(root), str(target), ["bad"], marks) == {"total_episodes": 3, "excluded_count": 3}
    below = sorted(str(p.relative_to(target)) for p in target.rglob("*") if p.is_file())
    assert below == ["data/chunk-000/file-000.parquet", "data/chunk-000/file-001.parquet", "meta/episodes/chunk-000/file-000.parquet",
                     "meta/info.json", "meta/tasks.parquet", f"videos/{CAMERA}/chunk-000/file-000.mp4", f"videos/{CAMERA}/chunk-000/file-001.mp4"]
    info = json.loads((target / "meta/info.json").read_text())
    assert (info["total_episodes"], info["total_frames"], info["note"]) == (3, 10, "é")
    rows = pq.read_table(target / "meta/episodes/chunk-000/file-000.parquet").to_pylist()
    source = pq.read_table(root / "meta/episodes/chunk-000/file-000.parquet")
    assert [r["episode_index"] for r in rows] == [0, 2, 3] and list(rows[0]) == source.column_names
    with pytest.raises(ValueError, match="exists"):
        sinks.export_folder(spark, str(root), str(target), [])


def test_a_failed_export_leaves_nothing(spark, tmp_path):
    with pytest.raises(RuntimeError):
        with sinks.staged(str(tmp_path / "out")) as staging:
            sinks.write_text(f"{staging}/meta/info.json", "{}")
            raise RuntimeError("lost")
    assert list(tmp_path.iterdir()) == []


def test_walk_stops_at_accepted_folders(spark, tmp_path):
    for path in ("a/b/mark", "a/b/c/mark", "a/d/x", "e/mark"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("")
    seen = files.walk(spark, [str(tmp_path), str(tmp_path / "none")], accept=["mark"])
    assert sorted({os.path.relpath(r.folder, tmp_path) for r in seen.where("accepted").collect()}) == ["a/b", "e"]
    assert "c" in {r.name for r in seen.collect()}
    assert files.walk(spark, [str(tmp_path / "none")]).count() == 0
    assert catalog.scan_info(spark, [str(tmp_path)]).count() == 0
