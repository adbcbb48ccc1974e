"""Log lines, live progress against an event-by-event fold, and the streams."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from kinetable.operators import curation
from kinetable.streaming import curation as curation_stream
from kinetable.streaming import log_events as logs
from kinetable.streaming import progress

START = datetime.datetime(2026, 4, 17, 6, 0, 0, tzinfo=datetime.timezone.utc)


def _parse(spark, *lines):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "n int, value string")
    return {r.n: r for r in logs.log_events(df).collect()}


def test_log_lines(spark):
    p = "2026-04-17 06:51:34 [INFO] "
    out = _parse(
        spark, p + "Converted: a/20260417_115509_881292 (1943 frames, 64.8s)", p + "Converted: a/b/s (12 frames)",
        p + "  Finalizing: cell001/pick_and_place", p + "Finalized: cell001/t ", p + "Converting cell001/t: 12 new recordings",
        p + "Recording: cell001/t/s (2 of 9)", p + "1 task with 3 pending", p.replace("INFO", "ERROR") + "Failed [E1]: a/s: no: topic",
        p.replace("INFO", "WARNING") + "Timestamp ANOMALY", p.replace("INFO", "WARNING") + "slow disk", p + "hello",
        "    indented", "  also", "Timestamp gap 3", "Traceback (most recent call last)", "", "   ", "no prefix", "ValueError: x")
    assert (out[0].type, out[0].frames, out[0].duration, out[0].ts) == ("converted", 1943, 64.8, "2026-04-17 06:51:34")
    assert out[1].duration is None and out[1].recording == "a/b/s"
    assert (out[2].type, out[2].task) == ("finalizing", "cell001/pick_and_place")
    assert (out[3].type, out[3].task) == ("finalized", "cell001/t")
    assert (out[4].task, out[4]["count"]) == ("cell001/t", 12)
    assert (out[5].recording, out[5]["index"], out[5].total) == ("cell001/t/s", 2, 9)
    assert (out[6].tasks, out[6].pending) == (1, 3)
    assert (out[7].error_code, out[7].recording, out[7].reason) == ("E1", "a/s", "no: topic")
    assert out[8].type == "warning" and out[10].type == "info"
    assert sorted(out) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 10]


def _random_log(rng, n):
    lines = []
    for i in range(n):
        ts = (START + datetime.timedelta(seconds=i)).strftime("%Y-%m-%d %H:%M:%S")
        task = f"c/t{rng.randrange(4)}"
        kind = rng.choice(["start", "start", "rec", "rec", "ok", "bad", "fin", "done"])
        text = {
            "start": f"Converting {task}: 5 new recordings", "rec": f"Recording: {task}/s{i} ({rng.randrange(1, 6)} of 5)",
            "ok": f"Converted: {task}/s{i} (3 frames)", "bad": f"Failed [E]: {task}/s{i}: broken",
            "fin": f"Finalizing: {task}", "done": f"Finalized: {task}"}[kind]
        lines.append((kind, task, i, ts, f"{ts} [INFO] {text}"))
    return lines


def _expected(lines):
    """The rules, one event after another."""
    live, active = {}, None
    for kind, task, i, ts, text in lines:
        ms = int((START + datetime.timedelta(seconds=i)).timestamp() * 1000)
        old = live.get(task)
        if kind == "start":
            if active and active != task and live.get(active, {}).get("phase") == "converting":
                live.pop(active)
            live[task], active = {"phase": "converting"}, task
        elif kind == "rec":
            index, total = text.split("(")[1].rstrip(")").split(" of ")
            live[task] = dict(phase=old["phase"] if old else "converting", index=int(index), total=int(total),
                              serial=f"s{i}", started=ms, flash=old.get("flash") if old else None)
        elif kind == "ok" and old:
            old["started"] = None
        elif kind == "bad" and old:
            old["flash"] = ms + 500
        elif kind == "done" or (kind == "fin" and not (old and old["phase"] == "done")):
            live[task] = dict(phase="done" if kind == "done" else "finalizing", flash=old.get("flash") if old else None)
            active = None if active == task else active
    return {t: tuple(e.get(k) for k in ("phase", "index", "total", "serial", "started", "flash")) for t, e in live.items()}, active


def _live_rows(rows):
    return {(r.log, r.task): (r.phase, r.recording_index, r.recording_total, r.recording_serial, r.started_ms, r.flash_until_ms) for r in rows}


def test_live_progress_equals_the_fold(spark):
    rng = random.Random(21)
    all_logs = {f"log{k}": _random_log(rng, rng.randrange(3, 40)) for k in range(80)}
    data = [(name, line[2], line[4]) for name, lines in all_logs.items() for line in lines]
    events = logs.log_events(spark.createDataFrame(data, "log string, line_no long, value string"))
    got = _live_rows(progress.live_progress(events).collect())
    want, active = {}, {}
    for name, lines in all_logs.items():
        tasks, now = _expected(lines)
        want |= {(name, t): v for t, v in tasks.items()}
        if now:
            active[name] = now
    assert got == want
    assert {r.log: r.task for r in progress.active_tasks(events).collect()} == active


def _follow(spark, tmp_path, store, **options):
    """Drain the log folder once; what the tasks of changed logs are now replaces what they were."""
    def keep(batch, number):
        rows = batch.collect()
        for name in {r.log for r in rows}:
            for key in [k for k in store if k[0] == name]:
                del store[key]
        store.update(_live_rows(rows))

    events = logs.source_log_stream(spark, str(tmp_path / "logs"))
    progress.run_progress_stream(events, str(tmp_path / "state"), str(tmp_path / "ckpt"), keep, **options).awaitTermination()


def test_growing_logs_to_live_progress(spark, tmp_path):
    """Lines are appended in uneven pieces, some in the middle of a line, over many batches."""
    rng = random.Random(22)
    folder = tmp_path / "logs"
    folder.mkdir()
    texts = {f"log{k}.txt": _random_log(rng, 40) for k in range(3)}
    data = {name: "".join(line[4] + "\n" for line in lines).encode() for name, lines in texts.items()}
    done, store = dict.fromkeys(texts, 0), {}
    for step in range(7):
        for name in texts:
            if rng.random() < .8:
                upto = len(data[name]) if step == 6 else min(len(data[name]), done[name] + rng.randrange(400))
                with open(folder / name, "ab") as file:
                    file.write(data[name][done[name]:upto])
                done[name] = upto
        _follow(spark, tmp_path, store)
        want = {}
        for name, lines in texts.items():
            whole = data[name][:done[name]].count(b"\n")
            want |= {(name, t): v for t, v in _expected(lines[:whole])[0].items()}
        assert store == want, step


def test_decisive_events_say_the_same(spark):
    rng = random.Random(5)
    all_logs = {f"log{k}": _random_log(rng, rng.randrange(20, 60)) for k in range(60)}
    data = [(name, line[2], line[4]) for name, lines in all_logs.items() for line in lines]
    lines = spark.createDataFrame(data, "log string, line_no long, value string")
    kept = spark.createDataFrame([], progress.EVENT_SCHEMA)
    for low, high in ((0, 7), (7, 8), (8, 30), (30, 99)):
        part = progress.task_events(logs.log_events(lines.where(f"line_no >= {low} and line_no < {high}")))
        kept = progress.progress_step(kept, part).select(*kept.columns).checkpoint()
    want = {(name, t): v for name, lines_ in all_logs.items() for t, v in _expected(lines_)[0].items()}
    assert _live_rows(progress._state(kept).collect()) == want
    assert kept.count() <= 60 * 4 * 8


def test_a_repeated_batch_changes_nothing_and_idle_logs_go(spark, tmp_path):
    line = lambda log, pos, at, text: (log, pos, f"2026-01-01 00:{at:02}:00 [INFO] {text}")
    table = lambda *rows: logs.log_events(spark.createDataFrame(rows, "log string, pos long, value string"))
    store = progress.ProgressStore(spark, str(tmp_path / "s"))
    one, two = table(line("a", 0, 0, "Converting c/t: 2 new recordings")), table(line("b", 0, 30, "Converting c/u: 1 new recordings"))
    store.step(0, one)
    first = _live_rows(store.step(1, two).collect())
    assert first == _live_rows(store.step(1, two).collect()) and set(first) == {("b", "c/u")}
    assert {r.log for r in store.load(1).collect()} == {"a", "b"}
    store.step(2, table(line("b", 50, 31, "Finalized: c/u")), idle=600)
    assert {r.log for r in store.load(2).collect()} == {"b"}
    assert not (tmp_path / "s" / "events" / "0").exists()


def test_positions_of_appended_lines(spark, tmp_path):
    folder = tmp_path / "logs" / "deep"
    folder.mkdir(parents=True)
    got = []

    def follow(**options):
        lines = logs.log_lines(spark, str(tmp_path / "logs"), **options)
        lines.writeStream.foreachBatch(lambda b, n: got.extend(tuple(r) for r in b.collect())).option(
            "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        out = sorted(got)
        got.clear()
        return out

    (folder / "a.log").write_bytes(b"one\ntwo\nthr")
    (folder / ".hidden").write_bytes(b"x\n")
    assert follow() == [("deep/a.log", 0, "one"), ("deep/a.log", 4, "two")]
    assert follow() == []
    with open(folder / "a.log", "ab") as file:
        file.write("ee\n\n\u00e9\n".encode() + b"\xff bad\nopen")
    (folder / "b.log").write_bytes(b"new\n" + b"x" * 200_000 + b"\nlast\n")
    out = follow(rangeBytes=1000)
    assert [r[1:] for r in out if r[0] == "deep/a.log"] == [(8, "three"), (14, ""), (15, "\u00e9"), (18, "\ufffd bad")]
    assert [(r[1], len(r[2])) for r in out if r[0] == "deep/b.log"] == [(0, 3), (4, 200_000), (200_005, 4)]
    (folder / "b.log").write_bytes(b"again\n")
    assert follow() == [("deep/b.log", 0, "again")]
    table = logs.log_lines(spark, str(tmp_path / "logs"), stream=False, rangeBytes=5).where("log = 'deep/a.log'")
    assert sorted((r.pos, r.value) for r in table.collect()) == [
        (0, "one"), (4, "two"), (8, "three"), (14, ""), (15, "\u00e9"), (18, "\ufffd bad"), (24, "open")]


def test_a_new_stream_may_begin_with_the_last_lines(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a").write_text("".join(f"2026-01-01 00:00:{i:02} [INFO] Finalized: c/{i}\n" for i in range(9)))
    (folder / "b").write_text("2026-01-01 00:00:00 [ERROR] boom\n")
    got = []
    logs.source_log_stream(spark, str(folder), tail=2).writeStream.foreachBatch(
        lambda b, n: got.extend((r.log, r.type, r.task) for r in b.collect())).option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(got, key=repr) == [("a", "finalized", "c/7"), ("a", "finalized", "c/8"), ("b", "error", None)]


def test_log_stream_writes_events(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "one.log").write_text("2026-01-01 00:00:00 [INFO] Finalized: c/t\nnoise\n")
    logs.write_events(logs.source_log_stream(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    (folder / "two.log").write_text("2026-01-01 00:00:01 [ERROR] boom\n")
    logs.write_events(logs.source_log_stream(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.log, r.type) for r in out) == [("one.log", "finalized"), ("two.log", "error")]


def test_job_progress_overwrites_with_null(spark):
    df = spark.createDataFrame([("a", 0, "2026-01-01 00:00:00 [INFO] Converted: t/s (5 frames, 2.5s)"),
                                ("a", 1, "2026-01-01 00:00:01 [INFO] Converted: t/u (6 frames)")], "log string, line_no long, value string")
    out = {r.field: r.value for r in progress.job_progress_fold(logs.log_events(df)).collect()}
    assert out == {"phase": "converting", "last_converted_recording": "t/u", "last_frames": "6", "last_duration": None}


def test_live_done(spark):
    base = spark.createDataFrame([("t", 10, 2), ("u", 0, 0), ("v", 8, 1)], "cell_task string, total long, done long")
    now = spark.createDataFrame([("a", "t", "converting", 4, 6), ("a", "v", "done", None, None)],
                                "log string, task string, phase string, recording_index long, recording_total long")
    out = {r.cell_task: (r.live_done, r.percent) for r in progress.live_done(base, now).collect()}
    assert out == {"t": (7, 70), "u": (0, 0), "v": (1, 13)}


def test_medallion_stream(spark, tmp_path):
    schema = ("serial_number string, cell string, task string, bronze_path string, silver_path string, state string, failure_reason string, "
              "processing_started_at timestamp, retry_required boolean, updated_at timestamp")
    folder = tmp_path / "in"
    folder.mkdir()
    latest = {"path": None}

    def load():
        return spark.read.parquet(latest["path"]) if latest["path"] else spark.createDataFrame([], schema)

    def store(df, number):
        path = str(tmp_path / f"state-{number}")
        df.write.mode("overwrite").parquet(path)
        latest["path"] = path

    outcomes = lambda: spark.createDataFrame([("s2", "no space")], "serial_number string, error string")
    for n in (1, 2):
        (folder / f"{n}.json").write_text(f'{{"path": "bronze/c/t/s{n}"}}\n')
        stream = curation.discover_bronze(spark.readStream.schema("path string").json(str(folder)), "/d")
        curation_stream.run_medallion_stream(stream, load, store, outcomes, str(tmp_path / "c")).awaitTermination()
    got = {r.serial_number: r.state for r in load().collect()}
    assert got == {"s1": "silver_ready", "s2": "silver_failed"}
