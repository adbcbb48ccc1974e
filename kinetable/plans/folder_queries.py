"""Queries over dataset and recording folders that are written from the supplied tables and read back."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.operators import annotations as ann
from kinetable.operators import conversion, stats
from kinetable.operators import distributions as dist
from kinetable.operators import validation as val
from kinetable.plans.conversion_queries import _PROGRESS
from kinetable.plans.registry import query, r6
from kinetable.plans.shapes import Shapes
from kinetable.plans.validation_queries import _FACTS, CAMERA, TEMPLATE
from kinetable.settings import checkpointed, shared_folder
from kinetable.sources import datasets, folders, recordings, sinks
from kinetable.sources.files import local, remove_folder, remove_folders

SHARD = "meta/episodes/chunk-000/file-%03d.parquet"
REPEATED = "episode_index % 23 = 0"


def scratch(s: Shapes) -> str:
    """A new folder for one round trip, in the folder all executors share."""
    return f"{local(shared_folder(s.spark))}/folders-{uuid.uuid4().hex}"


def _name(path: str):
    return F.element_at(F.split(path, "/"), -1)


# --- datasets whose shards differ ---------------------------------------------------

def mixed_folders(s: Shapes) -> str:
    """A folder for each source: src3 has no lengths, src4 no serials, src5 neither lengths nor ranges. Every 23rd
    episode is in a second file again, seven frames longer and graded anew."""
    columns = ["episode_index", "length", "dataset_from_index", "dataset_to_index", "Serial_number", "grade", "tags"]
    rows = s.episodes.select("dataset_key", *columns, F.lit(0).alias("_file"))
    again = rows.where(REPEATED).withColumns({
        "length": F.col("length") + 7, "dataset_to_index": F.col("dataset_to_index") + 7, "grade": F.lit("Normal "),
        "Serial_number": F.lit(None).cast("string"), "_file": F.lit(1)})
    key = F.col("dataset_key")
    without = lambda *names: F.array(*[F.lit(c) for c in columns if c not in names])
    own = F.when(key == "src3", without("length")).when(key == "src4", without("Serial_number")).when(
        key == "src5", without("length", "dataset_from_index", "dataset_to_index")).otherwise(without())
    root = scratch(s)
    sinks.write_shards(rows.unionByName(again).withColumns({
        "shard_columns": own, "_path": F.concat("dataset_key", F.lit("/"), F.format_string(SHARD, "_file"))}).drop(
        "dataset_key", "_file"), root, path="_path", order=["episode_index"])
    return root


def mixed_episodes(s: Shapes) -> DataFrame:
    root = mixed_folders(s)
    roots = s.catalog.select(F.concat(F.lit(f"{root}/"), "dataset_key").alias("root"))
    return datasets.scan_episodes(s.spark, roots).withColumn("dataset_key", _name("dataset_path"))


_MIXED = f"""mixed AS (
  SELECT dataset_key, episode_index, 0 AS file, length, dataset_from_index AS lo, dataset_to_index AS hi, CASE WHEN dataset_key <> 'src4' THEN serial END AS serial, grade FROM episodes
  UNION ALL SELECT dataset_key, episode_index, 1, length + 7, dataset_from_index, dataset_to_index + 7, NULL, 'Normal ' FROM episodes WHERE {REPEATED}),
sized AS (SELECT *, CASE dataset_key WHEN 'src3' THEN greatest(hi - lo, 0) WHEN 'src5' THEN 0 ELSE coalesce(length, 0) END AS frames FROM mixed),
last_rows AS (SELECT dataset_key, episode_index, arg_max(frames, file) AS frames, max_by(struct_pack(g := grade), file).g AS grade FROM sized GROUP BY dataset_key, episode_index)"""
_OLD = """old AS (SELECT dataset_key, episode_index, grade FROM legacy
  UNION ALL SELECT dataset_key, -episode_index - 1, grade FROM legacy WHERE episode_index % 10 = 1)"""


@query(f"""WITH {_MIXED} SELECT dataset_key, episode_index, file, CASE WHEN dataset_key NOT IN ('src3', 'src5') THEN length END AS length,
  CASE WHEN dataset_key <> 'src5' THEN hi END AS hi, serial, grade,
  CASE WHEN dataset_key = 'src5' THEN 4 WHEN dataset_key IN ('src3', 'src4') THEN 6 ELSE 7 END AS columns FROM mixed""")
def scan_mixed_episodes(s: Shapes):
    return mixed_episodes(s).select(
        "dataset_key", "episode_index", F.regexp_extract("shard_path", r"(\d)\.parquet$", 1).cast("int").alias("file"), "length",
        F.col("dataset_to_index").alias("hi"), F.col("Serial_number").alias("serial"), "grade", F.size("shard_columns").alias("columns"))


_SECONDS = lambda what: f"round(coalesce(sum(frames){what}, 0) / any_value(CASE WHEN c.fps > 0 THEN c.fps ELSE 1 END), 6)"


@query(f"""
WITH {_MIXED}, {_OLD},
owners AS (SELECT dataset_key, serial, min(episode_index) AS episode_index FROM mixed WHERE serial <> '' GROUP BY dataset_key, serial),
marked AS (SELECT o.dataset_key, o.episode_index, a.grade FROM owners o JOIN annotations a ON a.serial_number = o.serial),
resolved AS (SELECT coalesce(l.dataset_key, x.dataset_key) AS dataset_key, coalesce(l.frames, 0) AS frames,
    lower(trim(CASE WHEN m.dataset_key IS NOT NULL THEN m.grade ELSE coalesce(x.grade, l.grade) END)) AS g
  FROM last_rows l FULL JOIN (SELECT * FROM old WHERE grade IS NOT NULL) x ON x.dataset_key = l.dataset_key AND x.episode_index = l.episode_index
  LEFT JOIN marked m ON m.dataset_key = l.dataset_key AND m.episode_index = l.episode_index)
SELECT r.dataset_key, count(*) FILTER (g IN ('good', 'normal', 'bad')) AS graded_count, count(*) FILTER (g = 'good') AS good_count,
  count(*) FILTER (g = 'normal') AS normal_count, count(*) FILTER (g = 'bad') AS bad_count, {_SECONDS('')} AS total_duration_sec,
  {_SECONDS(" FILTER (g = 'good')")} AS good_duration_sec, {_SECONDS(" FILTER (g = 'normal')")} AS normal_duration_sec,
  {_SECONDS(" FILTER (g = 'bad')")} AS bad_duration_sec
FROM resolved r JOIN catalog c ON c.dataset_key = r.dataset_key GROUP BY r.dataset_key""")
def mixed_grade_summary(s: Shapes):
    """Grades and seconds over shards that differ, ids that repeat, and ids that only the legacy annotations have."""
    extra = s.legacy.where("episode_index % 10 = 1").withColumn("episode_index", -F.col("episode_index") - 1)
    rows = ann.resolve_summary(mixed_episodes(s), s.legacy.unionByName(extra), s.annotations)
    out = stats.dataset_grade_summary(rows, s.catalog)
    return out.select(*out.columns[:5], *[r6(c).alias(c) for c in out.columns[5:]])


@query(f"""
WITH {_MIXED}, owned AS (SELECT b.dataset_key, a.grade, CASE WHEN a.serial_number IS NOT NULL THEN l.frames END AS frames
  FROM bridge b JOIN last_rows l ON l.dataset_key = b.dataset_key AND l.episode_index = b.episode_index
  LEFT JOIN annotations a ON a.serial_number = b.serial_number)
SELECT c.dataset_key, count(grade) AS graded_count, round(CASE WHEN c.fps > 0 THEN coalesce(sum(frames), 0) / c.fps ELSE 0 END, 6) AS total_duration_sec
FROM catalog c LEFT JOIN owned o ON o.dataset_key = c.dataset_key GROUP BY c.dataset_key, c.fps""")
def mixed_refresh_stats(s: Shapes):
    out = stats.refresh_stats(s.bridge, s.annotations, mixed_episodes(s), s.catalog)
    return out.select("dataset_key", "graded_count", r6("total_duration_sec").alias("total_duration_sec"))


@query(f"""
WITH {_MIXED}, dated AS (SELECT dataset_key, replace(replace(trim(serial), '-', ''), '_', '') AS d FROM mixed WHERE dataset_key <> 'src4')
SELECT dataset_key, CASE WHEN regexp_matches(d, '^[0-9]{{8}}') THEN d[1:4] || '-' || d[5:6] || '-' || d[7:8] ELSE '(unknown)' END AS label, count(*) AS count,
  CAST(sum(count(*)) OVER (PARTITION BY dataset_key) AS BIGINT) AS total FROM dated GROUP BY dataset_key, label""")
def mixed_collection_date(s: Shapes):
    return dist.dist_collection_date(mixed_episodes(s))


# --- frames, tasks, validation, export ----------------------------------------------

_FILE = "floor(floor(episode_index / 8) / 256)"


def range_folders(s: Shapes) -> str:
    """The eight datasets of the validation queries as folders, a file for 256 episodes.

    ds1 claims a frame too many, ds2 lacks the frame rate, ds3 the task file, ds4 has an empty range, ds5 a foreign
    task, ds6 a lost video, ds7 a foreign episode.
    """
    root, k = scratch(s), F.col("dataset_key")
    file = F.expr(_FILE).cast("long")
    at = lambda folder, suffix="parquet", n=file: F.concat("dataset_key", F.lit(f"/{folder}/chunk-000/file-"), F.format_string("%03d", n), F.lit(f".{suffix}"))
    episodes = s.range_episodes.select(
        "dataset_key", "episode_index", "length", "task_index", "dataset_from_index",
        F.when((k == "ds4") & (F.floor(F.col("episode_index") / 8) == 5), F.col("dataset_from_index")).otherwise(
            F.col("dataset_to_index")).alias("dataset_to_index"),
        F.lit(0).cast("bigint").alias("data/chunk_index"), file.alias("data/file_index"))
    sinks.write_shards(episodes.withColumn("_path", at("meta/episodes", n=F.lit(0))).drop("dataset_key"), root, path="_path", order=["episode_index"])
    frames = s.range_frames.withColumn("_path", at("data")).withColumns({
        "task_index": F.when((k == "ds5") & (F.col("index") == 17), 9).otherwise(F.col("task_index")),
        "episode_index": F.when((k == "ds7") & (F.col("index") == 23), -1).otherwise(F.col("episode_index"))})
    sinks.write_shards(frames.drop("dataset_key", "dataset_from_index"), root, path="_path", order=["index"])
    tasks = s.range_episodes.where(k != "ds3").select(
        "task_index", F.concat(F.lit("task "), "task_index").alias("instruction"), F.concat("dataset_key", F.lit("/meta/tasks.parquet")).alias("_path")).distinct()
    sinks.write_shards(tasks, root, path="_path")
    videos = s.range_episodes.select(at(f"videos/{CAMERA}", "mp4").alias("path"), F.lit("v").alias("value")).distinct().where(
        ~F.col("path").endswith(f"ds6/videos/{CAMERA}/chunk-000/file-000.mp4"))
    per = s.range_episodes.groupBy("dataset_key").agg(F.count("*").alias("n"), F.sum("length").alias("frames"))
    info = F.to_json(F.struct(
        F.when(k != "ds2", 30).alias("fps"), F.col("n").alias("total_episodes"),
        (F.col("frames") + F.when(k == "ds1", 1).otherwise(0)).alias("total_frames"), F.lit(TEMPLATE).alias("video_path"),
        F.create_map(F.lit(CAMERA), F.struct(F.lit("video").alias("dtype"))).alias("features")))
    documents = per.select(F.concat("dataset_key", F.lit("/meta/info.json")).alias("path"), info.alias("value"))
    sinks.write_files(videos.unionByName(documents), root)
    return root


def _validated(s: Shapes, validate) -> DataFrame:
    root = range_folders(s)
    tables = folders.dataset_tables(s.spark, [f"{root}/ds{i}" for i in range(9)])
    names = tables.folders.select("dataset_key", _name("dataset_path").alias("dataset"))
    return validate(tables).join(names, "dataset_key").select("dataset", "status", F.replace("summary", F.lit(root), F.lit("")).alias("summary"))


_GONE = "UNION ALL SELECT 'ds8', 'failed', '{} failed: missing dataset directory /ds8'"


@query(f"""{_FACTS} SELECT dataset_key AS dataset, CASE WHEN problem IS NULL THEN 'passed' ELSE 'failed' END AS status,
  CASE WHEN problem IS NULL THEN 'Quick passed: ' || episodes || ' episodes, 0 warnings' ELSE 'Quick failed: ' || problem END AS summary FROM quick
{_GONE.format('Quick')}""")
def validate_folders_quick(s: Shapes):
    return _validated(s, val.quick_validate)


@query(f"""{_FACTS}, deep AS (SELECT *, CASE WHEN problem IS NOT NULL THEN problem WHEN outside > 0 THEN 'data index reference mismatch'
  WHEN wrong_episode > 0 THEN 'data episode reference mismatch' WHEN wrong_task > 0 THEN 'data task reference mismatch'
  WHEN dataset_key = 'ds6' THEN 'missing video file videos/{CAMERA}/chunk-000/file-000.mp4' END AS issue FROM quick)
SELECT dataset_key AS dataset, CASE WHEN issue IS NULL THEN 'partial' ELSE 'failed' END AS status,
  CASE WHEN issue IS NULL THEN 'Full partial: dataset OK, official loader skipped' ELSE 'Full failed: ' || issue END AS summary FROM deep
{_GONE.format('Full')}""")
def validate_folders_full(s: Shapes):
    return _validated(s, val.full_validate)


@query(f"""SELECT dataset_key AS dataset, CAST({_FILE} AS BIGINT) AS file, index, CASE WHEN dataset_key = 'ds7' AND index = 23 THEN -1 ELSE episode_index END AS episode_index,
  CASE WHEN dataset_key = 'ds5' AND index = 17 THEN 9 ELSE task_index END AS task_index, CAST(frame_index / 30.0 AS DOUBLE) AS timestamp,
  row_number() OVER (PARTITION BY dataset_key, CAST({_FILE} AS BIGINT) ORDER BY index) - 1 AS place FROM range_frames""")
def scan_dataset_frames(s: Shapes):
    root = range_folders(s)
    rows = datasets.scan_dataset_frames(s.spark, [f"{root}/ds{i}" for i in range(9)])
    return rows.select(_name("dataset_path").alias("dataset"), F.regexp_extract("shard_path", r"(\d+)\.parquet$", 1).cast("bigint").alias("file"),
                       "index", "episode_index", "task_index", "timestamp", F.col("shard_row").alias("place"))


@query("""SELECT DISTINCT dataset_key AS dataset, task_index, 'task ' || task_index AS task FROM range_episodes WHERE dataset_key <> 'ds3'""")
def scan_dataset_tasks(s: Shapes):
    root = range_folders(s)
    return datasets.scan_tasks(s.spark, [f"{root}/ds{i}" for i in range(9)]).select(_name("dataset_path").alias("dataset"), "task_index", "task")


@query(f"""WITH kept AS (SELECT episode_index, CAST({_FILE} AS BIGINT) AS file, length FROM range_episodes WHERE dataset_key = 'ds0' AND floor(episode_index / 8) % 3 <> 1)
SELECT e.episode_index, e.length, e.file, (SELECT count(*) FROM kept) AS total_episodes,
  (SELECT count(*) FROM range_frames WHERE dataset_key = 'ds0' AND CAST({_FILE} AS BIGINT) IN (SELECT file FROM kept)) AS frames_copied FROM kept e""")
def export_folder(s: Shapes):
    """One dataset without its bad episodes: the episode files as they are read back, the claimed total and the frames copied."""
    root, target = range_folders(s), scratch(s)
    marks = s.range_episodes.where("dataset_key = 'ds0' and floor(episode_index / 8) % 3 = 1").select(
        "episode_index", F.lit(" BAD").alias("grade"))
    done = sinks.export_folder(s.spark, f"{root}/ds0", target, ["bad"], marks)
    frames = datasets.scan_dataset_frames(s.spark, [target], ["index"]).count()
    return datasets.scan_episodes(s.spark, [target]).select(
        "episode_index", "length", F.col("data/file_index").alias("file"),
        F.lit(done["total_episodes"]).cast("bigint").alias("total_episodes"), F.lit(frames).cast("bigint").alias("frames_copied"))


# --- recordings ---------------------------------------------------------------------

# a recording is a folder with two files, so three inodes and three blocks: millions at once fill a file system
RECORDINGS_AT_ONCE = 1_000_000


def recording_folders(s: Shapes, recordings: DataFrame) -> str:
    """Recordings with their metacards and first files; every fifth task has a folder more that is no recording."""
    root = scratch(s)
    at = F.concat("cell_task", F.lit("/"), "serial")
    rows = recordings.select(F.explode(F.array(
        F.struct(F.concat(at, F.lit("/metacard.json")).alias("path"), F.col("metacard").alias("value")),
        F.struct(F.concat(at, F.lit("/"), "serial", F.lit("_0.mcap")).alias("path"), F.lit("m").alias("value")))).alias("f")).select("f.*")
    other = recordings.where("item_no % 5 = 0").select(F.concat("cell_task", F.lit("/draft/metacard.json")).alias("path"), F.lit("{}").alias("value")).distinct()
    sinks.write_files(rows.unionByName(other), root)
    return root


def scanned_recordings(s: Shapes) -> DataFrame:
    """All recordings as they are found in folders. So many are written and scanned at a time, and make place for the next."""
    parts = -(-s.recordings.count() // RECORDINGS_AT_ONCE) or 1
    found, root = [], ""
    for part in range(parts):
        if root:
            remove_folders(found[-1].select(F.concat(F.lit(f"{root}/"), "cell_task").alias("folder")), "folder")
            remove_folder(root)
        root = recording_folders(s, s.recordings.where(F.pmod(F.xxhash64("cell_task", "serial"), F.lit(parts)) == part))
        found.append(checkpointed(recordings.scan_recordings(s.spark, [root])))
    return reduce(DataFrame.unionByName, found)


@query("SELECT cell_task, serial, cell_task || '/' || serial AS recording, task_name FROM recordings")
def scan_recordings(s: Shapes):
    return recordings.list_recordings(scanned_recordings(s))


@query(f"{_PROGRESS} SELECT * FROM progress")
def convert_progress_from_folders(s: Shapes):
    """Progress of tasks whose recordings are found on disk and whose outputs are counted by their footers."""
    found, out = scanned_recordings(s), scratch(s)
    done = s.serial_status.where("status = 'converted' and not startswith(cell_task, 'cell004')").select(
        F.concat("cell_task", F.lit("/"), F.format_string(SHARD, F.col("item_no") % 2)).alias("_path"), F.col("item_no").alias("episode_index"))
    sinks.write_shards(done, out, path="_path")
    totals = recordings.raw_totals(found.where("cell_task <> 'cell001/SMALL'"))
    tasks = totals.select("cell_task").unionByName(s.task_counts.select("cell_task"))
    counts = recordings.output_counts(s.spark, out, tasks)
    return conversion.convert_progress(s.task_counts, totals, counts).drop("last_updated")
