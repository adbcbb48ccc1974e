"""Validation queries: eight datasets derived from the orders, most of them broken in one way."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.operators import validation as val
from kinetable.plans.registry import query
from kinetable.plans.shapes import Shapes

TEMPLATE = "videos/{video_key}/chunk-{chunk_index:03d}/file-{file_index:03d}.mp4"
CAMERA = "observation.images.cam"


def tables(s: Shapes) -> val.DatasetTables:
    """ds1 claims a frame too many, ds2 lacks the frame rate, ds3 the task file, ds4 has an
    empty range, ds5 a foreign task, ds6 a lost and an empty video, ds7 a foreign episode."""
    k = F.col("dataset_key")
    per = s.range_episodes.groupBy("dataset_key").agg(
        F.count("*").alias("total_episodes"), F.sum("length").alias("n"))
    keys = ["features", "fps", "robot_type", "total_episodes", "total_frames"]
    texts = lambda names: F.array(*[F.lit(n) for n in names])
    feature = lambda dtype: F.struct(
        F.lit(dtype).alias("dtype"), F.array(F.lit(3).cast("bigint")).alias("shape"),
        F.lit(None).cast("array<string>").alias("names"))
    catalog = per.select(
        "dataset_key", F.when(k == "ds2", texts([c for c in keys if c != "fps"])).otherwise(texts(keys)).alias("info_keys"),
        F.lit(30.0).alias("fps"), "total_episodes",
        (F.col("n") + F.when(k == "ds1", 1).otherwise(0)).alias("total_frames"),
        F.create_map(F.lit(CAMERA), feature("video"), F.lit("action"), feature("float32")).alias("features"),
        F.lit(TEMPLATE).alias("video_path"))
    names = s.range_episodes.columns
    shard = lambda kind, path, columns: F.struct(
        F.lit(kind).alias("kind"), F.lit(path).alias("path"), texts(columns).alias("columns"))
    shards = per.select("dataset_key", F.inline(F.array(
        shard("tasks", "meta/tasks.parquet", ["task_index", "task"]),
        shard("episodes", "meta/episodes/chunk-000/file-000.parquet", names),
        shard("data", "data/chunk-000/file-000.parquet",
              ["episode_index", "frame_index", "index", "task_index", "timestamp"]))))
    fixed = per.select("dataset_key", F.explode(texts([
        "meta/info.json", "meta/tasks.parquet", "meta/episodes/chunk-000/file-000.parquet",
        "data/chunk-000/file-000.parquet"])).alias("path")).where(
        ~((k == "ds3") & (F.col("path") == "meta/tasks.parquet"))).withColumn("size", F.lit(10))
    chunk, file = F.col("`data/chunk_index`"), F.col("`data/file_index`")
    videos = s.range_episodes.select(
        "dataset_key", chunk.alias("c"), file.alias("f")).distinct().where(
        "not (dataset_key = 'ds6' and c = 0 and f = 3)").select(
        "dataset_key", F.format_string(f"videos/{CAMERA}/chunk-%03d/file-%03d.mp4", "c", "f").alias("path"),
        F.when((k == "ds6") & (F.col("f") == 4), 0).otherwise(10).alias("size"))
    tasks = s.range_episodes.select(
        "dataset_key", "task_index", F.concat(F.lit("task "), "task_index").alias("task")).distinct()
    episodes = s.range_episodes.withColumn("dataset_to_index", F.when(
        (k == "ds4") & (F.floor(F.col("episode_index") / 8) == 5), F.col("dataset_from_index")
    ).otherwise(F.col("dataset_to_index")))
    frames = s.range_frames.withColumns({
        "task_index": F.when((k == "ds5") & (F.col("index") == 17), 9).otherwise(F.col("task_index")),
        "episode_index": F.when((k == "ds7") & (F.col("index") == 23), -1).otherwise(F.col("episode_index"))})
    return val.DatasetTables(catalog, shards, fixed.unionByName(videos), tasks, episodes, frames)


_BASE = """
WITH eps AS (SELECT * REPLACE (CASE WHEN dataset_key = 'ds4' AND episode_index // 8 = 5 THEN dataset_from_index ELSE dataset_to_index END AS dataset_to_index)
  FROM range_episodes),
frs AS (SELECT dataset_key, index, frame_index, CASE WHEN dataset_key = 'ds5' AND index = 17 THEN 9 ELSE task_index END AS task_index,
    CASE WHEN dataset_key = 'ds7' AND index = 23 THEN -1 ELSE episode_index END AS episode_index FROM range_frames),
counts AS (SELECT dataset_key, count(*) AS data_rows FROM frs GROUP BY dataset_key),
tiled AS (SELECT dataset_key, count(*) FILTER (dataset_from_index < 0 OR dataset_to_index <= dataset_from_index) AS broken,
    count(*) FILTER (dataset_from_index <> prev) AS gaps, max(dataset_to_index) AS range_end FROM (
    SELECT *, lag(dataset_to_index, 1, 0) OVER (PARTITION BY dataset_key ORDER BY dataset_from_index, dataset_to_index) AS prev FROM eps) GROUP BY dataset_key)"""
_OWNED = f"""{_BASE},
owned AS (SELECT f.*, e.episode_index AS owner_episode, e.task_index AS owner_task FROM frs f ASOF LEFT JOIN eps e
  ON e.dataset_key = f.dataset_key AND f.index >= e.dataset_from_index),
inside AS (SELECT o.dataset_key, o.index, o.episode_index, o.task_index, CASE WHEN o.index < e.dataset_to_index THEN o.owner_episode END AS owner_episode, o.owner_task
  FROM owned o LEFT JOIN eps e ON e.dataset_key = o.dataset_key AND e.episode_index = o.owner_episode),
refs AS (SELECT dataset_key, count(*) AS frames, count(*) FILTER (owner_episode IS NULL) AS outside,
    count(*) FILTER (owner_episode <> episode_index) AS wrong_episode,
    count(*) FILTER (owner_episode = episode_index AND owner_task <> task_index) AS wrong_task FROM inside GROUP BY dataset_key)"""


@query(f"{_BASE} SELECT t.dataset_key, broken, gaps, range_end, data_rows FROM tiled t JOIN counts c ON c.dataset_key = t.dataset_key")
def range_tiling(s: Shapes):
    t = tables(s)
    rows = t.frames.groupBy("dataset_key").agg(F.count("*").alias("data_rows"))
    return val.range_tiling(t.episodes, rows)


@query("""SELECT dataset_key, count(*) AS frames, count(*) - count(DISTINCT index) AS repeated, min(index) AS first, max(index) AS last,
  list_sort(list(index)) = range(count(*)) AS contiguous FROM (
    SELECT dataset_key, index FROM range_frames WHERE dataset_key <> 'ds3' OR index <> 40) GROUP BY dataset_key""")
def index_contiguity(s: Shapes):
    return val.index_contiguity(s.range_frames.where("dataset_key <> 'ds3' or index <> 40"))


@query(f"{_OWNED} SELECT dataset_key, index, episode_index, owner_episode FROM inside")
def frame_episode_interval_join(s: Shapes):
    t = tables(s)
    return val.frame_owner(t.frames, t.episodes).select("dataset_key", "index", "episode_index", "owner_episode")


@query(f"{_OWNED} SELECT * FROM refs")
def frame_references(s: Shapes):
    t = tables(s)
    return val.frame_references(t.frames, t.episodes, val.episode_task_sets(t.episodes, t.tasks))


@query("""SELECT e.dataset_key, e.episode_index, CASE WHEN e.lang <> 'es' THEN e.task_index END AS task_index, e.lang AS task FROM episodes e""")
def episode_task_sets(s: Shapes):
    return val.episode_task_sets(s.episodes.drop("task_index"), s.tasks.where("task <> 'es'"))


@query("""
WITH ids AS (SELECT dataset_key, task_index FROM tasks WHERE dataset_key <> 'src2' OR task_index <> 1),
used AS (SELECT DISTINCT dataset_key, task_index FROM episodes WHERE dataset_key <> 'src3' OR task_index <> 2)
SELECT i.dataset_key, count(*) AS task_count, list_sort(list(i.task_index)) = range(count(*)) AS dense,
  count(*) FILTER (u.task_index IS NULL) AS unused,
  (SELECT count(*) FROM used x WHERE x.dataset_key = i.dataset_key AND NOT EXISTS (SELECT 1 FROM ids y WHERE y.dataset_key = x.dataset_key AND y.task_index = x.task_index)) AS unlisted,
  list_sort(list(i.task_index)) = range(count(*)) AND count(*) FILTER (u.task_index IS NULL) = 0
    AND NOT EXISTS (SELECT 1 FROM used x WHERE x.dataset_key = i.dataset_key AND NOT EXISTS (SELECT 1 FROM ids y WHERE y.dataset_key = x.dataset_key AND y.task_index = x.task_index)) AS passed
FROM ids i LEFT JOIN used u ON u.dataset_key = i.dataset_key AND u.task_index = i.task_index GROUP BY i.dataset_key""")
def task_set_check(s: Shapes):
    return val.task_set_check(
        s.tasks.where("dataset_key <> 'src2' or task_index <> 1"),
        s.episodes.where("dataset_key <> 'src3' or task_index <> 2"))


@query(f"SELECT DISTINCT dataset_key, printf('videos/{CAMERA}/chunk-%03d/file-%03d.mp4', chunk_index, file_index) AS path FROM range_episodes")
def expected_video_paths(s: Shapes):
    t = tables(s)
    return val.expected_video_paths(t.episodes, t.catalog)


@query(f"""SELECT DISTINCT dataset_key, printf('videos/{CAMERA}/chunk-%03d/file-%03d.mp4', chunk_index, file_index) AS path,
  CASE WHEN file_index = 3 THEN 'missing' ELSE 'empty' END AS problem FROM range_episodes
WHERE dataset_key = 'ds6' AND (file_index = 4 OR (file_index = 3 AND chunk_index = 0))""")
def expected_vs_actual_files(s: Shapes):
    t = tables(s)
    return val.missing_videos(val.expected_video_paths(t.episodes, t.catalog), t.files)


_FACTS = f"""{_OWNED},
facts AS (SELECT c.dataset_key, n.episodes, c.data_rows, c.data_rows + CASE WHEN c.dataset_key = 'ds1' THEN 1 ELSE 0 END AS claimed,
    t.broken, t.gaps, t.range_end, r.outside, r.wrong_episode, r.wrong_task
  FROM counts c JOIN tiled t USING (dataset_key) JOIN refs r USING (dataset_key)
  JOIN (SELECT dataset_key, count(*) AS episodes FROM eps GROUP BY dataset_key) n USING (dataset_key)),
quick AS (SELECT *, CASE WHEN dataset_key = 'ds3' THEN 'missing required file meta/tasks.parquet'
  WHEN dataset_key = 'ds2' THEN 'missing info.json keys fps'
  WHEN data_rows <> claimed THEN 'info total_frames=' || claimed || ' but data parquet has ' || data_rows || ' rows'
  WHEN broken > 0 THEN 'invalid episode index ranges' WHEN gaps > 0 THEN 'data rows ' || data_rows || ' do not match episode ranges'
  WHEN range_end <> data_rows THEN 'data rows ' || data_rows || ' do not match episode range end ' || range_end END AS problem FROM facts)"""


@query(f"""{_FACTS} SELECT dataset_key, CASE WHEN problem IS NULL THEN 'passed' ELSE 'failed' END AS status,
  CASE WHEN problem IS NULL THEN 'Quick passed: ' || episodes || ' episodes, 0 warnings' ELSE 'Quick failed: ' || problem END AS summary FROM quick""")
def quick_validate(s: Shapes):
    return val.quick_validate(tables(s))


@query(f"""{_FACTS}, deep AS (SELECT *, CASE WHEN problem IS NOT NULL THEN problem WHEN outside > 0 THEN 'data index reference mismatch'
  WHEN wrong_episode > 0 THEN 'data episode reference mismatch' WHEN wrong_task > 0 THEN 'data task reference mismatch'
  WHEN dataset_key = 'ds6' THEN 'missing video file videos/{CAMERA}/chunk-000/file-003.mp4' END AS issue FROM quick)
SELECT dataset_key, CASE WHEN issue IS NULL THEN 'partial' ELSE 'failed' END AS status,
  CASE WHEN issue IS NULL THEN 'Full partial: dataset OK, official loader skipped' ELSE 'Full failed: ' || issue END AS summary FROM deep""")
def full_validate(s: Shapes):
    return val.full_validate(tables(s))


@query(f"""{_FACTS} SELECT dataset_key, 21::BIGINT AS rules, CASE WHEN dataset_key = 'ds4' THEN 2::BIGINT + CASE WHEN range_end <> data_rows THEN 1 ELSE 0 END
  WHEN problem IS NULL THEN 0 ELSE 1 END AS failed FROM quick""")
def quick_rules(s: Shapes):
    return val.quick_rules(tables(s)).groupBy("dataset_key").agg(
        F.count("*").alias("rules"), F.count_if(~F.col("passed")).alias("failed"))
