"""Queries that reorganize datasets, repair serials and edit tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.operators import episodes as ep
from kinetable.operators import registry, reorganize, serials, stats, tasks
from kinetable.plans.registry import joined, query, r6
from kinetable.plans.shapes import Shapes
from kinetable.sources import sinks

EP = ("dataset_key", "episode_index")


# --- split, delete, sync, merge, reindex ------------------------------------------

@query("""SELECT f.dataset_key, f.episode_index, count(*) AS frames FROM frames f
WHERE f.episode_index IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 60) GROUP BY ALL""")
def semi_select(s: Shapes):
    return reorganize.semi_select(s.frames, _flagged(s)).groupBy(*EP).agg(F.count("*").alias("frames"))


@query("""SELECT f.dataset_key, f.episode_index, count(*) AS frames FROM frames f
WHERE f.episode_index NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 60) GROUP BY ALL""")
def anti_delete(s: Shapes):
    return reorganize.anti_delete(s.frames, _flagged(s)).groupBy(*EP).agg(F.count("*").alias("frames"))


def _flagged(s: Shapes):
    return s.table("events").where("event_type = 'error' and value > 60").select(
        F.concat(F.lit("rig"), F.col("user_id") % 10).alias("dataset_key"),
        F.col("user_id").alias("episode_index"))


def _sync_sides(s: Shapes):
    source = s.episodes.where("grade = 'good'")
    return source, s.episodes.where("length % 4 = 0")


_SYNC = """SELECT e.*, EXISTS (SELECT 1 FROM episodes d WHERE d.length % 4 = 0 AND d.serial = e.serial AND d.serial <> '') AS there
FROM episodes e WHERE e.grade = 'good'"""


@query(f"SELECT dataset_key, episode_index, serial AS \"Serial_number\" FROM ({_SYNC}) WHERE NOT there")
def sync_new_episodes(s: Shapes):
    return reorganize.sync_new_episodes(*_sync_sides(s)).select(*EP, "Serial_number")


@query(f"""SELECT dataset_key, count(*) FILTER (NOT there) AS created, count(*) FILTER (there) AS skipped_duplicates
FROM ({_SYNC}) GROUP BY dataset_key""")
def sync_counts(s: Shapes):
    return reorganize.sync_counts(*_sync_sides(s))


@query("""SELECT cell_name, count(*) AS datasets, count(DISTINCT fps) = 1 AS same_fps, count(DISTINCT robot_type) = 1 AS same_robot,
  count(DISTINCT fps) = 1 AND count(DISTINCT robot_type) = 1 AS compatible FROM catalog GROUP BY cell_name""")
def merge_compat(s: Shapes):
    return reorganize.merge_compat(s.catalog, "cell_name")


@query("""SELECT dataset_key, episode_index AS old_episode_index, row_number() OVER w - 1 AS episode_index,
  CAST(sum(length) OVER w - length AS BIGINT) AS dataset_from_index, CAST(sum(length) OVER w AS BIGINT) AS dataset_to_index,
  (row_number() OVER w - 1) // 20 AS data_chunk, (row_number() OVER w - 1) % 20 AS data_file, (row_number() OVER w - 1) % 20 AS head_file
FROM episodes WHERE length % 3 > 0 WINDOW w AS (PARTITION BY dataset_key ORDER BY episode_index)""")
def reindex_episodes(s: Shapes):
    out = reorganize.reindex_episodes(s.stored_episodes.where("length % 3 > 0"), chunk_size=20)
    return out.select(
        "dataset_key", "old_episode_index", "episode_index", "dataset_from_index", "dataset_to_index",
        F.col("`data/chunk_index`").alias("data_chunk"), F.col("`data/file_index`").alias("data_file"),
        F.col("`videos/observation.images.cam_head/file_index`").alias("head_file"))


@query("""
WITH n AS (SELECT user_id, count(*) AS length FROM events WHERE user_id % 3 > 0 GROUP BY user_id),
e AS (SELECT *, row_number() OVER w - 1 AS new_id, sum(length) OVER w - length AS start FROM n
  WINDOW w AS (PARTITION BY user_id % 10 ORDER BY user_id))
SELECT 'rig' || (user_id % 10) AS dataset_key, new_id AS episode_index,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame_index,
  CAST(start + row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS index
FROM events JOIN e USING (user_id)""")
def reindex_frames(s: Shapes):
    kept = s.frames.where("episode_index % 3 > 0").groupBy(*EP).agg(F.count("*").alias("length"))
    return reorganize.reindex_frames(s.frames, reorganize.reindex_episodes(kept)).select(
        *EP, "frame_index", "index")


_MERGED_TASKS = """
WITH src AS (SELECT c.dataset_key, c.robot_type AS target, row_number() OVER (PARTITION BY robot_type ORDER BY dataset_key) - 1 AS source_order FROM catalog c),
texts AS (SELECT target, task, min(source_order * 100 + task_index) AS pos FROM tasks t JOIN src ON src.dataset_key = t.dataset_key GROUP BY ALL),
numbered AS (SELECT target, task, row_number() OVER (PARTITION BY target ORDER BY pos) - 1 AS new_task_index FROM texts)"""


def _targets(s: Shapes):
    from kinetable.operators.ordered import row_position

    named = s.catalog.select("dataset_key", F.col("robot_type").alias("target"))
    return row_position(named, keys=["target"], order=["dataset_key"],
                        block=F.substring("dataset_key", 1, 4), out="source_order")


@query(f"""{_MERGED_TASKS} SELECT src.target, t.dataset_key, t.task_index, t.task, n.new_task_index
FROM tasks t JOIN src ON src.dataset_key = t.dataset_key JOIN numbered n ON n.target = src.target AND n.task = t.task""")
def merged_tasks(s: Shapes):
    return reorganize.merged_tasks(s.tasks, _targets(s))


@query(f"""{_MERGED_TASKS} SELECT src.target, e.dataset_key AS source_dataset, e.episode_index AS old_episode_index,
  row_number() OVER w - 1 AS episode_index, CAST(sum(e.length) OVER w - e.length AS BIGINT) AS dataset_from_index, n.new_task_index AS task_index
FROM episodes e JOIN src ON src.dataset_key = e.dataset_key JOIN numbered n ON n.target = src.target AND n.task = e.lang
WINDOW w AS (PARTITION BY src.target ORDER BY source_order, e.episode_index)""")
def merge_datasets(s: Shapes):
    rows = s.episodes.select(*EP, "length", "task_index")
    return reorganize.merge_datasets(rows, s.tasks, _targets(s)).select(
        "target", "source_dataset", "old_episode_index", "episode_index", "dataset_from_index", "task_index")


@query("""SELECT DISTINCT dataset_key, 'data' AS kind, NULL AS camera, chunk_index AS chunk, file_index AS file FROM episodes
UNION ALL SELECT DISTINCT dataset_key, 'video', 'observation.images.cam_head', episode_index // 100, episode_index % 100 FROM episodes WHERE episode_index % 4 <> 0
UNION ALL SELECT DISTINCT dataset_key, 'video', 'observation.images.wrist', episode_index % 5, 0 FROM episodes WHERE episode_index % 3 = 0""")
def referenced_files(s: Shapes):
    return reorganize.referenced_files(ep.episode_file_location(s.stored_episodes))


@query("""
WITH w AS (SELECT e.dataset_key, e.episode_index, c.camera, e.chunk_index, e.file_index,
  CASE WHEN c.camera LIKE '%head' THEN episode_index % 4 <> 0 ELSE episode_index % 3 = 0 END AS here,
  CASE WHEN c.camera LIKE '%head' THEN episode_index // 100 ELSE episode_index % 5 END AS chunk,
  CASE WHEN c.camera LIKE '%head' THEN episode_index % 100 ELSE 0 END AS file,
  CASE WHEN c.camera LIKE '%head' AND episode_index % 4 <> 0 THEN CAST(episode_index % 10 AS DOUBLE) ELSE 0 END AS a,
  CASE WHEN c.camera LIKE '%head' AND episode_index % 4 <> 0 AND episode_index % 6 > 1 THEN CAST(episode_index % 7 AS DOUBLE) END AS z
  FROM episodes e, (VALUES ('observation.images.cam_head'), ('observation.images.wrist')) c(camera))
SELECT dataset_key, episode_index, camera, replace(camera, 'observation.images.', '') AS label,
  CASE WHEN here THEN printf('videos/%s/chunk-%03d/file-%03d.mp4', camera, chunk, file)
    ELSE printf('videos/%s/chunk-%03d/file-%03d.mp4', camera, chunk_index, file_index) END AS path,
  a AS from_timestamp, CASE WHEN z > a THEN z END AS to_timestamp FROM w WHERE episode_index % 100 <> 7 OR NOT (here AND camera LIKE '%head')""")
def video_window(s: Shapes):
    locations = ep.episode_file_location(s.stored_episodes)
    cameras = s.catalog.select("dataset_key", F.explode(F.array(
        F.lit("observation.images.cam_head"), F.lit("observation.images.wrist"))).alias("camera"))
    everything = reorganize.video_window(locations, cameras)
    own = F.try_element_at("videos", F.lit("observation.images.cam_head"))
    lost = locations.where("episode_index % 100 = 7").where(own.isNotNull()).select(
        *EP, F.lit("observation.images.cam_head").alias("camera"))
    files = everything.join(lost, [*EP, "camera"], "left_anti").select("dataset_key", "path").distinct()
    kept = reorganize.video_window(locations, cameras, files)
    return kept.select(*EP, "camera", "label", "path", "from_timestamp", "to_timestamp")


# --- sinks as tables ---------------------------------------------------------------

@query("""SELECT e.dataset_key, e.episode_index, CASE WHEN i.episode_index IS NOT NULL THEN i.grade ELSE e.grade END AS grade,
  array_to_string(CASE WHEN i.episode_index IS NOT NULL THEN i.tags ELSE e.tags END, '|') AS tags
FROM episodes e LEFT JOIN by_index i ON i.dataset_key = e.dataset_key AND i.episode_index = e.episode_index""")
def sink_annotated(s: Shapes):
    out = sinks.annotated_episodes(s.episodes, s.by_index, *EP)
    return out.select(*EP, "grade", joined("tags").alias("tags"))


@query("SELECT dataset_key, episode_index, CAST(7 AS BIGINT) AS batch_no, true AS checked FROM episodes")
def sink_add_column(s: Shapes):
    rows = sinks.add_column(s.episodes.select(*EP), "batch_no", "int64", 7)
    return sinks.add_column(rows, "checked", "bool", True)


# --- serials ---------------------------------------------------------------------------

@query("""SELECT dataset_key, serial AS serial_number, kept AS kept_episode, episode_index AS dropped_episode FROM (
  SELECT *, min(episode_index) OVER (PARTITION BY dataset_key, serial) AS kept FROM episodes WHERE serial <> '')
WHERE episode_index <> kept""")
def duplicate_serials(s: Shapes):
    return serials.duplicate_serials(s.episodes)


@query("""
WITH g AS (SELECT dataset_key, serial, count(*) AS n FROM episodes WHERE serial <> '' GROUP BY ALL)
SELECT e.dataset_key, e.rows, e.graded_rows, count(g.serial) AS unique_serials, count(*) FILTER (g.n > 1) AS duplicate_groups,
  CAST(coalesce(sum(g.n) FILTER (g.n > 1), 0) AS BIGINT) AS duplicate_episodes
FROM (SELECT dataset_key, count(*) AS rows, count(*) FILTER (grade <> '') AS graded_rows FROM episodes GROUP BY dataset_key) e
LEFT JOIN g ON g.dataset_key = e.dataset_key GROUP BY ALL""")
def serial_summary(s: Shapes):
    return serials.serial_summary(s.episodes)


# the k-th free number by listing candidates and striking out the taken ones
_RENAMED = """
WITH g AS (SELECT dataset_key, serial, count(*) AS n FROM episodes WHERE serial <> '' GROUP BY ALL),
free AS (SELECT dataset_key, serial, c, row_number() OVER (PARTITION BY dataset_key, serial ORDER BY c) AS k FROM (
    SELECT dataset_key, serial, unnest(range(1, n + 40)) AS c FROM g WHERE n > 1) x
  WHERE NOT EXISTS (SELECT 1 FROM g u WHERE u.n = 1 AND u.dataset_key = x.dataset_key AND u.serial = x.serial || '_' || x.c)),
renamed AS (SELECT e.*, CASE WHEN f.c IS NOT NULL THEN e.serial || '_' || f.c ELSE e.serial END AS new_serial FROM (
    SELECT *, row_number() OVER (PARTITION BY dataset_key, serial ORDER BY episode_index) AS k FROM episodes) e
  LEFT JOIN free f ON f.dataset_key = e.dataset_key AND f.serial = e.serial AND f.k = e.k)"""


@query(f"{_RENAMED} SELECT dataset_key, episode_index, serial AS \"Serial_number\", new_serial FROM renamed")
def unique_serials(s: Shapes):
    return serials.unique_serials(s.episodes.select(*EP, "Serial_number"))


_HEIRS = f"""{_RENAMED},
heirs AS (SELECT r.*, a.reason AS old_reason, row_number() OVER (PARTITION BY r.dataset_key, r.serial,
    a.grade = r.grade AND a.reason <> '' ORDER BY r.episode_index) = 1 AND a.grade = r.grade AND a.reason <> '' AS takes
  FROM renamed r LEFT JOIN annotations a ON a.serial_number = r.serial WHERE r.serial <> '' AND r.grade <> '')"""


@query(f"""{_HEIRS} SELECT dataset_key, episode_index, new_serial AS serial_number, grade,
  CASE WHEN takes THEN old_reason END AS reason FROM heirs""")
def reason_reattach(s: Shapes):
    renamed = serials.unique_serials(s.episodes)
    return serials.reason_reattach(renamed, s.annotations).select(*EP, "serial_number", "grade", "reason")


@query(f"""{_HEIRS}, owned AS (SELECT b.dataset_key, b.serial_number FROM bridge b JOIN annotations a
    ON a.serial_number = b.serial_number WHERE a.reason <> '')
SELECT o.dataset_key, count(*) FILTER (h.serial IS NOT NULL) AS recovered, count(*) FILTER (h.serial IS NULL) AS orphaned
FROM owned o LEFT JOIN (SELECT DISTINCT dataset_key, serial FROM heirs WHERE takes) h
  ON h.dataset_key = o.dataset_key AND h.serial = o.serial_number GROUP BY o.dataset_key""")
def reattach_counts(s: Shapes):
    new = serials.reason_reattach(serials.unique_serials(s.episodes), s.annotations)
    return serials.reattach_counts(new, s.annotations, s.bridge)


@query("""
WITH wanted AS (SELECT DISTINCT 'src' || (episode_index % 6) AS dataset_key, serial AS serial_number FROM episodes WHERE serial <> '')
SELECT dataset_key, serial_number FROM wanted w WHERE
  EXISTS (SELECT 1 FROM bridge b WHERE b.serial_number = w.serial_number AND b.dataset_key <> w.dataset_key)
  OR (EXISTS (SELECT 1 FROM annotations a WHERE a.serial_number = w.serial_number)
    AND NOT EXISTS (SELECT 1 FROM bridge b WHERE b.serial_number = w.serial_number AND b.dataset_key = w.dataset_key))""")
def serial_collisions(s: Shapes):
    wanted = s.episodes.where("Serial_number <> ''").select(
        F.concat(F.lit("src"), F.col("episode_index") % 6).alias("dataset_key"),
        F.col("Serial_number").alias("serial_number"))
    return serials.serial_collisions(wanted, s.bridge, s.annotations)


# --- tasks ------------------------------------------------------------------------------

@query("""SELECT dataset_key, task_index, CASE WHEN task_index = 2 THEN 'stack cups' ELSE task END AS task FROM tasks""")
def update_task(s: Shapes):
    return tasks.update_task(s.tasks, 2, "stack cups")


@query("""SELECT t.dataset_key, t.task_index, t.task, (SELECT count(*) FROM episodes e
  WHERE e.dataset_key = t.dataset_key AND e.task_index = t.task_index) AS episodes FROM tasks t""")
def affected_episodes(s: Shapes):
    return tasks.affected_episodes(s.episodes, s.tasks)


@query("""SELECT t.dataset_key, t.task_index, t.task, (SELECT count(*) FROM episodes e
  WHERE e.dataset_key = t.dataset_key AND e.lang = t.task) AS episodes FROM tasks t""")
def affected_by_task_list(s: Shapes):
    return tasks.affected_episodes(s.episodes.drop("task_index"), s.tasks)


_REQUESTS = """
SELECT dataset_key, episode_index, CASE WHEN episode_index % 4 = 0 THEN 'shared' ELSE 'episode' END AS mode,
  CASE episode_index % 7 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'fold towel' WHEN 3 THEN lang ELSE 'wipe ' || lang END AS instruction
FROM episodes WHERE length % 2 = 0"""
_PREVIEW = f"""
WITH requests AS ({_REQUESTS}),
sound AS (SELECT dataset_key, count(*) = max(task_index) + 1 AND min(task_index) = 0 AS contiguous FROM tasks GROUP BY dataset_key),
rows AS (SELECT r.*, e.task_index AS current_task_index, e.lang AS current_text, t.task_index AS target_task_index, s.contiguous,
    (SELECT count(*) FROM episodes x WHERE x.dataset_key = r.dataset_key AND x.task_index = e.task_index) AS users
  FROM requests r JOIN episodes e ON e.dataset_key = r.dataset_key AND e.episode_index = r.episode_index
  JOIN sound s ON s.dataset_key = r.dataset_key
  LEFT JOIN tasks t ON t.dataset_key = r.dataset_key AND t.task = r.instruction),
judged AS (SELECT *, CASE WHEN NOT contiguous THEN 'task_index_invalid'
  WHEN mode = 'shared' AND instruction <> current_text AND target_task_index IS NOT NULL THEN 'instruction_duplicate' END AS problem FROM rows),
preview AS (SELECT dataset_key, episode_index, mode, instruction, current_task_index,
  CASE WHEN problem IS NOT NULL THEN NULL WHEN mode = 'shared' THEN 'shared' WHEN instruction = current_text THEN 'no_op'
    WHEN target_task_index IS NOT NULL THEN 'reuse' ELSE 'create' END AS action,
  target_task_index, CASE WHEN mode = 'shared' THEN users ELSE 1 END AS affected, problem FROM judged)"""


def _requests(s: Shapes):
    i, lang = F.col("episode_index"), F.col("lang")
    return s.episodes.where("length % 2 = 0").select(
        *EP, F.when(i % 4 == 0, "shared").otherwise("episode").alias("mode"),
        F.when(i % 7 == 0, "en").when(i % 7 == 1, "fr").when(i % 7 == 2, "fold towel").when(
            i % 7 == 3, lang).otherwise(F.concat(F.lit("wipe "), lang)).alias("instruction"))


def _preview(s: Shapes):
    return tasks.instruction_preview(_requests(s), s.episodes, s.tasks)


@query(f"{_PREVIEW} SELECT * FROM preview")
def instruction_preview(s: Shapes):
    return _preview(s)


@query(f"""{_PREVIEW} SELECT dataset_key, episode_index, sha256(CAST(to_json({{'action': action, 'affected': affected,
  'current_task_index': current_task_index, 'dataset_key': dataset_key, 'episode_index': episode_index, 'instruction': instruction,
  'mode': mode, 'target_task_index': target_task_index}}) AS VARCHAR)) AS fingerprint FROM preview""")
def preview_fingerprint(s: Shapes):
    return tasks.preview_fingerprint(_preview(s)).select(*EP, "fingerprint")


_APPLIED = f"""{_PREVIEW},
fresh AS (SELECT dataset_key, instruction AS task, row_number() OVER (PARTITION BY dataset_key ORDER BY instruction) - 1
    + (SELECT count(*) FROM tasks t WHERE t.dataset_key = p.dataset_key) AS task_index
  FROM (SELECT DISTINCT dataset_key, instruction FROM preview WHERE action = 'create') p),
pool AS (SELECT dataset_key, task_index, task FROM tasks UNION ALL SELECT dataset_key, task_index, task FROM fresh),
moved AS (SELECT e.dataset_key, e.episode_index, coalesce(q.task_index, e.task_index) AS task_index FROM episodes e
  LEFT JOIN preview p ON p.dataset_key = e.dataset_key AND p.episode_index = e.episode_index AND p.action IN ('reuse', 'create')
  LEFT JOIN pool q ON q.dataset_key = e.dataset_key AND q.task = p.instruction),
used AS (SELECT dataset_key, task_index, row_number() OVER (PARTITION BY dataset_key ORDER BY task_index) - 1 AS new_index
  FROM (SELECT DISTINCT dataset_key, task_index FROM moved))"""


def _applied(s: Shapes):
    rows = s.episodes.select(*EP, "task_index")
    return tasks.apply_episode_instructions(s.tasks, rows, rows, _preview(s))


@query(f"""{_APPLIED} SELECT m.dataset_key, m.episode_index, u.new_index AS task_index FROM moved m
JOIN used u ON u.dataset_key = m.dataset_key AND u.task_index = m.task_index""")
def instruction_apply(s: Shapes):
    return _applied(s)[1]


@query(f"""{_APPLIED} SELECT p.dataset_key, u.new_index AS task_index, p.task FROM pool p
JOIN used u ON u.dataset_key = p.dataset_key AND u.task_index = p.task_index""")
def instruction_apply_tasks(s: Shapes):
    return _applied(s)[0]


@query(f"""{_PREVIEW}, renames AS (SELECT dataset_key, current_task_index AS task_index, min(instruction) AS task FROM preview
  WHERE action = 'shared' GROUP BY ALL HAVING min(instruction) = max(instruction))
SELECT t.dataset_key, t.task_index, coalesce(r.task, t.task) AS task FROM tasks t
LEFT JOIN renames r ON r.dataset_key = t.dataset_key AND r.task_index = t.task_index""")
def instruction_shared_rename(s: Shapes):
    return tasks.apply_shared_rename(s.tasks, s.episodes, _preview(s))[0]


@query("""
WITH kept AS (SELECT * FROM episodes WHERE length % 5 = 0),
used AS (SELECT dataset_key, task_index, row_number() OVER (PARTITION BY dataset_key ORDER BY task_index) - 1 AS new_index
  FROM (SELECT DISTINCT dataset_key, task_index FROM kept))
SELECT e.dataset_key, e.episode_index, coalesce(u.new_index, e.task_index) AS task_index FROM episodes e
LEFT JOIN used u ON u.dataset_key = e.dataset_key AND u.task_index = e.task_index""")
def dense_remap(s: Shapes):
    kept = s.episodes.where("length % 5 = 0").select(*EP, "task_index")
    return tasks.dense_remap(s.tasks, kept, s.episodes.select(*EP, "task_index"))[2]


# --- registry, jobs, workers -----------------------------------------------------------

@query("""SELECT d.dataset_key, d.name, d.total_episodes, coalesce(s.graded_count, 0) AS graded_count, coalesce(s.good_count, 0) AS good_count,
  coalesce(s.normal_count, 0) AS normal_count, coalesce(s.bad_count, 0) AS bad_count
FROM registry d LEFT JOIN registry_stats s ON s.dataset_key = d.dataset_key""")
def stats_left_join(s: Shapes):
    return stats.with_stats(s.registry, s.registry_stats).select(
        "dataset_key", "name", "total_episodes", "graded_count", "good_count", "normal_count", "bad_count")


@query("""SELECT d.name, d.path, d.total_episodes, coalesce(s.good_count, 0) AS good_count FROM registry d
LEFT JOIN registry_stats s ON s.dataset_key = d.dataset_key
WHERE robot_type = 'BUILDING' AND total_episodes >= 5
  AND CASE WHEN s.graded_count > 0 THEN s.good_count / s.graded_count ELSE 0 END >= 0.4""")
def registry_search(s: Shapes):
    return stats.registry_search(
        s.registry, s.registry_stats, robot_type="BUILDING", min_episodes=5, min_good_ratio=0.4
    ).select("name", "path", "total_episodes", "good_count")


def _live(s: Shapes):
    """What a scan of the even nations finds: most datasets, some changed, some new."""
    k = F.col("dataset_key").cast("bigint")
    old = s.registry.where(k % 9 != 0)
    return old.withColumn("info_mtime", F.when(k % 10 == 0, F.col("info_mtime") + 1).otherwise(
        F.col("info_mtime"))).withColumn("path", F.when(k % 50 == 1, F.concat("path", F.lit("/new"))).otherwise(
        F.col("path")))


_LIVE = """
WITH live AS (SELECT * REPLACE (CASE WHEN dataset_key::BIGINT % 10 = 0 THEN info_mtime + 1 ELSE info_mtime END AS info_mtime,
    CASE WHEN dataset_key::BIGINT % 50 = 1 THEN path || '/new' ELSE path END AS path)
  FROM registry WHERE dataset_key::BIGINT % 9 <> 0)"""


@query(f"""{_LIVE} SELECT dataset_key, path FROM registry r WHERE path IN (SELECT path FROM live)
  OR cell_name NOT IN (SELECT n_name FROM nation WHERE n_nationkey % 2 = 0)""")
def prune_vanished(s: Shapes):
    cells = s.table("nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("cell_name"))
    return registry.prune_vanished(s.registry, _live(s), cells).select("dataset_key", "path")


@query(f"""{_LIVE} SELECT l.path, l.info_mtime FROM live l LEFT JOIN registry r ON r.path = l.path
WHERE r.path IS NULL OR r.info_mtime <> l.info_mtime""")
def changed_datasets(s: Shapes):
    return registry.changed_datasets(_live(s), s.registry).select("path", "info_mtime")


@query("""SELECT id, type, status, dataset_id FROM jobs WHERE type = 'merge' AND status = 'queued'
AND updated_at >= TIMESTAMP '1997-06-01' ORDER BY id DESC""")
def list_jobs(s: Shapes):
    out = registry.list_jobs(s.jobs, type="merge", status="queued", since="1997-06-01 00:00:00")
    return out.select("id", "type", "status",
                      F.get_json_object("payload", "$.dataset_id").cast("bigint").alias("dataset_id"))


@query("""
WITH beats AS (SELECT user_id AS worker_id, max(ts) AS last_beat_at FROM events WHERE event_type = 'click' AND user_id % 4 <> 0 GROUP BY user_id)
SELECT CAST(s_suppkey AS BIGINT) AS worker_id, CAST(date_trunc('second', last_beat_at) AS VARCHAR) AS last_beat_at,
  coalesce(last_beat_at < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 86400 SECOND, true) AS stale
FROM supplier LEFT JOIN beats ON worker_id = s_suppkey""")
def worker_status(s: Shapes):
    controls = s.table("supplier").select(F.col("s_suppkey").alias("worker_id"))
    beats = s.table("events").where("event_type = 'click' and user_id % 4 <> 0").groupBy(
        F.col("user_id").alias("worker_id")).agg(F.max("ts").cast("timestamp").alias("last_beat_at"))
    out = registry.worker_status(controls, beats, F.to_timestamp(F.lit("2024-01-30 12:00:00")), 86_400)
    return out.withColumn("last_beat_at", F.date_trunc("second", "last_beat_at").cast("string"))
