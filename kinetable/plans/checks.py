"""The same views in SQL, for the independent checks of the registered queries."""

from __future__ import annotations

import re

_ID_SERIAL = "'202401' || printf('%02d', 1 + ({0}) % 28) || '_' || printf('%06d', {0})"


def _serial(doc: str) -> str:
    turn = f"(({doc} // 20) % 7)"
    return f"""CASE WHEN {doc} % 17 = 5 THEN NULL WHEN {doc} % 19 = 4 THEN ''
      WHEN {turn} IN (1, 2) THEN {_ID_SERIAL.format(f'({doc} - 20 * {turn})')}
      WHEN {turn} = 3 AND {doc} % 3 = 0 THEN {_ID_SERIAL.format(f'({doc} - 60)')} || '_2'
      ELSE {_ID_SERIAL.format(doc)} END"""


VIEWS: dict[str, str] = {
    "episodes": f"""
SELECT d.source AS dataset_key, d.doc_id AS episode_index, d.n_chars AS length,
  d.doc_id % 5 AS dataset_from_index, d.doc_id % 5 + d.n_chars - d.doc_id % 2 AS dataset_to_index,
  CAST(CASE d.lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'es' THEN 2 WHEN 'fr' THEN 3 ELSE 4 END AS BIGINT)
    AS task_index, d.lang, d.doc_id // 1000 AS chunk_index, d.doc_id % 1000 AS file_index,
  {_serial('d.doc_id')} AS serial,
  CASE WHEN d.doc_id % 11 = 0 THEN ' GOOD ' WHEN d.doc_id % 13 = 0 THEN 'undefined'
    WHEN d.doc_id % 29 = 0 THEN '   ' WHEN l.quality = 0 THEN 'bad' WHEN l.toxic = 1 THEN 'normal'
    WHEN l.quality = 1 THEN 'good' END AS grade,
  CASE WHEN d.doc_id % 31 = 0 THEN ['(no tags)'] WHEN d.n_chars % 5 = 0 THEN NULL
    WHEN d.n_chars % 5 = 1 THEN CAST([] AS VARCHAR[]) WHEN d.n_chars % 5 = 2 THEN [d.lang]
    WHEN d.n_chars % 5 = 3 THEN [d.lang, 'src-tag'] ELSE [d.lang, d.lang] END AS tags
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "tasks": "SELECT DISTINCT dataset_key, task_index, lang AS task FROM episodes",
    "catalog": """
SELECT dataset_key, count(*) AS total_episodes, CAST(sum(length) AS BIGINT) AS total_frames,
  CAST(CASE WHEN dataset_key = 'src5' THEN 0 WHEN length(dataset_key) <= 4 THEN 30 ELSE 25 END AS DOUBLE) AS fps,
  CASE WHEN length(dataset_key) <= 4 THEN 'so100' ELSE 'koch' END AS robot_type,
  CASE WHEN length(dataset_key) <= 4 THEN 'cell004' ELSE 'cell005' END AS cell_name
FROM episodes GROUP BY dataset_key""",
    "annotations": f"""
SELECT serial_number, CASE code WHEN 0 THEN 'good' WHEN 1 THEN 'normal' WHEN 2 THEN 'bad' END AS grade,
  CASE doc_id % 4 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['reviewed'] WHEN 2 THEN ['reviewed', 'recheck'] END AS tags,
  CASE WHEN code IN (1, 2) THEN 'Flicker seen ' || (doc_id % 10) WHEN doc_id % 2 = 0 THEN '' END AS reason,
  TIMESTAMP '2024-03-01 00:00:00' + to_minutes(doc_id) AS updated_at
FROM (SELECT *, (doc_id + quality + 2 * toxic) % 4 AS code,
        row_number() OVER (PARTITION BY serial_number ORDER BY doc_id) AS rn
      FROM (SELECT doc_id, quality, toxic, {_serial('doc_id')} AS serial_number FROM labels WHERE doc_id % 3 = 0)
      WHERE serial_number <> '')
WHERE rn = 1""",
    "bridge": """
SELECT dataset_key, min(episode_index) AS episode_index, serial AS serial_number
FROM episodes WHERE serial <> '' GROUP BY dataset_key, serial""",
    "known_index": """
SELECT b.dataset_key, b.episode_index, b.serial_number, a.grade, coalesce(a.tags, CAST([] AS VARCHAR[])) AS tags, a.reason
FROM bridge b JOIN annotations a ON a.serial_number = b.serial_number""",
    "by_index": """
SELECT dataset_key, episode_index, grade, tags, reason FROM known_index
UNION ALL SELECT dataset_key, -episode_index - 1, grade, tags, reason FROM known_index WHERE episode_index % 8 = 0""",
    "legacy": """
SELECT d.source AS dataset_key, d.doc_id AS episode_index,
  CASE d.doc_id % 4 WHEN 0 THEN 'good' WHEN 1 THEN 'normal' WHEN 2 THEN 'bad' END AS grade,
  [d.lang] AS tags, CASE WHEN d.doc_id % 4 = 2 THEN 'old note' END AS reason
FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE d.doc_id % 5 = 1""",
    "frames": """
SELECT 'rig' || (user_id % 10) AS dataset_key, user_id AS episode_index, event_id AS frame_index,
  event_id AS index, event_id / 30.0 AS timestamp, CAST(value / 490.0 AS FLOAT) AS left_arm,
  CAST((event_id * 37 % 100) / 100.0 AS FLOAT) AS right_arm FROM events""",
    "vectors": """
SELECT 'emb' || (vec_id // 200) AS dataset_key, vec_id // 50 AS episode_index, vec_id % 50 AS frame_index,
  vec_id, embedding FROM embeddings""",
    "tiles": """
SELECT dataset_key, episode_index, 'observation.images.cam_head' AS camera, frame_index AS frame_no, t AS tile,
  CAST(CAST(embedding[t + 1] AS DOUBLE) * 100 + CASE WHEN vec_id % 17 = 3 AND t < 3 THEN 400 ELSE 0 END AS FLOAT) AS luminance
FROM vectors, range(16) r(t)""",
    "range_episodes": """
SELECT dataset_key, episode_index, length, q % 3 AS task_index, q // 1000 AS chunk_index, q % 1000 AS file_index,
  CAST(sum(length) OVER (PARTITION BY dataset_key ORDER BY episode_index) - length AS BIGINT) AS dataset_from_index,
  CAST(sum(length) OVER (PARTITION BY dataset_key ORDER BY episode_index) AS BIGINT) AS dataset_to_index
FROM (SELECT 'ds' || (o_orderkey % 8) AS dataset_key, o_orderkey AS episode_index, o_orderkey // 8 AS q,
        o_orderkey // 8 % 4 + 1 AS length FROM orders)""",
    "range_frames": """
SELECT dataset_key, episode_index, task_index, dataset_from_index + k AS index, k AS frame_index
FROM (SELECT *, unnest(range(length)) AS k FROM range_episodes)""",
    "registry": """
SELECT CAST(c_custkey AS VARCHAR) AS dataset_key, c_name AS name,
  '/reg/' || n_name || '/' || c_custkey AS path, n_name AS cell_name, c_mktsegment AS robot_type,
  (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS total_episodes,
  CAST(c_custkey * 7 % 1000 AS DOUBLE) AS info_mtime
FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "registry_stats": """
SELECT CAST(o_custkey AS VARCHAR) AS dataset_key, count(*) AS graded_count,
  count(*) FILTER (o_orderstatus = 'O') AS good_count, count(*) FILTER (o_orderstatus = 'P') AS normal_count,
  count(*) FILTER (o_orderstatus = 'F') AS bad_count
FROM orders WHERE o_orderkey % 4 <> 3 GROUP BY o_custkey""",
    "jobs": """
SELECT o_orderkey AS id, ['convert','split','merge','delete','sync_good_episodes','stamp_cycles',
    'auto_bad_camera_flicker','bronze_silver_batch'][o_orderkey % 8 + 1] AS type,
  CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'complete' ELSE 'running' END AS status,
  o_custkey AS dataset_id, o_orderdate AS updated_at FROM orders""",
    "recordings": """
SELECT 'cell' || printf('%03d', p_partkey % 5) || '/' || p_type AS cell_task,
  CASE WHEN p_partkey % 41 = 0 THEN 'legacy-' || p_partkey WHEN p_partkey % 37 = 0 THEN plain || '_1' ELSE plain END AS serial,
  p_partkey AS item_no, p_partkey % 43 <> 0 AS readable, p_brand AS brand, p_size % 3 * 15 AS fps,
  CASE WHEN p_partkey % 43 = 0 OR p_partkey % 7 = 0 THEN '' ELSE p_name END AS task_name
FROM (SELECT *, '2024' || printf('%02d', 1 + p_partkey % 12) || printf('%02d', 1 + p_partkey % 31)
        || '_' || printf('%06d', p_partkey) AS plain FROM part)""",
    "serial_status": """
SELECT cell_task, serial, item_no, 'converted' AS status FROM recordings WHERE item_no % 3 = 0
UNION ALL SELECT cell_task, serial, item_no, 'failed' FROM recordings WHERE item_no % 7 = 0 AND item_no % 3 <> 0
UNION ALL SELECT cell_task, serial, item_no, 'transient' FROM recordings WHERE item_no % 11 = 0 AND item_no % 3 <> 0
UNION ALL SELECT cell_task, serial, item_no, 'retry_due' FROM recordings WHERE item_no % 22 = 0 AND item_no % 3 <> 0
UNION ALL SELECT cell_task, 'gone-' || serial, item_no, 'retry_due' FROM recordings WHERE item_no % 55 = 0""",
    "task_counts": """
SELECT cell_task, count(*) FILTER (status = 'converted')
    + CASE WHEN cell_task LIKE 'cell003%' THEN 1 ELSE 0 END AS converted_count,
  count(*) FILTER (status = 'failed') AS failed_count, count(*) FILTER (status = 'transient') AS retry_count,
  max(serial) FILTER (status = 'converted') AS last_serial
FROM serial_status GROUP BY cell_task""",
    "output_counts": """
SELECT cell_task, count(*) AS episodes FROM serial_status
WHERE status = 'converted' AND cell_task NOT LIKE 'cell004%' GROUP BY cell_task""",
    # what each log line says, straight from the rule that wrote it
    "log_facts": """
SELECT event_type AS log, event_id AS line_no, event_id % 13 AS kind, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts,
  epoch_ms(date_trunc('second', ts)) AS ms, user_id AS u, event_type,
  'cell' || printf('%03d', user_id % 5) || '/pick_' || (user_id % 3) AS task,
  '20240101_' || printf('%06d', event_id) AS serial FROM events""",
}


def check(body: str) -> str:
    """SQL text with the views it mentions in front, each defined once."""
    needed: list[str] = []
    seen: set[str] = set()

    def add(text: str) -> None:
        for name in VIEWS:
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                add(VIEWS[name])
                needed.append(name)

    add(body)
    if not needed:
        return body.strip()
    views = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in needed)
    text = body.strip()
    if text[:5].upper() == "WITH ":
        rest = text[5:]
        if rest[:10].upper() == "RECURSIVE ":
            return f"WITH RECURSIVE {views},\n{rest[10:]}"
        return f"WITH {views},\n{rest}"
    return f"WITH {views}\n{text}"
