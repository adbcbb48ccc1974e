"""Queries over recordings, conversion state, curation states and converter logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.functions.text import canonical_digest
from kinetable.operators import conversion, curation, serials, stats
from kinetable.plans.registry import query, r6
from kinetable.plans.shapes import Shapes
from kinetable.sources import recordings as raw
from kinetable.streaming import log_events as logs
from kinetable.streaming import progress as live

TASK_SERIAL = ("cell_task", "serial")


# --- raw recordings ---------------------------------------------------------------

def _files(s: Shapes):
    return s.recordings.select(F.concat_ws("/", *TASK_SERIAL).alias("path"), "metacard")


@query("SELECT cell_task, count(*) AS total FROM recordings GROUP BY cell_task")
def scan_raw_inventory(s: Shapes):
    return raw.raw_totals(raw.split_recording_path(_files(s)))


@query("""SELECT cell_task AS task, cell_task[9:] AS name, count(*) AS count FROM recordings
WHERE cell_task LIKE 'cell002/%' GROUP BY cell_task""")
def list_raw_tasks(s: Shapes):
    return raw.list_tasks(s.recordings, "cell002")


@query("SELECT cell_task, serial, cell_task || '/' || serial AS recording, task_name FROM recordings")
def list_recordings(s: Shapes):
    return raw.list_recordings(s.recordings)


@query("""SELECT cell_task, row_number() OVER w - 1 AS episode_index, row_number() OVER w - 1 AS file_index,
  coalesce(nullif(task_name, ''), nullif(first_value(task_name) OVER w, ''), split_part(cell_task, '/', -1)) AS task_instruction,
  CASE WHEN regexp_full_match(serial, '\\d{8}_\\d{6}(_\\d+)?') THEN serial[1:4] || '-' || serial[5:6] || '-' || serial[7:8] END AS created_at,
  'raw:' || cell_task || '/' || serial AS "Serial_number", 0::BIGINT AS length
FROM recordings WINDOW w AS (PARTITION BY cell_task ORDER BY serial)""")
def raw_as_episodes(s: Shapes):
    return raw.raw_as_episodes(s.recordings).select(
        "cell_task", "episode_index", "file_index", "task_instruction", "created_at", "Serial_number", "length")


@query("""
WITH ann AS (SELECT 'raw:' || cell_task || '/' || serial AS serial_number, CASE item_no % 5 WHEN 0 THEN 'good' WHEN 1 THEN 'bad' WHEN 2 THEN 'normal' END AS grade
  FROM recordings WHERE item_no % 2 = 0)
SELECT r.cell_task, count(a.grade) AS graded_count, count(*) FILTER (a.grade = 'good') AS good_count,
  count(*) FILTER (a.grade = 'normal') AS normal_count, count(*) FILTER (a.grade = 'bad') AS bad_count
FROM recordings r LEFT JOIN ann a ON a.serial_number = 'raw:' || r.cell_task || '/' || r.serial GROUP BY r.cell_task""")
def grade_counts_raw(s: Shapes):
    i = F.col("item_no")
    ann = s.recordings.where(i % 2 == 0).select(
        F.concat(F.lit("raw:"), F.concat_ws("/", *TASK_SERIAL)).alias("serial_number"),
        F.when(i % 5 == 0, "good").when(i % 5 == 1, "bad").when(i % 5 == 2, "normal").alias("grade"))
    return stats.grade_counts_raw(s.recordings, ann)


_CARD = """'{"action_joint_order":{},"action_order":[],"action_topic_names":[],"camera_names":["cam_a","cam_b"],"fps":' || fps ||
  ',"joint_names":["a","b"],"robot_type":"' || brand || '"}'"""
_GROUPS = f"""
WITH signed AS (SELECT *, sha256({_CARD}) AS digest FROM recordings WHERE readable),
groups AS (SELECT cell_task, digest, digest[1:8] AS signature_id, brand AS robot_type, count(*) AS recordings, min(serial) AS first_serial FROM signed GROUP BY ALL),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell_task ORDER BY recordings DESC, first_serial) AS rn FROM groups) WHERE rn = 1)"""


@query(f"SELECT cell_task, serial, sha256({_CARD})[1:8] AS signature_id FROM recordings WHERE readable")
def canonical_signature(s: Shapes):
    return conversion.with_signature(s.recordings).where("signature_id is not null").select(
        *TASK_SERIAL, F.substring(canonical_digest(F.col("signature")), 1, 8).alias("signature_id"))


@query(f"""{_GROUPS} SELECT g.cell_task, g.signature_id, g.robot_type, g.recordings,
  row_number() OVER (PARTITION BY g.cell_task ORDER BY g.recordings DESC, g.digest) - 1 AS position,
  k.digest = g.digest AS keep_in_source,
  CASE WHEN k.digest = g.digest THEN g.cell_task
    ELSE g.cell_task || '__' || replace(g.robot_type, '#', '_') || '__' || g.signature_id END AS destination
FROM groups g JOIN kept k ON k.cell_task = g.cell_task""")
def signature_groups(s: Shapes):
    return conversion.signature_groups(s.recordings)


@query(f"{_GROUPS} SELECT cell_task, digest AS keep FROM kept")
def top_group(s: Shapes):
    signed = conversion.with_signature(s.recordings).where("signature_id is not null")
    return conversion.top_group(signed.groupBy("cell_task", "signature_digest").agg(
        F.count("*").alias("recordings"), F.min("serial").alias("first_serial")))


@query("SELECT cell_task, serial FROM recordings WHERE NOT readable")
def invalid_metacards(s: Shapes):
    return conversion.invalid_metacards(s.recordings)


@query("""SELECT cell_task, count(DISTINCT serial) AS serials, sha256(string_agg(DISTINCT serial || chr(10), '' ORDER BY serial || chr(10))) AS digest
FROM recordings GROUP BY cell_task""")
def serial_set_digest(s: Shapes):
    return serials.serial_set_digest(s.recordings)


@query("""
WITH d AS (SELECT cell_task, serial, item_no, CASE WHEN regexp_full_match(serial, '[1-9]\\d{7}_\\d{6}') THEN strftime(try_strptime(serial, '%Y%m%d_%H%M%S'), '%Y-%m-%d') END AS date FROM recordings)
SELECT cell_task, serial, item_no, dense_rank() OVER (PARTITION BY cell_task ORDER BY date IS NULL, date DESC) - 1 AS group_order,
  count(*) OVER (PARTITION BY cell_task, date) AS group_size, row_number() OVER (PARTITION BY cell_task, date ORDER BY item_no) - 1 AS item_order, date
FROM d""")
def date_groups(s: Shapes):
    return conversion.date_groups(s.recordings)


# --- progress and queues ---------------------------------------------------------

_PROGRESS = """
WITH totals AS (SELECT cell_task, count(*) AS total FROM recordings WHERE cell_task <> 'cell001/SMALL' GROUP BY cell_task),
rows AS (SELECT coalesce(t.cell_task, c.cell_task) AS cell_task, coalesce(total, 0) AS total, c.failed_count, c.retry_count,
    coalesce(o.episodes, c.converted_count, 0) AS n, o.episodes, coalesce(c.converted_count, 0) AS state_count
  FROM totals t FULL JOIN task_counts c ON c.cell_task = t.cell_task LEFT JOIN output_counts o ON o.cell_task = coalesce(t.cell_task, c.cell_task)),
progress AS (SELECT cell_task, total, greatest(0, least(total, n)) AS done, coalesce(failed_count, 0) AS failed, coalesce(retry_count, 0) AS retry,
    greatest(0, total - greatest(0, least(total, n)) - coalesce(failed_count, 0)) AS pending FROM rows WHERE total > 0)"""


def _totals(s: Shapes):
    return raw.raw_totals(s.recordings.where("cell_task <> 'cell001/SMALL'"))


def _progress(s: Shapes):
    return conversion.convert_progress(s.task_counts, _totals(s), s.output_counts)


@query(f"{_PROGRESS} SELECT cell_task, total, state_count, episodes AS output_episodes FROM rows")
def progress_full_outer(s: Shapes):
    return conversion.progress_full_outer(s.task_counts, _totals(s), s.output_counts).select(
        "cell_task", F.coalesce("total", F.lit(0)).alias("total"),
        F.coalesce("converted_count", F.lit(0)).alias("state_count"), "output_episodes")


@query(f"{_PROGRESS} SELECT * FROM progress")
def convert_progress(s: Shapes):
    return _progress(s).drop("last_updated")


@query(f"""{_PROGRESS} SELECT count(*) AS tasks, CAST(sum(total) AS BIGINT) AS total, CAST(sum(done) AS BIGINT) AS done,
  CAST(sum(pending) AS BIGINT) AS pending, CAST(sum(failed) AS BIGINT) AS failed, CAST(floor(sum(done) * 100.0 / sum(total) + 0.5) AS BIGINT) AS percent,
  count(*) || ' tasks | ' || sum(total) || ' recordings | ' || sum(done) || ' done | ' || sum(pending) || ' pending | ' || sum(failed) || ' failed' AS summary
FROM progress""")
def progress_summary(s: Shapes):
    return conversion.progress_summary(_progress(s))


@query(f"{_PROGRESS} SELECT cell_task, state_count, episodes AS output_episodes FROM rows WHERE episodes <> state_count")
def progress_mismatch(s: Shapes):
    return conversion.progress_mismatch(s.task_counts, _totals(s), s.output_counts)


@query(f"""{_PROGRESS}, v AS (SELECT 'cell' || printf('%03d', user_id % 5) || '/SMALL' AS cell_task,
    CASE WHEN user_id % 2 = 0 THEN 'quick' ELSE 'full' END AS mode, CASE WHEN value > 50 THEN 'failed' ELSE 'passed' END AS status,
    event_type AS summary, ts FROM events WHERE event_type <> 'view'),
latest AS (SELECT cell_task, mode, arg_max(status, ts) AS status, arg_max(summary, ts) AS summary FROM v GROUP BY ALL)
SELECT p.cell_task, p.done, coalesce(q.status, 'not_run') AS quick_status, coalesce(q.summary, 'Not validated') AS quick_summary,
  coalesce(f.status, 'not_run') AS full_status, coalesce(f.summary, 'Not validated') AS full_summary FROM progress p
LEFT JOIN latest q ON q.cell_task = p.cell_task AND q.mode = 'quick' LEFT JOIN latest f ON f.cell_task = p.cell_task AND f.mode = 'full'""")
def progress_with_validation(s: Shapes):
    u = F.col("user_id")
    done = s.table("events").where("event_type <> 'view'").select(
        F.format_string("cell%03d/SMALL", u % 5).alias("cell_task"),
        F.when(u % 2 == 0, "quick").otherwise("full").alias("mode"),
        F.when(F.col("value") > 50, "failed").otherwise("passed").alias("status"),
        F.col("event_type").alias("summary"), F.col("ts").alias("checked_at"))
    return conversion.progress_with_validation(_progress(s), done).select(
        "cell_task", "done", "quick_status", "quick_summary", "full_status", "full_summary")


_PENDING = """
WITH due AS (SELECT DISTINCT s.cell_task, s.serial FROM serial_status s JOIN recordings r USING (cell_task, serial) WHERE status = 'retry_due'),
fresh AS (SELECT cell_task, serial FROM recordings WHERE (cell_task, serial) NOT IN (
    SELECT (cell_task, serial) FROM serial_status WHERE status <> 'retry_due')),
pending AS (SELECT cell_task, serial, true AS retry FROM due UNION ALL SELECT cell_task, serial, false FROM fresh
  WHERE (cell_task, serial) NOT IN (SELECT (cell_task, serial) FROM due))"""


@query(f"{_PENDING} SELECT * FROM pending")
def pending_set(s: Shapes):
    return conversion.pending_set(s.recordings, s.serial_status)


@query(f"""{_PENDING} SELECT *, row_number() OVER (PARTITION BY cell_task ORDER BY retry DESC, serial) - 1 AS position FROM pending""")
def retry_first_queue(s: Shapes):
    return conversion.retry_first_queue(conversion.pending_set(s.recordings, s.serial_status))


@query("""SELECT cell_task, count(*) AS recordings FROM recordings WHERE item_no % 4 > 0 AND cell_task <> 'cell002/SMALL' GROUP BY cell_task
UNION ALL SELECT 'cell002/SMALL', 0 WHERE EXISTS (SELECT 1 FROM recordings WHERE cell_task = 'cell002/SMALL' AND NOT readable)""")
def tasks_with_failures(s: Shapes):
    good = s.recordings.where("item_no % 4 > 0 and cell_task <> 'cell002/SMALL'")
    return conversion.tasks_with_failures(good, conversion.invalid_metacards(s.recordings))


_LEFT = """
WITH unresolved AS (SELECT r.cell_task, r.serial FROM recordings r WHERE item_no % 2 = 0
  AND NOT EXISTS (SELECT 1 FROM serial_status s WHERE s.cell_task = r.cell_task AND s.serial = r.serial AND s.status IN ('converted', 'failed')))"""


def _unresolved(s: Shapes):
    of = lambda status: s.serial_status.where(F.col("status") == status)
    return conversion.unresolved_set(s.recordings.where("item_no % 2 = 0"), of("converted"), of("failed"))


@query(f"{_LEFT} SELECT * FROM unresolved")
def unresolved_set(s: Shapes):
    return _unresolved(s)


@query(f"""{_LEFT}, n AS (SELECT cell_task, count(*) AS unresolved FROM unresolved GROUP BY cell_task)
SELECT c.cell_task, coalesce(n.unresolved, 0) AS unresolved, CASE WHEN c.cell_task LIKE 'cell003%' THEN 'regressed'
  WHEN c.cell_task LIKE 'cell001%' THEN 'ok' WHEN n.unresolved > 0 THEN 'no_progress' ELSE 'ok' END AS verdict
FROM task_counts c LEFT JOIN n ON n.cell_task = c.cell_task""")
def run_verdict(s: Shapes):
    t = F.col("cell_task")
    counts = s.task_counts.select(
        "cell_task", F.col("converted_count").alias("before_count"),
        F.when(t.startswith("cell003"), F.col("converted_count") - 1).when(
            t.startswith("cell001"), F.col("converted_count") + 2).otherwise(F.col("converted_count")).alias("after_count"),
        F.lit(5).alias("before_output"), F.lit(5).alias("after_output"))
    return conversion.run_verdict(counts, _unresolved(s)).select("cell_task", "unresolved", "verdict")


@query("""
WITH converted AS (SELECT cell_task, serial FROM serial_status WHERE status IN ('converted', 'retry_due')
  UNION ALL SELECT cell_task, serial FROM serial_status WHERE status = 'converted' AND item_no % 30 = 0 AND cell_task LIKE 'cell000%')
SELECT cell_task, count(DISTINCT serial) FILTER (serial LIKE 'gone-%') AS not_in_raw,
  count(DISTINCT serial) FILTER (n > 1) AS repeated, count(*) FILTER (serial LIKE 'gone-%' OR n > 1) = 0 AS passed
FROM (SELECT *, count(*) OVER (PARTITION BY cell_task, serial) AS n FROM converted) GROUP BY cell_task""")
def subset_check(s: Shapes):
    listed = s.serial_status.where("status in ('converted', 'retry_due')")
    again = s.serial_status.where("status = 'converted' and item_no % 30 = 0 and cell_task like 'cell000%'")
    return conversion.subset_check(listed.unionByName(again), s.recordings)


@query("SELECT cell_task, max(serial) AS last_serial, count(*) AS converted_count FROM serial_status WHERE status = 'converted' GROUP BY cell_task")
def last_state_by_serial(s: Shapes):
    return serials.last_state_by_serial(s.serial_status.where("status = 'converted'"))


def _unfinished(s: Shapes):
    waiting = F.col("status") == "transient"
    return s.serial_status.where("status in ('failed', 'transient')").select(
        *TASK_SERIAL, "status",
        F.when(waiting, F.col("item_no") % 5).alias("attempt_count"),
        F.when(waiting, F.col("item_no") * 1.5).alias("first_failed_at"),
        F.when(waiting, F.col("item_no") * 2.0).alias("next_retry_at"),
        F.when(waiting, "timeout").alias("last_error"))


@query("""SELECT cell_task, serial, 'transient' AS status, bool_or(status = 'failed') AS reset,
  CASE WHEN bool_or(status = 'failed') THEN 0 ELSE max(item_no % 5) END AS attempt_count,
  CASE WHEN bool_or(status = 'failed') THEN 1000.0::DOUBLE ELSE max(item_no) * 1.5::DOUBLE END AS first_failed_at,
  CASE WHEN bool_or(status = 'failed') THEN 0.0::DOUBLE ELSE max(item_no) * 2.0::DOUBLE END AS next_retry_at,
  CASE WHEN bool_or(status = 'failed') THEN 'manual retry requested from UI' ELSE 'timeout' END AS last_error
FROM serial_status WHERE status IN ('failed', 'transient') GROUP BY cell_task, serial""")
def retry_all_failed(s: Shapes):
    out = conversion.retry_all_failed(_unfinished(s), F.lit(1000.0))
    return out.select(*TASK_SERIAL, "status", "reset", "attempt_count", r6("first_failed_at").alias("first_failed_at"),
                      r6("next_retry_at").alias("next_retry_at"), "last_error")


# --- partitions ------------------------------------------------------------------------

_PARTS = f"""
WITH parts AS (SELECT cell_task, serial, item_no, {_CARD} AS contract, sha256({_CARD}) AS digest FROM recordings WHERE readable),
partition_rows AS (SELECT cell_task, serial, CASE WHEN item_no % 97 = 5 THEN sha256('wrong') ELSE digest END AS digest, contract FROM parts
  UNION ALL SELECT cell_task, serial, digest, contract FROM parts WHERE item_no % 101 = 7),
listed AS (SELECT cell_task, serial, CASE WHEN item_no % 89 = 3 THEN sha256('other') ELSE digest END AS digest,
    CASE WHEN item_no % 83 = 2 THEN 'pending' ELSE 'resolved' END AS status FROM parts WHERE item_no % 103 <> 9)"""


@query(f"""{_PARTS},
p AS (SELECT cell_task, serial, count(*) AS n, min(digest) AS expected, bool_or(sha256(contract) <> digest) AS bad FROM partition_rows GROUP BY ALL),
both_sides AS (SELECT p.*, l.digest AS given, l.status FROM p LEFT JOIN listed l ON l.cell_task = p.cell_task AND l.serial = p.serial)
SELECT cell_task, count(*) FILTER (n > 1) AS overlapping, count(*) FILTER (bad) AS wrong_digest,
  count(*) FILTER (NOT regexp_full_match(serial, '\\d{{8}}_\\d{{6}}(_\\d+)?')) AS bad_serials, count(*) FILTER (status = 'pending') AS bad_recordings,
  count(*) FILTER (expected IS DISTINCT FROM given) AS differing, count(*) AS serials,
  count(*) FILTER (n > 1 OR bad OR NOT regexp_full_match(serial, '\\d{{8}}_\\d{{6}}(_\\d+)?') OR status = 'pending' OR expected IS DISTINCT FROM given) = 0 AS valid
FROM both_sides GROUP BY cell_task""")
def partition_cover(s: Shapes):
    i = F.col("item_no")
    signed = conversion.with_signature(s.recordings).where("signature_id is not null").select(
        *TASK_SERIAL, "item_no", F.to_json("signature", {"ignoreNullFields": "false"}).alias("contract"),
        canonical_digest(F.col("signature")).alias("digest"))
    wrong = lambda cond, word: F.when(cond, F.sha2(F.lit(word), 256)).otherwise(F.col("digest")).alias("digest")
    columns = [*TASK_SERIAL, "digest", "contract"]
    parts = signed.select(*TASK_SERIAL, wrong(i % 97 == 5, "wrong"), "contract").unionByName(
        signed.where(i % 101 == 7).select(*columns))
    listed = signed.where(i % 103 != 9).select(
        *TASK_SERIAL, wrong(i % 89 == 3, "other"),
        F.when(i % 83 == 2, "pending").otherwise("resolved").alias("status"))
    return conversion.partition_cover(parts, listed)


def _homes(s: Shapes):
    """Recordings of each cell's first task moved on by their signature."""
    i = F.col("item_no")
    return s.recordings.select(
        F.col("cell_task").alias("source_task"), "serial",
        F.when(i % 4 == 1, F.concat("cell_task", F.lit("__b"))).otherwise(F.col("cell_task")).alias("task"))


@query("""
WITH homes AS (SELECT cell_task AS source_task, serial, CASE WHEN item_no % 4 = 1 THEN cell_task || '__b' ELSE cell_task END AS task FROM recordings),
failures AS (SELECT cell_task, serial, status FROM serial_status WHERE status IN ('failed', 'transient')
  UNION ALL SELECT cell_task || '__b', serial, status FROM serial_status WHERE status = 'failed' AND item_no % 8 < 2),
converted AS (SELECT cell_task, serial FROM recordings WHERE item_no % 14 = 0)
SELECT DISTINCT f.cell_task, f.serial, f.status, f.cell_task LIKE '%\\_\\_b' ESCAPE '\\' AND NOT EXISTS (
    SELECT 1 FROM homes h WHERE h.task = f.cell_task AND h.serial = f.serial) AS "foreign"
FROM failures f
WHERE NOT EXISTS (SELECT 1 FROM converted c WHERE c.cell_task = f.cell_task AND c.serial = f.serial)
  AND NOT EXISTS (SELECT 1 FROM homes h WHERE h.source_task = f.cell_task AND h.serial = f.serial AND h.task <> h.source_task)""")
def state_reconcile(s: Shapes):
    failed = s.serial_status.where("status in ('failed', 'transient')").select(*TASK_SERIAL, "status")
    there = s.serial_status.where("status = 'failed' and item_no % 8 < 2").select(
        F.concat("cell_task", F.lit("__b")).alias("cell_task"), "serial", "status")
    failures = failed.unionByName(there).withColumn("payload", F.lit(""))
    converted = s.recordings.where("item_no % 14 = 0")
    return conversion.state_reconcile(failures, _homes(s), converted).drop("payload")


@query("""SELECT t.cell_task, count(DISTINCT r.serial) AS converted_count, coalesce(max(r.serial), '') AS last_serial
FROM (SELECT DISTINCT cell_task FROM recordings) t LEFT JOIN recordings r ON r.cell_task = t.cell_task AND r.item_no % 14 = 0 AND t.cell_task NOT LIKE 'cell002%'
GROUP BY t.cell_task""")
def reconciled_counts(s: Shapes):
    done = s.recordings.where("item_no % 14 = 0 and cell_task not like 'cell002%'")
    return conversion.reconciled_counts(s.recordings.select("cell_task").distinct(), done)


def _versions(s: Shapes):
    """State before, as desired, and as found: some tasks moved on, some edited by others."""
    before = conversion.state_fields(s.task_counts, _unfinished(s))
    cleared = _unfinished(s).where("status = 'transient'")
    desired = conversion.state_fields(s.task_counts.withColumn("last_updated", F.lit("later")), cleared)
    t = F.col("cell_task")
    taken = before.where(t.startswith("cell000")).unionByName(desired.where(t.startswith("cell001")))
    mixed = before.where(t.startswith("cell002")).withColumn("last_updated", F.lit("later"))
    edited = before.where(t.startswith("cell003")).withColumn("last_serial", F.lit("someone else"))
    return taken.unionByName(mixed).unionByName(edited), before, desired


@query("""SELECT cell_task, cell_task[1:7] IN ('cell000', 'cell001', 'cell002') AS admissible FROM task_counts""")
def three_way_check(s: Shapes):
    return conversion.three_way_check(*_versions(s))


@query("""SELECT cell_task, 'later' AS last_updated FROM task_counts WHERE cell_task LIKE 'cell001%' OR cell_task LIKE 'cell002%'
UNION ALL SELECT cell_task, '2024-05-01T00:00:00+00:00' FROM task_counts WHERE cell_task LIKE 'cell000%' OR cell_task LIKE 'cell003%'""")
def compose_scope(s: Shapes):
    current, _, desired = _versions(s)
    scope = desired.where("cell_task like 'cell001%' or cell_task like 'cell002%'").select("cell_task")
    return conversion.compose_scope(current, desired, scope).select("cell_task", "last_updated")


# --- curation states -------------------------------------------------------------------

_AS_OF = "1998-06-01 00:00:00"
_STATES = """
SELECT printf('20240101_%06d', o_orderkey) AS serial_number, 'cell' || (o_custkey % 3) AS cell, o_orderpriority AS task,
  ['bronze_detected', 'silver_processing', 'silver_ready', 'human_curating', 'gold_ready', 'silver_failed', 'silver_ready_old'][o_orderkey % 7 + 1] AS state,
  CASE WHEN o_orderkey % 14 = 5 THEN 'disk full' END AS failure_reason, CASE WHEN o_orderkey % 7 = 1 THEN o_orderdate END AS processing_started_at,
  o_orderkey % 14 = 5 AS retry_required, o_orderdate AS updated_at FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 7 = 1"""


def _states(s: Shapes):
    i = F.col("o_orderkey")
    names = ["bronze_detected", "silver_processing", "silver_ready", "human_curating", "gold_ready",
             "silver_failed", "silver_ready_old"]
    serial = F.format_string("20240101_%06d", i)
    day = F.col("o_orderdate").cast("timestamp")
    return s.table("orders").where((i % 2 == 0) | (i % 7 == 1)).select(
        serial.alias("serial_number"), F.concat(F.lit("cell"), F.col("o_custkey") % 3).alias("cell"),
        F.col("o_orderpriority").alias("task"), F.concat(F.lit("/d/bronze/"), serial).alias("bronze_path"),
        F.concat(F.lit("/d/silver/"), serial).alias("silver_path"),
        F.element_at(F.array(*map(F.lit, names)), (i % 7 + 1).cast("int")).alias("state"),
        F.when(i % 14 == 5, "disk full").alias("failure_reason"), F.when(i % 7 == 1, day).alias("processing_started_at"),
        (i % 14 == 5).alias("retry_required"), day.alias("updated_at"))


def _detected(s: Shapes):
    i = F.col("o_orderkey")
    files = s.table("orders").where((i % 7 == 0) | (i % 7 == 3)).select(F.format_string(
        "bronze/cell%d/sort/20240101_%06d", F.col("o_custkey") % 3, i).alias("path"))
    return curation.discover_bronze(files.unionByName(s.table("region").select(
        F.concat(F.lit("bronze/"), "r_name").alias("path"))), "/d")


_DETECTED = """
SELECT printf('20240101_%06d', o_orderkey) AS serial_number, 'cell' || (o_custkey % 3) AS cell, 'sort' AS task,
  printf('/d/bronze/cell%d/sort/20240101_%06d', o_custkey % 3, o_orderkey) AS bronze_path,
  printf('/d/silver_label_data/cell%d/sort/20240101_%06d', o_custkey % 3, o_orderkey) AS silver_path
FROM orders WHERE o_orderkey % 7 IN (0, 3)"""


@query(_DETECTED)
def discover_bronze(s: Shapes):
    return _detected(s)


_TIMED = f"""
SELECT *, state = 'silver_processing' AND processing_started_at < TIMESTAMP '{_AS_OF}' - INTERVAL 90 DAY AS went_stale FROM ({_STATES})"""


@query(f"""SELECT serial_number, CASE WHEN went_stale THEN 'silver_failed' ELSE state END AS state,
  CASE WHEN went_stale THEN 'silver_processing timeout' ELSE failure_reason END AS failure_reason,
  retry_required OR coalesce(went_stale, false) AS retry_required FROM ({_TIMED})""")
def stale_timeout(s: Shapes):
    out = curation.stale_timeout(_states(s), F.to_timestamp(F.lit(_AS_OF)), 90 * 86_400)
    return out.select("serial_number", "state", "failure_reason", "retry_required")


_KNOWN = f"""
SELECT coalesce(t.serial_number, d.serial_number) AS serial_number,
  CASE WHEN t.serial_number IS NULL OR (d.serial_number IS NOT NULL AND t.state = 'bronze_detected') THEN d.task ELSE t.task END AS task,
  CASE WHEN t.serial_number IS NULL THEN 'bronze_detected' WHEN t.went_stale THEN 'silver_failed' ELSE t.state END AS state,
  CASE WHEN t.went_stale THEN 'silver_processing timeout' ELSE t.failure_reason END AS failure_reason,
  coalesce(t.retry_required, false) OR coalesce(t.went_stale, false) AS retry_required,
  CASE WHEN t.serial_number IS NULL OR (d.serial_number IS NOT NULL AND t.state = 'bronze_detected') OR t.went_stale THEN TIMESTAMP '{_AS_OF}' ELSE t.updated_at END AS updated_at
FROM ({_TIMED}) t FULL JOIN ({_DETECTED}) d ON d.serial_number = t.serial_number"""


@query(f"SELECT serial_number, task, CASE WHEN failure_reason = 'silver_processing timeout' THEN 'silver_processing' ELSE state END AS state FROM ({_KNOWN})")
def upsert_detected(s: Shapes):
    return curation.upsert_detected(_states(s), _detected(s), F.to_timestamp(F.lit(_AS_OF))).select(
        "serial_number", "task", "state")


@query(f"""SELECT serial_number, CAST(updated_at AS VARCHAR) AS updated_at FROM ({_STATES}) WHERE state = 'bronze_detected'
ORDER BY updated_at, serial_number LIMIT 200""")
def eligible_batch(s: Shapes):
    return curation.eligible_batch(_states(s), 200).select(
        "serial_number", F.col("updated_at").cast("string").alias("updated_at"))


@query(f"""
WITH known AS ({_KNOWN}), picked AS (SELECT serial_number FROM known WHERE state = 'bronze_detected'),
outcomes AS (SELECT printf('20240101_%06d', o_orderkey) AS serial_number,
  CASE WHEN o_orderkey % 5 = 0 THEN repeat('no space left ', 100) END AS error FROM orders)
SELECT k.serial_number, k.task, CASE WHEN p.serial_number IS NULL THEN k.state WHEN o.error IS NULL THEN 'silver_ready' ELSE 'silver_failed' END AS state,
  CASE WHEN p.serial_number IS NULL THEN k.failure_reason ELSE left(o.error, 1000) END AS failure_reason,
  CASE WHEN p.serial_number IS NULL THEN k.retry_required ELSE o.error IS NOT NULL END AS retry_required,
  CAST(CASE WHEN p.serial_number IS NULL THEN k.updated_at ELSE TIMESTAMP '{_AS_OF}' END AS VARCHAR) AS updated_at
FROM known k LEFT JOIN picked p ON p.serial_number = k.serial_number LEFT JOIN outcomes o ON o.serial_number = k.serial_number""")
def medallion_step(s: Shapes):
    i = F.col("o_orderkey")
    outcomes = s.table("orders").select(
        F.format_string("20240101_%06d", i).alias("serial_number"),
        F.when(i % 5 == 0, F.repeat(F.lit("no space left "), 100)).alias("error"))
    out = curation.medallion_step(
        _states(s), _detected(s), outcomes, F.to_timestamp(F.lit(_AS_OF)), 90 * 86_400)
    return out.select("serial_number", "task", "state", "failure_reason", "retry_required",
                      F.col("updated_at").cast("string").alias("updated_at"))


@query(f"""SELECT serial_number, 0::BIGINT AS episode_index, '/d/silver/' || serial_number AS dataset_path FROM ({_STATES}) WHERE state = 'silver_ready'""")
def silver_bridge(s: Shapes):
    return curation.silver_bridge(_states(s))


@query(f"SELECT serial_number, CASE WHEN state = 'silver_ready_old' THEN 'silver_ready' ELSE state END AS state, task FROM ({_STATES})")
def schema_migration_states(s: Shapes):
    return curation.drop_legacy_state(_states(s), "silver_ready_old", "silver_ready", "bronze_path").drop(
        "silver_path", "cell", "failure_reason", "processing_started_at", "retry_required", "updated_at")


@query("""SELECT dataset_key, CASE WHEN robot_type = 'BUILDING' THEN 1 ELSE 2 END AS keys FROM registry""")
def schema_migration_features(s: Shapes):
    source = F.when(F.col("robot_type") == "BUILDING", "bronze_silver_batch").otherwise("manual")
    rows = s.registry.select("dataset_key", F.create_map(
        F.lit("source"), source, F.lit("preview_path"), F.col("path")).alias("features"))
    return curation.drop_info_key(rows, "bronze_silver_batch", "preview_path").select(
        "dataset_key", F.size("features").alias("keys"))


# --- logs ---------------------------------------------------------------------------------

_EVENTS = """
SELECT log, line_no, ['converted', 'converted', 'failed', 'converting', 'recording_start', 'recording_start', 'finalizing', 'finalized',
    'scan', 'warning', 'info'][kind + 1] AS type, ts,
  CASE WHEN kind IN (0, 1, 2, 4, 5) THEN task || '/' || serial END AS recording,
  CASE WHEN kind IN (0, 1) THEN line_no % 900 END AS frames, CASE WHEN kind = 0 THEN CAST(u + 0.5 AS DOUBLE) END AS duration,
  CASE WHEN kind = 2 THEN 'E' || (u % 9) END AS error_code, CASE WHEN kind = 2 THEN 'bad topic: ' || event_type END AS reason,
  CASE WHEN kind IN (3, 6, 7) THEN task END AS task, CASE WHEN kind = 3 THEN u % 40 END AS count,
  CASE WHEN kind IN (4, 5) THEN line_no % 7 + 1 END AS index, CASE WHEN kind IN (4, 5) THEN line_no % 7 + 5 END AS total,
  CASE WHEN kind = 8 THEN u % 6 END AS tasks, CASE WHEN kind = 8 THEN u END AS pending,
  CASE kind WHEN 9 THEN 'Timing Anomaly in ' || task || '/' || serial WHEN 10 THEN 'value ' || event_type END AS message
FROM log_facts WHERE kind <= 10"""


def _events(s: Shapes):
    return logs.log_events(s.log_lines)


@query(_EVENTS)
def parse_log_line(s: Shapes):
    return _events(s)


@query("SELECT log, count(*) FILTER (kind < 2) AS ok, count(*) FILTER (kind = 2) AS fail FROM log_facts GROUP BY log")
def event_counts(s: Shapes):
    return logs.event_counts(_events(s), "log")


# the fold itself, one event after another per log, as a recursive query over
# the whole state is far too slow; this states the final entry by its rules
_LIVE = """
WITH ev AS (SELECT log, line_no AS pos, kind, task, serial, ms, line_no % 7 + 1 AS idx, line_no % 7 + 5 AS tot,
    CASE WHEN kind = 3 THEN 'C' WHEN kind IN (4, 5) THEN 'R' WHEN kind < 2 THEN 'K' WHEN kind = 2 THEN 'F' WHEN kind = 6 THEN 'Z' WHEN kind = 7 THEN 'D' END AS t
  FROM log_facts WHERE kind <= 7),
starts AS (SELECT log, task, pos, lead(task) OVER w AS next_task, lead(pos) OVER w AS next_pos FROM ev WHERE t = 'C' WINDOW w AS (PARTITION BY log ORDER BY pos)),
gone AS (SELECT log, task, next_pos AS pos FROM starts s WHERE next_task <> task AND NOT EXISTS (
    SELECT 1 FROM ev f WHERE f.log = s.log AND f.task = s.task AND f.t IN ('Z', 'D') AND f.pos > s.pos AND f.pos < s.next_pos)),
allev AS (SELECT log, task, pos, t, serial, ms, idx, tot FROM ev UNION ALL SELECT log, task, pos, 'X', NULL, NULL, NULL, NULL FROM gone),
marked AS (SELECT *, coalesce(last_value(CASE WHEN t IN ('C', 'D', 'X') THEN t END IGNORE NULLS) OVER (PARTITION BY log, task ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before FROM allev),
valid AS (SELECT * FROM marked WHERE NOT (t = 'Z' AND before = 'D')),
seg AS (SELECT *, count(*) FILTER (t IN ('C', 'X')) OVER (PARTITION BY log, task ORDER BY pos) AS life,
    count(*) FILTER (t IN ('C', 'X', 'Z', 'D')) OVER (PARTITION BY log, task ORDER BY pos) AS phase_no FROM valid),
last_life AS (SELECT * FROM (SELECT *, max(life) OVER (PARTITION BY log, task) AS ml, max(phase_no) OVER (PARTITION BY log, task) AS mp FROM seg) WHERE life = ml),
alive AS (SELECT *, min(pos) FILTER (t IN ('C', 'R', 'Z', 'D')) OVER (PARTITION BY log, task) AS born FROM last_life)
SELECT log, task,
  CASE arg_max(t, pos) FILTER (t IN ('C', 'Z', 'D', 'X')) WHEN 'Z' THEN 'finalizing' WHEN 'D' THEN 'done' ELSE 'converting' END AS phase,
  arg_max(idx, pos) FILTER (t = 'R' AND phase_no = mp) AS recording_index, arg_max(tot, pos) FILTER (t = 'R' AND phase_no = mp) AS recording_total,
  arg_max(serial, pos) FILTER (t = 'R' AND phase_no = mp) AS recording_serial,
  CASE WHEN max(pos) FILTER (t = 'R' AND phase_no = mp) > coalesce(max(pos) FILTER (t = 'K' AND phase_no = mp), -1)
    THEN arg_max(ms, pos) FILTER (t = 'R' AND phase_no = mp) END AS started_ms,
  arg_max(ms, pos) FILTER (t = 'F' AND pos > born) + 500 AS flash_until_ms
FROM alive WHERE born IS NOT NULL GROUP BY log, task"""


@query(_LIVE)
def live_progress(s: Shapes):
    return live.live_progress(_events(s))


@query("""
WITH moves AS (SELECT log, task, line_no, kind FROM log_facts WHERE kind IN (3, 6, 7)),
final AS (SELECT log, arg_max(task, line_no) AS task, max(line_no) AS at FROM moves WHERE kind = 3 GROUP BY log)
SELECT log, task FROM final f WHERE NOT EXISTS (SELECT 1 FROM moves m WHERE m.log = f.log AND m.task = f.task AND m.kind > 3 AND m.line_no > f.at)""")
def active_tasks(s: Shapes):
    return live.active_tasks(_events(s))


@query(f"""
WITH totals AS (SELECT task AS cell_task, count(*) FILTER (kind < 6) AS total, count(*) FILTER (kind < 2) AS done FROM log_facts GROUP BY task),
live AS (SELECT * FROM ({_LIVE})),
shown AS (SELECT t.cell_task, t.total, t.done, max(CASE WHEN l.phase = 'converting' AND l.recording_total > 0 AND l.recording_index IS NOT NULL AND t.total > 0
    THEN least(t.total, greatest(t.done, greatest(0, t.total - l.recording_total) + greatest(0, l.recording_index - 1))) ELSE t.done END) AS live_done
  FROM totals t LEFT JOIN live l ON l.task = t.cell_task GROUP BY ALL)
SELECT cell_task, total, done, live_done, CASE WHEN total > 0 THEN CAST(floor(live_done * 100.0 / total + 0.5) AS BIGINT) ELSE 0 END AS percent FROM shown""")
def live_done(s: Shapes):
    own = live.task_events(_events(s))
    progress = own.groupBy(F.col("task").alias("cell_task")).agg(
        F.count_if(~F.col("type").isin("finalizing", "finalized")).alias("total"),
        F.count_if(F.col("type") == "converted").alias("done"))
    now = live.live_progress(_events(s))
    return live.live_done(progress, now).select("cell_task", "total", "done", "live_done", "percent")


@query(f"""
WITH ev AS ({_EVENTS}),
sets AS (
  SELECT log, line_no, 'phase' AS field, CASE WHEN type IN ('finalizing', 'finalized') THEN type ELSE 'converting' END AS value FROM ev
    WHERE type IN ('converting', 'recording_start', 'converted', 'failed', 'finalizing', 'finalized')
  UNION ALL SELECT log, line_no, 'cell_task', task FROM ev WHERE type IN ('converting', 'finalizing', 'finalized')
  UNION ALL SELECT log, line_no, 'pending_recordings', CAST(count AS VARCHAR) FROM ev WHERE type = 'converting'
  UNION ALL SELECT log, line_no, 'recording', recording FROM ev WHERE type = 'recording_start'
  UNION ALL SELECT log, line_no, 'recording_index', CAST(index AS VARCHAR) FROM ev WHERE type = 'recording_start'
  UNION ALL SELECT log, line_no, 'recording_total', CAST(total AS VARCHAR) FROM ev WHERE type = 'recording_start'
  UNION ALL SELECT log, line_no, 'last_converted_recording', recording FROM ev WHERE type = 'converted'
  UNION ALL SELECT log, line_no, 'last_frames', CAST(frames AS VARCHAR) FROM ev WHERE type = 'converted'
  UNION ALL SELECT log, line_no, 'last_duration', CAST(duration AS VARCHAR) FROM ev WHERE type = 'converted'
  UNION ALL SELECT log, line_no, 'last_failed_recording', recording FROM ev WHERE type = 'failed'
  UNION ALL SELECT log, line_no, 'last_error_code', error_code FROM ev WHERE type = 'failed'
  UNION ALL SELECT log, line_no, 'last_error', reason FROM ev WHERE type = 'failed')
SELECT log, field, value FROM (SELECT *, row_number() OVER (PARTITION BY log, field ORDER BY line_no DESC) AS rn FROM sets) WHERE rn = 1""")
def job_progress_fold(s: Shapes):
    return live.job_progress_fold(_events(s))
