"""Queries over episodes and their annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.functions import grades, playback, serials, text
from kinetable.operators import annotations as ann
from kinetable.operators import distributions as dist
from kinetable.operators import episodes as ep
from kinetable.operators import stats
from kinetable.plans.registry import joined, query, r6
from kinetable.plans.shapes import Shapes

EP = ("dataset_key", "episode_index")

# the four overlay policies in SQL
_LIST = """
SELECT e.dataset_key, e.episode_index,
  CASE WHEN i.episode_index IS NOT NULL THEN i.grade WHEN a.serial_number IS NOT NULL THEN a.grade ELSE e.grade END AS grade,
  CASE WHEN i.episode_index IS NOT NULL THEN i.tags
       WHEN a.serial_number IS NOT NULL THEN coalesce(a.tags, CAST([] AS VARCHAR[]))
       ELSE coalesce(e.tags, CAST([] AS VARCHAR[])) END AS tags,
  CASE WHEN i.episode_index IS NOT NULL THEN i.reason WHEN a.serial_number IS NOT NULL THEN a.reason END AS reason,
  e.length, e.serial
FROM episodes e LEFT JOIN by_index i ON i.dataset_key = e.dataset_key AND i.episode_index = e.episode_index
LEFT JOIN annotations a ON a.serial_number = e.serial"""
_DIST = """
SELECT e.dataset_key, e.episode_index,
  CASE WHEN a.serial_number IS NOT NULL THEN a.grade WHEN i.episode_index IS NOT NULL THEN i.grade ELSE e.grade END AS grade,
  CASE WHEN a.serial_number IS NOT NULL THEN coalesce(a.tags, CAST([] AS VARCHAR[]))
       WHEN i.episode_index IS NOT NULL THEN i.tags ELSE coalesce(e.tags, CAST([] AS VARCHAR[])) END AS tags
FROM episodes e LEFT JOIN by_index i ON i.dataset_key = e.dataset_key AND i.episode_index = e.episode_index
LEFT JOIN annotations a ON a.serial_number = e.serial
UNION ALL
SELECT i.dataset_key, i.episode_index, i.grade, i.tags FROM by_index i
WHERE NOT EXISTS (SELECT 1 FROM episodes e WHERE e.dataset_key = i.dataset_key AND e.episode_index = i.episode_index)"""
_SUMMARY = """
SELECT e.*, CASE WHEN b.serial_number IS NOT NULL AND a.serial_number IS NOT NULL THEN a.grade
  ELSE coalesce(l.grade, e.grade) END AS final_grade
FROM episodes e
LEFT JOIN bridge b ON b.dataset_key = e.dataset_key AND b.episode_index = e.episode_index
LEFT JOIN annotations a ON a.serial_number = b.serial_number
LEFT JOIN legacy l ON l.dataset_key = e.dataset_key AND l.episode_index = e.episode_index"""
_KEYED = "CASE WHEN lower(trim({0})) IN ('good', 'normal', 'bad') THEN lower(trim({0})) ELSE '(ungraded)' END"
_EIGHT = "regexp_extract({0}, '^(\\d{{4}})(\\d{{2}})(\\d{{2}})', {1})"


def _date_sql(expr: str) -> str:
    parts = " || '-' || ".join(_EIGHT.format(expr, i) for i in (1, 2, 3))
    return f"CASE WHEN regexp_matches({expr}, '^\\d{{8}}') THEN {parts} END"


def listing(s: Shapes):
    return ann.resolve_episode_list(s.episodes, s.by_index, s.annotations)


def distribution(s: Shapes):
    return ann.resolve_distribution(s.episodes, s.by_index, s.annotations)


def summary(s: Shapes):
    return ann.resolve_summary(s.episodes, s.legacy, s.annotations)


# --- flagship: grade summary per dataset ------------------------------------

@query(f"""
WITH resolved AS ({_SUMMARY}),
graded AS (SELECT r.dataset_key, r.length, lower(trim(final_grade)) AS g FROM resolved r)
SELECT g.dataset_key, count(*) FILTER (g IN ('good', 'normal', 'bad')) AS graded_count,
  count(*) FILTER (g = 'good') AS good_count, count(*) FILTER (g = 'normal') AS normal_count,
  count(*) FILTER (g = 'bad') AS bad_count,
  round(sum(g.length) / any_value(CASE WHEN c.fps > 0 THEN c.fps ELSE 1 END), 6) AS total_duration_sec,
  round(coalesce(sum(g.length) FILTER (g = 'good'), 0) / any_value(CASE WHEN c.fps > 0 THEN c.fps ELSE 1 END), 6) AS good_duration_sec,
  round(coalesce(sum(g.length) FILTER (g = 'normal'), 0) / any_value(CASE WHEN c.fps > 0 THEN c.fps ELSE 1 END), 6) AS normal_duration_sec,
  round(coalesce(sum(g.length) FILTER (g = 'bad'), 0) / any_value(CASE WHEN c.fps > 0 THEN c.fps ELSE 1 END), 6) AS bad_duration_sec
FROM graded g JOIN catalog c ON c.dataset_key = g.dataset_key GROUP BY g.dataset_key""")
def dataset_grade_summary(s: Shapes):
    out = stats.dataset_grade_summary(summary(s), s.catalog)
    return out.select(*out.columns[:5], *[r6(c).alias(c) for c in out.columns[5:]])


# --- annotation joins ------------------------------------------------------------

@query("SELECT dataset_key, episode_index, serial_number, grade, array_to_string(tags, '|') AS tags, reason FROM known_index")
def annotation_by_index(s: Shapes):
    return ann.annotation_by_index(s.bridge, s.annotations).withColumn("tags", joined("tags"))


@query("""SELECT e.dataset_key, e.episode_index, a.grade, a.serial_number IS NOT NULL AS found
FROM episodes e LEFT JOIN annotations a ON a.serial_number = e.serial""")
def annotation_by_serial(s: Shapes):
    return ann.annotation_by_serial(s.episodes, s.annotations).select(
        *EP, F.col("by_serial.grade").alias("grade"), F.col("by_serial").isNotNull().alias("found"))


@query(f"SELECT dataset_key, episode_index, grade, array_to_string(tags, '|') AS tags, reason FROM ({_LIST})")
def resolve_episode_list(s: Shapes):
    return listing(s).select(*EP, "grade", joined("tags").alias("tags"), "reason")


@query(f"SELECT dataset_key, episode_index, grade, array_to_string(tags, '|') AS tags FROM ({_DIST})")
def resolve_distribution(s: Shapes):
    return distribution(s).select(*EP, "grade", joined("tags").alias("tags"))


@query("""SELECT e.dataset_key, e.episode_index, coalesce(i.grade, e.grade) AS grade
FROM episodes e LEFT JOIN by_index i ON i.dataset_key = e.dataset_key AND i.episode_index = e.episode_index""")
def resolve_export(s: Shapes):
    return ann.resolve_export(s.episodes, s.by_index).select(*EP, "grade")


@query(f"SELECT dataset_key, episode_index, final_grade AS grade FROM ({_SUMMARY})")
def resolve_summary(s: Shapes):
    return summary(s).select(*EP, "grade")


@query("""SELECT i.dataset_key, i.episode_index, i.grade FROM by_index i
WHERE (i.dataset_key, i.episode_index) NOT IN (SELECT dataset_key, episode_index FROM episodes)""")
def db_only_annotations(s: Shapes):
    return ann.db_only_annotations(s.episodes, s.by_index).select(*EP, "grade")


@query("SELECT dataset_key, episode_index, serial_number FROM bridge")
def bridge_first_serial(s: Shapes):
    return s.bridge


_FRESH = """
SELECT serial_number, grade, tags, reason FROM (
  SELECT b.serial_number, l.grade, l.tags, l.reason,
    row_number() OVER (PARTITION BY b.serial_number ORDER BY l.dataset_key, l.episode_index) AS rn
  FROM legacy l JOIN bridge b ON b.dataset_key = l.dataset_key AND b.episode_index = l.episode_index
  WHERE b.serial_number NOT IN (SELECT serial_number FROM annotations)) WHERE rn = 1"""


@query(f"""SELECT serial_number, grade, reason FROM annotations
UNION ALL SELECT serial_number, grade, reason FROM ({_FRESH})""")
def insert_if_absent(s: Shapes):
    return ann.insert_if_absent(s.legacy, s.bridge, s.annotations).select("serial_number", "grade", "reason")


@query("""SELECT l.dataset_key, count(*) AS legacy_rows, count(*) FILTER (b.serial_number IS NULL) AS no_serial,
  count(a.serial_number) AS already_annotated
FROM legacy l LEFT JOIN bridge b ON b.dataset_key = l.dataset_key AND b.episode_index = l.episode_index
LEFT JOIN annotations a ON a.serial_number = b.serial_number GROUP BY l.dataset_key""")
def legacy_migration_counts(s: Shapes):
    return ann.migration_counts(s.legacy, s.bridge, s.annotations)


@query(f"""SELECT coalesce(n.serial_number, a.serial_number) AS serial_number,
  CASE WHEN n.serial_number IS NOT NULL THEN n.grade ELSE a.grade END AS grade,
  CASE WHEN n.serial_number IS NOT NULL THEN n.reason ELSE a.reason END AS reason,
  CASE WHEN a.serial_number IS NOT NULL THEN CAST(a.updated_at AS VARCHAR) END AS updated_at
FROM annotations a FULL JOIN (
  SELECT serial_number, arg_min(grade, (dataset_key, episode_index)) AS grade,
    arg_min(reason, (dataset_key, episode_index)) AS reason FROM (
    SELECT b.serial_number, l.* FROM legacy l JOIN bridge b
      ON b.dataset_key = l.dataset_key AND b.episode_index = l.episode_index
    WHERE l.grade = 'bad') GROUP BY serial_number) n ON n.serial_number = a.serial_number""")
def merge_upsert(s: Shapes):
    new = s.legacy.where("grade = 'bad'").join(s.bridge, list(EP)).groupBy("serial_number").agg(
        F.min_by(F.struct("grade", "reason"), F.struct(*EP)).alias("r")).select("serial_number", "r.*")
    out = ann.merge_upsert(s.annotations, new, ["serial_number"])
    return out.select("serial_number", "grade", "reason", F.col("updated_at").cast("string").alias("updated_at"))


_UPDATES = """
SELECT dataset_key, episode_index, CASE episode_index % 5 WHEN 0 THEN 'good' WHEN 1 THEN 'bad' WHEN 2 THEN 'normal'
    WHEN 3 THEN 'excellent' END AS grade,
  CASE WHEN episode_index % 7 = 0 THEN '  ' WHEN episode_index % 7 < 5 THEN 'because ' || (episode_index % 7) END AS reason,
  CASE WHEN episode_index % 2 = 0 THEN [' a ', '', lang] END AS tags
FROM episodes"""


def _updates(s: Shapes):
    i = F.col("episode_index")
    return s.episodes.select(
        *EP, F.when(i % 5 == 0, "good").when(i % 5 == 1, "bad").when(i % 5 == 2, "normal").when(
            i % 5 == 3, "excellent").alias("grade"),
        F.when(i % 7 == 0, "  ").when(i % 7 < 5, F.concat(F.lit("because "), i % 7)).alias("reason"),
        F.when(i % 2 == 0, F.array(F.lit(" a "), F.lit(""), "lang")).alias("tags"))


@query(f"""SELECT dataset_key, episode_index, grade, CASE WHEN grade IN ('bad', 'normal') THEN reason END AS reason,
  array_to_string(list_filter(list_transform(tags, lambda t: trim(t)), lambda t: t <> ''), '|') AS tags,
  grade IS NULL OR (grade IN ('good', 'bad', 'normal') AND (grade = 'good' OR coalesce(trim(reason), '') <> '')) AS valid
FROM ({_UPDATES})""")
def grade_update_rules(s: Shapes):
    return ann.grade_updates(_updates(s)).select(*EP, "grade", "reason", joined("tags").alias("tags"), "valid")


@query(f"""
WITH ready AS (SELECT b.serial_number, u.grade, u.tags, CASE WHEN u.grade IN ('bad', 'normal') THEN u.reason END AS reason
  FROM ({_UPDATES}) u JOIN bridge b ON b.dataset_key = u.dataset_key AND b.episode_index = u.episode_index
  WHERE u.grade IS NULL OR u.grade = 'good' OR (u.grade IN ('bad', 'normal') AND trim(u.reason) <> '')
  QUALIFY row_number() OVER (PARTITION BY b.serial_number ORDER BY u.dataset_key DESC, u.episode_index DESC) = 1)
SELECT coalesce(r.serial_number, a.serial_number) AS serial_number,
  CASE WHEN r.serial_number IS NOT NULL THEN r.grade ELSE a.grade END AS grade,
  CASE WHEN r.serial_number IS NOT NULL THEN r.reason ELSE a.reason END AS reason,
  array_to_string(CASE WHEN r.tags IS NOT NULL THEN list_filter(list_transform(r.tags, lambda t: trim(t)), lambda t: t <> '')
    WHEN r.serial_number IS NOT NULL THEN coalesce(a.tags, CAST([] AS VARCHAR[])) ELSE a.tags END, '|') AS tags
FROM ready r FULL JOIN annotations a ON a.serial_number = r.serial_number""")
def apply_grade_updates(s: Shapes):
    return ann.apply_grade_updates(s.annotations, _updates(s), s.bridge).select(
        "serial_number", "grade", "reason", joined("tags").alias("tags"))


@query("""
WITH ids AS (SELECT b.serial_number FROM episodes e JOIN bridge b ON b.dataset_key = e.dataset_key
    AND b.episode_index = e.episode_index WHERE e.length % 3 = 0 GROUP BY b.serial_number)
SELECT coalesce(i.serial_number, a.serial_number) AS serial_number,
  CASE WHEN i.serial_number IS NOT NULL THEN 'bad' ELSE a.grade END AS grade,
  CASE WHEN i.serial_number IS NOT NULL THEN 'dropped object' ELSE a.reason END AS reason,
  array_to_string(coalesce(a.tags, CAST([] AS VARCHAR[])), '|') AS tags
FROM ids i FULL JOIN annotations a ON a.serial_number = i.serial_number""")
def bulk_grade(s: Shapes):
    ids = s.episodes.where("length % 3 = 0")
    now = F.to_timestamp(F.lit("2024-06-01 00:00:00"))
    return ann.bulk_grade(s.annotations, ids, s.bridge, "bad", "dropped object", now).select(
        "serial_number", "grade", "reason", joined("tags").alias("tags"))


@query("""SELECT e.dataset_key, e.episode_index FROM episodes e ANTI JOIN bridge b
ON b.dataset_key = e.dataset_key AND b.episode_index = e.episode_index""")
def unmapped_episodes(s: Shapes):
    return ann.unmapped_episodes(s.episodes, s.bridge)


@query(f"""SELECT dataset_key, grade IS NOT NULL AS restore, grade,
  CASE WHEN grade IS NOT NULL THEN reason END AS reason, count(*) AS group_size
FROM ({_LIST}) GROUP BY ALL""")
def undo_groups(s: Shapes):
    return ann.undo_groups(listing(s))


@query(f"""SELECT dataset_key, episode_index, grade IS NOT NULL AS restore, grade,
  CASE WHEN grade IS NOT NULL THEN reason END AS reason FROM ({_LIST})""")
def undo_members(s: Shapes):
    return ann.undo_members(listing(s))


# --- episode rows, filters -----------------------------------------------------

@query(f"""SELECT e.dataset_key, e.episode_index, e.dataset_to_index - e.dataset_from_index AS length,
  e.task_index, e.lang AS task_instruction, e.chunk_index, e.file_index, e.dataset_from_index, e.dataset_to_index,
  e.grade, array_to_string(coalesce(e.tags, CAST([] AS VARCHAR[])), '|') AS tags,
  {_date_sql("replace(trim(e.serial), '-', '')")} AS created_at FROM episodes e""")
def resolve_episode_row(s: Shapes):
    out = ep.resolve_episode_row(s.stored_episodes, s.tasks)
    return out.withColumn("tags", joined("tags")).drop("reason", "raw_recording", "Serial_number")


@query("""SELECT dataset_key, episode_index, CASE WHEN lang = 'de' THEN 0 ELSE task_index END AS task_index,
  lang AS task_instruction FROM episodes""")
def resolve_episode_task_list(s: Shapes):
    listed = s.episodes.drop("task_index")
    return ep.resolve_episode_row(listed, s.tasks.where("task <> 'de'")).select(
        *EP, "task_index", "task_instruction")


@query("""SELECT t.dataset_key, t.task_index, t.task, count(e.episode_index) AS episodes FROM tasks t
LEFT JOIN episodes e ON e.dataset_key = t.dataset_key AND e.task_index = t.task_index GROUP BY ALL""")
def task_join(s: Shapes):
    rows = s.episodes.select(*EP, "task_index").join(s.tasks, ["dataset_key", "task_index"], "right")
    return rows.groupBy("dataset_key", "task_index", "task").agg(F.count("episode_index").alias("episodes"))


@query("""SELECT dataset_key, episode_index, chunk_index AS data_chunk, file_index AS data_file,
  CASE WHEN episode_index % 4 <> 0 THEN 1 ELSE 0 END + CASE WHEN episode_index % 3 = 0 THEN 1 ELSE 0 END AS cameras,
  CASE WHEN episode_index % 4 <> 0 THEN episode_index // 100 END AS head_chunk,
  CASE WHEN episode_index % 3 = 0 THEN 0::BIGINT END AS wrist_file FROM episodes""")
def episode_file_location(s: Shapes):
    out = ep.episode_file_location(s.stored_episodes)
    entry = lambda camera, field: F.try_element_at("videos", F.lit(camera))[field]
    return out.select(
        *EP, F.col("data_chunk_index").alias("data_chunk"), F.col("data_file_index").alias("data_file"),
        F.size("videos").alias("cameras"),
        entry("observation.images.cam_head", "chunk").alias("head_chunk"),
        entry("observation.images.wrist", "file").alias("wrist_file"))


_ROW = f"SELECT *, coalesce(tags, CAST([] AS VARCHAR[])) AS t FROM episodes"


def _rows(s: Shapes):
    return s.episodes.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


@query("SELECT dataset_key, episode_index, length FROM episodes WHERE length >= 500 AND length < 2000 AND list_contains(tags, 'en')")
def curate_filter(s: Shapes):
    return ep.curate_filter(_rows(s), (500, 2000), "en").select(*EP, "length")


@query("""SELECT 'good' AS choice, count(*) FILTER (grade = 'good') AS n FROM episodes
UNION ALL SELECT 'ungraded', count(*) FILTER (grade IS NULL OR grade = '') FROM episodes
UNION ALL SELECT 'all', count(*) FROM episodes""")
def grade_filter(s: Shapes):
    counts = [ep.grade_filter(s.episodes, c).agg(F.count("*").alias("n")).select(F.lit(c).alias("choice"), "n")
              for c in ("good", "ungraded", "all")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(f"SELECT dataset_key, {_KEYED.format('grade')} AS grade_key, count(*) AS n FROM episodes GROUP BY ALL")
def grade_key(s: Shapes):
    return s.episodes.groupBy("dataset_key", grades.grade_key(F.col("grade")).alias("grade_key")).agg(
        F.count("*").alias("n"))


@query(f"SELECT dataset_key, episode_index FROM episodes WHERE {_KEYED.format('grade')} = '(ungraded)'")
def episodes_for_grade_key(s: Shapes):
    return ep.episodes_for_grade_key(s.episodes, "(ungraded)").select(*EP)


@query("""SELECT dataset_key, episode_index FROM episodes
WHERE coalesce(grade, 'Ungraded') IN ('good', 'Ungraded') AND list_has_any(tags, ['en', 'src-tag'])""")
def out_filter(s: Shapes):
    return ep.out_filter(_rows(s), ["good", "Ungraded"], ["en", "src-tag"]).select(*EP)


@query("SELECT dataset_key, episode_index FROM episodes WHERE coalesce(grade, 'Ungraded') = 'Ungraded'")
def delete_filter(s: Shapes):
    return ep.delete_filter(_rows(s), grades=["Ungraded"]).select(*EP)


@query("""SELECT dataset_key, count(*) AS episodes, count(*) FILTER (list_has_any(tags, ['src-tag'])) AS matched,
  count(*) FILTER (list_has_any(tags, ['src-tag'])) IN (0, count(*)) AS refused FROM episodes GROUP BY dataset_key""")
def delete_guard(s: Shapes):
    rows = _rows(s)
    return ep.delete_guard(rows, ep.delete_filter(rows, tags=["src-tag"]))


@query("""SELECT e.dataset_key, e.episode_index FROM episodes e
LEFT JOIN by_index i ON i.dataset_key = e.dataset_key AND i.episode_index = e.episode_index
WHERE coalesce(lower(trim(coalesce(i.grade, nullif(e.grade, '')))), '') NOT IN ('bad', 'undefined')""")
def export_filter(s: Shapes):
    rows = ann.resolve_export(s.episodes, s.by_index)
    return ann.export_filter(rows, [" Bad", "UNDEFINED"]).select(*EP)


@query(f"""SELECT dataset_key, episode_index, reason FROM ({_LIST})
WHERE grade = 'normal' AND regexp_matches(coalesce(reason, ''), '(?i)FLICKER.*[1-4]$')
ORDER BY dataset_key, episode_index LIMIT 20""")
def reason_regex_select(s: Shapes):
    return ep.reason_regex_select(listing(s), "normal", "FLICKER.*[1-4]$", limit=20).select(*EP, "reason")


@query("SELECT dataset_key, episode_index, length, grade FROM episodes WHERE episode_index = 42")
def point_lookup(s: Shapes):
    return ep.point_lookup(s.episodes, episode_index=42).select(*EP, "length", "grade")


@query(f"SELECT DISTINCT dataset_key, unnest(tags) AS tag FROM ({_LIST})")
def distinct_tags(s: Shapes):
    return ep.distinct_tags(listing(s))


_ISLANDS = """
SELECT dataset_key, min(p) AS start, max(p) AS "end" FROM (
  SELECT dataset_key, p, p - row_number() OVER (PARTITION BY dataset_key ORDER BY p) AS island
  FROM (SELECT DISTINCT dataset_key, episode_index // 20 AS p FROM episodes WHERE length % 3 > 0))
GROUP BY dataset_key, island"""


def _chosen(s: Shapes):
    return s.episodes.where("length % 3 > 0").select(
        "dataset_key", F.floor(F.col("episode_index") / 20).alias("episode_index"))


@query(_ISLANDS)
def episode_ranges(s: Shapes):
    return ep.episode_ranges(_chosen(s))


@query(f"""SELECT dataset_key, CAST(floor(rn / 1000) AS BIGINT) AS line, string_agg(label, ', ' ORDER BY start) AS ranges,
  count(*) AS range_count FROM (
    SELECT dataset_key, start, row_number() OVER (PARTITION BY dataset_key ORDER BY start) - 1 AS rn,
      CASE WHEN start = "end" THEN CAST(start AS VARCHAR) ELSE start || '-' || "end" END AS label
    FROM ({_ISLANDS})) GROUP BY ALL""")
def episode_ranges_text(s: Shapes):
    return ep.episode_ranges_text(_chosen(s), per_line=1000)


# --- distributions -----------------------------------------------------------------

_BINNED = """
SELECT *, CASE WHEN hi = lo THEN 0 ELSE len(list_filter(range(1, 20), lambda k: length >= lo + k * ((hi - lo) / 20.0))) END AS bin
FROM (SELECT e.*, CAST(min(length) OVER w AS DOUBLE) AS lo, CAST(max(length) OVER w AS DOUBLE) AS hi,
        count(*) OVER w AS total FROM episodes e WINDOW w AS (PARTITION BY dataset_key))"""


@query(f"""SELECT dataset_key, CAST(bin AS INTEGER) AS bin, count(*) AS count, any_value(total) AS total,
  round(any_value(lo + bin * ((hi - lo) / 20.0)), 6) AS bin_lo,
  round(any_value(CASE WHEN bin = 19 OR hi = lo THEN hi ELSE lo + (bin + 1) * ((hi - lo) / 20.0) END), 6) AS bin_hi
FROM ({_BINNED}) GROUP BY dataset_key, bin""")
def dist_histogram(s: Shapes):
    return dist.dist_histogram(s.episodes, "length").select(
        "dataset_key", "bin", "count", "total", r6("bin_lo").alias("bin_lo"), r6("bin_hi").alias("bin_hi"))


@query("""SELECT dataset_key, coalesce(grade, '(null)') AS label, count(*) AS count,
  CAST(sum(count(*)) OVER (PARTITION BY dataset_key) AS BIGINT) AS total FROM episodes GROUP BY dataset_key, grade""")
def dist_categorical(s: Shapes):
    return dist.dist_categorical(s.episodes, "grade")


@query(f"""SELECT 'length' AS field, dataset_key, CAST(bin AS VARCHAR) AS label, count(*) AS count FROM ({_BINNED}) GROUP BY ALL
UNION ALL SELECT 'lang', dataset_key, lang, count(*) FROM episodes GROUP BY ALL
UNION ALL SELECT 'task_index as bar', dataset_key, CAST(task_index AS VARCHAR), count(*) FROM episodes GROUP BY ALL""")
def dist_auto(s: Shapes):
    e = s.episodes
    part = lambda name, df, label: df.select(
        F.lit(name).alias("field"), "dataset_key", F.col(label).cast("string").alias("label"), "count")
    return (
        part("length", dist.dist_auto(e, "length"), "bin")
        .unionByName(part("lang", dist.dist_auto(e, "lang"), "label"))
        .unionByName(part("task_index as bar", dist.dist_auto(e, "task_index", "bar"), "label")))


@query(f"""SELECT dataset_key, CASE WHEN grade IS NULL OR grade = '' THEN '(ungraded)' ELSE lower(trim(grade)) END AS label,
  count(*) AS count, CAST(sum(count(*)) OVER (PARTITION BY dataset_key) AS BIGINT) AS total FROM ({_DIST}) GROUP BY dataset_key, label""")
def dist_grade(s: Shapes):
    return dist.dist_grade(distribution(s))


@query(f"""
WITH rows AS ({_DIST}),
named AS (SELECT dataset_key, tag AS label, count(*) AS count FROM (SELECT dataset_key, unnest(tags) AS tag FROM rows) GROUP BY ALL),
bare AS (SELECT dataset_key, count(*) AS n FROM rows WHERE len(tags) = 0 GROUP BY ALL)
SELECT x.dataset_key, label, count, total FROM (
  SELECT n.dataset_key, label, count FROM named n LEFT JOIN bare b ON b.dataset_key = n.dataset_key AND label = '(no tags)'
  WHERE b.n IS NULL UNION ALL SELECT dataset_key, '(no tags)', n FROM bare) x
JOIN (SELECT dataset_key, count(*) AS total FROM rows GROUP BY dataset_key) t ON t.dataset_key = x.dataset_key""")
def dist_tags(s: Shapes):
    return dist.dist_tags(distribution(s))


@query(f"""SELECT dataset_key, coalesce({_date_sql("replace(replace(trim(serial), '-', ''), '_', '')")}, '(unknown)') AS label,
  count(*) AS count, CAST(sum(count(*)) OVER (PARTITION BY dataset_key) AS BIGINT) AS total FROM episodes GROUP BY dataset_key, label""")
def dist_collection_date(s: Shapes):
    return dist.dist_collection_date(s.episodes)


@query(f"""SELECT dataset_key, CAST(bin AS INTEGER) AS bin, count(*) FILTER (grade = 'good') AS good,
  count(*) FILTER (grade = 'normal') AS normal, count(*) FILTER (grade = 'bad') AS bad
FROM ({_BINNED}) GROUP BY dataset_key, bin""")
def bin_grade_crosstab(s: Shapes):
    return dist.bin_grade_crosstab(s.episodes)


@query(f"""SELECT dataset_key, tag, count(*) FILTER (grade = 'good') AS good, count(*) FILTER (grade = 'normal') AS normal,
  count(*) FILTER (grade = 'bad') AS bad FROM (SELECT dataset_key, grade, unnest(list_distinct(tags)) AS tag FROM ({_LIST})) GROUP BY ALL""")
def tag_grade_crosstab(s: Shapes):
    return dist.tag_grade_crosstab(listing(s))


# --- statistics ----------------------------------------------------------------------

@query("""
WITH owned AS (SELECT b.dataset_key, a.grade, CASE WHEN a.serial_number IS NOT NULL THEN e.length END AS n
  FROM bridge b JOIN episodes e ON e.dataset_key = b.dataset_key AND e.episode_index = b.episode_index
  LEFT JOIN annotations a ON a.serial_number = b.serial_number)
SELECT c.dataset_key, count(grade) AS graded_count, count(*) FILTER (grade = 'good') AS good_count,
  count(*) FILTER (grade = 'normal') AS normal_count, count(*) FILTER (grade = 'bad') AS bad_count,
  round(CASE WHEN c.fps > 0 THEN coalesce(sum(n), 0) / c.fps ELSE 0 END, 6) AS total_duration_sec,
  round(CASE WHEN c.fps > 0 THEN coalesce(sum(n) FILTER (grade = 'good'), 0) / c.fps ELSE 0 END, 6) AS good_duration_sec,
  round(CASE WHEN c.fps > 0 THEN coalesce(sum(n) FILTER (grade = 'normal'), 0) / c.fps ELSE 0 END, 6) AS normal_duration_sec,
  round(CASE WHEN c.fps > 0 THEN coalesce(sum(n) FILTER (grade = 'bad'), 0) / c.fps ELSE 0 END, 6) AS bad_duration_sec
FROM catalog c LEFT JOIN owned o ON o.dataset_key = c.dataset_key GROUP BY c.dataset_key, c.fps""")
def refresh_stats(s: Shapes):
    out = stats.refresh_stats(s.bridge, s.annotations, s.episodes, s.catalog)
    return out.select(*out.columns[:5], *[r6(c).alias(c) for c in out.columns[5:]])


@query(f"""
WITH rows AS (SELECT dataset_key, {_KEYED.format('grade')} AS grade_key, length FROM ({_LIST})),
cards AS (SELECT c.dataset_key, c.fps, k.grade_key FROM catalog c, (VALUES ('good'), ('normal'), ('bad'), ('(ungraded)')) k(grade_key))
SELECT c.dataset_key, c.grade_key, count(r.length) AS count,
  round(CASE WHEN c.fps > 0 THEN coalesce(sum(r.length), 0) / c.fps ELSE 0 END, 6) AS seconds,
  (SELECT count(*) FROM rows t WHERE t.dataset_key = c.dataset_key) AS total,
  CAST(floor(count(r.length) * 100.0 / (SELECT count(*) FROM rows t WHERE t.dataset_key = c.dataset_key) + 0.5) AS BIGINT) AS percent
FROM cards c LEFT JOIN rows r ON r.dataset_key = c.dataset_key AND r.grade_key = c.grade_key
GROUP BY c.dataset_key, c.fps, c.grade_key""")
def grade_summary_cards(s: Shapes):
    return stats.grade_summary_cards(listing(s), s.catalog).withColumn("seconds", r6("seconds"))


# --- scalar functions -------------------------------------------------------------

@query(f"""SELECT dataset_key, episode_index, {_date_sql("replace(trim(serial), '-', '')")} AS created_at,
  CASE WHEN regexp_full_match(serial, '\\d{{8}}_\\d{{6}}(_\\d+)?') THEN {_date_sql('serial')} END AS raw_created_at FROM episodes""")
def serial_dates(s: Shapes):
    n = F.col("Serial_number")
    return s.episodes.select(
        *EP, serials.created_at(n).alias("created_at"), serials.raw_created_at(n).alias("raw_created_at"))


@query("""SELECT serial, CASE WHEN regexp_full_match(serial, '[1-9]\\d{7}_\\d{6}')
    AND try_strptime(serial, '%Y%m%d_%H%M%S') IS NOT NULL
  THEN serial[1:4] || '-' || serial[5:6] || '-' || serial[7:8] END AS recorded FROM recordings""")
def strict_recording_date(s: Shapes):
    return s.recordings.select("serial", serials.strict_recording_date(F.col("serial")).alias("recorded"))


@query("""SELECT cell_task, serial, cell_task || '/' || serial AS recording,
  CASE WHEN trim(regexp_replace(brand || ' #1', '[^A-Za-z0-9]+', '_', 'g'), '_') = '' THEN 'unknown'
    ELSE trim(regexp_replace(brand || ' #1', '[^A-Za-z0-9]+', '_', 'g'), '_') END AS slug,
  sha256(cell_task || '/' || serial)[1:16] AS dataset_key, 'raw-' || sha256(cell_task || '/' || serial)[1:16] AS raw_key
FROM recordings""")
def keys_and_slugs(s: Shapes):
    rec = F.concat_ws("/", "cell_task", "serial")
    return s.recordings.select(
        serials.task_from_recording(rec).alias("cell_task"),
        serials.serial_from_recording(rec).alias("serial"), rec.alias("recording"),
        text.slug(F.concat("brand", F.lit(" #1"))).alias("slug"),
        text.dataset_key(rec).alias("dataset_key"), text.raw_dataset_key(rec).alias("raw_key"))


@query("""SELECT dataset_key, episode_index, CAST(to_json(coalesce(tags, CAST([] AS VARCHAR[]))) AS VARCHAR) AS tags_json,
  array_to_string(coalesce(tags, CAST([] AS VARCHAR[])), '|') AS tags FROM episodes""")
def tags_json(s: Shapes):
    rows = s.episodes.select(*EP, text.tags_to_json(F.col("tags")).alias("tags_json"))
    return rows.withColumn("tags", joined(text.tags_from_json(F.col("tags_json"))))


@query("""
WITH b AS (SELECT *, episode_index % 10 * 1.0 AS s, CASE WHEN episode_index % 6 IN (0, 1) THEN NULL ELSE episode_index % 7 * 1.0 END AS e,
    CASE WHEN episode_index % 9 = 0 THEN 0 ELSE 30 END AS fps, length / 7.0 AS t FROM episodes),
c AS (SELECT *, CASE WHEN e > s THEN e WHEN length > 0 AND fps > 0 THEN s + length / 30.0 WHEN 50.0 > s THEN 50.0 END AS bound FROM b),
d AS (SELECT *, CASE WHEN fps > 0 THEN greatest(s, bound - 1 / 30.0) ELSE bound END AS playable FROM c)
SELECT dataset_key, episode_index, round(bound, 6) AS boundary, round(playable, 6) AS playable_end,
  round(greatest(s, least(t, playable)), 6) AS clamped, t >= bound - 0.002 AS crossed,
  CASE WHEN fps > 0 THEN greatest(0, CAST(floor((t - s) * 30 + 0.0001) AS BIGINT)) ELSE 0 END AS frame FROM d""")
def playback_bounds(s: Shapes):
    i = F.col("episode_index")
    start, end = (i % 10).cast("double"), F.when(i % 6 == 0, float("nan")).when(
        i % 6 == 1, None).otherwise((i % 7).cast("double"))
    fps, t = F.when(i % 9 == 0, 0).otherwise(30), F.col("length") / 7.0
    bound = playback.boundary(start, end, F.col("length"), fps, F.lit(50.0))
    rows = s.episodes.select(*EP, "length", start.alias("s"), fps.alias("fps"), t.alias("t"), bound.alias("b"))
    rows = rows.withColumn("p", playback.playable_end(F.col("s"), F.col("b"), F.col("fps")))
    return rows.select(
        *EP, r6("b").alias("boundary"), r6("p").alias("playable_end"),
        r6(playback.clamp_time(F.col("t"), F.col("s"), F.col("p"))).alias("clamped"),
        playback.crossed(F.col("t"), F.col("b")).alias("crossed"),
        playback.frame_at(F.col("t"), F.col("s"), F.col("fps")).alias("frame"))
