"""Queries over readers, the catalog, and what is written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kinetable.operators import annotations as ann
from kinetable.operators import stats
from kinetable.plans.registry import joined, query
from kinetable.plans.shapes import Shapes
from kinetable.settings import shared_folder
from kinetable.sources import catalog as cat
from kinetable.sources import datasets, sidecar, sinks

EP = ("dataset_key", "episode_index")


@query("SELECT count(*) AS frames, count(*) * (count(*) - 1) // 2 AS position_sum FROM lineitem")
def scan_frames(s: Shapes):
    frames = datasets.scan_frames(s.spark, f"{s.folder}/lineitem.parquet", ["l_orderkey"])
    return frames.agg(F.count("*").alias("frames"), F.sum("shard_row").alias("position_sum"))


@query()
def dataset_fingerprint(s: Shapes):
    files = datasets.file_inventory(s.spark, f"{s.folder}/*.parquet", s.folder)
    return datasets.dataset_fingerprint(files.withColumn("dataset_key", F.lit("supplied")), "dataset_key")


def _scratch(s: Shapes) -> str:
    """A new folder for one round trip, in the folder all executors share."""
    return f"{shared_folder(s.spark)}/round-trip-{uuid.uuid4().hex}"


@query("""SELECT e.dataset_key, e.episode_index, e.grade, e.length FROM episodes e
LEFT JOIN by_index i ON i.dataset_key = e.dataset_key AND i.episode_index = e.episode_index
WHERE coalesce(lower(trim(coalesce(i.grade, nullif(e.grade, '')))), '') <> 'bad'""")
def sink_export(s: Shapes):
    rows = ann.resolve_export(s.episodes, s.by_index)
    kept = ann.export_filter(rows, ["bad"]).select(*EP, "length", "chunk_index")
    path = _scratch(s)
    sinks.export_dataset(kept, s.episodes.select(*EP, "grade"), path, keys=list(EP))
    back = datasets.read_shards(s.spark, [f"{path}/episodes"])
    frames = datasets.read_shards(s.spark, [f"{path}/data"])
    return back.join(frames, list(EP)).select(*EP, "grade", "length")


@query("""SELECT 'odd' AS dataset, episode_index, CAST(length AS DOUBLE) AS length, NULL AS grade, serial AS "Serial_number" FROM episodes WHERE episode_index % 2 = 1
UNION ALL SELECT 'even', episode_index, CAST(length AS DOUBLE), grade, NULL FROM episodes WHERE episode_index % 2 = 0""")
def scan_episodes(s: Shapes):
    """Two datasets whose shards differ in columns and in the width of the length."""
    root = _scratch(s)
    i = F.col("episode_index")
    shard = "meta/episodes/chunk-000/file-000.parquet"
    odd = s.episodes.where(i % 2 == 1).select("episode_index", F.col("length").cast("int"), "Serial_number")
    even = s.episodes.where(i % 2 == 0).select("episode_index", F.col("length").cast("double"), "grade")
    sinks.write_new(odd, f"{root}/odd/{shard}")
    sinks.write_new(even, f"{root}/even/{shard}")
    found = datasets.scan_episodes(s.spark, [f"{root}/odd", f"{root}/even", f"{root}/none"])
    return found.select(
        F.element_at(F.split("dataset_path", "/"), -1).alias("dataset"),
        "episode_index", "length", "grade", "Serial_number")


@query("SELECT DISTINCT task_index, lang AS task FROM episodes")
def scan_tasks(s: Shapes):
    root = _scratch(s)
    rows = s.tasks.select("task_index", F.col("task").alias("instruction_text")).distinct()
    sinks.write_new(rows, f"{root}/meta/tasks.parquet")
    return datasets.scan_tasks(s.spark, root)


# --- catalog ------------------------------------------------------------------------

def _catalog(s: Shapes):
    return cat.place_in_cells(cat.drop_nested_datasets(cat.parse_info(s.info_documents)))


# src9's document is corrupt, src7 lies inside src6
_KNOWN = "dataset_key NOT IN ('src9', 'src7')"


@query(f"""SELECT '/mnt/' || cell_name || '/' || dataset_key AS dataset_path, '/mnt' AS mount_root, cell_name, dataset_key AS name, fps,
  total_episodes, total_frames, robot_type, 4 AS features, 'hello ' || dataset_key AS custom_field_1, '42' AS custom_field_2,
  sha256('/mnt/' || cell_name || '/' || dataset_key)[1:16] AS dataset_key FROM catalog WHERE {_KNOWN}""")
def scan_catalog(s: Shapes):
    return _catalog(s).select(
        "dataset_path", "mount_root", "cell_name", "name", "fps", "total_episodes", "total_frames", "robot_type",
        F.size("features").alias("features"), F.col("custom")["custom_field_1"].alias("custom_field_1"),
        F.col("custom")["custom_field_2"].alias("custom_field_2"), "dataset_key")


@query(f"""SELECT '/mnt' AS mount_root, cell_name, count(*) AS dataset_count FROM catalog WHERE {_KNOWN} GROUP BY cell_name
UNION ALL SELECT '/mnt', 'cell' || r_regionkey, 0 FROM region""")
def scan_cells(s: Shapes):
    catalog = _catalog(s)
    empty = s.table("region").select(F.lit("/mnt").alias("mount_root"), F.concat(F.lit("cell"), "r_regionkey").alias("cell_name"))
    return cat.scan_cells(catalog, catalog.select("mount_root", "cell_name").unionByName(empty))


def _columns(s: Shapes):
    """Episode columns per dataset; one dataset has no serials."""
    known = s.catalog.select("dataset_key")
    fields = [(n, t) for n, t in cat.schema_columns(s.episodes, skip=("dataset_key", "lang"))]
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("dtype")) for n, t in fields])
    return known.select("dataset_key", F.inline(pairs)).where(
        "dataset_key <> 'src4' or name <> 'Serial_number'")


@query(f"""
WITH known AS (SELECT sha256('/mnt/' || cell_name || '/' || dataset_key)[1:16] AS k FROM catalog WHERE {_KNOWN})
SELECT k AS dataset_key, 'info' AS kind, name, NULL AS dtype, name NOT LIKE 'custom%' AS is_system FROM known,
  (VALUES ('fps'), ('total_episodes'), ('total_frames'), ('robot_type'), ('features'), ('custom_field_1'), ('custom_field_2')) v(name)
UNION ALL SELECT k, 'feature', name, dtype, false FROM known, (VALUES ('observation.state', 'float32'), ('action', 'float32'),
  ('observation.images.cam_head', 'video'), ('observation.images.wrist', 'image')) v(name, dtype)
UNION ALL SELECT c.dataset_key, 'episode', name, dtype, sys FROM catalog c, (VALUES ('episode_index', 'int64', true), ('length', 'int64', true),
  ('dataset_from_index', 'int64', true), ('dataset_to_index', 'int64', true), ('task_index', 'int64', true), ('tasks', 'list<element: string>', false),
  ('chunk_index', 'int64', true), ('file_index', 'int64', true), ('Serial_number', 'string', false), ('grade', 'string', false),
  ('tags', 'list<element: string>', false)) v(name, dtype, sys) WHERE c.dataset_key <> 'src4' OR name <> 'Serial_number'""")
def column_inventory(s: Shapes):
    return cat.column_inventory(_catalog(s), _columns(s))


@query("""SELECT dataset_key, name, dtype, name = 'length' AS is_system FROM catalog, (VALUES ('length', 'int64'), ('grade', 'string'),
  ('tags', 'list[string]'), ('collection_date', 'date')) v(name, dtype) WHERE dataset_key <> 'src4' OR name <> 'collection_date'""")
def available_fields(s: Shapes):
    return cat.available_fields(_columns(s))


@query(f"""SELECT dataset_key AS name, 'owner=lab;site=B' AS changed, 'custom_field_2=42' AS removed FROM catalog WHERE {_KNOWN}""")
def info_update(s: Shapes):
    catalog = _catalog(s)
    changed = cat.info_update(cat.info_update(cat.info_update(catalog, "site", "A"), "site", "B"), "owner", "lab")
    text = lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    both = changed.select("name", text(F.map_filter("custom", lambda k, v: ~k.startswith("custom"))).alias("changed"))
    removed = cat.info_delete(cat.info_delete(catalog, "custom_field_1"), "never_there")
    return both.join(removed.select("name", text("custom").alias("removed")), "name")


@query(f"""SELECT sha256('/mnt/' || cell_name || '/' || dataset_key)[1:16] AS dataset_key, total_episodes, robot_type, fps, 4::BIGINT AS feature_count
FROM catalog WHERE {_KNOWN}""")
def dataset_summary(s: Shapes):
    return cat.dataset_summary(_catalog(s))


@query("""SELECT 'a' AS dataset_key, doc_id AS episode_index, CASE WHEN quality = 1 THEN 'good' END AS grade,
  CASE WHEN toxic = 1 THEN 'x|' || doc_id ELSE '' END AS tags FROM labels""")
def scan_sidecar(s: Shapes):
    """Sidecar text as written per annotated document, one of them corrupt."""
    i = F.col("doc_id").cast("string")
    good = F.concat(
        F.lit('{"'), i, F.lit('": {"grade": '), F.when(F.col("quality") == 1, '"good"').otherwise("null"),
        F.when(F.col("toxic") == 1, F.concat(F.lit(', "tags": ["x", "'), i, F.lit('"]'))).otherwise(""), F.lit("}}"))
    docs = s.table("labels").select(F.lit("a").alias("dataset_key"), good.alias("value"))
    broken = s.table("region").select(F.lit("b").alias("dataset_key"), F.lit('{"7": {"gra').alias("value"))
    return sidecar.explode_sidecar(docs.unionByName(broken), "dataset_key").withColumn("tags", joined("tags"))
