"""The supplied tables seen as episodes, frames, annotations, recordings and logs.

Only views: every row here is computed by Spark from the given Parquet files.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetable.operators.annotations import annotation_by_index, first_serial_owner
from kinetable.settings import prepare
from kinetable.sources.datasets import read_shards

TS = "yyyy-MM-dd HH:mm:ss"


def _id_serial(doc_id: Column) -> Column:
    """Recording serial of a document number."""
    return F.format_string("202401%02d_%06d", F.lit(1) + doc_id % 28, doc_id)


def _serial(doc_id: Column) -> Column:
    """Serial with gaps, empty ones, repeats inside a source, and names ending in _2."""
    turn = F.floor(doc_id / 20) % 7
    return (
        F.when(doc_id % 17 == 5, None).when(doc_id % 19 == 4, "")
        .when(turn.isin(1, 2), _id_serial(doc_id - 20 * turn))
        .when((turn == 3) & (doc_id % 3 == 0), F.concat(_id_serial(doc_id - 60), F.lit("_2")))
        .otherwise(_id_serial(doc_id)))


class Shapes:
    """Lazily built views over one folder of supplied tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return read_shards(self.spark, [f"{self.folder}/{name}.parquet"])

    # --- episodes and annotations -------------------------------------------

    @cached_property
    def episodes(self) -> DataFrame:
        docs = self.table("documents").select("doc_id", "source", "lang", "n_chars")
        df = docs.join(self.table("labels"), "doc_id", "left")
        i, lang, size = F.col("doc_id"), F.col("lang"), F.col("n_chars")
        task = F.when(lang == "en", 0).when(lang == "de", 1).when(lang == "es", 2).when(
            lang == "fr", 3).otherwise(4)
        grade = (
            F.when(i % 11 == 0, " GOOD ").when(i % 13 == 0, "undefined").when(i % 29 == 0, "   ")
            .when(F.col("quality") == 0, "bad").when(F.col("toxic") == 1, "normal")
            .when(F.col("quality") == 1, "good"))
        tags = (
            F.when(i % 31 == 0, F.array(F.lit("(no tags)"))).when(size % 5 == 0, None)
            .when(size % 5 == 1, F.array().cast("array<string>")).when(size % 5 == 2, F.array(lang))
            .when(size % 5 == 3, F.array(lang, F.lit("src-tag"))).otherwise(F.array(lang, lang)))
        return df.select(
            F.col("source").alias("dataset_key"), i.alias("episode_index"), size.alias("length"),
            (i % 5).alias("dataset_from_index"), (i % 5 + size - i % 2).alias("dataset_to_index"),
            task.cast("bigint").alias("task_index"), F.array(lang).alias("tasks"), lang.alias("lang"),
            F.floor(i / 1000).alias("chunk_index"), (i % 1000).alias("file_index"),
            _serial(i).alias("Serial_number"), grade.alias("grade"), tags.alias("tags"))

    @cached_property
    def stored_episodes(self) -> DataFrame:
        """Episodes in their stored column names, with two cameras on some."""
        e = self.episodes
        i = F.col("episode_index")
        head, wrist = "videos/observation.images.cam_head", "videos/observation.images.wrist"
        only = lambda cond, col: F.when(cond, col)
        return e.select(
            "dataset_key", "episode_index", "length", "task_index", "grade", "tags", "Serial_number",
            "dataset_from_index", "dataset_to_index",
            F.col("chunk_index").alias("data/chunk_index"), F.col("file_index").alias("data/file_index"),
            only(i % 4 != 0, F.floor(i / 100)).alias(f"{head}/chunk_index"),
            only(i % 4 != 0, i % 100).alias(f"{head}/file_index"),
            only(i % 4 != 0, (i % 10).cast("double")).alias(f"{head}/from_timestamp"),
            F.when(i % 6 == 0, float("nan")).when(i % 6 == 1, None).otherwise(
                (i % 7).cast("double")).alias(f"{head}/to_timestamp"),
            only(i % 3 == 0, i % 5).alias(f"{wrist}/chunk_index"),
            F.lit(None).cast("bigint").alias(f"{wrist}/file_index"))

    @cached_property
    def tasks(self) -> DataFrame:
        return self.episodes.select(
            "dataset_key", "task_index", F.col("lang").alias("task")).distinct()

    @cached_property
    def catalog(self) -> DataFrame:
        short = F.length("dataset_key") <= 4
        return self.episodes.groupBy("dataset_key").agg(
            F.count("*").alias("total_episodes"), F.sum("length").alias("total_frames")).select(
            "dataset_key", "total_episodes", "total_frames",
            F.when(F.col("dataset_key") == "src5", 0).when(short, 30).otherwise(25).cast("double").alias("fps"),
            F.when(short, "so100").otherwise("koch").alias("robot_type"),
            F.when(short, "cell004").otherwise("cell005").alias("cell_name"))

    @cached_property
    def info_documents(self) -> DataFrame:
        """Info documents: one nested below another dataset, one corrupt, some with padding."""
        c = self.catalog
        k = F.col("dataset_key")
        feature = lambda dtype, size: F.struct(F.lit(dtype).alias("dtype"), F.array(F.lit(size)).alias("shape"))
        features = F.to_json(F.struct(
            feature("float32", 16).alias("observation.state"), feature("float32", 16).alias("action"),
            feature("video", 3).alias("observation.images.cam_head"),
            feature("image", 3).alias("observation.images.wrist")))
        text = F.concat(
            F.format_string('{"fps": %d, "total_episodes": %d, "total_frames": %d, "robot_type": "%s", ',
                            F.col("fps").cast("int"), "total_episodes", "total_frames", "robot_type"),
            F.lit('"features": '), features, F.lit(', "custom_field_1": "hello '), k,
            F.lit('", "custom_field_2": 42}'), F.when(k == "src3", "\u0000\u0000").otherwise(""))
        name = F.when(k == "src7", "src6/inner/src7").otherwise(k)
        return c.select(
            F.concat(F.lit("/mnt/"), "cell_name", F.lit("/"), name).alias("dataset_path"),
            F.when(k == "src9", '{"fps": 3').otherwise(text).alias("info_text"))

    @cached_property
    def annotations(self) -> DataFrame:
        rows = self.table("labels").where("doc_id % 3 = 0").withColumn("serial_number", _serial(F.col("doc_id")))
        first = rows.where("serial_number <> ''").groupBy("serial_number").agg(
            F.min(F.struct("doc_id", "quality", "toxic")).alias("r")).select("serial_number", "r.*")
        i = F.col("doc_id")
        code = (i + F.col("quality") + 2 * F.col("toxic")) % 4
        grade = F.when(code == 0, "good").when(code == 1, "normal").when(code == 2, "bad")
        tags = F.when(i % 4 == 0, F.array().cast("array<string>")).when(
            i % 4 == 1, F.array(F.lit("reviewed"))).when(
            i % 4 == 2, F.array(F.lit("reviewed"), F.lit("recheck")))
        reason = F.when(code.isin(1, 2), F.concat(F.lit("Flicker seen "), (i % 10).cast("string"))).when(
            i % 2 == 0, "")
        stamp = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-03-01 00:00:00")) + i * 60)
        return first.select("serial_number", grade.alias("grade"), tags.alias("tags"),
                            reason.alias("reason"), stamp.alias("updated_at"))

    @cached_property
    def bridge(self) -> DataFrame:
        return first_serial_owner(self.episodes)

    @cached_property
    def by_index(self) -> DataFrame:
        """Annotations by episode, plus some for episodes that are not in the tables."""
        known = annotation_by_index(self.bridge, self.annotations)
        extra = known.where("episode_index % 8 = 0").withColumn(
            "episode_index", -F.col("episode_index") - 1)
        return known.unionByName(extra).drop("serial_number")

    @cached_property
    def legacy(self) -> DataFrame:
        docs = self.table("documents").where("doc_id % 5 = 1").select("doc_id", "source", "lang")
        i = F.col("doc_id")
        return docs.join(self.table("labels").select("doc_id"), "doc_id").select(
            F.col("source").alias("dataset_key"), i.alias("episode_index"),
            F.when(i % 4 == 0, "good").when(i % 4 == 1, "normal").when(i % 4 == 2, "bad").alias("grade"),
            F.array("lang").alias("tags"), F.when(i % 4 == 2, "old note").alias("reason"))

    # --- frames -----------------------------------------------------------------

    @cached_property
    def frames(self) -> DataFrame:
        e = self.table("events")
        i = F.col("event_id")
        left = (F.col("value") / 490.0).cast("float")
        right = ((i * 37 % 100) / 100.0).cast("float")
        zeros = lambda n: F.array_repeat(F.lit(0.0).cast("float"), n)
        return e.select(
            F.concat(F.lit("rig"), F.col("user_id") % 10).alias("dataset_key"),
            F.col("user_id").alias("episode_index"), i.alias("frame_index"), i.alias("index"),
            (i / 30.0).alias("timestamp"),
            F.concat(zeros(7), F.array(left), zeros(7), F.array(right)).alias("observation.state"),
            F.concat(F.lit("file-"), F.lpad(F.floor(i / 1000).cast("string"), 3, "0")).alias("shard_path"),
            (i % 1000).alias("shard_row"))

    @cached_property
    def vectors(self) -> DataFrame:
        """Embedding halves as observation and action of an episode's frames."""
        i = F.col("vec_id")
        return self.table("embeddings").select(
            F.concat(F.lit("emb"), F.floor(i / 200)).alias("dataset_key"),
            F.floor(i / 50).alias("episode_index"), (i % 50).alias("frame_index"), "vec_id",
            F.slice("embedding", 1, 32).alias("observation.state"),
            F.slice("embedding", 33, 32).alias("action"))

    @cached_property
    def tiles(self) -> DataFrame:
        """Sixteen tile means per frame of a head camera, one in seventeen frames flashing."""
        first = F.slice("`observation.state`", 1, 16)
        return self.vectors.select(
            "dataset_key", "episode_index", F.lit("observation.images.cam_head").alias("camera"),
            F.col("frame_index").alias("frame_no"), "vec_id", F.posexplode(first).alias("tile", "_x")
        ).select(
            "dataset_key", "episode_index", "camera", "frame_no", "tile",
            (F.col("_x").cast("double") * 100 + F.when(
                (F.col("vec_id") % 17 == 3) & (F.col("tile") < 3), 400).otherwise(0)
             ).cast("float").alias("luminance"))

    @cached_property
    def range_episodes(self) -> DataFrame:
        """Orders as episodes of 1 to 4 frames, laid end to end in eight datasets."""
        i = F.col("o_orderkey")
        q = F.floor(i / 8)
        start = F.floor(q / 4) * 10 + (q % 4) * (q % 4 + 1) / 2
        return self.table("orders").select(
            F.concat(F.lit("ds"), i % 8).alias("dataset_key"), i.alias("episode_index"),
            (q % 4 + 1).alias("length"), start.cast("bigint").alias("dataset_from_index"),
            (start + q % 4 + 1).cast("bigint").alias("dataset_to_index"),
            (q % 3).alias("task_index"),
            F.floor(q / 1000).alias("data/chunk_index"), (q % 1000).alias("data/file_index"))

    @cached_property
    def range_frames(self) -> DataFrame:
        return self.range_episodes.select(
            "dataset_key", "episode_index", "task_index", "dataset_from_index",
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1)).alias("frame_index"),
        ).select(
            "dataset_key", "episode_index", "task_index", "frame_index",
            (F.col("dataset_from_index") + F.col("frame_index")).alias("index"),
            (F.col("frame_index") / 30.0).alias("timestamp"))

    # --- registry and jobs -----------------------------------------------------

    @cached_property
    def registry(self) -> DataFrame:
        counts = self.table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
            F.count("*").alias("total_episodes"))
        nation = self.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
        return (
            self.table("customer").join(nation, "c_nationkey").join(counts, "c_custkey", "left")
            .select(
                F.col("c_custkey").cast("string").alias("dataset_key"), F.col("c_name").alias("name"),
                F.concat_ws("/", F.lit("/reg"), "n_name", F.col("c_custkey").cast("string")).alias("path"),
                F.col("n_name").alias("cell_name"), F.col("c_mktsegment").alias("robot_type"),
                F.coalesce("total_episodes", F.lit(0).cast("bigint")).alias("total_episodes"),
                (F.col("c_custkey") * 7 % 1000).cast("double").alias("info_mtime")))

    @cached_property
    def registry_stats(self) -> DataFrame:
        o = self.table("orders").where("o_orderkey % 4 <> 3")
        is_ = lambda s: F.col("o_orderstatus") == s
        return o.groupBy(F.col("o_custkey").cast("string").alias("dataset_key")).agg(
            F.count("*").alias("graded_count"), F.count_if(is_("O")).alias("good_count"),
            F.count_if(is_("P")).alias("normal_count"), F.count_if(is_("F")).alias("bad_count"))

    @cached_property
    def jobs(self) -> DataFrame:
        kinds = ["convert", "split", "merge", "delete", "sync_good_episodes", "stamp_cycles",
                 "auto_bad_camera_flicker", "bronze_silver_batch"]
        i = F.col("o_orderkey")
        return self.table("orders").select(
            i.alias("id"),
            F.element_at(F.array(*map(F.lit, kinds)), (i % 8 + 1).cast("int")).alias("type"),
            F.when(F.col("o_orderstatus") == "O", "queued").when(
                F.col("o_orderstatus") == "F", "complete").otherwise("running").alias("status"),
            F.format_string('{"dataset_id": %d}', "o_custkey").alias("payload"),
            F.col("o_orderdate").cast("timestamp").alias("updated_at"))

    # --- recordings --------------------------------------------------------------

    @cached_property
    def recordings(self) -> DataFrame:
        p = self.table("part")
        i = F.col("p_partkey")
        plain = F.format_string("2024%02d%02d_%06d", F.lit(1) + i % 12, F.lit(1) + i % 31, i)
        serial = F.when(i % 41 == 0, F.concat(F.lit("legacy-"), i)).when(
            i % 37 == 0, F.concat(plain, F.lit("_1"))).otherwise(plain)
        card = F.concat(
            F.format_string('{"robot_type": "%s", "fps": %d, ', "p_brand", (F.col("p_size") % 3) * 15),
            F.lit('"joint_names": ["a", "b"], "camera_topic_map": {"cam_b": "/x", "cam_a": "/y"}'),
            F.when(i % 7 == 0, "").otherwise(F.concat(F.lit(', "task_name": "'), "p_name", F.lit('"'))),
            F.lit("}"))
        return p.select(
            F.format_string("cell%03d/%s", i % 5, "p_type").alias("cell_task"), serial.alias("serial"),
            i.alias("item_no"), F.when(i % 43 == 0, "not json").otherwise(card).alias("metacard"),
            F.col("p_brand").alias("brand"))

    @cached_property
    def serial_status(self) -> DataFrame:
        """Conversion status of recordings; retries also name recordings that are gone."""
        i = F.col("item_no")
        pick = lambda cond, status, key=F.col("serial"): F.struct(
            cond.alias("holds"), key.alias("serial"), F.lit(status).alias("status"))
        found = F.array(
            pick(i % 3 == 0, "converted"), pick((i % 7 == 0) & (i % 3 != 0), "failed"),
            pick((i % 11 == 0) & (i % 3 != 0), "transient"), pick((i % 22 == 0) & (i % 3 != 0), "retry_due"),
            pick(i % 55 == 0, "retry_due", F.concat(F.lit("gone-"), "serial")))
        return self.recordings.select("cell_task", "item_no", F.explode(found).alias("f")).where("f.holds").select(
            "cell_task", "f.serial", "item_no", "f.status")

    @cached_property
    def task_counts(self) -> DataFrame:
        """Task-level state: counts per task, one cell off by one from its output."""
        off = F.when(F.col("cell_task").startswith("cell003"), 1).otherwise(0)
        return self.serial_status.groupBy("cell_task").agg(
            F.count_if(F.col("status") == "converted").alias("_n"),
            F.count_if(F.col("status") == "failed").alias("failed_count"),
            F.count_if(F.col("status") == "transient").alias("retry_count"),
            F.max(F.when(F.col("status") == "converted", F.col("serial"))).alias("last_serial"),
        ).select("cell_task", (F.col("_n") + off).alias("converted_count"), "failed_count",
                 "retry_count", "last_serial", F.lit("2024-05-01T00:00:00+00:00").alias("last_updated"))

    @cached_property
    def output_counts(self) -> DataFrame:
        """Episodes found in each task's output; one cell has no output yet."""
        return self.serial_status.where("status = 'converted'").where(
            ~F.col("cell_task").startswith("cell004")).groupBy("cell_task").agg(F.count("*").alias("episodes"))

    # --- logs ----------------------------------------------------------------------

    @cached_property
    def log_lines(self) -> DataFrame:
        e = self.table("events")
        i, u = F.col("event_id"), F.col("user_id")
        task = F.format_string("cell%03d/pick_%d", u % 5, u % 3)
        rec = F.format_string("cell%03d/pick_%d/20240101_%06d", u % 5, u % 3, i)
        head = F.concat(F.date_format("ts", TS), F.lit(" ["))
        kind = i % 13
        line = lambda level, *parts: F.concat(head, F.lit(level + "] "), *[
            F.lit(p) if isinstance(p, str) else p for p in parts])
        n = lambda c: c.cast("string")
        text = (
            F.when(kind == 0, line("INFO", "Converted: ", rec, " (", n(i % 900), " frames, ", n(u), ".5s)"))
            .when(kind == 1, line("INFO", "Converted: ", rec, " (", n(i % 900), " frames)"))
            .when(kind == 2, line("ERROR", "Failed [E", n(u % 9), "]: ", rec, ": bad topic: ", F.col("event_type")))
            .when(kind == 3, line("INFO", "Converting ", task, ": ", n(u % 40), " new recordings"))
            .when(kind.isin(4, 5), line("INFO", "Recording: ", rec, " (", n(i % 7 + 1), " of ", n(i % 7 + 5), ")"))
            .when(kind == 6, line("INFO", "  Finalizing: ", task))
            .when(kind == 7, line("INFO", "Finalized: ", task))
            .when(kind == 8, line("INFO", n(u % 6), " tasks with ", n(u), " pending"))
            .when(kind == 9, line("WARNING", "Timing Anomaly in ", rec))
            .when(kind == 10, line("INFO", "value ", F.col("event_type")))
            .when(kind == 11, F.lit("    continued detail"))
            .otherwise(line("DEBUG", "nothing to see")))
        return e.select(F.col("event_type").alias("log"), i.alias("line_no"), text.alias("value"))
