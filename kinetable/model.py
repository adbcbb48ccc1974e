"""Table shapes and the fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values of the data model -------------------------------------
GRADES = ("good", "normal", "bad")
UNGRADED = "(ungraded)"
NO_TAGS = "(no tags)"
UNKNOWN_DATE = "(unknown)"
NULL_LABEL = "(null)"
SYSTEM_INFO_KEYS = (
    "fps", "total_episodes", "total_tasks", "robot_type", "features",
    "total_frames", "total_chunks", "chunks_size", "data_path",
    "videos_path", "splits",
)
SYSTEM_EPISODE_COLUMNS = (
    "episode_index", "length", "task_index", "chunk_index", "file_index",
    "dataset_from_index", "dataset_to_index", "task_instruction",
)
CHARTABLE_COLUMNS = ("length", "task_instruction")
REQUIRED_INFO_KEYS = ("features", "fps", "total_episodes", "total_frames")
REQUIRED_FRAME_COLUMNS = (
    "episode_index", "frame_index", "index", "task_index", "timestamp",
)
REQUIRED_EPISODE_COLUMNS = (
    "data/chunk_index", "data/file_index", "dataset_from_index",
    "dataset_to_index", "episode_index",
)
TASK_TEXT_COLUMNS = ("task", "__index_level_0__")
COLUMN_TYPES = {"string": "string", "int64": "bigint", "float64": "double", "bool": "boolean"}
CURATION_STATES = (
    "bronze_detected", "silver_processing", "silver_ready",
    "human_curating", "gold_ready", "silver_failed",
)
SERIAL_PATTERN = r"^\d{8}_\d{6}(_\d+)?$"
MANUAL_RETRY_ERROR = "manual retry requested from UI"
STALE_REASON = "silver_processing timeout"
# -------------------------------------------------------------------------

EPISODE = T.StructType([
    T.StructField("episode_index", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("task_index", T.LongType()),
    T.StructField("task_instruction", T.StringType()),
    T.StructField("chunk_index", T.LongType()),
    T.StructField("file_index", T.LongType()),
    T.StructField("dataset_from_index", T.LongType()),
    T.StructField("dataset_to_index", T.LongType()),
    T.StructField("grade", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("reason", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("raw_recording", T.StringType()),
])

TRANSIENT_FAILURE = T.StructType([
    T.StructField("attempt_count", T.LongType()),
    T.StructField("first_failed_at", T.DoubleType()),
    T.StructField("next_retry_at", T.DoubleType()),
    T.StructField("last_error", T.StringType()),
])

FEATURE = T.StructType([
    T.StructField("dtype", T.StringType()),
    T.StructField("shape", T.ArrayType(T.LongType())),
    T.StructField("names", T.ArrayType(T.StringType())),
])
