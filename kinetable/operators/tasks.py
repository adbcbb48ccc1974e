"""Task texts: renaming, reassigning episodes and keeping the index dense."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.operators.ordered import int_block, row_position
from kinetable.settings import checkpointed

EP = ("dataset_key", "episode_index")


def update_task(tasks: DataFrame, index: int, text: str) -> DataFrame:
    """Replace the text of one task index in every given dataset."""
    return tasks.withColumn(
        "task", F.when(F.col("task_index") == index, F.lit(text)).otherwise(F.col("task")))


def unknown_tasks(tasks: DataFrame, index: int) -> DataFrame:
    """Datasets of a task table that have no such index, which `update_task` leaves as they are."""
    known = tasks.groupBy("dataset_key").agg(F.bool_or(F.col("task_index") == index).alias("_has"))
    return known.where(~F.coalesce("_has", F.lit(False))).select(
        "dataset_key", F.lit(index).cast("bigint").alias("task_index"), F.lit("task_not_found").alias("problem"))


def task_text_of(tasks: DataFrame) -> DataFrame:
    """First index of each task text per dataset."""
    return tasks.groupBy("dataset_key", "task").agg(F.min("task_index").alias("task_index"))


def affected_episodes(episodes: DataFrame, tasks: DataFrame) -> DataFrame:
    """Episodes that refer to each task, by index or by text in their task list."""
    listed = tasks.select("dataset_key", "task_index", "task")
    if "task_index" in episodes.columns:
        refs = episodes.select("dataset_key", "task_index")
        used = refs.groupBy("dataset_key", "task_index").agg(F.count("*").alias("n"))
        joined = listed.join(used, ["dataset_key", "task_index"], "left")
    else:
        refs = episodes.select("dataset_key", F.explode(F.array_distinct("tasks")).alias("task"))
        used = refs.groupBy("dataset_key", "task").agg(F.count("*").alias("n"))
        joined = listed.join(used, ["dataset_key", "task"], "left")
    return joined.select(
        "dataset_key", "task_index", "task",
        F.coalesce("n", F.lit(0).cast("bigint")).alias("episodes"))


def contiguous_tasks(tasks: DataFrame) -> DataFrame:
    """Per dataset, whether its task ids are 0..n-1."""
    return tasks.groupBy("dataset_key").agg(
        F.count("*").alias("task_count"),
        ((F.min("task_index") == 0) & (F.max("task_index") == F.count("*") - 1)
         & (F.count_distinct("task_index") == F.count("*"))).alias("contiguous"))


def instruction_preview(requests: DataFrame, episodes: DataFrame, tasks: DataFrame) -> DataFrame:
    """What each requested instruction change would do.

    ``requests`` holds ``(dataset_key, episode_index, instruction, mode)`` with
    mode ``episode`` or ``shared``. ``problem`` is set when it must be refused.
    """
    counts = affected_episodes(episodes, tasks).select(
        "dataset_key", F.col("task_index").alias("current_task_index"),
        F.col("task").alias("current_text"), F.col("episodes").alias("_users"))
    targets = task_text_of(tasks).select(
        "dataset_key", F.col("task").alias("instruction"), F.col("task_index").alias("target_task_index"))
    if "task_index" in episodes.columns:
        current = episodes.select(
            *EP, F.col("task_index").alias("current_task_index"), F.lit(1).alias("_tasks"))
    else:
        current = episodes.select(
            *EP, F.get("tasks", F.lit(0)).alias("_text"), F.size("tasks").alias("_tasks")
        ).join(task_text_of(tasks).select(
            "dataset_key", F.col("task").alias("_text"), F.col("task_index").alias("current_task_index")),
            ["dataset_key", "_text"], "left").drop("_text")
    rows = (
        requests.join(current.withColumn("_found", F.lit(True)), list(EP), "left")
        .join(counts, ["dataset_key", "current_task_index"], "left")
        .join(targets, ["dataset_key", "instruction"], "left")
        .join(contiguous_tasks(tasks), "dataset_key", "left")
    )
    shared, same = F.col("mode") == "shared", F.col("instruction") == F.col("current_text")
    problem = (
        F.when(~F.coalesce("contiguous", F.lit(False)), "task_index_invalid")
        .when(F.col("_found").isNull(), "episode_not_found")
        .when(F.col("current_text").isNull() | (F.col("_tasks") < 1), "multi_task_episode")
        .when(~shared & (F.col("_tasks") != 1), "multi_task_episode")
        .when(shared & ~same & F.col("target_task_index").isNotNull(), "instruction_duplicate")
    )
    action = F.when(shared, "shared").when(same, "no_op").when(
        F.col("target_task_index").isNotNull(), "reuse").otherwise("create")
    return rows.withColumn("problem", problem).select(
        *EP, "mode", "instruction", "current_task_index",
        F.when(F.col("problem").isNull(), action).alias("action"), "target_task_index",
        F.when(shared, F.col("_users")).otherwise(F.lit(1)).cast("bigint").alias("affected"), "problem")


def preview_fingerprint(preview: DataFrame) -> DataFrame:
    """Digest of each previewed change, to be compared before it is applied."""
    fields = ["action", "affected", "current_task_index", "dataset_key", "episode_index",
              "instruction", "mode", "target_task_index"]
    text = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return preview.withColumn("fingerprint", F.sha2(text, 256))


def apply_shared_rename(
    tasks: DataFrame, episodes: DataFrame, preview: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Rename task texts in the task table and in every episode's task list.

    A rename that several episodes ask for is one; a task for which different
    texts are asked keeps its own.
    """
    renames = preview.where("action = 'shared' and problem is null").groupBy(
        "dataset_key", F.col("current_task_index").alias("task_index")).agg(
        F.min("instruction").alias("_new"), F.max("instruction").alias("_other")
    ).where(F.col("_new") == F.col("_other")).drop("_other")
    new_tasks = tasks.join(renames, ["dataset_key", "task_index"], "left")
    # one entry per renamed task of a dataset, each asked for by a person
    changed = new_tasks.where("_new is not null").groupBy("dataset_key", "task").agg(
        F.min("_new").alias("_new")).groupBy("dataset_key").agg(
        F.map_from_entries(F.collect_list(F.struct("task", "_new"))).alias("_map"))
    new_tasks = new_tasks.withColumn("task", F.coalesce("_new", "task")).drop("_new")
    if "tasks" not in episodes.columns:
        return new_tasks, episodes
    listed = episodes.join(changed, "dataset_key", "left").withColumn("tasks", F.when(
        F.col("_map").isNull(), F.col("tasks")).otherwise(F.transform(
            "tasks", lambda t: F.coalesce(F.try_element_at("_map", t), t)))).drop("_map")
    return new_tasks, listed


def rename_rejects(tasks: DataFrame, preview: DataFrame) -> DataFrame:
    """Renames that `apply_shared_rename` can't follow, ``(dataset_key, task_index, instruction, problem)``.

    ``conflicting_texts``: different texts are asked for one task, which keeps its own. ``ambiguous_text``: two tasks
    have the same text and get different ones; lists of task texts in episodes take the smaller.
    """
    asked = preview.where("action = 'shared' and problem is null").select(
        "dataset_key", F.col("current_task_index").alias("task_index"), "instruction").distinct()
    each = asked.groupBy("dataset_key", "task_index").agg(F.count("*").alias("_n"))
    marked = asked.join(each, ["dataset_key", "task_index"])
    once = marked.where("_n = 1").join(tasks.select("dataset_key", "task_index", "task"), ["dataset_key", "task_index"])
    unclear = once.groupBy("dataset_key", "task").agg(
        F.min("instruction").alias("_lo"), F.max("instruction").alias("_hi")).where("_lo <> _hi")
    columns = ["dataset_key", "task_index", "instruction"]
    return marked.where("_n > 1").select(*columns, F.lit("conflicting_texts").alias("problem")).unionByName(
        once.join(unclear, ["dataset_key", "task"], "left_semi").select(*columns, F.lit("ambiguous_text").alias("problem")))


def apply_episode_instructions(
    tasks: DataFrame, episodes: DataFrame, frames: DataFrame, preview: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Point episodes and their frames at another task, adding new texts at the end.

    Afterwards unused tasks are dropped and the index made dense.
    """
    # the plan is small and read at every step
    wanted = checkpointed(preview.where("action in ('reuse', 'create') and problem is null"))
    fresh = wanted.where("action = 'create'").select("dataset_key", F.col("instruction").alias("task")).distinct()
    sizes = tasks.groupBy("dataset_key").agg(F.count("*").alias("_base"))
    # few requests per dataset: a person edits them one by one
    added = row_position(
        fresh, keys=["dataset_key"], order=["task"], block=F.substring("task", 1, 2), out="_p",
    ).join(sizes, "dataset_key").select(
        "dataset_key", (F.col("_base") + F.col("_p")).alias("task_index"), "task")
    all_tasks = tasks.select("dataset_key", "task_index", "task").unionByName(added)
    moves = checkpointed(wanted.join(
        task_text_of(all_tasks).select(
            "dataset_key", F.col("task").alias("instruction"), F.col("task_index").alias("_to")),
        ["dataset_key", "instruction"]).select(*EP, "_to"))
    moved = lambda df: df.join(moves, list(EP), "left").withColumn(
        "task_index", F.coalesce("_to", "task_index")).drop("_to")
    return dense_remap(all_tasks, moved(episodes), moved(frames))


def used_task_map(tasks: DataFrame, episodes: DataFrame) -> DataFrame:
    """Old to new index of the tasks some episode uses, dense from 0."""
    used = tasks.select("dataset_key", "task_index").join(
        episodes.select("dataset_key", "task_index").distinct(),
        ["dataset_key", "task_index"], "left_semi")
    return row_position(
        used, keys=["dataset_key"], order=["task_index"], block=int_block("task_index"), out="new_index")


def dense_remap(
    tasks: DataFrame, episodes: DataFrame, frames: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drop unused tasks and renumber; frames with an unknown index keep it."""
    mapping = checkpointed(used_task_map(tasks, episodes))
    on = ["dataset_key", "task_index"]
    renumber = lambda df, how: df.join(mapping, on, how).withColumn(
        "task_index", F.coalesce("new_index", "task_index")).drop("new_index")
    return renumber(tasks, "inner"), renumber(episodes, "left"), renumber(frames, "left")
