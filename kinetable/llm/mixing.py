"""Mix sources to target weights: capped water-filling, then seeded repetitions.

Targets share the total size by weight; a source is clamped at ``epochs`` times
its own size and its excess is shared again among the others, until none is
above. A row of a source is taken ``floor(target / size)`` times, and once more
if it comes early enough in a seeded order: rows fill up the rest of the target,
the last one counting if that brings the sum nearer. Sizes are summed up by
block of that order, so no task walks through a whole source.

Defined results: a null source is a source of its own, ordered last; null or
empty texts have size zero; a source of size zero has target zero; rows that are
equal in keys and text are one place in the order, of which as many are taken as
bring the sum nearest (which of them is not defined); an empty table gives an empty
result. The result depends on the rows alone, so reruns agree.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetable.llm.common import words
from kinetable.operators.ordered import ordered_scan, row_position
from kinetable.settings import checkpointed


def targets(sizes: DataFrame, weights: Column, *, epochs: int = 3) -> DataFrame:
    """Add ``target`` (double) to sources with ``size`` (long) and a positive whole weight.

    Each round needs three sums; the sources stay on the executors. A round
    clamps at least one source or is the last.
    """
    rows = checkpointed(sizes.withColumns({
        "__weight": weights.cast("long"), "__cap": (F.col("size") * epochs).cast("long")}))
    wide = lambda c: c.cast("decimal(38,0)")
    total = int(rows.agg(F.sum(wide(F.col("size")))).first()[0] or 0)
    clamped, numerator, denominator = F.lit(False), total, None
    while True:
        free = rows.where(~clamped)
        held = rows.where(clamped).agg(F.sum(wide(F.col("__cap")))).first()[0] or 0
        weight = free.agg(F.sum(wide(F.col("__weight")))).first()[0] or 0
        numerator, denominator = total - int(held), int(weight)
        above = clamped if not denominator else (
            wide(F.col("__weight")) * F.lit(Decimal(numerator)) > wide(F.col("__cap")) * F.lit(Decimal(denominator)))
        more = 0 if not denominator else free.where(above).count()
        if not more:
            break
        clamped = clamped | above
        # clamped sources stay clamped: the level only rises
    level = (F.col("__weight") * F.lit(numerator)).cast("double") / F.lit(float(denominator or 1))
    return rows.withColumn("target", F.when(clamped, F.col("__cap").cast("double")).otherwise(level)).drop(
        "__weight", "__cap")


def _sized(docs: DataFrame, keys: list[str], text: str, source: str, seed: int) -> DataFrame:
    """``__source``, ``__size`` and the seeded order ``__place`` of every row, next to its own columns."""
    named = [F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")) for k in keys]
    size = F.size(words(F.col(f"`{text}`"))).cast("long")
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{source}`").alias("__source"),
        size.alias("__size"), F.struct(
            F.md5(F.concat_ws(":", F.lit(str(seed)), *named)).alias("draw"),
            F.xxhash64(F.col(f"`{text}`")).alias("tie")).alias("__place"))


def shares(
    docs: DataFrame, keys: list[str], *, text: str = "text", source: str = "source", seed: int = 17, epochs: int = 3,
    cycle: int = 3,
) -> DataFrame:
    """One row for each source: its size and target, how often it is taken whole, and up to where once more.

    Sources in code point order weigh 1 to ``cycle``, repeating.
    """
    rows = checkpointed(_sized(docs, keys, text, source, seed).select(
        "__source", F.col("__size").alias("size"), "__place.draw", "__place.tie"))
    sums = rows.groupBy("__source").agg(F.sum("size").alias("size"))
    ordered = row_position(
        sums.withColumns({"__all": F.lit(0), "__null": F.col("__source").isNull(), "__name": F.coalesce("__source", F.lit(""))}),
        keys=["__all"], order=["__null", "__name"], out="__rank",
        block=F.struct(F.col("__null"), F.substring("__name", 1, 6)))
    level = targets(ordered, F.col("__rank") % cycle + 1, epochs=epochs)
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(F.lit(0)).cast("long")
    level = checkpointed(level.select(
        F.col("__source").alias("__of"), "__rank", F.col("size").alias("source_size"), "target", whole.alias("whole")))
    # rows that are equal in all that decides are one, taken as often as there is room
    equal = rows.groupBy("__source", "draw", "tie", "size").agg(F.count("*").alias("copies"))
    joined = equal.join(level.where(F.col("whole") < epochs), F.col("__source").eqNullSafe(F.col("__of")))
    running = ordered_scan(
        joined, keys=["__rank"], order=["draw", "tie", "size"], block=F.substring("draw", 1, 3),
        totals={"__before": F.col("size") * F.col("copies")})
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    room = F.floor((2 * rest - F.col("size") - 2 * F.col("__before")) / (2 * F.col("size"))) + 1
    taken = F.when(F.col("size") > 0, F.least(room, F.col("copies"))).otherwise(F.col("copies")).cast("long")
    last = running.where(2 * F.col("__before") + F.col("size") <= 2 * rest).groupBy("__rank").agg(
        F.max(F.struct("draw", "tie", taken.alias("taken"), "copies")).alias("l"))
    return level.join(last, "__rank", "left").select(
        "__of", "__rank", "source_size", "target", "whole", F.struct("l.draw", "l.tie").alias("last"), "l.taken", "l.copies")


SOURCES_BROADCAST = 50_000


def _timed(docs: DataFrame, keys: list[str], **options) -> DataFrame:
    level = checkpointed(shares(docs, keys, **options))
    few = level.count() <= SOURCES_BROADCAST  # more sources than that meet their rows in a shuffle
    picked = {"text": "text", "source": "source", "seed": 17} | {k: v for k, v in options.items() if k in ("text", "source", "seed")}
    rows = _sized(docs, keys, **picked)
    joined = rows.join(F.broadcast(level) if few else level, F.col("__source").eqNullSafe(F.col("__of")))
    extra = F.col("taken").isNotNull() & (F.col("__place") <= F.col("last"))
    if level.where("taken < copies").isEmpty():
        return joined.withColumn("__times", F.col("whole") + extra.cast("long"))
    # of the equal rows that come last only some have room: they get numbers, task by task
    partly = F.coalesce((F.col("__place") == F.col("last")) & (F.col("taken") < F.col("copies")), F.lit(False))
    tied = checkpointed(joined.where(partly).withColumn("__part", F.spark_partition_id()))
    along = Window.partitionBy("__rank").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = tied.groupBy("__rank", "__part").agg(F.count("*").alias("__n")).select(
        "__rank", "__part", F.coalesce(F.sum("__n").over(along), F.lit(0)).alias("__sofar"))
    inside = F.row_number().over(Window.partitionBy("__rank", "__part").orderBy("__size"))
    numbered = tied.withColumn("__number", inside).join(before, ["__rank", "__part"]).withColumn(
        "__times", F.col("whole") + (F.col("__sofar") + F.col("__number") <= F.col("taken")).cast("long"))
    rest = joined.where(~partly).withColumn("__times", F.col("whole") + extra.cast("long"))
    return rest.unionByName(numbered.select(*rest.columns))


def mixed(docs: DataFrame, keys: list[str], **options) -> DataFrame:
    """``keys``, ``size``, ``source_size``, ``target`` and ``times`` a row is taken; options as in :func:`shares`."""
    return _timed(docs, keys, **options).select(
        *[F.col(f"__row.`{k}`").alias(k) for k in keys], F.col("__size").alias("size"), "source_size", "target",
        F.col("__times").alias("times"))


def repeated(docs: DataFrame, keys: list[str], **options) -> DataFrame:
    """Every row as often as the mix takes it, with its columns as they are; options as in :func:`shares`."""
    rows = _timed(docs, keys, **options).where("__times > 0")
    return rows.select("__row", F.explode(F.sequence(F.lit(1), F.col("__times")))).select("__row.*")
