"""Ordered computations that do not put a whole key into one task.

A window over (key, order) sends every row of a key to one task. Here each
key is cut into blocks by a column that never decreases along the order, the
window runs inside a block, and one summary row per block carries the result
across blocks. The block value depends only on the row, so a task that is run
again lands on the same blocks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BLOCK = 65_536
_BLOCK = "_block"


def int_block(column: str | Column, rows: int = ROWS_PER_BLOCK) -> Column:
    """Block number of an integer order column."""
    col = F.col(column) if isinstance(column, str) else column
    return F.floor(col / F.lit(rows))


def ordered_scan(
    df: DataFrame,
    *,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    totals: Mapping[str, Column] | None = None,
    carries: Mapping[str, Column] | None = None,
    carries_with_current: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add running values along ``order`` inside each key.

    ``totals``: sum of the value over the rows before this one.
    ``carries``: last non-null value before this row.
    ``carries_with_current``: the same, this row included.
    """
    totals = dict(totals or {})
    carries = dict(carries or {})
    with_current = dict(carries_with_current or {})
    part = [*keys, _BLOCK]

    work = df.withColumn(_BLOCK, block)
    sources = {**totals, **carries, **with_current}
    work = work.withColumns({f"_v_{name}": value for name, value in sources.items()})

    row_order = Window.partitionBy(*part).orderBy(*order)
    before = row_order.rowsBetween(Window.unboundedPreceding, -1)
    upto = row_order.rowsBetween(Window.unboundedPreceding, 0)
    local = {f"_l_{n}": F.sum(f"_v_{n}").over(before) for n in totals}
    local |= {f"_l_{n}": F.last(f"_v_{n}", ignorenulls=True).over(before) for n in carries}
    local |= {f"_l_{n}": F.last(f"_v_{n}", ignorenulls=True).over(upto) for n in with_current}
    rows = work.withColumns(local)

    # a single number as position keeps the summary a hash aggregate
    position = F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(c) for c in order])
    summary = [F.sum(f"_v_{n}").alias(f"_s_{n}") for n in totals]
    summary += [
        F.max_by(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), position)).alias(f"_s_{n}")
        for n in (*carries, *with_current)
    ]
    blocks = work.groupBy(*part).agg(*summary)
    earlier = (
        Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = {f"_b_{n}": F.sum(f"_s_{n}").over(earlier) for n in totals}
    carried |= {
        f"_b_{n}": F.last(f"_s_{n}", ignorenulls=True).over(earlier)
        for n in (*carries, *with_current)
    }
    blocks = blocks.withColumns(carried).select(*part, *carried)

    zero = F.lit(0)
    result = {
        n: F.coalesce(F.col(f"_b_{n}"), zero) + F.coalesce(F.col(f"_l_{n}"), zero) for n in totals
    }
    result |= {
        n: F.coalesce(F.col(f"_l_{n}"), F.col(f"_b_{n}")) for n in (*carries, *with_current)
    }
    joined = rows.join(blocks, part, "left").withColumns(result)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c not in result], *result)


def row_position(
    df: DataFrame, *, keys: Sequence[str], order: Sequence[str], block: Column, out: str
) -> DataFrame:
    """Add the 0-based position of each row inside its key."""
    return ordered_scan(
        df, keys=keys, order=order, block=block, totals={out: F.lit(1).cast("bigint")}
    )


def runs(
    df: DataFrame,
    *,
    keys: Sequence[str],
    pos: str,
    label: str,
    end: str | None = None,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Merge neighbouring rows with the same label into ``(keys, start, end, label)``.

    A row covers ``pos`` to ``end`` (``pos`` alone when no end is given); rows
    merge when the next one starts right after the previous end.
    """
    last = F.col(end) if end else F.col(pos)
    base = df.select(*keys, F.col(pos).alias("_s"), last.alias("_e"), F.col(label).alias("_lab"))
    base = base.withColumn(_BLOCK, int_block("_s", rows_per_block))
    pieces = _merge_touching(base, [*keys, _BLOCK])
    # only the outer pieces of a block can go on in another block; inner ones
    # are done and stay where they are
    inside = Window.partitionBy(*keys, _BLOCK)
    outer = (F.col("_run") == 1) | (F.col("_run") == F.max("_run").over(inside))
    sorted_out = pieces.withColumn("_group", F.when(outer, -1).otherwise(F.col(_BLOCK)))
    merged = _merge_touching(sorted_out.drop(_BLOCK, "_run"), [*keys, "_group"])
    return merged.select(
        *keys, F.col("_s").alias("start"), F.col("_e").alias("end"), F.col("_lab").alias(label))


def _merge_touching(df: DataFrame, part: list[str]) -> DataFrame:
    """Merge neighbours inside each part; ``_run`` numbers the results from 1."""
    order = Window.partitionBy(*part).orderBy("_s")
    goes_on = (F.lag("_lab").over(order) == F.col("_lab")) & (F.lag("_e").over(order) + 1 == F.col("_s"))
    return (
        df.withColumn("_new", F.when(goes_on, 0).otherwise(1))
        .withColumn("_run", F.sum("_new").over(order))
        .groupBy(*part, "_run")
        .agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.first("_lab").alias("_lab"))
    )


def exact_median(df: DataFrame, *, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Exact median of non-negative values per key, the two middle ones averaged.

    Values are first counted in narrow buckets; only those of the buckets that
    hold the middle are then ranked, equal ones counted together. No task sees
    all values of a key.
    """
    keys = list(keys)
    v = F.col(value)
    # 1024 buckets for each doubling, so a bucket holds few distinct values
    bucket = F.when(v > 0, F.floor(F.log2(v) * 1024)).otherwise(F.lit(-(2**40)))
    rows = df.where(v.isNotNull()).select(*keys, v.alias("_v"), bucket.alias("_bucket"))
    counts = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    along = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumns({
        "_below": F.coalesce(F.sum("_n").over(along), F.lit(0)),
        "_total": F.sum("_n").over(Window.partitionBy(*keys)),
    })
    middle = placed.where(_holds_middle()).select(*keys, "_bucket", "_below", "_total")
    values = rows.join(middle, [*keys, "_bucket"]).groupBy(*keys, "_bucket", "_below", "_total", "_v").agg(
        F.count("*").alias("_n"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = values.withColumn("_below", F.col("_below") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    return ranked.where(_holds_middle()).groupBy(*keys).agg(
        ((F.min("_v") + F.max("_v")) / 2).alias(out))


def _holds_middle() -> Column:
    """Whether ranks ``_below`` to ``_below + _n - 1`` hold a middle rank of ``_total``."""
    holds = lambda rank: (F.col("_below") <= rank) & (rank < F.col("_below") + F.col("_n"))
    return holds(F.floor((F.col("_total") - 1) / 2)) | holds(F.floor(F.col("_total") / 2))
