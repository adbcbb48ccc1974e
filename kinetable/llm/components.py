"""Connected components of a graph given as edges, by alternating star rounds.

Each round hangs the larger neighbours of a node on the smallest one it knows
(large star), then the smaller ones (small star). Edges never grow in number,
and a few rounds are enough even for long chains. A round is two hash
aggregates with map-side combining and two joins, whose hot keys Spark splits;
its result is written to the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.settings import checkpointed


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node that has an edge to another one.

    Roots are the smallest node of the component. Null ends, loops and repeated
    edges are ignored; no edges give an empty table.
    """
    x, y = F.col(a), F.col(b)
    now = checkpointed(
        edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").where("v != m").select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(
            F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        now = checkpointed(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
