"""Weakly connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorloom.plans.recovery import settled

#: Edges per task.
ROWS = 1 << 17


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, component`` for every node of an edge; the component is its smallest node.

    Alternates two steps until nothing changes: every node hands its larger neighbours to the smallest one it knows, then
    its smaller neighbours.  The number of rounds grows with the logarithm of the longest path.  Both steps sum map-side
    before they shuffle, and a hub's rows meet a single row in the join, which adaptive execution may split.
    Edges with a null end are no edges; loops make a component of one node.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    # Loops are settled with the edges, so that what makes the edges runs once.
    held = settled(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = held.agg(F.count_if(F.col("u") != F.col("v")), F.count_if(F.col("u") == F.col("v"))).first()
    loops = held.where("u = v").select(F.col("u").alias("node")) if mark[1] else None
    held = held.where("u <> v")
    while True:
        # Edges are few bytes: few of them need few tasks, whatever the session's number of shuffle partitions.
        n = max(1, -(-mark[0] // ROWS))
        held = held.coalesce(n)
        both = held.union(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        wide = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(n).distinct().coalesce(n)
        least = wide.groupBy("u").agg(F.min("v").alias("m")).coalesce(n)
        met = wide.join(least, "u")
        small = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).coalesce(n).distinct()
        held = settled(small.coalesce(n))
        # The sum of a hash of all edges; it repeats once the edges do.
        now = held.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first()
        if now == mark:
            break
        mark = now
    roots = held.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    found = held.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    if loops is None:
        return found
    alone = loops.join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.union(alone)
