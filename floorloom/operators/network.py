"""Node and graph aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def node_attributes(points: DataFrame) -> DataFrame:
    """node, level_ids (sorted set), z_min, z_max, z_mean from rows (node, level_id, z)."""
    return points.groupBy("node").agg(F.array_sort(F.collect_set("level_id")).alias("level_ids"), F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.avg("z").alias("z_mean"))


def graph_stats(arcs: DataFrame) -> DataFrame:
    """nodes, arcs and the mean of in and out degrees, in one pass over the arcs' ends."""
    ends = arcs.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    out = ends.agg(F.count(F.lit(1)).alias("nodes"), F.expr("coalesce(sum(d), 0) div 2").alias("arcs"), F.round(F.avg("d"), 4).alias("mean_degree"))
    return out


def level_heights(levels: DataFrame, nodes: DataFrame) -> DataFrame:
    """z range of each level over its distinct nodes; nulls where there are none."""
    per = nodes.dropDuplicates(["node", "level_id"]).groupBy("level_id").agg(F.min("z_min").alias("z_min"), F.max("z_max").alias("z_max"), F.avg("z_mean").alias("z_mean"))
    return levels.select("level_id").join(per, "level_id", "left")


def node_map(features: DataFrame) -> DataFrame:
    """prefix, feature_id, role (start, end) to node."""
    prefix = F.when(F.col("mode") == "pathway", "PW").otherwise("TR")
    ends = F.explode(F.array(F.struct(F.lit("start").alias("role"), F.col("src").alias("node")), F.struct(F.lit("end").alias("role"), F.col("dst").alias("node"))))
    return features.select(prefix.alias("prefix"), "feature_id", ends.alias("e")).select("prefix", "feature_id", "e.role", "e.node")


def orphans(wanted: DataFrame, known: DataFrame, limit: int = 5) -> DataFrame:
    """First keys (prefix, feature_id, role) that the node map lacks."""
    keys = ["prefix", "feature_id", "role"]
    return wanted.select(*keys).join(known, keys, "left_anti").orderBy(*keys).limit(limit)


def sorted_fold(rows: DataFrame, by: list[str], order: list[str], start, step, made: str) -> DataFrame:
    """Rows with a column that a sequential rule gives them in the order of each group.

    Groups are sorted by Spark, which spills, and streamed through ``step(state, rows)`` batch by batch; a group is never held whole.
    """
    name = made.split()[0]
    sorted_rows = rows.repartition(*by).sortWithinPartitions(*by, *order)
    schema = ", ".join(f"`{c}` {t}" for c, t in sorted_rows.dtypes) + ", " + made

    def run(batches):
        key = state = None
        for pdf in batches:
            for k, part in pdf.groupby(by, sort=False, dropna=False):
                k = tuple("" if x is None else x for x in k)
                if k != key:
                    key, state = k, start()
                part = part.copy()
                part[name] = step(state, part)
                yield part

    return sorted_rows.mapInPandas(run, schema)
