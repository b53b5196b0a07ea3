"""Arcs and the iterative operators on them.

Arcs are rows ``src, dst, key, mode, length_3d``; parallel arcs are further rows.  A profile is a set of modes, joined as a column, so that
every operator runs for all profiles at once.  Loops end when a round adds nothing; each round is written to the shared folder, which
cuts the lineage.
"""

from __future__ import annotations

import functools
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from floorloom.functions.geometry import finite, positive
from floorloom.operators.connectivity import components
from floorloom.plans.recovery import settled, small

#: Metres beyond which the search for the nearest node meets all nodes of a floor: more than the earth's girth.
FAR = 1e8
#: Modes that each profile may use (fixed values).
PROFILES = {"default": ("elevator", "pathway", "stairs"), "elevator_only": ("elevator", "pathway")}


def profile_modes(spark: SparkSession, profiles: dict[str, tuple[str, ...]] = PROFILES) -> DataFrame:
    return spark.createDataFrame([(p, m) for p, modes in profiles.items() for m in modes], "profile string, mode string")


def by_profile(arcs: DataFrame, profiles: dict[str, tuple[str, ...]] = PROFILES) -> DataFrame:
    """Arcs with a column profile, once for each profile that allows their mode."""
    return arcs.join(F.broadcast(profile_modes(arcs.sparkSession, profiles)), "mode")


def both_ways(features: DataFrame) -> DataFrame:
    """Forward arc ``PW_f`` and reverse arc ``PW_f_R`` of every feature that is no loop; geometry, if any, is reversed too."""
    swap = {"src": "dst", "dst": "src", "level_id_from": "level_id_to", "level_id_to": "level_id_from", "vertical_order_from": "vertical_order_to", "vertical_order_to": "vertical_order_from"}
    rows = features.where(F.col("src") != F.col("dst"))
    prefix = F.when(F.col("mode") == "pathway", "PW_").otherwise("TR_")
    ahead = rows.withColumn("key", F.concat(prefix, F.col("feature_id").cast("string")))
    back = ahead.select(*[(F.reverse(c) if c == "geometry" else F.concat("key", F.lit("_R")) if c == "key" else F.col(swap[c]) if c in swap and swap[c] in ahead.columns else F.col(c)).alias(c) for c in ahead.columns])
    return ahead.unionByName(back)


def self_loops(features: DataFrame) -> DataFrame:
    """Features that snapping has made loops; they are left out of the graph."""
    return features.where(F.col("src") == F.col("dst")).select("feature_id")


def profile_components(arcs: DataFrame) -> DataFrame:
    """profile, node, component (smallest node), undirected and over nodes with an arc only; all profiles in the same rounds."""
    edges = arcs.where("src IS NOT NULL AND dst IS NOT NULL").select(F.struct("profile", F.col("src").alias("n")).alias("src"), F.struct("profile", F.col("dst").alias("n")).alias("dst"))
    found = components(edges)
    return found.select(F.col("node.profile").alias("profile"), F.col("node.n").alias("node"), F.col("component.n").alias("component"))


def component_ids(labels: DataFrame) -> DataFrame:
    """profile, component, component_id: digest of the canonical JSON of the profile and the nodes, sorted by theirs."""
    nodes = F.array_join(F.array_sort(F.collect_list(node_json(labels, "node"))), ",")
    rows = labels.groupBy("profile", "component").agg(nodes.alias("_nodes"), F.count(F.lit(1)).alias("size"))
    text = F.concat(F.lit('{"kind":"counted_component","nodes":['), "_nodes", F.lit('],"profile":"'), "profile", F.lit('"}'))
    return rows.select("profile", "component", F.sha2(text, 256).alias("component_id"), "size")


def node_json(rows: DataFrame, node: str) -> Column:
    """Canonical JSON of a node key: text quoted and escaped, numbers as they are."""
    if dict(rows.dtypes)[node] != "string":
        return F.col(node).cast("string")
    quoted = F.to_json(F.struct(F.col(node).alias("n")), {"ignoreNullFields": "false"})
    return F.substring(quoted, F.lit(6), F.length(quoted) - 6)


def isolated_id(profile, node):
    text = F.concat(F.lit('{"kind":"profile_isolated_singleton","node":'), node.cast("string"), F.lit(',"profile":"'), profile, F.lit('"}'))
    return F.sha2(text, 256)


def reachable(arcs: DataFrame, seeds: DataFrame) -> DataFrame:
    """profile, origin, node for every node that a seed (profile, origin, node) reaches along directed arcs, itself included."""
    step = arcs.select(F.col("profile").alias("_p"), "src", "dst").distinct()
    seen = settled(seeds.select("profile", "origin", "node").distinct())
    edge = seen
    while True:
        there = edge.join(step, (F.col("profile") == F.col("_p")) & (F.col("node") == F.col("src"))).select("profile", "origin", F.col("dst").alias("node")).distinct()
        edge = settled(there.join(seen, ["profile", "origin", "node"], "left_anti"))
        if edge.isEmpty():
            return seen
        seen = settled(seen.union(edge))


def shortest(arcs: DataFrame, seeds: DataFrame) -> DataFrame:
    """profile, origin, node, cost, path: cheapest directed path; of several the one with the smallest signature, its steps one by one.

    A step's signature is the canonical JSON of its key and the node that it leads to, in binary order; a path that another one continues goes first.
    Lengths that are not positive count 0 in the search (and make ``path_valid`` refuse the path).  A node's entry is replaced when
    (cost, signature) of another is smaller; only nodes that improved hand on.
    """
    step = arcs.select(F.col("profile").alias("_p"), "src", "dst", "key", F.coalesce(positive(F.col("length_3d")), F.lit(0.0)).alias("w")).where("src <> dst")
    # Of parallel arcs only the cheapest, first by key, can be on such a path.
    step = step.withColumn("sign", F.to_json(F.struct(F.col("key").cast("string").alias("edge_key"), F.col("dst").alias("target_node"))))
    step = settled(step.groupBy("_p", "src", "dst").agg(F.min(F.struct("w", "sign", "key")).alias("s")).select("_p", "src", "dst", "s.w", "s.sign", "s.key"))
    none = F.array().cast("array<string>")
    best = settled(seeds.select("profile", "origin", "node", F.lit(0.0).alias("cost"), none.alias("signature"), none.alias("path"), F.lit(True).alias("fresh")).distinct())
    while True:
        grown = best.where("fresh").join(step, (F.col("profile") == F.col("_p")) & (F.col("node") == F.col("src")))
        grown = grown.select("profile", "origin", F.col("dst").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), F.concat("signature", F.array("sign")).alias("signature"), F.concat("path", F.array(F.col("key").cast("string"))).alias("path"), F.lit(True).alias("fresh"))
        every = best.withColumn("fresh", F.lit(False)).union(grown)
        merged = every.groupBy("profile", "origin", "node").agg(F.min(F.struct("cost", "signature", "path", "fresh")).alias("b"))
        best = settled(merged.select("profile", "origin", "node", "b.cost", "b.signature", "b.path", "b.fresh"))
        if best.where("fresh").isEmpty():
            return best.drop("fresh", "signature")


def path_valid(paths: DataFrame, arcs: DataFrame) -> DataFrame:
    """profile, origin, node, valid: every arc of the path has an allowed mode and a positive length."""
    used = paths.select("profile", "origin", "node", F.explode_outer("path").alias("key"))
    known = arcs.select(F.col("profile").alias("_p"), F.col("key").alias("_k"), positive(F.col("length_3d")).isNotNull().alias("ok"))
    met = used.join(known, (F.col("profile") == F.col("_p")) & (F.col("key") == F.col("_k")), "left")
    return met.groupBy("profile", "origin", "node").agg(F.every(F.col("key").isNull() | F.coalesce("ok", F.lit(False))).alias("valid"))


def physical_degree(arcs: DataFrame) -> DataFrame:
    """node, degree: distinct neighbours, parallels and directions collapsed."""
    sides = arcs.where("src <> dst").select(F.col("src").alias("node"), F.col("dst").alias("nbr"))
    sides = sides.union(sides.select("nbr", "node"))
    return sides.groupBy("node").agg(F.count_distinct("nbr").alias("degree"))


def ambiguous_nodes(arcs: DataFrame) -> DataFrame:
    """Nodes whose neighbours are joined by different numbers of features."""
    sides = arcs.where("src <> dst").select(F.col("src").alias("node"), F.col("dst").alias("nbr"), "feature_id")
    sides = sides.union(sides.select("nbr", "node", "feature_id"))
    per = sides.groupBy("node", "nbr").agg(F.count_distinct("feature_id").alias("n"))
    return per.groupBy("node").agg((F.min("n") != F.max("n")).alias("ambiguous"))


def cheapest_pairs(arcs: DataFrame) -> DataFrame:
    """a, b, length: the shortest of the parallel edges of each unordered pair."""
    return arcs.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min("length_3d").alias("length"))


def chains(edges: DataFrame, boundary: DataFrame) -> DataFrame:
    """feature_id, chain: maximal runs of undirected edges (feature_id, a, b) through nodes that are not in ``boundary`` (node).

    Two edges are linked when they share a node inside; chains are the components of these links, named by their smallest feature.
    Inside nodes have exactly two edges, so a node's edges link in a line and nothing fans out.
    """
    half = edges.select("feature_id", F.explode(F.array("a", "b")).alias("node")).distinct()
    inside = half.join(boundary.select("node").distinct(), "node", "left_anti")
    links = inside.groupBy("node").agg(F.min("feature_id").alias("src"), F.max("feature_id").alias("dst")).select("src", "dst")
    found = components(links)
    return edges.select("feature_id").join(found, F.col("feature_id") == F.col("node"), "left").select("feature_id", F.coalesce("component", "feature_id").alias("chain"))


def contracted(edges: DataFrame, boundary: DataFrame) -> DataFrame:
    """chain, original_feature_ids, segments, length and the boundary nodes at the ends (two, or one of a loop, or none)."""
    named = edges.join(chains(edges, boundary), "feature_id")
    ends = named.select("chain", F.explode(F.array("a", "b")).alias("node")).groupBy("chain", "node").agg(F.count(F.lit(1)).alias("n"))
    outer = ends.where("n % 2 = 1").groupBy("chain").agg(F.array_sort(F.collect_list("node")).alias("terminals"))
    merged = named.groupBy("chain").agg(F.array_sort(F.collect_list("feature_id")).alias("original_feature_ids"), F.count(F.lit(1)).alias("segments"), F.sum("length_3d").alias("length"))
    return merged.join(outer, "chain", "left")


def _met(points: DataFrame, nodes: DataFrame, radius: float | None, on: str) -> DataFrame:
    """unit_id, b (d, k, node_id): the nearest node of the level at most ``radius`` away (6 places), of points that have one; None: at any distance.

    A point looks into the nine grid cells around it, each a little wider than the radius, so that what rounds to it is found too.
    """
    n = nodes.select(F.col(on).alias("_l"), "node_id", F.col("x").alias("nx"), F.col("y").alias("ny"))
    p = points.select("unit_id", on, "x", "y")
    same = F.col(on) == F.col("_l")
    if radius is not None:
        cell = lambda c: F.floor(F.col(c) / (radius + 1e-5)).cast("double")
        around = F.array(*map(F.lit, (-1.0, 0.0, 1.0)))
        n = n.withColumns({"cx": cell("nx"), "cy": cell("ny")})
        p = p.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around)).withColumns({"gx": cell("x") + F.col("_dx"), "gy": cell("y") + F.col("_dy")})
        same = same & (F.col("gx") == F.col("cx")) & (F.col("gy") == F.col("cy"))
    met = p.join(n, same).withColumn("d", F.round(F.hypot(F.col("x") - F.col("nx"), F.col("y") - F.col("ny")), 6))
    met = met if radius is None else met.where(F.col("d") <= radius)
    return met.groupBy("unit_id").agg(F.min(F.struct("d", F.col("node_id").cast("string").alias("k"), "node_id")).alias("b"))


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with finite coordinates."""
    return rows.where(F.hypot("x", "y") < float("inf"))


def anchors(points: DataFrame, nodes: DataFrame, limit: float, on: str = "level_id") -> DataFrame:
    """unit_id, node_id, eligible: the nearest node of the same level at most ``limit`` away; null and not eligible where there is none."""
    found = _met(_placed(points), _placed(nodes), limit, on)
    return points.select("unit_id").distinct().join(found, "unit_id", "left").select("unit_id", F.col("b.node_id").alias("node_id"), F.col("b").isNotNull().alias("eligible"))


def nearest(points: DataFrame, nodes: DataFrame, limit: float, on: str = "level_id") -> DataFrame:
    """Nearest node of the same level for every point (unit_id, level, x, y): node_id, distance (6 places), eligible, reason.

    Ties go to the smaller node key as text.  Points without a node on their level are kept, and those without finite coordinates, which are too
    far from any; nodes without are none.  Points look into grid cells of the limit's size; those that find nothing look into cells four times as
    wide, and so on, so that a point meets the nodes around it and not its whole floor.  Only what is left beyond ``FAR`` does.
    """
    nodes = _placed(nodes)
    levels = small(nodes.select(F.col(on).alias("_l")).distinct().withColumn("_has", F.lit(True)))
    known = points.join(levels, F.col(on) == F.col("_l"), "left").withColumn("_has", F.coalesce("_has", F.lit(False)))
    rest = settled(_placed(known.where("_has")).select("unit_id", on, "x", "y"))
    radius, rounds = max(limit, 1.0), []
    while not rest.isEmpty():
        rounds.append(settled(_met(rest, nodes, radius if radius < FAR else None, on)))
        rest = settled(rest.join(rounds[-1].select("unit_id"), "unit_id", "left_anti"))
        radius *= 4
    out = known.groupBy("unit_id").agg(F.max("_has").alias("_has"))
    if rounds:
        out = out.join(functools.reduce(DataFrame.union, rounds).groupBy("unit_id").agg(F.min("b").alias("b")), "unit_id", "left")
    else:
        out = out.withColumn("b", F.lit(None).cast(f"struct<d:double,k:string,node_id:{dict(nodes.dtypes)['node_id']}>"))
    eligible = F.coalesce(F.col("b.d") <= limit, F.lit(False))
    reason = F.when(~F.col("_has"), "no_node_on_level").when(~eligible, "too_far").otherwise("ok")
    return out.select("unit_id", F.col("b.node_id").alias("node_id"), F.col("b.d").alias("distance"), eligible.alias("eligible"), reason.alias("reason"))


def within(points: DataFrame, nodes: DataFrame, radius: float, on: str = "level_id") -> DataFrame:
    """Nodes with a point of the same level at most ``radius`` away; both sides meet in grid cells of that size."""
    cell = lambda c: F.floor(F.col(c) / radius)
    near = points.select(F.col(on).alias("_l"), F.col("x").alias("px"), F.col("y").alias("py")).withColumns({"cx": cell("px"), "cy": cell("py")})
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    spread = nodes.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around)).withColumns({"gx": cell("x") + F.col("_dx"), "gy": cell("y") + F.col("_dy")})
    on_cell = (F.col(on) == F.col("_l")) & (F.col("gx") == F.col("cx")) & (F.col("gy") == F.col("cy")) & (F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")) <= radius)
    return spread.join(near, on_cell, "left_semi").select(*nodes.columns).distinct()


def greedy_representatives(points: DataFrame, radius: float) -> DataFrame:
    """First representative of each cluster in the order (x, y, fid) per category and level.

    A point is a representative unless an earlier representative of its group is at most ``radius`` away; this depends on the order and is
    not the transitive closure.  Of equal positions only the first counts, the others are at no distance from it or lose to the same one.  Points
    are cut into clumps of grid cells that touch, which no pair crosses, and every clump is streamed in its order past the
    representatives of the last two columns of cells.  No pairs are made, and nothing is held but those.  Points without a finite position are close to none.
    """
    columns = ["category", "level_id", "fid", "x", "y"]
    rows = points.select(*columns).where("category IS NOT NULL AND level_id IS NOT NULL")
    fixed = finite(F.col("x")).isNotNull() & finite(F.col("y")).isNotNull()
    firsts = rows.where(fixed).groupBy("category", "level_id", "x", "y").agg(F.min("fid").alias("fid"))
    side = radius * (1 + 2**-20)  # so that rounding puts no pair two cells apart
    name = lambda cx, cy: F.xxhash64("category", "level_id", cx, cy)  # noqa: E731  # equal names of two cells only make a larger clump
    firsts = firsts.withColumns({"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side)})
    cells = firsts.select("category", "level_id", "cx", "cy").distinct()
    # Every cell goes to itself and to half of its neighbours: five rows a cell at most meet, and no table is joined.
    to = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))]))
    sent = cells.select("*", to.alias("d")).select(name(F.col("cx"), F.col("cy")).alias("src"), name(F.col("cx") + F.col("d.dx"), F.col("cy") + F.col("d.dy")).alias("dst"))
    met = sent.groupBy("dst").agg(F.max(F.col("src") == F.col("dst")).alias("there"), F.collect_set("src").alias("s")).where("there")
    clumps = components(met.select(F.explode("s").alias("src"), "dst").where("src <> dst")).hint("merge")  # as many as cells, however few bytes the input has
    named = firsts.withColumn("cell", name(F.col("cx"), F.col("cy"))).join(clumps, F.col("cell") == F.col("node"), "left").withColumn("clump", F.coalesce("component", "cell"))
    # Clumps of one group may share a task: they do not touch, so that they are folded as one.
    sorted_rows = named.repartition("clump").select(*columns).sortWithinPartitions("category", "level_id", "x", "y", "fid")

    def fold(batches):
        group, held = None, {}  # representatives of the group by column and row of cells
        for batch in batches:
            keep = []
            for c, level, x, y in zip(*(batch.column(n).to_pylist() for n in ("category", "level_id", "x", "y"))):
                if (c, level) != group:
                    group, held = (c, level), {}
                cx, cy = math.floor(x / side), math.floor(y / side)
                if cx not in held:
                    held = {k: v for k, v in held.items() if k >= cx - 1} | {cx: {}}
                near = (p for col in (cx - 1, cx) if col in held for row in (cy - 1, cy, cy + 1) for p in held[col].get(row, ()))
                free = all(math.hypot(x - a, y - b) > radius for a, b in near)
                if free:
                    held[cx].setdefault(cy, []).append((x, y))
                keep.append(free)
            yield batch.filter(pa.array(keep, pa.bool_()))

    kinds = dict(sorted_rows.dtypes)
    return sorted_rows.mapInArrow(fold, ", ".join(f"{c} {kinds[c]}" for c in columns)).union(rows.where(~fixed))


def first_pairs(labels: DataFrame) -> DataFrame:
    """Per profile the first ordered pair i < j of the same component and the first of different ones.

    ``labels`` has profile, unit_id, rid.  The first id is the smallest with any partner, so no pairs are made.
    """
    order = W.Window.partitionBy("profile", "rid").orderBy("unit_id")
    same = labels.withColumn("d", F.lead("unit_id").over(order)).where("d IS NOT NULL")
    same = same.groupBy("profile").agg(F.min(F.struct(F.col("unit_id").alias("o"), "d")).alias("p")).select("profile", F.lit("same").alias("outcome"), "p.o", "p.d")
    head = labels.groupBy("profile").agg(F.min(F.struct("unit_id", "rid")).alias("h"))
    other = labels.join(head, "profile").where(F.col("rid") != F.col("h.rid")).groupBy("profile").agg(F.min(F.struct(F.col("h.unit_id").alias("o"), F.col("unit_id").alias("d"))).alias("p"))
    return same.union(other.select("profile", F.lit("different").alias("outcome"), "p.o", "p.d"))
