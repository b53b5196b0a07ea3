"""Noding of lines at shared vertices, with the guards around it, and multipart lines.

Lines are rows ``feature_id, level_id, geometry array<struct<x,y,z>>, length_3d``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from floorloom.functions import geometry as G


def vertices(lines: DataFrame) -> DataFrame:
    return lines.select("feature_id", "level_id", F.posexplode("geometry").alias("vertex", "p"), F.size("geometry").alias("n")).select("feature_id", "level_id", "vertex", "n", "p.x", "p.y", "p.z")


def shared(lines: DataFrame) -> DataFrame:
    """level_id, x, y, z, owners: exact positions of one level that lie on several features."""
    per = vertices(lines).groupBy("level_id", "x", "y", "z").agg(F.count_distinct("feature_id").alias("owners"))
    return per.where("owners > 1")


def safe_junctions(junctions: DataFrame, points: DataFrame) -> DataFrame:
    """Junctions whose centimetre cell holds no second exact position."""
    cells = points.select("level_id", "x", "y", "z").distinct().groupBy("level_id", G.snap(F.col("x")).alias("sx"), G.snap(F.col("y")).alias("sy")).agg(F.count(F.lit(1)).alias("n"))
    met = junctions.join(cells.where("n = 1").select(F.col("level_id").alias("_l"), "sx", "sy"), (F.col("level_id") == F.col("_l")) & (G.snap(F.col("x")) == F.col("sx")) & (G.snap(F.col("y")) == F.col("sy")), "left_semi")
    return met


def noded(lines: DataFrame) -> DataFrame:
    """Pieces of every line, cut at interior vertices that other features share.

    piece_id ``f:vA-B``, feature_id, start_vertex, end_vertex, geometry, length_3d (the recorded length shared by geometric lengths, the
    last piece taking the remainder) and whole (nothing was cut).  A line of which a piece would snap to a single position stays whole.
    """
    at = vertices(lines)
    joints = safe_junctions(shared(lines), at).select(F.col("level_id").alias("_l"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("z").alias("_z"))
    inner = at.where("vertex > 0 AND vertex < n - 1")
    cuts = inner.join(joints, (F.col("level_id") == F.col("_l")) & (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")) & F.col("z").eqNullSafe(F.col("_z")), "left_semi").groupBy("feature_id").agg(F.array_sort(F.collect_set("vertex")).alias("_cuts"))
    rows = lines.join(cuts, "feature_id", "left")
    marks = F.concat(F.array(F.lit(0)), F.coalesce("_cuts", F.array().cast("array<int>")), F.array(F.size("geometry") - 1))
    rows = rows.withColumn("_marks", marks)
    cell = lambda i: F.struct(G.snap(F.get("geometry", i)["x"]).alias("x"), G.snap(F.get("geometry", i)["y"]).alias("y"))
    pairs = lambda m: F.zip_with(F.slice(m, 1, F.size(m) - 1), F.slice(m, 2, F.size(m) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    collapsed = F.exists(pairs(F.col("_marks")), lambda p: cell(p["a"]) == cell(p["b"]))
    rows = rows.withColumn("_marks", F.when(collapsed, F.array(F.lit(0), F.size("geometry") - 1)).otherwise(F.col("_marks")))
    part = lambda p: F.slice("geometry", p["a"] + 1, p["b"] - p["a"] + 1)
    rows = rows.withColumn("_pairs", pairs(F.col("_marks"))).withColumn("_w", F.transform("_pairs", lambda p: G.length(part(p))))
    rows = rows.withColumn("_len", G.allocate(F.col("length_3d"), F.col("_w")))
    out = rows.select("*", F.posexplode("_pairs").alias("_i", "_p"))
    return out.select(
        F.format_string("%s:v%d-%d", F.col("feature_id").cast("string"), F.col("_p.a"), F.col("_p.b")).alias("piece_id"), "feature_id", "level_id",
        F.col("_p.a").alias("start_vertex"), F.col("_p.b").alias("end_vertex"), F.slice("geometry", F.col("_p.a") + 1, F.col("_p.b") - F.col("_p.a") + 1).alias("geometry"),
        F.get("_len", F.col("_i")).alias("length_3d"), (F.size("_pairs") == 1).alias("whole"),
    )


def conserved(lines: DataFrame, pieces: DataFrame) -> DataFrame:
    """feature_id, conserved: the pieces' lengths add up and their vertices are contiguous and complete."""
    order = W.Window.partitionBy("feature_id").orderBy("start_vertex")
    gaps = pieces.withColumn("_gap", F.coalesce(F.lag("end_vertex").over(order), F.lit(0)) != F.col("start_vertex"))
    per = gaps.groupBy("feature_id").agg(F.sum("length_3d").alias("_sum"), F.max("_gap").alias("_gap"), F.max("end_vertex").alias("_end"))
    met = lines.join(per, "feature_id", "left")
    close = F.abs(F.col("_sum") - F.col("length_3d")) <= F.greatest(F.abs("length_3d") * 1e-12, F.lit(1e-9))
    return met.select("feature_id", F.coalesce(close & ~F.col("_gap") & (F.col("_end") == F.size("geometry") - 1), F.lit(False)).alias("conserved"))


def discontinuous(parts: DataFrame) -> DataFrame:
    """feature_id, discontinuous: some part does not begin where the one before ends, in stored order."""
    order = W.Window.partitionBy("feature_id").orderBy("part_index")
    jump = F.element_at("geometry", 1) != F.lag(F.element_at("geometry", -1)).over(order)
    return parts.withColumn("_j", F.coalesce(jump, F.lit(False))).groupBy("feature_id").agg(F.max("_j").alias("discontinuous"))


#: Reasons for which a multipart line is refused (fixed values).
REFUSED = ("unsupported_multipart_direction", "ambiguous_multipart_part", "branched_or_closed_multipart", "disjoint_multipart", "ambiguous_multipart_chain")


def joined_parts(parts: DataFrame) -> DataFrame:
    """Multipart lines as one open simple line each, part 0 forward.

    ``parts`` has feature_id, part_index, direction and geometry.  Result: feature_id, geometry, parts (array of part_index, reversed), spans (part_index,
    start_vertex, end_vertex of every segment, as the part stores them) and reason, null if accepted, else one of ``REFUSED``.  A single part is returned as it is.

    Ends are counted as rows.  An accepted line grows out of its part 0 on both sides at once: a fold over the feature's parts, as many steps as
    there are parts, puts the part that touches the line's last position after it and the one that touches the first before it.
    """
    point = "struct<x:double,y:double,z:double>"
    first, last = F.element_at("geometry", 1), F.element_at("geometry", -1)
    n = F.size("geometry")
    still = F.exists(F.zip_with(F.slice("geometry", 1, n - 1), F.slice("geometry", 2, n - 1), lambda a, b: a == b), lambda x: x)
    unfit = F.exists("geometry", lambda p: G.finite(p["x"]).isNull() | G.finite(p["y"]).isNull() | G.finite(p["z"]).isNull())
    bad = F.when(F.coalesce(n, F.lit(0)) < 2, True).otherwise(unfit | (first == last) | still | ~G.simple(F.col("geometry")))
    rows = parts.select("feature_id", "part_index", "direction", "geometry", F.coalesce(bad, F.lit(True)).alias("bad"))
    ends = rows.where("NOT bad").select("feature_id", F.explode(F.array(first, last)).alias("p")).groupBy("feature_id", "p").agg(F.count(F.lit(1)).alias("n"))
    ends = ends.groupBy("feature_id").agg(F.count_if(F.col("n") == 1).alias("loose"), F.max("n").alias("most"))
    whole = rows.groupBy("feature_id").agg(
        F.array_sort(F.collect_list(F.struct("part_index", "geometry"))).alias("p"), F.max(F.col("direction").isNull() | (F.col("direction") != 1)).alias("turned"), F.max("bad").alias("bad"),
    ).join(ends.withColumnRenamed("feature_id", "_f"), F.col("feature_id") == F.col("_f"), "left")
    early = F.when(F.size("p") == 1, None).when(F.col("turned"), REFUSED[0]).when(F.col("bad"), REFUSED[1]).when((F.col("loose") != 2) | (F.col("most") > 2), REFUSED[2])
    whole = whole.withColumn("reason", early)

    # line: places in p and whether reversed, in order; head and tail: where it begins and ends.
    tips = F.transform("p", lambda x, i: F.struct(i.cast("int").alias("at"), F.element_at(x["geometry"], 1).cast(point).alias("a"), F.element_at(x["geometry"], -1).cast(point).alias("z")))
    own = F.struct(F.lit(0).alias("at"), F.lit(False).alias("reversed"))
    kind = "struct<line:array<struct<at:int,reversed:boolean>>,head:" + point + ",tail:" + point + ">"
    start = F.struct(F.array(own).alias("line"), F.get("tips", F.lit(0))["a"].alias("head"), F.get("tips", F.lit(0))["z"].alias("tail")).cast(kind)

    def grow(state: Column, _k: Column) -> Column:
        free = F.filter("tips", lambda t: ~F.exists(state["line"], lambda u: u["at"] == t["at"]))
        after = F.get(F.filter(free, lambda t: (t["a"] == state["tail"]) | (t["z"] == state["tail"])), F.lit(0))
        ahead = F.get(F.filter(free, lambda t: (t["a"] == state["head"]) | (t["z"] == state["head"])), F.lit(0))
        ahead_ok = ahead.isNotNull() & ~F.coalesce(ahead["at"] == after["at"], F.lit(False))
        none = F.array().cast("array<struct<at:int,reversed:boolean>>")
        one = lambda t, back: F.array(F.struct(t["at"].alias("at"), back.alias("reversed")))
        line = F.concat(F.when(ahead_ok, one(ahead, ahead["z"] != state["head"])).otherwise(none), state["line"], F.when(after.isNotNull(), one(after, after["a"] != state["tail"])).otherwise(none))
        head = F.when(ahead_ok, F.when(ahead["z"] == state["head"], ahead["a"]).otherwise(ahead["z"])).otherwise(state["head"])
        tail = F.when(after.isNotNull(), F.when(after["a"] == state["tail"], after["z"]).otherwise(after["a"])).otherwise(state["tail"])
        return F.struct(line.alias("line"), head.alias("head"), tail.alias("tail")).cast(kind)

    line = F.aggregate(F.sequence(F.lit(1), F.size("p")), start, grow)["line"]
    whole = whole.withColumn("tips", tips).withColumn("line", F.when(F.col("reason").isNull(), line))
    whole = whole.withColumn("reason", F.coalesce("reason", F.when(F.size("line") != F.size("p"), REFUSED[3])))
    laid = F.transform("line", lambda u, k: F.when(u["reversed"], F.reverse(F.get("p", u["at"])["geometry"])).otherwise(F.get("p", u["at"])["geometry"]))
    joined = F.flatten(F.transform(laid, lambda g, k: F.when(k == 0, g).otherwise(F.slice(g, 2, F.size(g)))))
    whole = whole.withColumn("geometry", joined)
    whole = whole.withColumn("reason", F.coalesce("reason", F.when((F.size("p") > 1) & ~G.simple(F.col("geometry")), REFUSED[4])))

    def span(u: Column) -> Column:
        segments = F.size(F.get("p", u["at"])["geometry"]) - 1
        of = F.get("p", u["at"])["part_index"].cast("int")
        steps = F.filter(F.sequence(F.lit(0), segments), lambda i: i < segments)
        made = F.transform(steps, lambda i: F.struct(of.alias("part_index"), i.alias("start_vertex"), (i + 1).alias("end_vertex")))
        back = F.transform(F.reverse(steps), lambda i: F.struct(of.alias("part_index"), (i + 1).alias("start_vertex"), i.alias("end_vertex")))
        return F.when(u["reversed"], back).otherwise(made)

    fine = F.col("reason").isNull()
    return whole.select(
        "feature_id", F.when(fine, F.col("geometry")).alias("geometry"),
        F.when(fine, F.transform("line", lambda u: F.struct(F.get("p", u["at"])["part_index"].cast("int").alias("part_index"), u["reversed"].alias("reversed")))).alias("parts"),
        F.when(fine, F.flatten(F.transform("line", span))).alias("spans"), "reason",
    )
