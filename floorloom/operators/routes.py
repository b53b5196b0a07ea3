"""Routes as ordered rows: headings, steps, visits, spans and guidance.

Segments are rows ``route, pos, dx, dy, length``; everything ordered is a window over one route, which is as long as a walk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from floorloom.functions import geometry as G
from floorloom.functions import texts as X

MIN_HEADING, MAX_STEPS, MAX_SEGMENTS, END_TOLERANCE = 0.5, 2000, 50000, 0.01
#: Warnings and refusals of a guidance document (fixed values).
LENGTHS = "Mapped geometry does not agree with recorded distance. Distances and turn instructions are unavailable; use this as a route preview only."
FLOORS = "Some floor information is missing or inconsistent. Check floor changes before using this route preview."
REFUSALS = {
    "geometry": "Route geometry is unavailable; cannot show directions.",
    "detail": "This route is too detailed to display directions safely.",
    "coordinates": "Route coordinates are invalid; cannot show directions.",
    "endpoints": "Route geometry does not match its directed endpoints; cannot show directions.",
    "mode": "The route contains an unsupported movement type.",
    "capacity": "This route needs too many instructions to display safely.",
}


def segments(vertices: DataFrame, by: str, order: str) -> DataFrame:
    """by, pos, dx, dy, length from vertices (by, order, x, y): consecutive pairs."""
    w = W.Window.partitionBy(by).orderBy(order)
    rows = vertices.select(by, F.col(order).alias("pos"), "x", "y", F.lead("x").over(w).alias("_x"), F.lead("y").over(w).alias("_y")).where("_x IS NOT NULL")
    return rows.select(by, "pos", (F.col("_x") - F.col("x")).alias("dx"), (F.col("_y") - F.col("y")).alias("dy")).withColumn("length", F.hypot("dx", "dy"))


def headed(rows: DataFrame, *by: str) -> DataFrame:
    """heading of segments of at least half a metre, previous (the last valid one before) and act."""
    w = W.Window.partitionBy(*by).orderBy("pos")
    rows = rows.withColumn("heading", F.when(F.hypot("dx", "dy") >= MIN_HEADING, F.degrees(F.atan2("dy", "dx"))))
    rows = rows.withColumn("previous", F.last("heading", ignorenulls=True).over(w.rowsBetween(W.Window.unboundedPreceding, -1)))
    act = F.when(F.col("heading").isNotNull() & F.col("previous").isNotNull(), G.action(F.col("previous"), F.col("heading")))
    return rows.withColumn("act", F.coalesce(act, F.lit("continue")))


def walk_steps(rows: DataFrame, *by: str) -> DataFrame:
    """by, step, act, start, end (half open, in pos), length: runs between turns."""
    w = W.Window.partitionBy(*by).orderBy("pos")
    marked = headed(rows, *by).withColumn("step", F.sum((F.col("act") != "continue").cast("int")).over(w))
    per = marked.groupBy(*by, "step").agg(F.min(F.struct("pos", "act")).alias("h"), F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.sum("length").alias("length"))
    return per.select(*by, "step", F.col("h.act").alias("act"), "start", "end", "length")


def visits(rows: DataFrame, by: str, order: str, level: str, forced: Column) -> DataFrame:
    """Rows with visit: a new one where the level changes or a row is forced; nulls are a level."""
    w = W.Window.partitionBy(by).orderBy(order)
    new = ~F.col(level).eqNullSafe(F.lag(level).over(w)) | forced
    first = F.row_number().over(w) == 1
    return rows.withColumn("visit", F.sum((new & ~first).cast("int")).over(w))


def spans(rows: DataFrame, by: str, order: str, occurrence: str) -> DataFrame:
    """by, occurrence, start_segment, end_segment: neighbouring segments of one occurrence merged."""
    w = W.Window.partitionBy(by).orderBy(order)
    rows = rows.withColumn("_new", (~F.col(occurrence).eqNullSafe(F.lag(occurrence).over(w))).cast("int")).withColumn("_run", F.sum("_new").over(w))
    return rows.groupBy(by, "_run", occurrence).agg(F.min(order).alias("start_segment"), (F.max(order) + 1).alias("end_segment")).drop("_run")


def running(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    return rows.withColumn("running", F.sum(value).over(W.Window.partitionBy(by).orderBy(order)))


def checked(edges: DataFrame, levels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of routes with refusal (first reason), length_ok and floor_ok.

    ``edges``: route, occurrence, mode, level_id, level_from, level_to, source, target, geometry, length_3d;
    ``levels``: level_id, label, vertical_order; ``nodes``: node, x, y, vertical_order, level_ids.
    """
    at = lambda p: nodes.select(F.col("node").alias(f"_{p}"), F.struct("x", "y", "vertical_order", "level_ids").alias(f"{p}_node"))
    rows = edges.join(at("source"), F.col("source") == F.col("_source"), "left").join(at("target"), F.col("target") == F.col("_target"), "left").drop("_source", "_target")
    order = lambda p: levels.select(F.col("level_id").alias(f"_{p}"), F.struct("label", "vertical_order").alias(p))
    walk = F.col("mode") == "pathway"
    rows = rows.withColumns({"_from": F.when(walk, F.col("level_id")).otherwise(F.col("level_from")), "_to": F.when(walk, F.col("level_id")).otherwise(F.col("level_to"))})
    rows = rows.join(order("lf").withColumnRenamed("_lf", "_a"), F.col("_from") == F.col("_a"), "left").join(order("lt").withColumnRenamed("_lt", "_b"), F.col("_to") == F.col("_b"), "left")

    def floor(level: str, label: str, node: str) -> Column:
        known = F.col(f"{label}.vertical_order").isNotNull() & (F.col(f"{node}.vertical_order") == F.col(f"{label}.vertical_order"))
        return F.coalesce(known & F.array_contains(F.col(f"{node}.level_ids"), F.col(level)) & (F.trim(F.col(f"{label}.label")) != ""), F.lit(False))

    from_ok, to_ok = floor("_from", "lf", "source_node"), floor("_to", "lt", "target_node")
    first, last = F.get("geometry", F.lit(0)), F.get("geometry", F.size("geometry") - 1)
    near = lambda p, n: F.coalesce(F.hypot(p["x"] - F.col(f"{n}.x"), p["y"] - F.col(f"{n}.y")) <= END_TOLERANCE, F.lit(False))
    bad = F.exists("geometry", lambda p: G.finite(p["x"]).isNull() | G.finite(p["y"]).isNull())
    total = F.sum(F.greatest(F.size("geometry") - 1, F.lit(0))).over(W.Window.partitionBy("route").orderBy("occurrence"))
    refusal = (
        F.when(F.col("geometry").isNull() | (F.size("geometry") < 2), "geometry").when(total > MAX_SEGMENTS, "detail").when(bad, "coordinates")
        .when(~near(first, "source_node") | ~near(last, "target_node"), "endpoints").when(~F.col("mode").isin("pathway", "stairs", "elevator"), "mode")
    )
    flat = F.exists("geometry", lambda p: p["z"].isNull())
    measured = G.length(F.col("geometry"))
    weight = G.positive(F.col("length_3d"))
    length_ok = F.coalesce(~flat & weight.isNotNull() & (measured > 0) & G.agrees(measured, weight), F.lit(False))
    floor_ok = from_ok & to_ok & (walk | (F.col("_from") != F.col("_to")))
    return rows.withColumns({"refusal": refusal, "length_ok": length_ok, "floor_ok": floor_ok, "from_ok": from_ok, "to_ok": to_ok, "measured": measured})


def guidance(edges: DataFrame, ends: DataFrame, levels: DataFrame, nodes: DataFrame, internal: str = "INT_") -> tuple[DataFrame, DataFrame]:
    """Documents (route, status, distance_m, warnings) and steps (route, step_id, kind, action, instruction, level_id, visit, distance_m).

    ``ends``: route, origin_label, origin_level, destination_label, destination_level.  A refused route has no steps; one whose lengths or floors
    do not agree is limited: it has steps, but neither turns nor distances.  More than 2000 steps are refused, never cut.  Labels that begin with
    ``internal`` are not shown.
    """
    rows = checked(edges, levels, nodes)
    whole = rows.groupBy("route").agg(
        F.min(F.when(F.col("refusal").isNotNull(), F.struct("occurrence", "refusal"))).alias("r"), F.every("length_ok").alias("lengths"), F.every("floor_ok").alias("floors"),
        F.sum("length_3d").alias("total"),
    )
    known = F.broadcast(levels.select(F.col("level_id").alias("_l"), F.col("label").alias("_label")))  # a building's floors
    named = lambda df, level, out: df.join(known.withColumnsRenamed({"_l": "_l" + out, "_label": out}), F.col(level) == F.col("_l" + out), "left").drop("_l" + out)
    ends = named(named(ends, "origin_level", "o_label"), "destination_level", "d_label")
    both = ends.join(whole, "route", "left")
    floors = F.coalesce("floors", F.lit(True)) & (F.trim(F.coalesce("o_label", F.lit(""))) != "") & (F.trim(F.coalesce("d_label", F.lit(""))) != "")
    warnings = F.filter(F.array(F.when(~F.coalesce("lengths", F.lit(True)), LENGTHS), F.when(~floors, FLOORS)), lambda x: x.isNotNull())
    text = F.create_map(*[F.lit(x) for pair in REFUSALS.items() for x in pair])
    both = both.withColumn("warnings", F.when(F.col("r").isNotNull(), F.array(F.element_at(text, F.col("r.refusal")))).otherwise(warnings))
    both = both.withColumn("status", F.when(F.col("r").isNotNull(), "unavailable").when(F.size("warnings") > 0, "limited").otherwise("available"))
    both = both.withColumn("distance_m", F.when(F.col("status") == "available", F.coalesce("total", F.lit(0.0))))
    live = both.where("status <> 'unavailable'").select("route", "status")
    rows = rows.join(live, "route")

    # Walks: neighbouring pathways of one floor; a transition or another floor begins a new run.
    w = W.Window.partitionBy("route").orderBy("occurrence")
    walk = F.col("mode") == "pathway"
    rows = rows.withColumn("_level", F.when(walk & F.col("from_ok") & F.col("to_ok"), F.col("level_id")))
    cut = ~walk | ~F.coalesce(F.lag(walk).over(w), F.lit(False)) | ~F.col("_level").eqNullSafe(F.lag("_level").over(w))
    rows = rows.withColumn("_run", F.sum(cut.cast("int")).over(w))
    n = F.size("geometry")
    pairs = F.zip_with(F.slice("geometry", 1, n - 1), F.slice("geometry", 2, n - 1), lambda a, b: F.struct((b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy")))
    lengths = G.segment_lengths(F.col("geometry"))
    # A line without length has no shares; its route is limited.
    legs = rows.where(walk).select("route", "status", "_run", "_level", "occurrence", F.posexplode(F.arrays_zip(pairs.alias("m"), F.transform(lengths, lambda x: F.try_divide(x * F.col("length_3d"), F.col("measured"))).alias("l"))).alias("k", "s"))
    legs = legs.select("route", "status", "_run", "_level", (F.col("occurrence").cast("long") * (1 << 20) + F.col("k")).alias("pos"), "s.m.dx", "s.m.dy", F.col("s.l").alias("length"))
    limited = F.col("status") == "limited"
    turned = walk_steps(legs.where(~limited), "route", "_run", "_level").select("route", "_run", "_level", "step", "act", F.col("length").alias("distance_m"))
    plain = legs.where(limited).groupBy("route", "_run", "_level").agg(F.lit(0).cast("long").alias("step"), F.lit("continue").alias("act"), F.lit(None).cast("double").alias("distance_m"))
    steps = turned.unionByName(plain).select(
        "route", F.col("_run").alias("a"), F.col("step").alias("b"), F.lit("walk").alias("kind"), F.col("act").alias("action"),
        G.walking_text(F.col("act"), F.col("distance_m")).alias("instruction"), F.col("_level").alias("level_id"), "distance_m", F.lit(False).alias("forced"),
    )
    # Transitions: a departure and an arrival, which always opens a visit.
    change = F.col("lt.vertical_order") - F.col("lf.vertical_order")
    ride = rows.where(~walk).withColumns({"_f": F.when(F.col("from_ok"), F.col("_from")), "_t": F.when(F.col("to_ok"), F.col("_to"))})
    way = F.when(F.col("_f").isNotNull() & F.col("_t").isNotNull(), F.when(change > 0, " up").when(change < 0, " down").otherwise("")).otherwise("")
    label = F.when(F.col("_t").isNotNull(), F.trim("lt.label")).otherwise("Floor not recorded")
    leave = F.when(F.col("_t").isNotNull(), F.concat(F.lit("Take the "), "mode", way, F.lit(" to "), label, F.lit("."))).otherwise(F.concat(F.lit("Take the "), "mode", F.lit("; the arrival floor is not recorded.")))
    step = lambda b, act, text, level, forced: F.struct(F.lit(b).cast("long").alias("b"), act.alias("action"), text.alias("instruction"), level.alias("level_id"), F.lit(forced).alias("forced"))
    two = F.array(step(0, F.concat(F.lit("take_"), "mode"), leave, F.col("_f"), False), step(1, F.lit("exit_transition"), F.concat(F.lit("Exit the "), "mode", F.lit(" on "), label, F.lit(".")), F.col("_t"), True))
    rides = ride.select("route", F.col("_run").alias("a"), F.explode(two).alias("s")).select("route", "a", "s.b", F.lit("transition").alias("kind"), "s.action", "s.instruction", "s.level_id", F.lit(None).cast("double").alias("distance_m"), "s.forced")
    room = lambda c: X.room_label(F.col(c), internal)
    tip = lambda a, kind, act, text, level: ends.join(live, "route").select("route", F.lit(a).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(kind).alias("kind"), F.lit(act).alias("action"), text.alias("instruction"), F.col(level).alias("level_id"), F.lit(None).cast("double").alias("distance_m"), F.lit(False).alias("forced"))
    every = tip(-1, "depart", "start", F.concat(F.lit("Start near "), room("origin_label"), F.lit(".")), "origin_level").unionByName(steps).unionByName(rides)
    every = every.unionByName(tip(1 << 40, "arrive", "arrive", F.concat(F.lit("The mapped route ends near "), room("destination_label"), F.lit(".")), "destination_level"))
    order = W.Window.partitionBy("route").orderBy("a", "b")
    every = every.withColumn("_n", F.row_number().over(order) - 1).withColumn("_total", F.count(F.lit(1)).over(W.Window.partitionBy("route")))
    every = visits(every, "route", "_n", "level_id", F.col("forced"))
    over = every.where(F.col("_total") > MAX_STEPS).select("route").distinct().withColumn("_over", F.lit(True))
    docs = both.join(over, "route", "left").select(
        "route", F.when(F.col("_over"), "unavailable").otherwise(F.col("status")).alias("status"), F.when(F.col("_over").isNull(), F.col("distance_m")).alias("distance_m"),
        F.when(F.col("_over"), F.array(F.lit(REFUSALS["capacity"]))).otherwise(F.col("warnings")).alias("warnings"),
    )
    out = every.where(F.col("_total") <= MAX_STEPS).select("route", F.concat(F.lit("step-"), "_n").alias("step_id"), "kind", "action", "instruction", "level_id", F.concat(F.lit("visit-"), "visit").alias("visit_id"), "distance_m")
    return docs, out


def guided(edges: DataFrame, ends: DataFrame, levels: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Checked edges with run and limited, the routes that have directions, and their ends; what the parts of a document are made of."""
    rows = checked(edges, levels, nodes)
    whole = rows.groupBy("route").agg(F.max(F.col("refusal").isNotNull()).alias("refused"), (~F.every("length_ok") | ~F.every("floor_ok")).alias("limited"))
    live = ends.select("route").join(whole, "route", "left").where(~F.coalesce("refused", F.lit(False))).select("route", F.coalesce("limited", F.lit(False)).alias("limited"))
    w = W.Window.partitionBy("route").orderBy("occurrence")
    walk = F.col("mode") == "pathway"
    rows = rows.join(live, "route").withColumns({"level": F.when(walk & F.col("from_ok") & F.col("to_ok"), F.col("level_id")), "_walk": walk})
    cut = ~walk | ~F.coalesce(F.lag("_walk").over(w), F.lit(False)) | ~F.col("level").eqNullSafe(F.lag("level").over(w))
    return rows.withColumn("run", F.sum(cut.cast("int")).over(w)), live, ends


def markers(rows: DataFrame, live: DataFrame, ends: DataFrame, tips: DataFrame, internal: str = "INT_") -> DataFrame:
    """route, marker_id, kind, level_id, label, x, y: both ends of a route and both sides of its changes of floor, in order.

    ``tips``: route, origin_xy, destination_xy (structs, null if unknown).
    """
    point = lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))
    ride = rows.where(~F.col("_walk"))
    title = F.initcap("mode")
    side = lambda b, ok, level, verb, at: F.struct(F.lit(b).alias("b"), F.col("mode").alias("kind"), F.when(F.col(ok), F.col(level)).alias("level_id"), F.concat(title, F.lit(f" {verb}")).alias("label"), point(at).alias("p"))
    two = F.array(side(0, "from_ok", "_from", "departure", F.element_at("geometry", 1)), side(1, "to_ok", "_to", "arrival", F.element_at("geometry", -1)))
    middle = ride.select("route", F.col("occurrence").cast("long").alias("a"), F.explode(two).alias("m")).select("route", "a", "m.*")
    known = ends.join(live, "route").join(tips, "route")
    tip = lambda a, kind, text: known.select("route", F.lit(a).cast("long").alias("a"), F.lit(0).alias("b"), F.lit(kind).alias("kind"), F.col(f"{kind}_level").alias("level_id"), F.concat(F.lit(text), X.room_label(F.col(f"{kind}_label"), internal)).alias("label"), F.col(f"{kind}_xy").alias("p"))
    every = tip(-1, "origin", "Start near ").unionByName(middle).unionByName(tip(1 << 40, "destination", "End near "))
    every = every.where(G.finite(F.col("p.x")).isNotNull() & G.finite(F.col("p.y")).isNotNull())
    number = F.row_number().over(W.Window.partitionBy("route").orderBy("a", "b")) - 1
    return every.select("route", F.concat(F.lit("marker-"), number).alias("marker_id"), "kind", "level_id", "label", "p.x", "p.y")


def transitions(rows: DataFrame, live: DataFrame, ends: DataFrame) -> DataFrame:
    """route, transition_id, edge_occurrence, mode, floors, labels, visits and markers on both sides, distance_m of every change of floor.

    A visit begins with the route, on another floor than the one before, and with every arrival; markers count from the origin's.
    """
    w = W.Window.partitionBy("route").orderBy("occurrence")
    left = F.when(F.col("_walk"), F.col("level")).otherwise(F.when(F.col("from_ok"), F.col("_from")))
    came = F.when(F.col("_walk"), F.col("level")).otherwise(F.when(F.col("to_ok"), F.col("_to")))
    first = ends.select(F.col("route").alias("_r"), F.col("origin_level").alias("_start"))
    seen = rows.join(first, F.col("route") == F.col("_r")).withColumns({"_left": left, "_came": came})
    before = F.when(F.row_number().over(w) == 1, F.col("_start")).otherwise(F.lag("_came").over(w))
    opened = (~F.col("_left").eqNullSafe(before)).cast("int")
    seen = seen.withColumn("_open", opened).withColumn("_forced", (~F.col("_walk")).cast("int"))
    seen = seen.withColumn("_visit", F.sum(F.col("_open") + F.col("_forced")).over(w)).withColumn("_n", F.sum("_forced").over(w) - 1)
    label = lambda ok, p: F.when(F.col(ok), F.trim(f"{p}.label")).otherwise("Floor not recorded")
    name = lambda kind, n: F.concat(F.lit(f"{kind}-"), n.cast("string"))
    return seen.where(~F.col("_walk")).select(
        "route", name("transition", F.col("_n")).alias("transition_id"), F.col("occurrence").alias("edge_occurrence"), "mode", F.col("_left").alias("from_level_id"), F.col("_came").alias("to_level_id"),
        label("from_ok", "lf").alias("from_label"), label("to_ok", "lt").alias("to_label"), name("visit", F.col("_visit") - 1).alias("from_visit_id"), name("visit", F.col("_visit")).alias("to_visit_id"),
        name("marker", 2 * F.col("_n") + 1).alias("departure_marker_id"), name("marker", 2 * F.col("_n") + 2).alias("arrival_marker_id"), F.when(~F.col("limited"), F.col("length_3d")).alias("distance_m"),
    )


def geometries(rows: DataFrame, live: DataFrame) -> DataFrame:
    """route, geometry_id, level_id, edge_occurrence, start_segment, end_segment, coordinates: what each walking step shows of each edge.

    Steps are cut at turns; neighbouring segments of one edge in one step are one piece.  Limited routes have one step a run.
    """
    n = F.size("geometry")
    pairs = F.zip_with(F.slice("geometry", 1, n - 1), F.slice("geometry", 2, n - 1), lambda a, b: F.struct((b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy")))
    legs = rows.where("_walk").select("route", "run", "level", "limited", "occurrence", F.posexplode(pairs).alias("k", "m"))
    legs = legs.select("route", "run", "level", "limited", "occurrence", F.col("k").cast("long").alias("k"), (F.col("occurrence").cast("long") * (1 << 20) + F.col("k")).alias("pos"), "m.dx", "m.dy", F.hypot("m.dx", "m.dy").alias("length"))
    acts = headed(legs, "route", "run")
    step = F.sum(F.when(~F.col("limited") & (F.coalesce(F.col("act"), F.lit("continue")) != "continue"), 1).otherwise(0)).over(W.Window.partitionBy("route", "run").orderBy("pos"))
    spans_ = acts.withColumn("step", step).groupBy("route", "run", "level", "step", "occurrence").agg(F.min("k").alias("start_segment"), (F.max("k") + 1).alias("end_segment"))
    shown = spans_.join(rows.select("route", "occurrence", "geometry"), ["route", "occurrence"])
    number = F.row_number().over(W.Window.partitionBy("route").orderBy("run", "step", "occurrence", "start_segment")) - 1
    part = F.slice("geometry", (F.col("start_segment") + 1).cast("int"), (F.col("end_segment") - F.col("start_segment") + 1).cast("int"))
    return shown.select("route", F.concat(F.lit("geometry-"), number).alias("geometry_id"), F.col("level").alias("level_id"), F.col("occurrence").alias("edge_occurrence"), "start_segment", "end_segment", G.xy(part).alias("coordinates"))


def legacy_steps(edges: DataFrame) -> DataFrame:
    """route, place, type, instruction: depart, one step per pathway, two per transition, arrive.

    ``edges``: route, occurrence, mode, key, geometry.  The heading is forgotten at each transition.
    """
    w = W.Window.partitionBy("route").orderBy("occurrence")
    walk = F.col("mode") == "pathway"
    rows = edges.withColumns({"_in": G.line_bearing(F.col("geometry")), "_out": G.line_bearing(F.col("geometry"), departing=False)})
    rows = rows.withColumn("_before", F.when(walk & F.lag(walk).over(w), F.lag("_out").over(w)))
    delta = G.turn(F.col("_before"), F.col("_in"))
    size, side = F.abs(delta), F.when(delta > 0, "left").otherwise("right")
    straight = F.coalesce(size < 15, F.lit(True))
    text = F.when(straight, "Continue along the measured pathway.").when(size <= 45, F.concat(F.lit("Bear "), side, F.lit(" along the measured pathway."))).when(size <= 135, F.concat(F.lit("Turn "), side, F.lit(" along the measured pathway."))).otherwise(F.concat(F.lit("Make a "), side, F.lit(" u-turn along the measured pathway.")))
    one = lambda t, s: F.struct(t.alias("type"), s.alias("instruction"))
    walked = F.array(one(F.when(straight, "continue").otherwise("turn"), text))
    rode = F.array(*[one(F.lit(f"{verb}_transition"), F.concat(F.lit(f"{verb.capitalize()} the "), "mode", F.lit(" transition."))) for verb in ("enter", "exit")])
    out = rows.select("route", "occurrence", F.posexplode(F.when(walk, walked).otherwise(rode)).alias("k", "s"))
    return out.select("route", F.row_number().over(W.Window.partitionBy("route").orderBy("occurrence", "k")).alias("place"), "s.type", "s.instruction")
