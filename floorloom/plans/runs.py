"""Queries over layers as files, manifests, staged runs, and rules that go through events in order."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from floorloom.functions import geometry as G
from floorloom.operators import graph, lineage, network, review
from floorloom.plans.network import _COMP, _LABELS, _arcs, _labels
from floorloom.plans.recovery import shared_folder
from floorloom.plans.registry import query
from floorloom.sources import layers


def _place(v, name):
    """A path of its own in the shared folder."""
    return f"{shared_folder(v.spark)}/{name}-{uuid.uuid4().hex}"


@query("a3_append_or_create", "SELECT level_id, count(*) AS units, sum(unit_id)::BIGINT AS ids FROM v_unit GROUP BY 1")
def _(v):
    """A layer that is created by its first part and appended to by its second."""
    path = _place(v, "units")
    for k in (0, 1):
        layers.put(v.unit.where(F.col("unit_id") % 2 == k), path)
    return v.spark.read.parquet(path).groupBy("level_id").agg(F.count(F.lit(1)).alias("units"), F.sum("unit_id").alias("ids"))


@query("a4_staged_install", "SELECT level_id, facility_id, short_name || '!' AS short_name FROM v_level")
def _(v):
    """A layer installed, then replaced as a whole."""
    path = _place(v, "levels")
    layers.install(v.level.select("level_id", "facility_id", "short_name"), path)
    layers.install(v.level.select("level_id", "facility_id", F.concat("short_name", F.lit("!")).alias("short_name")), path, overwrite=True)
    return v.spark.read.parquet(path)


@query("a6_drop_and_create", "SELECT facility_id, name FROM v_facility")
def _(v):
    """Dropped if it is there, then created; twice with one result."""
    path = _place(v, "facilities")
    for _k in range(2):
        layers.drop(v.spark, path)
        layers.install(v.facility.select("facility_id", "name"), path)
    return v.spark.read.parquet(path)


@query("a7_create_as", "SELECT l.facility_id::INT AS facility_id, count(*)::INT AS units, min(u.room_id) AS first, 'int,int,string' AS types FROM v_unit u JOIN v_level l USING (level_id) GROUP BY 1")
def _(v):
    """A typed layer out of a query."""
    made = layers.create_as(v.spark, "SELECT facility_id, count(*) AS units, min(room_id) AS first FROM {u} JOIN {l} USING (level_id) GROUP BY 1", _place(v, "per_facility"), "facility_id int, units int, first string", u=v.unit, l=v.level)
    return made.withColumn("types", F.lit(",".join(t for _, t in made.dtypes)))


@query("a8_feature_documents", "SELECT unit_id, room_id, level_id, x FROM v_unit")
def _(v):
    """Features written as JSON documents and read again."""
    path = _place(v, "documents")
    layers.documents(v.unit.select("unit_id", "room_id", "level_id", "x"), path)
    return layers.read_documents(v.spark, path, "unit_id long, room_id string, level_id int, x double")


@query("a9_feature_collection", "SELECT unit_id, 'Point' AS type, round(x + 505000.0, 3) AS x, round(y + 5458000.0, 3) AS y FROM v_unit")
def _(v):
    """GeoJSON features in degrees, out of metres; read again and taken back."""
    path = _place(v, "geojson")
    point = F.array(F.struct((F.col("x") + 505000.0).alias("x"), (F.col("y") + 5458000.0).alias("y"), F.lit(0.0).alias("z")))
    layers.collection(v.unit.withColumn("g", point), ["unit_id"], "g", "EPSG:26910", "EPSG:4326").write.text(path)
    rows = layers.read_documents(v.spark, path, "properties struct<unit_id:long>, geometry struct<type:string,coordinates:array<double>>")
    back = G.utm_forward(F.get("geometry.coordinates", F.lit(0)), F.get("geometry.coordinates", F.lit(1)))
    return rows.select("properties.unit_id", "geometry.type", F.round(back["x"], 3).alias("x"), F.round(back["y"], 3).alias("y"))


@query("a12_graph_files", "SELECT mode, count(*) AS arcs, (SELECT count(*) * 2 FROM v_feature) AS entries FROM (SELECT mode FROM v_feature WHERE src <> dst UNION ALL SELECT mode FROM v_feature WHERE src <> dst) GROUP BY 1")
def _(v):
    """Graph and node map, written and read again."""
    paths = _place(v, "arcs"), _place(v, "node_map")
    layers.install(graph.both_ways(v.feature), paths[0])
    layers.install(network.node_map(v.feature), paths[1])
    arcs, entries = (v.spark.read.parquet(p) for p in paths)
    return arcs.groupBy("mode").agg(F.count(F.lit(1)).alias("arcs")).crossJoin(F.broadcast(entries.agg(F.count(F.lit(1)).alias("entries"))))  # one row


@query("a13_stats_documents", """SELECT '{"level_id":' || level_id || ',"searchable":' || count(*) FILTER (searchable = 'Y') || ',"units":' || count(*) || '}' AS value FROM v_unit GROUP BY level_id""")
def _(v):
    """Statistics as JSON with sorted keys."""
    path = _place(v, "stats")
    rows = v.unit.groupBy("level_id").agg(F.count(F.lit(1)).alias("units"), F.count_if(F.col("searchable") == "Y").alias("searchable"))
    layers.stats(rows, path, "units", "searchable", "level_id")
    return v.spark.read.text(path)


@query("a15_ledger", "SELECT CAST(unit_id AS VARCHAR) AS unit_id, room_id, use_type FROM v_unit")
def _(v):
    """A CSV ledger with a header, read again as text."""
    path = _place(v, "ledger")
    layers.ledger(v.unit.select("unit_id", "room_id", "use_type"), path)
    return v.spark.read.option("header", True).csv(path)


_YAML = """# use types
Office:
  category: office

Washroom, single-stall:
  category: washroom
  accessible: false
  gender: neutral
"Ramp":
  category: corridor  # a way
  accessible: true
"""


@query("a16_yaml_dimension", "SELECT * FROM (VALUES ('Office', 'office', CAST(NULL AS BOOLEAN), CAST(NULL AS VARCHAR)), ('Washroom, single-stall', 'washroom', false, 'neutral'), ('Ramp', 'corridor', true, NULL)) AS t(use_type, category, accessible, gender)")
def _(v):
    """A dimension out of YAML."""
    return layers.yaml_dimension(v.spark, _YAML)


@query("a17_file_digests", "SELECT level_id, strlen(t)::BIGINT AS size, sha256(t) AS sha256 FROM (SELECT level_id, string_agg(room_id || chr(10), '' ORDER BY room_id || chr(10)) AS t FROM v_unit GROUP BY 1)")
def _(v):
    """Files below a folder, with size and digest (M8)."""
    path = _place(v, "files")
    v.unit.select("level_id", "room_id").repartition("level_id").sortWithinPartitions("level_id", "room_id").write.partitionBy("level_id").text(path)
    found = layers.file_digests(v.spark, path).where(F.col("path").contains("level_id="))
    return found.select(F.regexp_extract("path", "level_id=([0-9]+)", 1).cast("int").alias("level_id"), "size", "sha256")


@query("a18_layer_metadata", "SELECT * FROM (VALUES ('units', 'area', 'decimal(9,2)', 9, 2, NULL), ('units', 'level_id', 'int', NULL, NULL, NULL), ('units', 'outline', 'array<struct<x:double,y:double,z:double>>', NULL, NULL, 'LineString'), ('units', 'unit_id', 'bigint', NULL, NULL, NULL)) AS t(layer, field, type, width, precision, geometry)")
def _(v):
    """Fields of a layer by name, with type, width, precision and the kind of geometry."""
    line = F.array(F.struct(F.col("x"), F.col("y"), F.lit(0.0).alias("z")))
    return layers.metadata(v.unit.select("unit_id", "level_id", F.col("x").cast("decimal(9,2)").alias("area"), line.alias("outline")), "units").drop("nullable")


@query("a19_schema_contract", "SELECT * FROM (VALUES ('doors', NULL), ('units', 'outline')) AS t(layer, field)")
def _(v):
    """Layers and fields that a contract asks for and the source lacks."""
    there = layers.require_layers({"units": v.unit, "levels": v.level}, {"units": {"unit_id", "room_id"}, "levels": {"level_id"}})
    return layers.lacking(v.spark, there, {"units": {"unit_id", "outline"}, "levels": {"level_id", "short_name"}, "doors": {"door_id"}})


@query("b20_xy_projection", "SELECT edge_id, count(*) AS points, round(sum(x), 4) AS x, round(sum(y), 4) AS y FROM v_vertex GROUP BY 1")
def _(v):
    """Lines of XYZ points as XY points."""
    p = F.transform(F.array_sort(F.collect_list(F.struct("i", "x", "y"))), lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"), F.lit(7.0).alias("z")))
    rows = v.vertex.groupBy("edge_id").agg(p.alias("g")).select("edge_id", G.xy(F.col("g")).alias("g"))
    return rows.select("edge_id", F.size("g").cast("long").alias("points"), F.round(G.total(F.transform("g", lambda q: q["x"])), 4).alias("x"), F.round(G.total(F.transform("g", lambda q: q["y"])), 4).alias("y"))


@query("d6_reverse_spans", "SELECT edge_id, string_agg((i + 1) || '-' || i, ',' ORDER BY i DESC) AS spans FROM v_vertex GROUP BY 1")
def _(v):
    """Spans of a line walked backwards: the last first, ends exchanged."""
    span = F.struct(F.col("edge_id").alias("feature_id"), F.lit(0).alias("part_index"), F.col("i").alias("start_vertex"), (F.col("i") + 1).alias("end_vertex"))
    rows = v.vertex.groupBy("edge_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", span.alias("s")))), lambda x: x["s"]).alias("s"))
    return rows.select("edge_id", F.array_join(F.transform(G.reverse_spans(F.col("s")), lambda s: F.concat_ws("-", s["start_vertex"].cast("string"), s["end_vertex"].cast("string"))), ",").alias("spans"))


@query("d19_tagged_values", """
WITH s AS (SELECT level_id, string_agg(DISTINCT '"' || use_type || '"', ',' ORDER BY '"' || use_type || '"') AS items FROM v_unit GROUP BY 1),
m AS (SELECT level_id, string_agg('["' || use_type || '",' || n || ']', ',' ORDER BY '["' || use_type || '",' || n || ']') AS entries FROM (SELECT level_id, use_type, count(*) AS n FROM v_unit GROUP BY 1, 2) GROUP BY 1)
SELECT level_id, '{"items":[' || items || '],"type":"set"}' AS kinds, '{"entries":[' || entries || '],"type":"mapping"}' AS counts,
  '{"type":"geometry","value":{"entries":[["coordinates",[' || level_id || ',0]],["type","Point"]],"type":"mapping"}}' AS place FROM s JOIN m USING (level_id)""")
def _(v):
    """Sets, mappings and geometries as JSON that says which they are."""
    per = v.unit.groupBy("level_id", "use_type").agg(F.count(F.lit(1)).alias("n"))
    quoted = F.concat(F.lit('"'), "use_type", F.lit('"'))
    rows = per.groupBy("level_id").agg(F.collect_list(quoted).alias("k"), F.collect_list(F.struct(quoted.alias("k"), F.col("n").cast("string").alias("v"))).alias("e"))
    place = lineage.tagged_geometry("Point", F.concat(F.lit("["), F.col("level_id").cast("string"), F.lit(",0]")))
    return rows.select("level_id", lineage.tagged_set(F.col("k")).alias("kinds"), lineage.tagged_map(F.col("e")).alias("counts"), place.alias("place"))


@query("d28_simple_lines", "SELECT unit_id, unit_id % 4 NOT IN (1, 3) AS simple FROM v_unit")
def _(v):
    """Whether lines cross or touch themselves: a bend, a loop, a straight line, one that comes back to touch itself."""
    p = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.lit(0.0).alias("z"))
    k = F.col("unit_id") % 4
    line = F.when(k == 0, F.array(p(0.0, 0.0), p(4.0, 0.0), p(4.0, 4.0))).when(k == 1, F.array(p(0.0, 0.0), p(4.0, 4.0), p(4.0, 0.0), p(0.0, 4.0)))
    line = line.when(k == 2, F.array(p(0.0, 0.0), p(2.0, 0.0), p(4.0, 0.0))).otherwise(F.array(p(0.0, 0.0), p(8.0, 0.0), p(8.0, 4.0), p(4.0, 4.0), p(4.0, -4.0)))
    return v.unit.select("unit_id", G.simple(line).alias("simple"))


_GATES = """prof3 AS (SELECT * FROM (VALUES ('pathway','pathway'),('elevator','pathway'),('elevator','elevator'),('stairs','pathway'),('stairs','stairs')) AS t(profile, mode)), f3 AS (SELECT * FROM v_feature WHERE src <> dst),
nodes3 AS (SELECT src AS n FROM f3 UNION SELECT dst FROM f3), und3 AS (SELECT p.profile, src AS a, dst AS b FROM f3 JOIN prof3 p USING (mode) UNION SELECT p.profile, dst, src FROM f3 JOIN prof3 p USING (mode)),
r3 AS (SELECT profile, n AS node, n AS seen FROM nodes3, (SELECT DISTINCT profile FROM prof3) UNION SELECT r.profile, r.node, u.b FROM r3 r JOIN und3 u ON u.profile = r.profile AND u.a = r.seen),
k3 AS (SELECT profile, count(DISTINCT m) AS c FROM (SELECT profile, node, min(seen) AS m FROM r3 GROUP BY 1, 2) GROUP BY 1)"""


@query("g13_gates", f"""WITH RECURSIVE {_GATES} SELECT profile AS name, (SELECT c FROM k3 WHERE profile = 'pathway') AS before, c AS after, true AS ok FROM k3 WHERE profile <> 'pathway'
UNION ALL SELECT 'features', (SELECT count(*) FROM v_feature), (SELECT count(*) FROM f3), (SELECT count(*) FROM v_feature) = (SELECT count(*) FROM f3)""")  # fmt: skip
def _(v):
    """Gates of a build: components must not rise when stairs or elevators join, features must stay as many."""
    real = v.feature.where("src <> dst")
    profiles = {"pathway": ("pathway",), "elevator": ("pathway", "elevator"), "stairs": ("pathway", "stairs")}
    names = v.spark.createDataFrame([(p,) for p in profiles], "profile string")
    loops = real.select(F.explode(F.array("src", "dst")).alias("src")).distinct().crossJoin(F.broadcast(names)).select("profile", "src", F.col("src").alias("dst"))
    found = graph.profile_components(graph.by_profile(real, profiles).select("profile", "src", "dst").union(loops))
    counts = found.groupBy(F.col("profile").alias("name")).agg(F.count_distinct("component").alias("n"))
    total = lambda df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("features").alias("name"), "n")
    walking = counts.where("name = 'pathway'").select("n")
    old = v.spark.createDataFrame([("elevator",), ("stairs",)], "name string").crossJoin(F.broadcast(walking)).union(total(v.feature))
    return review.gates(old, counts.where("name <> 'pathway'").union(total(real)), ("elevator", "stairs"), ("features",))


@query("g25_evidence", f"""
WITH RECURSIVE {_LABELS}, same AS (SELECT a.profile, a.unit_id AS o, min(b.unit_id) AS d FROM lab a JOIN lab b ON a.profile = b.profile AND a.rid = b.rid AND a.unit_id < b.unit_id GROUP BY 1, 2),
other AS (SELECT a.profile, a.unit_id AS o, min(b.unit_id) AS d FROM lab a JOIN lab b ON a.profile = b.profile AND a.rid <> b.rid AND a.unit_id < b.unit_id GROUP BY 1, 2),
iso AS (SELECT p.profile, string_agg(CAST(n.node_id AS VARCHAR), ',' ORDER BY CAST(n.node_id AS VARCHAR)) AS ids FROM v_node n CROSS JOIN profs p LEFT JOIN comp c ON c.profile = p.profile AND c.node = n.node_id WHERE c.node IS NULL GROUP BY 1),
doc AS (SELECT p.profile, '{{"different":[' || (SELECT min(o) || ',' || arg_min(d, o) FROM other x WHERE x.profile = p.profile) || '],"isolated":[' || coalesce(iso.ids, '') || '],"profile":"' || p.profile || '","same":[' || (SELECT min(o) || ',' || arg_min(d, o) FROM same x WHERE x.profile = p.profile) || ']}}' AS body
        FROM profs p LEFT JOIN iso ON iso.profile = p.profile)
SELECT profile, body, sha256(body) AS digest FROM doc""")  # fmt: skip
def _(v):
    """Evidence of a build per profile, with its own digest: a connected and an unconnected pair of units, and the nodes without an arc.

    Every profile has a row; the body of one without either pair is null, as nothing proves it.
    """
    pairs = graph.first_pairs(_labels(v).select("profile", "unit_id", "rid"))
    pair = lambda kind: F.max(F.when(F.col("outcome") == kind, F.concat_ws(",", F.col("o").cast("string"), F.col("d").cast("string")))).alias(kind)
    both = pairs.groupBy("profile").agg(pair("same"), pair("different"))
    used = _arcs(v).select("profile", F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    profiles = v.spark.createDataFrame([(p,) for p in graph.PROFILES], "profile string")
    alone = v.node.select("node_id").crossJoin(F.broadcast(profiles)).join(used, ["profile", "node_id"], "left_anti")
    alone = alone.groupBy("profile").agg(F.array_join(F.array_sort(F.collect_list(F.col("node_id").cast("string"))), ",").alias("ids"))
    body = F.concat(F.lit('{"different":['), "different", F.lit('],"isolated":['), F.coalesce("ids", F.lit("")), F.lit('],"profile":"'), "profile", F.lit('","same":['), "same", F.lit("]}"))
    rows = profiles.join(both, "profile", "left").join(alone, "profile", "left").withColumn("body", body)
    return rows.select("profile", "body", F.sha2("body", 256).alias("digest"))


@query("h6_reason_codes", """
WITH t AS (SELECT unit_id AS fid, unit_id % 10 AS k FROM v_unit)
SELECT fid, CASE k WHEN 0 THEN 'missing_facility_id' WHEN 1 THEN 'orphan_facility_id' WHEN 2 THEN 'invalid_length_3d' WHEN 3 THEN 'unsupported_travel_direction' WHEN 4 THEN 'missing_geometry' WHEN 5 THEN 'unsupported_transition_type'
  WHEN 6 THEN 'missing_level_name_from' WHEN 7 THEN 'orphan_level_to' WHEN 8 THEN 'facility_level_mismatch' END AS reasons FROM t WHERE k <> 9""")
def _(v):
    """Transitions with one fault each, and the code of it."""
    k = F.col("unit_id") % 10
    p = lambda dx: F.struct((F.col("x") + dx).alias("x"), F.col("y").alias("y"), F.lit(0.0).alias("z"))
    rows = v.unit.select(
        F.col("unit_id").alias("fid"), F.when(k == 0, " ").otherwise("F1").alias("facility_id"), (k != 1).alias("facility_known"), F.when(k == 2, -1.0).otherwise(2.0).alias("length_3d"), F.when(k == 3, 2).otherwise(1).alias("travel_direction"),
        F.when(k != 4, F.array(F.array(p(0.0), p(2.0)))).alias("parts"), F.when(k == 5, 3).otherwise(4).alias("transition_type"), F.when(k != 6, "1").alias("level_name_from"), F.lit("2").alias("level_name_to"),
        (k != 6).alias("from_known"), (k != 7).alias("to_known"), F.when(k == 8, "F2").when(k == 0, " ").otherwise("F1").alias("from_facility"), F.when(k == 0, " ").otherwise("F1").alias("to_facility"),
    )
    return review.diagnosed(rows, review.row_tests(rows, "Transitions"), "fid").select("fid", F.array_join("reasons", ",").alias("reasons"))


@query("h6_level_codes", """
WITH t AS (SELECT unit_id AS fid, unit_id % 5 AS k FROM v_unit) SELECT fid, CASE k WHEN 0 THEN 'duplicate_level_id' WHEN 1 THEN 'invalid_vertical_order' WHEN 2 THEN 'missing_level_id' WHEN 3 THEN 'orphan_facility_id' END AS reasons FROM t WHERE k <> 4""")
def _(v):
    """Levels with one fault each."""
    k = F.col("unit_id") % 5
    rows = v.unit.select(F.col("unit_id").alias("fid"), F.when(k == 2, "").otherwise("L").alias("level_id"), F.lit("F1").alias("facility_id"), (k != 3).alias("facility_known"), F.when(k == 1, 1.5).otherwise(2.0).alias("vertical_order"), F.when(k == 0, 2).otherwise(1).alias("repeats"))
    return review.diagnosed(rows, review.row_tests(rows, "Levels"), "fid").select("fid", F.array_join("reasons", ",").alias("reasons"))


@query("h10_edge_audit", """
SELECT l_orderkey, count(*) FILTER (abs(l_extendedprice - l_quantity * 1000) > 0.05) AS weights, count(*) FILTER (l_linenumber % 4 = 0) AS unsupported, count(*) FILTER (l_linenumber % 5 = 0) AS without_spans FROM lineitem GROUP BY 1""")
def _(v):
    """Edges whose weight, segments or spans do not agree with the source."""
    segment = F.struct(F.lit(0).alias("a"), F.lit(1).alias("b"))
    rows = v.table("lineitem").select(
        "l_orderkey", (F.col("l_quantity") * 1000).alias("measured"), F.col("l_extendedprice").alias("recorded"), F.array(F.struct(F.lit(0).alias("a"), F.when(F.col("l_linenumber") % 4 == 0, 2).otherwise(1).alias("b"))).alias("segments"),
        F.array(segment).alias("supported"), F.when(F.col("l_linenumber") % 5 != 0, F.array(segment)).alias("spans"),
    )
    return review.edge_audit(rows, "l_orderkey")


@query("j9_geometry_validity", "SELECT unit_id, unit_id % 3 <> 0 AS valid, CASE WHEN unit_id % 3 <> 0 THEN 'partial_indoor' ELSE 'overview_only' END AS coverage FROM v_unit")
def _(v):
    """Outlines of which some are not closed: they are not valid and show an overview only."""
    p = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.lit(0.0).alias("z"))
    ring = F.array(p(0.0, 0.0), p(2.0, 0.0), p(2.0, 1.0), F.when(F.col("unit_id") % 3 == 0, p(0.0, 1.0)).otherwise(p(0.0, 0.0)))
    valid = G.ring_valid(ring)
    return v.unit.select("unit_id", valid.alias("valid"), F.when(valid, "partial_indoor").otherwise("overview_only").alias("coverage"))


@query("l2_admission", """
WITH RECURSIVE q AS (SELECT event_id, event_type, epoch_us(ts) / 1e6 AS t, CAST(value * 4000 AS DOUBLE) AS d, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT event_type, k, event_id, true AS admitted, [t + d] AS held FROM q WHERE k = 1
  UNION ALL SELECT event_type, k, event_id, len(h) < 16, CASE WHEN len(h) < 16 THEN list_append(h, t + d) ELSE h END FROM (SELECT q.*, list_filter(r.held, lambda e: e > q.t) AS h FROM r JOIN q ON q.event_type = r.event_type AND q.k = r.k + 1))
SELECT event_id, admitted FROM r""")
def _(v):
    """Requests to a server that does 16 at a time and refuses more; events as requests, a server per kind."""
    from floorloom.streaming.admission import in_flight

    rows = v.table("events").select(F.col("event_type").alias("server"), "event_id", "ts", (F.col("value") * 4000).alias("seconds"))
    return in_flight(rows).select("event_id", "admitted")


@query("l3_scene_cache", """
WITH RECURSIVE q AS (SELECT event_id, event_type, user_id % 20 AS scene, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT event_type, k, event_id, false AS hit, [scene] AS held FROM q WHERE k = 1
  UNION ALL SELECT q.event_type, q.k, q.event_id, list_contains(r.held, q.scene), list_append(list_filter(r.held, lambda s: s <> q.scene), q.scene)[-8:] FROM r JOIN q ON q.event_type = r.event_type AND q.k = r.k + 1)
SELECT event_id, hit FROM r""")
def _(v):
    """Scenes found in a cache of the eight used last; a server per kind of event."""
    from floorloom.streaming.admission import cached

    rows = v.table("events").select(F.col("event_type").alias("server"), "event_id", "ts", (F.col("user_id") % 20).alias("scene"))
    return cached(rows).select("event_id", "hit")


@query("m1_staged_run", "SELECT category, facility_id, count(*) AS units FROM v_unit JOIN v_level USING (level_id) JOIN v_category USING (use_type) WHERE searchable = 'Y' GROUP BY 1, 2")
def _(v):
    """Extract, normalise, derive: stages run in the order of their inputs, each checked against its digest."""
    run = lineage.Stages(v.spark, _place(v, "run"))
    run.stage("derived", ("normalised",), lambda normalised: normalised.groupBy("category", "facility_id").agg(F.count(F.lit(1)).alias("units")))
    run.stage("normalised", ("units", "levels", "categories"), lambda units, levels, categories: units.where("searchable = 'Y'").join(F.broadcast(levels), "level_id").join(F.broadcast(categories), "use_type"))
    run.source("units", v.unit)
    run.source("levels", v.level)  # a building's floors
    run.source("categories", v.category)  # five rows
    doc = run.run()
    if not lineage.verify_seal(doc) or doc["state"] != "complete":
        raise ValueError("the run is not complete")
    return v.spark.read.parquet(run.path("derived"))


@query("m3_seals", "SELECT * FROM (VALUES ('as made', true), ('changed', false), ('unsealed', false)) AS t(manifest, valid)")
def _(v):
    """Seals of a manifest, as it was made, changed afterwards, and without one."""
    made = lineage.Manifest("r", {"python": "3"})
    made.stage("a", {}, {"x": "1"})
    doc = made.sealed()
    rows = [("as made", lineage.verify_seal(doc)), ("changed", lineage.verify_seal(doc | {"run": "s"})), ("unsealed", lineage.verify_seal({k: x for k, x in doc.items() if k != "seal"}))]
    return v.spark.createDataFrame(rows, "manifest string, valid boolean")


@query("m4_runtime", "SELECT unnest(['code', 'machine', 'python', 'spark', 'system']) AS part, true AS known")
def _(v):
    """Parts of the fingerprint of what computes."""
    return v.spark.createDataFrame([(k, bool(x)) for k, x in lineage.runtime().items()], "part string, known boolean")


@query("m5_states", """
WITH s AS (SELECT * FROM (VALUES (0, 'extracting'), (1, 'extracted'), (2, 'deriving'), (3, 'derived'), (4, 'complete')) AS t(k, state))
SELECT a.state AS from_state, b.state AS to_state, b.k = a.k + 1 AS allowed FROM s a, s b UNION ALL SELECT state, 'failed', true FROM s UNION ALL SELECT 'failed', state, false FROM s""")
def _(v):
    """Which steps a run may take."""

    def allowed(a, b):
        run = lineage.Manifest("r", {})
        run.doc["state"] = a
        try:
            run.advance(b)
        except ValueError:
            return False
        return True

    rows = [(a, b, allowed(a, b)) for a in (*lineage.STATES, "failed") for b in (*lineage.STATES, "failed") if (a, b) != ("failed", "failed")]
    return v.spark.createDataFrame(rows, "from_state string, to_state string, allowed boolean")


@query("m7_replay", f"WITH RECURSIVE {_COMP} SELECT profile, node, node % 10 <> 3 AS same FROM comp")
def _(v):
    """Recorded answers against today's, on the recorded data; every tenth record was altered."""
    now = lineage.content_digest(v.feature).first()["digest"]
    found = graph.profile_components(_arcs(v))
    recorded = found.withColumn("component", F.when(F.col("node") % 10 == 3, -1).otherwise(F.col("component")))
    return lineage.replayed(recorded, found, ["profile", "node"], now, now)
