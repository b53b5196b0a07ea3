"""Queries on single tables, lookups, text and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from floorloom.functions import geometry as G
from floorloom.functions import texts as X
from floorloom.operators import search
from floorloom.plans.registry import query

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query("a1_layer_read", "SELECT facility_id, code, name, 3 AS n_fields FROM v_facility")
def _(v):
    """A layer read with its fields by name."""
    layer = v.facility
    return layer.withColumn("n_fields", F.lit(len(layer.columns)))


@query("a5_layer_counts", " UNION ALL ".join(f"SELECT '{t}' AS layer, count(*) AS n FROM {t}" for t in TABLES))
def _(v):
    """Rows of every layer, in one result."""
    out = None
    for t in TABLES:
        one = v.table(t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("layer"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("a10_level_lookup", "SELECT level_id, vertical_order FROM v_level WHERE level_id IS NOT NULL AND vertical_order IS NOT NULL")
def _(v):
    """Key to value, without null keys and values; an empty lookup is an error."""
    from floorloom.sources.layers import lookup

    return lookup(v.level, "level_id", "vertical_order")


@query("a11_unit_scan", "SELECT unit_id, room_id, level_id, round(x, 2) AS cx, round(y, 2) AS cy FROM v_unit")
def _(v):
    """Units with a centroid read from well-known text."""
    text = F.format_string("POINT (%.2f %.2f)", "x", "y")
    rows = v.unit.withColumn("centroid", text)
    return rows.select("unit_id", "room_id", "level_id", F.round(X.wkt_x(F.col("centroid")), 2).alias("cx"), F.round(X.wkt_y(F.col("centroid")), 2).alias("cy"))


@query("a20_reviewed_rows", "SELECT fid, description FROM v_landmark_raw WHERE fid IN (1, 2, 3, 5, 8, 13, 21, 34)")
def _(v):
    return v.landmark_raw.where(F.col("fid").isin(1, 2, 3, 5, 8, 13, 21, 34)).select("fid", "description")


@query("b1_facility", "SELECT facility_id, code, name FROM v_facility")
def _(v):
    return v.facility


@query("b2_level", "SELECT level_id, facility_id, short_name, vertical_order FROM v_level")
def _(v):
    return v.level


@query("b3_searchable_units", "SELECT unit_id, room_id, level_id FROM v_unit WHERE searchable = 'Y'")
def _(v):
    return v.unit.where(F.col("searchable") == "Y").select("unit_id", "room_id", "level_id")


@query("b4_unit_category", """
SELECT unit_id, u.use_type, category, CASE WHEN accessible THEN 1 WHEN NOT accessible THEN 0 END AS accessible,
       CASE WHEN accessible IS NOT NULL THEN 'survey' END AS verified_by, CASE WHEN accessible IS NOT NULL THEN '2024-01-01' END AS verified_date
FROM v_unit u LEFT JOIN v_category c ON c.use_type = u.use_type AND c.use_type <> 'MACHINERY'""")  # fmt: skip
def _(v):
    """Use types mapped to categories; provenance only where accessibility is known either way; unmapped ones are null."""
    from floorloom.operators.normalise import categorise

    return categorise(v.unit, v.category.where("use_type <> 'MACHINERY'"), "survey", "2024-01-01").select("unit_id", "use_type", "category", "accessible", "verified_by", "verified_date")


@query("b6_unmapped_use_types", "SELECT DISTINCT use_type FROM v_unit WHERE searchable = 'Y' AND use_type NOT IN (SELECT use_type FROM v_category WHERE category <> 'office')")
def _(v):
    """Use types in the data that the mapping lacks."""
    from floorloom.operators.normalise import unmapped

    return unmapped(v.unit.where("searchable = 'Y'"), v.category.where("category <> 'office'"))


@query("b7_centroid_fallback", """
SELECT unit_id, CASE WHEN unit_id % 7 <> 0 THEN x WHEN unit_id = 14 THEN 1.5 END AS cx,
       CASE WHEN unit_id % 7 <> 0 THEN 'centroid' WHEN unit_id = 14 THEN 'recorded' END AS centroid_method,
       CASE WHEN unit_id = 21 THEN NULL ELSE y END AS geom_y FROM v_unit""")  # fmt: skip
def _(v):
    """A centroid, else a recorded point for one known key, else null; the geometry of one bad key is blanked."""
    rows = v.unit.withColumn("cx", F.when(F.col("unit_id") % 7 != 0, F.col("x")))
    method = F.when(F.col("cx").isNotNull(), "centroid").when(F.col("unit_id") == 14, "recorded")
    return rows.select("unit_id", F.coalesce("cx", F.when(F.col("unit_id") == 14, 1.5)).alias("cx"), method.alias("centroid_method"), F.when(F.col("unit_id") == 21, None).otherwise(F.col("y")).alias("geom_y"))


@query("b9_detail_door_split", "SELECT CASE WHEN use_type = 'A' THEN 'door' ELSE 'detail' END AS kind, count(*) AS n FROM v_linework WHERE use_type IS NOT NULL GROUP BY 1")
def _(v):
    """Doors and details; rows without a use type belong to neither."""
    from floorloom.operators.normalise import split

    detail, door = split(v.linework, "use_type", "A")
    return detail.select(F.lit("detail").alias("kind")).union(door.select(F.lit("door").alias("kind"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("b10_prefix_class", """
SELECT p_partkey AS fid, CASE WHEN starts_with(p_type, 'PROMO') THEN 'water_fountain' WHEN starts_with(p_type, 'ECONOMY') THEN 'vending_machine' ELSE 'unknown' END AS category FROM part""")  # fmt: skip
def _(v):
    from floorloom.operators.normalise import by_prefix

    return v.table("part").select(F.col("p_partkey").alias("fid"), by_prefix(F.col("p_type"), {"PROMO": "water_fountain", "ECONOMY": "vending_machine"}).alias("category"))


@query("b11_transition_codes", "SELECT l_linenumber AS code, CASE l_linenumber WHEN 2 THEN 'stairs' WHEN 4 THEN 'elevator' END AS mode, count(*) AS n FROM lineitem WHERE l_linenumber IN (2, 4) GROUP BY 1, 2")
def _(v):
    """Transition types 2 and 4; any other code fails the query."""
    from floorloom.operators.normalise import transition_mode

    rows = v.table("lineitem").where("l_linenumber IN (2, 4)")
    return rows.groupBy(F.col("l_linenumber").alias("code"), transition_mode(F.col("l_linenumber")).alias("mode")).agg(F.count(F.lit(1)).alias("n"))


_FLAGS = """
SELECT f.feature_id, f.mode, a.facility_id || '_' || a.short_name AS from_key, b.facility_id || '_' || b.short_name AS to_key,
       b.vertical_order - a.vertical_order AS d, f.mode = 'elevator' AND abs(b.vertical_order - a.vertical_order) > 1 AS express
FROM v_feature f JOIN v_level a ON a.level_id = f.src % 25 JOIN v_level b ON b.level_id = f.dst % 25"""


@query("b14_transition_flags", _FLAGS)
def _(v):
    """Both levels of every feature (C2), their keys (B12) and express elevators."""
    from floorloom.operators.normalise import level_key

    at = lambda p: v.level.select(F.col("level_id").alias(p + "l"), level_key(F.col("facility_id"), F.col("short_name")).alias(p + "_key"), F.col("vertical_order").alias(p + "o"))
    rows = v.feature.join(F.broadcast(at("from")), F.col("src") % 25 == F.col("froml")).join(F.broadcast(at("to")), F.col("dst") % 25 == F.col("tol"))
    d = F.col("too") - F.col("fromo")
    return rows.select("feature_id", "mode", "from_key", "to_key", d.alias("d"), ((F.col("mode") == "elevator") & (F.abs(d) > 1)).alias("express"))


@query("b13_profile_filter", """
SELECT p.profile, f.mode, count(*) AS n FROM v_feature f JOIN (VALUES ('default','elevator'),('default','pathway'),('default','stairs'),('elevator_only','elevator'),('elevator_only','pathway')) AS p(profile, mode)
ON p.mode = f.mode GROUP BY ALL""")  # fmt: skip
def _(v):
    from floorloom.operators.graph import by_profile

    return by_profile(v.feature).groupBy("profile", "mode").agg(F.count(F.lit(1)).alias("n"))


@query("b15_levels_of_facility", "SELECT level_id, short_name, vertical_order FROM v_level WHERE facility_id = 2")
def _(v):
    return search.levels(v.level, 2).select("level_id", "short_name", "vertical_order")


@query("b16_unit_by_id", "SELECT unit_id, room_id, level_id FROM v_unit WHERE unit_id = 42")
def _(v):
    return search.one(v.unit, "unit_id", 42).select("unit_id", "room_id", "level_id")


@query("b17_scene_layers", """
SELECT 'unit' AS layer, CAST(unit_id AS VARCHAR) AS id, use_type AS kind FROM v_unit WHERE level_id = 3
UNION ALL SELECT 'landmark', CAST(fid AS VARCHAR), substr(description, 1, 3) FROM v_landmark_raw WHERE level_id = 3
UNION ALL SELECT 'node', CAST(node_id AS VARCHAR), NULL FROM v_node WHERE level_id = 3""")  # fmt: skip
def _(v):
    """All layers of one level."""
    marks = v.landmark_raw.select("level_id", F.col("fid").alias("landmark_id"), F.substring("description", 1, 3).alias("category"))
    return search.scene(3, unit=v.unit.select("level_id", F.col("unit_id").alias("id"), F.col("use_type").alias("kind")), landmark=marks.select("level_id", F.col("landmark_id").alias("id"), F.col("category").alias("kind")), node=v.node.select("level_id", F.col("node_id").alias("id"), F.lit(None).cast("string").alias("kind")))


@query("b18_tristate", """
SELECT event_id, CASE WHEN t IN ('true','1','yes','y') THEN true WHEN t IN ('false','0','no','n') THEN false END AS flag
FROM (SELECT event_id, lower(trim(list_extract([' True', 'YES ', 'n', '0', 'maybe', NULL, ''], CAST(event_id % 7 + 1 AS INT)))) AS t FROM events)""")  # fmt: skip
def _(v):
    words = F.array(*[F.lit(x) for x in (" True", "YES ", "n", "0", "maybe", None, "")])
    return v.table("events").select("event_id", X.tristate(F.get(words, (F.col("event_id") % 7).cast("int"))).alias("flag"))


@query("b19_public_edges", "SELECT feature_id AS source_id, list_aggregate([feature_id], 'string_agg', ',') AS original_ids, mode FROM v_feature")
def _(v):
    """Edge as shown: its original ids default to its own id."""
    from floorloom.operators.normalise import public_edge

    rows = v.feature.withColumn("original_feature_ids", F.lit(None).cast("array<string>"))
    return public_edge(rows).select("source_id", F.array_join("original_feature_ids", ",").alias("original_ids"), "mode")


@query("b21_identifiers", r"SELECT page_id, regexp_full_match(url, '[A-Za-z0-9_.:-]{1,255}') AS as_url, regexp_full_match(regexp_extract(url, '://([^/?#]*)', 1), '[A-Za-z0-9_.:-]{1,255}') AS as_host FROM pages")
def _(v):
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    return v.table("pages").select("page_id", X.identifier(F.col("url")).alias("as_url"), X.identifier(host).alias("as_host"))


@query("b22_run_ids", r"""SELECT event_id, regexp_full_match(r, '[A-Za-z0-9][A-Za-z0-9_-]{0,63}') AND lower(r) NOT IN ('con','prn','aux','nul') AS ok
FROM (SELECT event_id, list_extract(['run-1', 'CON', '-x', 'a b', 'nul', 'R_2'], CAST(event_id % 6 + 1 AS INT)) AS r FROM events)""")
def _(v):
    names = F.array(*[F.lit(x) for x in ("run-1", "CON", "-x", "a b", "nul", "R_2")])
    return v.table("events").select("event_id", X.run_id(F.get(names, (F.col("event_id") % 6).cast("int"))).alias("ok"))


_HOSTS = ("localhost", "LOCALHOST.:80", "127.0.0.1:0", "127.0.0.1:65535", "[::1]:8000", "[::1", "evil.example", "a:b:c", "", "local host", "localhost:65536")


@query("b23_hosts", f"""
WITH h AS (SELECT event_id, list_extract({list(_HOSTS)!r}, CAST(event_id % 11 + 1 AS INT)) AS h FROM events),
p AS (SELECT event_id, h, CASE WHEN starts_with(h, '[') THEN regexp_extract(h, '^\\[([^\\]]+)\\](:[0-9]{{1,5}})?$', 1)
       WHEN len(h) - len(replace(h, ':', '')) = 1 THEN split_part(h, ':', 1) WHEN contains(h, ':') THEN '' ELSE h END AS host,
       CASE WHEN NOT starts_with(h, '[') AND len(h) - len(replace(h, ':', '')) = 1 THEN split_part(h, ':', 2) END AS port FROM h)
SELECT event_id, h <> '' AND NOT regexp_matches(h, '[ /\\\\\\t\\r\\n]') AND (port IS NULL OR (regexp_full_match(port, '[0-9]+') AND try_cast(port AS INT) BETWEEN 1 AND 65535))
  AND rtrim(lower(host), '.') IN ('localhost', '127.0.0.1', '::1') AS ok FROM p""")  # fmt: skip
def _(v):
    """Host headers against an allow-list."""
    names = F.array(*[F.lit(x) for x in _HOSTS])
    return v.table("events").select("event_id", X.host_allowed(F.get(names, (F.col("event_id") % 11).cast("int")), ("localhost", "127.0.0.1", "::1")).alias("ok"))


@query("b24_route_templates", r"""
SELECT page_id, CASE WHEN regexp_full_match(p, '/[a-z]{2}/[0-9]+') THEN '/{lang}/{page}' WHEN regexp_full_match(p, '/[a-z]{2}/[0-9]+\.html') THEN '/{lang}/{page}.html' ELSE '<unmatched>' END AS route
FROM (SELECT page_id, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS p FROM pages)""")
def _(v):
    path = F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1)
    return v.table("pages").select("page_id", X.template(path, {r"/[a-z]{2}/[0-9]+": "/{lang}/{page}", r"/[a-z]{2}/[0-9]+\.html": "/{lang}/{page}.html"}).alias("route"))


@query("b25_query_strings", r"""
SELECT page_id, q <> '' AND regexp_full_match(q, '(page=[^&=]+&ref=[^&=]+|ref=[^&=]+&page=[^&=]+)') AS valid
FROM (SELECT page_id, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages)""")
def _(v):
    """Exactly the keys page and ref, once each and not empty."""
    return v.table("pages").select("page_id", X.query_keys(F.regexp_extract("url", r"\?([^#]*)", 1), ("page", "ref")).alias("valid"))


@query("b26_missing", "SELECT doc_id, text IS NULL OR trim(text) = '' AS missing FROM documents")
def _(v):
    return v.table("documents").select("doc_id", X.missing(F.col("text")).alias("missing"))


@query("b27_positive_lengths", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS length FROM customer")
def _(v):
    return v.table("customer").select("c_custkey", G.positive(F.col("c_acctbal")).alias("length"))


@query("b28_finite_positions", "SELECT unit_id, CASE WHEN unit_id % 5 <> 0 THEN x END AS fx FROM v_unit")
def _(v):
    """Finite coordinates; the others are null."""
    broken = F.when(F.col("unit_id") % 10 == 0, float("nan")).when(F.col("unit_id") % 5 == 0, float("inf")).otherwise(F.col("x"))
    return v.unit.select("unit_id", G.finite(broken).alias("fx"))


@query("b29_profile_sample", "SELECT fid, description FROM v_landmark_raw WHERE description IS NOT NULL ORDER BY fid LIMIT 15")
def _(v):
    return v.landmark_raw.where("description IS NOT NULL").orderBy("fid").limit(15).select("fid", "description")


@query("b30_request_validation", """
SELECT event_id, event_id % 4 = 0 AS valid FROM events""")  # fmt: skip
def _(v):
    """Route requests as JSON: exact keys, endpoint ids and profile."""
    bodies = ('{"origin":{"unit_id":"U-1"},"destination":{"unit_id":"U-2"},"profile":"default"}', '{"origin":{"unit_id":"U-1"},"destination":{"unit_id":"U-2"}}', '{"origin":{"unit_id":"U 1"},"destination":{"unit_id":"U-2"},"profile":"default"}', '{"origin":{"unit_id":"U-1","x":1},"destination":{"unit_id":"U-2"},"profile":"walk"}')
    body = F.get(F.array(*[F.lit(b) for b in bodies]), (F.col("event_id") % 4).cast("int"))
    return v.table("events").select("event_id", X.route_request(body).alias("valid"))


@query("d1_snap", "SELECT c_custkey, floor(c_acctbal / 7.0 * 100 + 0.5) / 100 AS snapped FROM customer")
def _(v):
    return v.table("customer").select("c_custkey", G.snap(F.col("c_acctbal") / F.lit(7.0)).alias("snapped"))


@query("d8_centroids", "SELECT unit_id, round(x + 1.0, 6) AS cx, round(y + 0.5, 6) AS cy, true AS valid FROM v_unit")
def _(v):
    """Centroid, bounds and validity (D20) of a rectangle around each unit, from its ring."""
    p = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.lit(0.0).alias("z"))
    ring = F.array(p(0.0, 0.0), p(2.0, 0.0), p(2.0, 1.0), p(0.0, 1.0), p(0.0, 0.0))
    rows = v.unit.withColumn("ring", ring).withColumn("c", G.ring_centroid(F.col("ring")))
    return rows.select("unit_id", F.round("c.x", 6).alias("cx"), F.round("c.y", 6).alias("cy"), G.ring_valid(F.col("ring")).alias("valid"))


@query("d9_reproject", "SELECT unit_id, round(x + 505000.0, 3) AS x, round(y + 5458000.0, 3) AS y, true AS inside FROM v_unit")
def _(v):
    """Units from UTM 10N metres to longitude and latitude, and back again; whether the degrees lie where those metres do."""
    rows = v.unit.withColumn("p", G.utm_inverse(F.col("x") + 505000.0, F.col("y") + 5458000.0))
    back = G.utm_forward(F.col("p.lon"), F.col("p.lat"))
    inside = F.col("p.lon").between(-122.94, -122.92) & F.col("p.lat").between(49.27, 49.28)
    return rows.select("unit_id", F.round(back["x"], 3).alias("x"), F.round(back["y"], 3).alias("y"), inside.alias("inside"))


@query("a2_layer_reprojected", "SELECT edge_id, count(*) AS points, round(min(x) + 505000.0, 3) AS min_x, round(max(y) + 5458000.0, 3) AS max_y FROM v_vertex GROUP BY 1 HAVING count(*) > 1")
def _(v):
    """A layer of lines copied into degrees and back into metres, its dimension kept."""
    p = F.transform(F.array_sort(F.collect_list(F.struct("i", "x", "y"))), lambda q: F.struct((q["x"] + 505000.0).alias("x"), (q["y"] + 5458000.0).alias("y"), F.lit(3.0).alias("z")))
    lines = v.vertex.groupBy("edge_id").agg(p.alias("g")).where(F.size("g") > 1)
    rows = lines.select("edge_id", G.reprojected(G.reprojected(F.col("g"), "EPSG:4326"), "EPSG:26910").alias("g"))
    kept = F.size(F.filter("g", lambda q: q["z"] == 3.0)).cast("long")
    return rows.select("edge_id", kept.alias("points"), F.round(F.array_min(F.transform("g", lambda q: q["x"])), 3).alias("min_x"), F.round(F.array_max(F.transform("g", lambda q: q["y"])), 3).alias("max_y"))


@query("d13_room_labels", "SELECT unit_id, CASE WHEN room_id IS NOT NULL AND room_id <> '' AND NOT starts_with(room_id, 'R1') THEN trim(room_id) ELSE 'the selected room' END AS label FROM v_unit")
def _(v):
    return v.unit.select("unit_id", X.room_label(F.col("room_id"), "R1").alias("label"))


@query("d14_collapsed", r"SELECT conv_id, turn, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS compact FROM conversations WHERE regexp_full_match(text, '[\x00-\x7F]*')")
def _(v):
    """White space collapsed and case folded, on ASCII texts."""
    return v.table("conversations").where(F.col("text").rlike(r"\A[\x00-\x7F]*\z")).select("conv_id", "turn", F.lower(X.collapsed(F.col("text"))).alias("compact"))


@query("d14_casefold", r"SELECT conv_id, turn, sha256(replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ß', 'ss')) AS digest FROM conversations")
def _(v):
    """Full case folding of all texts, beyond ASCII too."""
    return v.table("conversations").select("conv_id", "turn", F.sha2(X.casefold(X.collapsed(F.col("text"))), 256).alias("digest"))


@query("d15_directions", r"""
SELECT u.unit_id, 'R' || (u.unit_id % 1000) AS origin, 'R' || (u.unit_id % 7) AS destination, u.unit_id % 2 = 0 AS mobility FROM v_unit u""")
def _(v):
    """Origin, destination and a mobility word out of a sentence."""
    text = F.concat(F.when(F.col("unit_id") % 2 == 0, "Accessible directions FROM ").otherwise("directions from "), "room_id", F.lit("  to R"), (F.col("unit_id") % 7).cast("string"))
    d = X.directions(X.collapsed(text))
    return v.unit.select("unit_id", d["origin"].alias("origin"), d["destination"].alias("destination"), X.mobility(F.lower(text)).alias("mobility"))


@query("d16_digests", "SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents")
def _(v):
    return v.table("documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


@query("d17_chain_ids", "SELECT least(src, dst) AS a, greatest(src, dst) AS b, substr(sha256(least(src, dst) || '|' || greatest(src, dst) || '|' || string_agg(feature_id, ',' ORDER BY feature_id)), 1, 16) AS chain_id FROM v_feature GROUP BY 1, 2")
def _(v):
    from floorloom.operators.lineage import chain_id

    rows = v.feature.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.collect_list("feature_id").alias("ids"))
    return rows.select("a", "b", chain_id(F.array("a", "b"), F.col("ids")).alias("chain_id"))


@query("d18_canonical_json", """SELECT unit_id, '{"level_id":' || level_id || ',"room_id":"' || room_id || '","unit_id":' || unit_id || '}' AS doc FROM v_unit""")
def _(v):
    """Canonical JSON (A14): sorted keys, shortest numbers."""
    from floorloom.operators.lineage import canonical_json

    return v.unit.select("unit_id", canonical_json(F.to_json(F.struct("unit_id", "room_id", "level_id"))).alias("doc"))


@query("d22_allocation", """
SELECT l_orderkey, round(sum(l_extendedprice), 2) AS recorded, round(sum(l_extendedprice), 2) AS allocated FROM lineitem GROUP BY l_orderkey""")  # fmt: skip
def _(v):
    """A recorded length shared over pieces by weight: the pieces add up to it again."""
    rows = v.table("lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("w"), F.sum("l_extendedprice").alias("t"))
    return rows.select("l_orderkey", F.round("t", 2).alias("recorded"), F.round(G.total(G.allocate(F.col("t"), F.col("w"))), 2).alias("allocated"))


@query("d23_tolerance", "SELECT l_orderkey, l_linenumber, l_extendedprice, count(*) AS n, abs(l_quantity * 1000 - l_extendedprice) <= greatest(0.05, 0.005 * l_extendedprice) AS agrees FROM lineitem GROUP BY ALL")
def _(v):
    ok = G.agrees(F.col("l_quantity") * 1000, F.col("l_extendedprice"))
    return v.table("lineitem").groupBy("l_orderkey", "l_linenumber", "l_extendedprice", ok.alias("agrees")).agg(F.count(F.lit(1)).alias("n"))


@query("d24_lineage_lookup", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'h2' ELSE NULL END AS hash FROM pages")
def _(v):
    """First entry whose path ends in a suffix, separators normalised."""
    from floorloom.operators.lineage import hash_of

    entry = lambda p, h: F.struct(p.alias("path"), F.lit(h).alias("sha256"))
    rows = v.table("pages").withColumn("inputs", F.array(entry(F.lit("a/raw.json"), "h1"), entry(F.when(F.col("page_id") % 2 == 0, F.lit("b\\graph.bin")).otherwise(F.lit("b/other")), "h2")))
    return rows.select("page_id", hash_of(F.col("inputs"), "b/graph.bin").alias("hash"))


@query("d26_ratios", "SELECT n_regionkey, round(CAST(sum(CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 4) AS ratio, count(*) * (count(*) - 1) // 2 AS pairs FROM nation GROUP BY 1")
def _(v):
    """Rounded ratios and numbers of pairs."""
    n = F.count(F.lit(1))
    return v.table("nation").groupBy("n_regionkey").agg(F.round(F.count_if(F.col("n_nationkey") % 3 == 0).cast("double") / n, 4).alias("ratio"), F.expr("count(*) * (count(*) - 1) div 2").alias("pairs"))


@query("d30_fingerprints", "SELECT fid, sha256(sha256('{\"c_acctbal\":' || CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS VARCHAR) || ',\"c_name\":\"' || c_name || '\"}') || chr(0) || sha256(c_mktsegment)) AS fingerprint FROM v_snap_old")
def _(v):
    """Digest of a row's sorted attributes and of its geometry (here: segment)."""
    from floorloom.operators.review import fingerprint

    rows = v.snap_old.withColumn("c_acctbal", F.round(F.col("c_acctbal") * 100).cast("long"))
    return rows.select("fid", fingerprint(["c_name", "c_acctbal"], F.col("c_mktsegment")).alias("fingerprint"))


@query("d31_profile_pick", "SELECT unit_id, 'e' || level_id AS picked FROM v_unit")
def _(v):
    maps = F.create_map(F.lit("default"), F.concat(F.lit("d"), "level_id"), F.lit("elevator_only"), F.concat(F.lit("e"), "level_id"))
    return v.unit.withColumn("m", maps).select("unit_id", F.element_at("m", F.lit("elevator_only")).alias("picked"))


@query("d32_json_safe", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '{\"nonfinite\":\"nan\"}' WHEN c_custkey % 3 = 1 THEN '{\"nonfinite\":\"inf\"}' ELSE CAST(c_custkey AS VARCHAR) END AS safe FROM customer")
def _(v):
    from floorloom.operators.lineage import json_safe

    x = F.when(F.col("c_custkey") % 3 == 0, float("nan")).when(F.col("c_custkey") % 3 == 1, float("inf")).otherwise(F.col("c_custkey").cast("double"))
    return v.table("customer").select("c_custkey", json_safe(x, F.col("c_custkey").cast("string")).alias("safe"))


@query("d33_node_level", "SELECT node_id, CASE WHEN node_id % 4 = 0 THEN -1 ELSE least(level_id, 7) END AS level FROM v_node")
def _(v):
    ids = F.when(F.col("node_id") % 4 != 0, F.array(F.lit(7), F.col("level_id")))
    return v.node.select("node_id", F.coalesce(F.array_min(ids), F.lit(-1)).alias("level"))


@query("e1_count_by_type", "SELECT c_mktsegment AS use_type, count(*) AS n FROM customer GROUP BY 1")
def _(v):
    return v.table("customer").groupBy(F.col("c_mktsegment").alias("use_type")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "use_type")


@query("e2_count_by_keys", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def _(v):
    return v.table("lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query("e3_global", "SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, round(avg(l_quantity), 6) AS mean, round(sum(l_quantity), 2) AS total FROM lineitem")
def _(v):
    return v.table("lineitem").agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.sum("l_quantity"), 2).alias("total"))


@query("e4_null_counts", "SELECT count(*) AS n, sum(CASE WHEN use_type IS NULL THEN 1 ELSE 0 END) AS missing FROM v_linework")
def _(v):
    return v.linework.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("use_type").isNull()).alias("missing"))


@query("e5_level_units", "SELECT level_id, count(*) AS total, count(*) FILTER (searchable = 'Y') AS searchable FROM v_unit GROUP BY level_id")
def _(v):
    return v.unit.groupBy("level_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("searchable") == "Y").alias("searchable"))


@query("e6_filtered_count", "SELECT count(*) AS n FROM v_linework WHERE use_type IS NULL")
def _(v):
    return v.linework.where("use_type IS NULL").agg(F.count(F.lit(1)).alias("n"))


@query("e7_distinct", "SELECT DISTINCT use_type FROM v_linework")
def _(v):
    return v.linework.select("use_type").distinct()


@query("e8_node_attributes", """
SELECT l_suppkey AS node, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS level_ids, min(l_quantity) AS z_min, max(l_quantity) AS z_max, round(avg(l_quantity), 6) AS z_mean FROM lineitem GROUP BY 1""")  # fmt: skip
def _(v):
    from floorloom.operators.network import node_attributes

    rows = v.table("lineitem").select(F.col("l_suppkey").alias("node"), F.col("l_returnflag").alias("level_id"), F.col("l_quantity").alias("z"))
    return node_attributes(rows).select("node", F.array_join("level_ids", ",").alias("level_ids"), "z_min", "z_max", F.round("z_mean", 6).alias("z_mean"))


@query("e9_graph_stats", """
WITH a AS (SELECT src, dst FROM v_feature WHERE src <> dst UNION ALL SELECT dst, src FROM v_feature WHERE src <> dst), n AS (SELECT DISTINCT src FROM a)
SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM a) AS arcs, round(2.0 * (SELECT count(*) FROM a) / (SELECT count(*) FROM n), 4) AS mean_degree""")  # fmt: skip
def _(v):
    from floorloom.operators.graph import both_ways
    from floorloom.operators.network import graph_stats

    return graph_stats(both_ways(v.feature))


@query("e11_level_heights", """
SELECT l.level_id, min(c_acctbal) AS z_min, max(c_acctbal) AS z_max, round(avg(c_acctbal), 6) AS z_mean FROM v_level l LEFT JOIN customer ON c_nationkey = level_id AND c_nationkey % 6 <> 0 GROUP BY 1""")  # fmt: skip
def _(v):
    """Heights per level; levels without nodes keep nulls."""
    from floorloom.operators.network import level_heights

    nodes = v.table("customer").where("c_nationkey % 6 <> 0").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("level_id"), F.col("c_acctbal").alias("z_min"), F.col("c_acctbal").alias("z_max"), F.col("c_acctbal").alias("z_mean"))
    return level_heights(v.level, nodes).withColumn("z_mean", F.round("z_mean", 6))


@query("e23_folded_labels", "SELECT 'strasse ' || (unit_id % 40) AS label, string_agg(CAST(unit_id AS VARCHAR), ',' ORDER BY unit_id) AS unit_ids FROM v_unit GROUP BY 1")
def _(v):
    """Labels that differ in case alone, beyond ASCII, are one."""
    name = F.when(F.col("unit_id") % 3 == 0, "Straße ").when(F.col("unit_id") % 3 == 1, "STRASSE ").otherwise("strasse ")
    rows = search.labels(v.unit.select("unit_id", F.concat(name, (F.col("unit_id") % 40).cast("string")).alias("room_id")))
    return rows.select("label", F.array_join(F.transform("unit_ids", lambda x: x.cast("string")), ",").alias("unit_ids"))


@query("e23_room_labels", "SELECT lower(room_id) AS label, string_agg(CAST(unit_id AS VARCHAR), ',' ORDER BY unit_id) AS unit_ids FROM v_unit GROUP BY 1")
def _(v):
    rows = search.labels(v.unit)
    return rows.select("label", F.array_join(F.transform("unit_ids", lambda x: x.cast("string")), ",").alias("unit_ids"))


@query("e24_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(v):
    from floorloom.operators.review import duplicated

    return duplicated(v.table("lineitem"), "l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query("e25_null_rates", "SELECT round(CAST(sum(CASE WHEN use_type IS NULL THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6) AS null_rate, count(*) AS n FROM v_linework")
def _(v):
    return v.linework.agg(F.round(F.count_if(F.col("use_type").isNull()).cast("double") / F.count(F.lit(1)), 6).alias("null_rate"), F.count(F.lit(1)).alias("n"))


@query("e26_bounds", "SELECT level_id, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM v_unit GROUP BY 1")
def _(v):
    return search.extents(v.unit, "level_id")


@query("e28_facility_units", "SELECT facility_id, count(*) AS units, count(*) FILTER (searchable = 'Y') AS eligible FROM v_unit JOIN v_level USING (level_id) GROUP BY 1")
def _(v):
    rows = v.unit.join(F.broadcast(v.level.select("level_id", "facility_id")), "level_id")
    return rows.groupBy("facility_id").agg(F.count(F.lit(1)).alias("units"), F.count_if(F.col("searchable") == "Y").alias("eligible"))


@query("e29_sentence", "SELECT 'Facilities: ' || string_agg(name, ', ' ORDER BY name, facility_id) AS text FROM v_facility")
def _(v):
    return search.sentence(v.facility, "Facilities: ", "name", "facility_id")


@query("e30_source_digest", "SELECT source, count(*) AS files, sum(strlen(coalesce(text, ''))) AS bytes, sha256(string_agg(doc_id || chr(0) || sha256(coalesce(text, '')) || chr(10), '' ORDER BY CAST(doc_id AS VARCHAR))) AS digest FROM documents GROUP BY source")
def _(v):
    """Digest of a directory: sorted lines of name and digest of each file."""
    from floorloom.operators.lineage import directory_digest

    files = v.table("documents").select("source", F.col("doc_id").cast("string").alias("name"), F.coalesce("text", F.lit("")).alias("content"))
    return directory_digest(files, "source")


@query("e32_envelope", "SELECT count(*) AS count, string_agg(code, ',' ORDER BY name, facility_id) AS codes FROM v_facility")
def _(v):
    rows = search.envelope(v.facility, "name", "facility_id")
    return rows.select("count", F.array_join(F.transform("rows", lambda r: r["code"]), ",").alias("codes"))


@query("i1_facilities", "SELECT facility_id, name, row_number() OVER (ORDER BY coalesce(name, ''), facility_id) AS place FROM v_facility")
def _(v):
    return search.placed(v.facility, F.coalesce("name", F.lit("")), "facility_id").select("facility_id", "name", "place")


@query("i2_levels", "SELECT level_id, row_number() OVER (ORDER BY vertical_order, facility_id, short_name) AS place FROM v_level")
def _(v):
    return search.placed(v.level, "vertical_order", "facility_id", "short_name").select("level_id", "place")


@query("i3_units_of_level", "SELECT unit_id, row_number() OVER (PARTITION BY level_id ORDER BY coalesce(room_id, ''), unit_id) AS place FROM v_unit")
def _(v):
    order = W.Window.partitionBy("level_id").orderBy(F.coalesce("room_id", F.lit("")), "unit_id")
    return v.unit.select("unit_id", F.row_number().over(order).alias("place"))


@query("i5_first_orphans", "SELECT l_partkey AS fid FROM lineitem WHERE l_partkey % 11 = 3 GROUP BY 1 ORDER BY 1 LIMIT 5")
def _(v):
    known = v.table("part").where("p_partkey % 11 <> 3").select(F.col("p_partkey").alias("l_partkey"))
    return v.table("lineitem").join(known, "l_partkey", "left_anti").select(F.col("l_partkey").alias("fid")).distinct().orderBy("fid").limit(5)


@query("i7_canonical_order", "SELECT node_id, row_number() OVER (ORDER BY CAST(node_id AS VARCHAR)) AS place FROM v_node")
def _(v):
    """Node keys in the order of their text: 10 before 2."""
    return search.placed(v.node, F.col("node_id").cast("string")).select("node_id", "place")
