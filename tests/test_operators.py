"""Operators on literal cases."""

import random
import json
import math

import pytest
from pyspark.sql import functions as F

from floorloom.functions import geometry as G
from floorloom.functions import texts as X
from floorloom.operators import graph, lineage, network, normalise, review, routes, search, topology
from floorloom.operators.connectivity import components
from floorloom.sources import layers
from floorloom.streaming import admission


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def line(*points):
    return [{"x": float(p[0]), "y": float(p[1]), "z": float(p[2]) if len(p) > 2 and p[2] is not None else None if len(p) > 2 else 0.0} for p in points]


@pytest.mark.parametrize("value, snapped", [(505123.455, 505123.46), (505123.445, 505123.45), (100.005, 100.01), (100.015, 100.02), (1.005, 1.0), (-1.005, -1.0)])
def test_snap(spark, value, snapped):
    assert one(spark, G.snap(F.lit(value))) == snapped


@pytest.mark.parametrize("delta, act", [(14, "continue"), (15, "bear_left"), (45, "bear_left"), (46, "turn_left"), (135, "turn_left"), (136, "u_turn_left"), (-30, "bear_right"), (-90, "turn_right"), (350, "continue"), (-340, "bear_left")])
def test_action(spark, delta, act):
    assert one(spark, G.action(F.lit(10.0), F.lit(10.0 + delta))) == act


@pytest.mark.parametrize("act, metres, text", [
    ("continue", 4.5, "Continue for about 5 m."), ("turn_left", 0.4, "Turn left, then continue for less than 1 m."), ("u_turn_right", 2.0, "Turn around, then continue for about 2 m."), ("bear_left", None, "Follow the highlighted route."),
])
def test_walking_text(spark, act, metres, text):
    assert one(spark, G.walking_text(F.lit(act), F.lit(metres).cast("double"))) == text


def test_line_functions(spark):
    df = spark.createDataFrame([(line((0, 0), (3, 0), (3, 4)), [line((0, 0), (1, 0)), line((1, 0), (2, 5))])], f"g {G.LINE}, p array<{G.LINE}>")
    first, last = G.endpoints(F.col("p"))
    row = df.select(G.length(F.col("g")).alias("n"), G.line_bearing(F.col("g")).alias("a"), G.line_bearing(F.col("g"), False).alias("b"), first.alias("f"), last.alias("l"), F.size(G.flat(F.col("p"))).alias("s"), G.simple(F.col("g")).alias("ok"), G.xy(F.col("g")).alias("xy")).first()
    assert (row["n"], row["a"], row["b"]) == (7.0, 0.0, 90.0)
    assert (row["f"]["x"], row["l"]["y"], row["s"], row["ok"]) == (0.0, 5.0, 4, True)
    assert row["xy"][2].asDict() == {"x": 3.0, "y": 4.0}
    cross = spark.createDataFrame([(line((0, 0), (2, 2), (2, 0), (0, 2)),)], f"g {G.LINE}")
    assert not cross.select(G.simple(F.col("g")).alias("ok")).first()["ok"]


def test_rings(spark):
    df = spark.createDataFrame([(line((0, 0), (2, 0), (2, 1), (0, 1), (0, 0)),), (line((0, 0), (2, 0), (0, 0)),), (line((0, 0), (2, 0), (2, 1), (0, 1)),)], f"g {G.LINE}")
    rows = df.select(G.ring_valid(F.col("g")).alias("ok"), G.bounds(F.col("g")).alias("b")).collect()
    assert [r["ok"] for r in rows] == [True, False, False]
    assert rows[0]["b"]["max_x"] == 2.0


@pytest.mark.parametrize("value, out", [(0.0, None), (-1.0, None), (None, None), (float("inf"), None), (float("nan"), None), (2.0, 2.0)])
def test_positive(spark, value, out):
    assert one(spark, G.positive(F.lit(value).cast("double"))) == out


def test_utm_round_trip(spark):
    p = one(spark, G.utm_inverse(F.lit(500000.0), F.lit(5000000.0)))
    assert abs(p["lon"] + 123) < 1e-9 and abs(p["lat"] - 45.1535) < 1e-3


def test_allocation_gives_the_rest_to_the_last(spark):
    parts = one(spark, G.allocate(F.lit(10.0), F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0))))
    assert sum(parts[:2]) + parts[2] == 10.0


def test_reverse_spans(spark):
    spans = F.array(F.struct(F.lit("f").alias("feature_id"), F.lit(0).alias("part_index"), F.lit(0).alias("start_vertex"), F.lit(2).alias("end_vertex")))
    s = one(spark, G.reverse_spans(spans))[0]
    assert (s["start_vertex"], s["end_vertex"]) == (2, 0)


def test_transition_codes(spark):
    df = spark.createDataFrame([(2,), (4,)], "c int")
    assert [r["m"] for r in df.select(normalise.transition_mode(F.col("c")).alias("m")).collect()] == ["stairs", "elevator"]
    with pytest.raises(Exception, match="unsupported transition type 3"):
        spark.createDataFrame([(3,)], "c int").select(normalise.transition_mode(F.col("c"))).collect()


def test_split_drops_nulls(spark):
    detail, door = normalise.split(spark.createDataFrame([("ADO",), ("X",), (None,)], "t string"), "t", "ADO")
    assert (detail.count(), door.count()) == (1, 1)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (5, 6), (7, 7), (None, 1)] + [(k, k + 1) for k in range(100, 140)], "src long, dst long")
    found = {r["node"]: r["component"] for r in components(edges).collect()}
    assert found[3] == 1 and found[6] == 5 and found[7] == 7 and found[140] == 100 and len(found) == 3 + 2 + 1 + 41


def test_components_make_their_edges_once(spark):
    """Loops, alone and beside other edges, out of a table that counts how often its rows are made."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [(1, 1), (2, 2), (2, 2), (3, 2), (5, 4), (4, 6), (6, 6), (9, 9), (None, 7), (7, None)]
    edges = spark.createDataFrame(rows, "src long, dst long").mapInArrow(counted, "src long, dst long")
    found = sorted((r["node"], r["component"]) for r in components(edges).collect())
    assert found == [(1, 1), (2, 2), (3, 2), (4, 4), (5, 4), (6, 4), (9, 9)]
    assert made.value == len(rows)


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


ARCS = [("L", "A", "B", "k1", "pathway", 20.0), ("L", "B", "C", "k2", "pathway", 20.0), ("L", "B", "C", "k3", "elevator", 20.0), ("L", "C", "S", "k4", "stairs", 20.0), ("L", "A", "D", "k5", "other", 100.0)]


def arcs(spark):
    return graph.by_profile(spark.createDataFrame(ARCS, "level string, src string, dst string, key string, mode string, length_3d double"))


def test_profile_components(spark):
    found = {(r["profile"], r["node"]): r["component"] for r in graph.profile_components(arcs(spark)).collect()}
    assert found == {("default", n): "A" for n in "ABCS"} | {("elevator_only", n): "A" for n in "ABC"}


def test_reachability_is_directed(spark):
    seeds = spark.createDataFrame([(p, n, n) for p in graph.PROFILES for n in "ABC"], "profile string, origin string, node string")
    far = {(r["profile"], r["origin"], r["node"]) for r in graph.reachable(arcs(spark), seeds).collect()}
    assert {n for p, o, n in far if (p, o) == ("default", "A")} == set("ABCS")
    assert {n for p, o, n in far if (p, o) == ("elevator_only", "A")} == set("ABC")
    assert ("default", "B", "A") not in far


def test_shortest_path_ties(spark):
    rows = [("p", "A", "B", "b1", 1.0), ("p", "A", "C", "a9", 1.0), ("p", "B", "D", "x", 1.0), ("p", "C", "D", "x", 1.0), ("p", "A", "D", "z", 5.0), ("p", "D", "E", "w", -1.0)]
    df = spark.createDataFrame(rows, "profile string, src string, dst string, key string, length_3d double")
    found = {r["node"]: r for r in graph.shortest(df, spark.createDataFrame([("p", "A", "A")], "profile string, origin string, node string")).collect()}
    assert found["D"]["cost"] == 2.0 and found["D"]["path"] == ["a9", "x"]
    assert found["E"]["cost"] == 2.0  # a length that is not positive counts nothing in the search
    ok = {r["node"]: r["valid"] for r in graph.path_valid(graph.shortest(df, spark.createDataFrame([("p", "A", "A")], "profile string, origin string, node string")), df).collect()}
    assert ok["D"] and not ok["E"] and ok["A"]


def test_greedy_is_not_transitive(spark):
    df = spark.createDataFrame([("c", 1, 1, 0.0, 0.0), ("c", 1, 2, 0.4, 0.0), ("c", 1, 3, 0.8, 0.0), ("c", 1, 4, 0.8, 0.0), ("d", 1, 5, 0.0, 0.0), (None, 1, 6, 0.0, 0.0)], "category string, level_id int, fid long, x double, y double")
    assert sorted(r["fid"] for r in graph.greedy_representatives(df, 0.5).collect()) == [1, 3, 5]


def test_greedy_on_copies_and_crowds(spark):
    """Against a plain fold: many copies of few positions make no pairs, and points without a position are close to none."""
    r = random.Random(5)
    spots = [(round(r.uniform(-9, 9), 2), round(r.uniform(-9, 9), 2)) for _ in range(300)]
    rows = [(c, level, 0, *r.choice(spots)) for c in "ab" for level in (1, 2) for _ in range(1500)] + [("a", 1, 0, None, 0.0), ("a", 1, 0, None, 0.0), ("b", 2, 0, 1.0, float("nan"))]
    rows = [(c, level, k, x, y) for k, (c, level, _, x, y) in enumerate(rows)]
    want, kept = [k for _, _, k, x, y in rows[-3:]], {}
    for c, level, k, x, y in sorted(rows[:-3], key=lambda p: (p[3], p[4], p[2])):
        near = kept.setdefault((c, level), [])
        if all(math.hypot(x - a, y - b) > 0.505 for a, b in near):
            near.append((x, y))
            want.append(k)
    df = spark.createDataFrame(rows, "category string, level_id int, fid long, x double, y double")
    assert sorted(p["fid"] for p in graph.greedy_representatives(df, 0.505).collect()) == sorted(want)


def test_greedy_meets_no_copies(spark, monkeypatch):
    """No more than four edges a cell are made, whatever the number of points; each pair of close points was one."""
    made, real = [], graph.components
    monkeypatch.setattr(graph, "components", lambda edges: made.append(edges.count()) or real(edges))
    df = spark.range(4000).selectExpr("'c' AS category", "1 AS level_id", "id AS fid", "(id % 40) / 100D AS x", "0D AS y")
    assert [p["fid"] for p in graph.greedy_representatives(df, 0.505).collect()] == [0] and sum(made) <= 4


def test_within_is_inclusive(spark):
    units = spark.createDataFrame([(1, 0.0, 0.0)], "level_id int, x double, y double")
    nodes = spark.createDataFrame([(1, 1, 0.5, 0.0), (2, 1, 0.51, 0.0), (3, 2, 0.0, 0.0)], "node_id int, level_id int, x double, y double")
    assert [r["node_id"] for r in graph.within(units, nodes, 0.5).collect()] == [1]


LINES = f"feature_id string, level_id string, geometry {G.LINE}, length_3d double"


def test_nearest_against_brute_force(spark):
    """Ties, units on a cell's border, far away, twice, without coordinates and on floors without nodes."""
    deal = random.Random(5)
    spot = lambda: (deal.randrange(-40, 40) / 2.0, deal.randrange(-40, 40) / 2.0)
    units = [(i, i % 3, *spot()) for i in range(150)] + [(150, 0, 9000.0, -70000.0), (151, 1, 3e9, 0.0), (152, 0, None, 1.0), (153, 1, float("nan"), 1.0), (154, 1, float("inf"), 1.0), (0, 0, 2.5, 2.5), (155, None, 1.0, 1.0), (156, 1, 30.0, 0.0)]
    nodes = [(i, i % 2, *spot()) for i in range(30)] + [(30, 2, None, 0.0), (31, 2, 0.0, float("nan")), (32, 1, 20.0, 0.0)]
    expected = {}
    for unit, level, x, y in units:
        there = [n for n in nodes if n[1] == level and n[2] is not None and not math.isnan(n[3])]
        placed = x is not None and math.isfinite(x)
        best = min(((round(math.hypot(x - n[2], y - n[3]), 6), str(n[0]), n[0]) for n in there), default=None) if placed else None
        had = expected.get(unit)
        has = bool(there) or (had is not None and had[0])
        expected[unit] = (has, min((b for b in (best, had and had[1]) if b), default=None))
    rows = spark.createDataFrame(units, "unit_id long, level_id int, x double, y double"), spark.createDataFrame(nodes, "node_id long, level_id int, x double, y double")
    reason = lambda has, b: "no_node_on_level" if not has else "ok" if b and b[0] <= 10 else "too_far"
    found = {r["unit_id"]: (r["node_id"], r["distance"], r["eligible"], r["reason"]) for r in graph.nearest(*rows, 10.0).collect()}
    assert found == {u: (b and b[2], b and b[0], bool(b) and b[0] <= 10, reason(has, b)) for u, (has, b) in expected.items()}
    assert {"ok", "too_far", "no_node_on_level"} == {f[3] for f in found.values()}
    near = {r["unit_id"]: (r["node_id"], r["eligible"]) for r in graph.anchors(*rows, 10.0).collect()}
    assert near == {u: (f[0] if f[2] else None, f[2]) for u, f in found.items()}


def test_nearest_of_nothing(spark):
    units, nodes = spark.createDataFrame([(1, 1, 0.0, 0.0)], "unit_id long, level_id int, x double, y double"), spark.createDataFrame([], "node_id long, level_id int, x double, y double")
    assert [tuple(r) for r in graph.nearest(units, nodes, 10.0).collect()] == [(1, None, None, False, "no_node_on_level")]
    assert graph.nearest(units.limit(0), nodes, 10.0).count() == 0


def test_noding_cuts_at_a_junction(spark):
    df = spark.createDataFrame([("1", "L", line((0, 0, 0), (1, 0, 0), (2, 0, 0)), 2.0), ("2", "L", line((1, 0, 0), (1, 1, 0)), 1.0), ("3", "M", line((1, 0, 0), (5, 5, 0)), 6.4)], LINES)
    pieces = {r["piece_id"]: r["length_3d"] for r in topology.noded(df).collect()}
    assert pieces == {"1:v0-1": 1.0, "1:v1-2": 1.0, "2:v0-1": 1.0, "3:v0-1": 6.4}
    assert all(r["conserved"] for r in topology.conserved(df, topology.noded(df)).collect())


def test_noding_guards(spark):
    collapsed = spark.createDataFrame([("1", "L", line((0, 0, 0), (0.001, 0, 0), (2, 0, 0)), 2.0), ("2", "L", line((0.001, 0, 0), (1, 1, 0)), 1.0)], LINES)
    assert {r["piece_id"] for r in topology.noded(collapsed).collect()} == {"1:v0-2", "2:v0-1"}


PARTS = f"feature_id string, part_index int, direction int, geometry {G.LINE}"


@pytest.mark.parametrize("parts, reason", [
    ([line((1, 0, 0), (2, 0, 0)), line((0, 0, 0), (1, 0, 0))], None),
    ([line((0, 0, 0), (1, 0, 0)), line((5, 0, 0), (6, 0, 0))], "branched_or_closed_multipart"),
    ([line((0, 0, 0), (1, 0, 0)), line((1, 0, 0), (2, 0, 0)), line((1, 0, 0), (1, 5, 0))], "branched_or_closed_multipart"),
    ([line((0, 0, 0), (1, 0, 0)), line((1, 0, 0), (0, 1, 0)), line((0, 1, 0), (0, 0, 0))], "branched_or_closed_multipart"),
    ([line((0, 0, 0), (1, 0, 0)), line((1, 0, 9), (2, 0, 0))], "branched_or_closed_multipart"),
    ([line((0, 0, 0), (1, 0, 0)), line((1, 0, 0), (0, 0, 0))], "branched_or_closed_multipart"),
    ([line((0, 0, 0)), line((1, 0, 0), (0, 0, 0))], "ambiguous_multipart_part"),
    ([line((0, 0, 0), (1, 0, 0)), line((5, 5, 0), (6, 5, 0)), line((6, 5, 0), (5, 5, 0)), line((1, 0, 0), (2, 0, 0))], "disjoint_multipart"),
    ([line((0, 0, 0), (1, 0, 0)), line((1, 0, 0), (2, 0, float("nan")))], "ambiguous_multipart_part"),
    ([line((0, 0, 0), (1, 0, 0)), line((1, 0, 0), (1, 0, 0), (2, 0, 0))], "ambiguous_multipart_part"),
    ([line((0, 0, 0), (4, 0, 0)), line((4, 0, 0), (4, 2, 0), (2, 2, 0), (2, -2, 0))], "ambiguous_multipart_chain"),
])
def test_multipart(spark, parts, reason):
    df = spark.createDataFrame([("f", i, 1, g) for i, g in enumerate(parts)], PARTS)
    row = topology.joined_parts(df).first()
    assert row["reason"] == reason
    if reason is None:
        assert [p["x"] for p in row["geometry"]] == [0.0, 1.0, 2.0]
        assert [(p["part_index"], p["reversed"]) for p in row["parts"]] == [(1, False), (0, False)]


def test_multipart_direction(spark):
    """A single part is taken whatever its direction; several parts only if they are directed forward."""
    df = spark.createDataFrame([("f", 0, 2, line((0, 0, 0), (1, 0, 0))), ("g", 0, 1, line((0, 0, 0), (1, 0, 0))), ("g", 1, 2, line((1, 0, 0), (2, 0, 0)))], PARTS)
    rows = {r["feature_id"]: r for r in topology.joined_parts(df).collect()}
    assert rows["f"]["reason"] is None and len(rows["f"]["geometry"]) == 2 and rows["g"]["reason"] == "unsupported_multipart_direction"


def test_multipart_lines_cut_at_random(spark):
    """Lines cut into parts that are dealt in any order and direction come together again, with part 0 forward and every segment named."""
    r = random.Random(3)
    rows, want = [], {}
    for k in range(40):
        points = [(float(i), float(r.randint(0, 3)), float(r.randint(0, 2))) for i in range(r.randint(3, 14))]
        cuts = sorted({0, len(points) - 1, *r.sample(range(1, len(points) - 1), r.randint(1, min(5, len(points) - 2)))})
        pieces = [points[a : b + 1] for a, b in zip(cuts, cuts[1:])]
        turned = [r.random() < 0.5 for _ in pieces]
        number = r.sample(range(len(pieces)), len(pieces))
        rows += [(f"f{k}", i, 1, line(*(p[::-1] if t else p))) for i, p, t in zip(number, pieces, turned)]
        order = list(zip(number, turned))
        if dict(order)[0]:
            points, order = points[::-1], [(i, not t) for i, t in reversed(order)]
        size = dict(zip(number, (len(p) for p in pieces)))
        spans = [(i, a + 1, a) if t else (i, a, a + 1) for i, t in order for a in (reversed(range(size[i] - 1)) if t else range(size[i] - 1))]
        want[f"f{k}"] = (points, order, spans)
    for row in topology.joined_parts(spark.createDataFrame(rows, PARTS)).collect():
        points, order, spans = want.pop(row["feature_id"])
        assert row["reason"] is None and [tuple(p) for p in row["geometry"]] == points
        assert [tuple(p) for p in row["parts"]] == order and [tuple(x) for x in row["spans"]] == spans
    assert not want


EDGES = f"route string, occurrence int, mode string, level_id string, level_from string, level_to string, source string, target string, geometry {G.LINE}, length_3d double, key string"
ENDS = "route string, origin_label string, origin_level string, destination_label string, destination_level string"


def guided(spark, edges, levels=(("L1", "A 1", 1), ("L2", "A 2", 2)), nodes=None):
    at = nodes or [("a", 0.0, 0.0, 1, ["L1"]), ("b", 3.0, 4.0, 1, ["L1"]), ("c", 3.0, 4.0, 2, ["L2"])]
    return routes.guidance(
        spark.createDataFrame(edges, EDGES), spark.createDataFrame([("r", "101", "L1", "INT_9", edges[-1][3] or edges[-1][5])], ENDS),
        spark.createDataFrame(list(levels), "level_id string, label string, vertical_order int"), spark.createDataFrame(at, "node string, x double, y double, vertical_order int, level_ids array<string>"),
    )


BEND = ("r", 0, "pathway", "L1", None, None, "a", "b", line((0, 0, 0), (3, 0, 0), (3, 4, 0)), 7.0, "e")


def test_guidance_bend(spark):
    docs, steps = guided(spark, [BEND])
    assert (docs.first()["status"], docs.first()["distance_m"], docs.first()["warnings"]) == ("available", 7.0, [])
    rows = sorted(steps.collect(), key=lambda r: int(r["step_id"].split("-")[1]))
    assert [(r["kind"], r["action"], r["distance_m"]) for r in rows] == [("depart", "start", None), ("walk", "continue", 3.0), ("walk", "turn_left", 4.0), ("arrive", "arrive", None)]
    assert rows[0]["instruction"] == "Start near 101." and rows[-1]["instruction"] == "The mapped route ends near the selected room."


def test_guidance_transition(spark):
    ride = ("r", 1, "elevator", None, "L1", "L2", "b", "c", line((3, 4, 0), (3, 4, 5)), 5.0, "t")
    docs, steps = guided(spark, [BEND, ride])
    rows = sorted(steps.collect(), key=lambda r: int(r["step_id"].split("-")[1]))
    assert docs.first()["status"] == "available"
    assert [r["instruction"] for r in rows if r["kind"] == "transition"] == ["Take the elevator up to A 2.", "Exit the elevator on A 2."]
    assert [r["visit_id"] for r in rows] == ["visit-0"] * 4 + ["visit-1"] * 2


@pytest.mark.parametrize("weight", [0.0, -1.0, None, float("inf"), float("nan"), 9.0])
def test_guidance_is_limited_by_weights(spark, weight):
    docs, steps = guided(spark, [BEND[:9] + (weight, "e")])
    assert (docs.first()["status"], docs.first()["distance_m"], docs.first()["warnings"]) == ("limited", None, [routes.LENGTHS])
    assert [r["instruction"] for r in steps.where("kind = 'walk'").collect()] == ["Follow the highlighted route."]


def test_guidance_of_a_line_without_length(spark):
    """Two equal vertices were an error: a division by their distance."""
    still = ("r", 1, "pathway", "L1", None, None, "b", "b", line((3, 4, 0), (3, 4, 0)), 0.0, "s")
    docs, steps = guided(spark, [BEND, still])
    assert (docs.first()["status"], docs.first()["distance_m"], docs.first()["warnings"]) == ("limited", None, [routes.LENGTHS])
    rows = sorted(steps.collect(), key=lambda r: int(r["step_id"].split("-")[1]))
    assert [(r["kind"], r["action"], r["instruction"], r["distance_m"]) for r in rows[1:-1]] == [("walk", "continue", "Follow the highlighted route.", None)]


def test_guidance_refusals(spark):
    docs, steps = guided(spark, [BEND[:8] + (None, 7.0, "e")])
    assert (docs.first()["status"], docs.first()["warnings"], steps.count()) == ("unavailable", [routes.REFUSALS["geometry"]], 0)
    docs, steps = guided(spark, [BEND], nodes=[("a", 1.0, 0.0, 1, ["L1"]), ("b", 3.0, 4.0, 1, ["L1"])])
    assert docs.first()["warnings"] == [routes.REFUSALS["endpoints"]]


def test_legacy_steps_forget_the_heading(spark):
    rows = [("r", 0, "pathway", "k", line((0, 0, 0), (1, 0, 0))), ("r", 1, "pathway", "k", line((1, 0, 0), (1, 1, 0))), ("r", 2, "stairs", "s", line((1, 1, 0), (1, 1, 3))), ("r", 3, "pathway", "k", line((1, 1, 3), (0, 1, 3)))]
    got = routes.legacy_steps(spark.createDataFrame(rows, f"route string, occurrence int, mode string, key string, geometry {G.LINE}")).orderBy("place").collect()
    assert [r["type"] for r in got] == ["continue", "turn", "enter_transition", "exit_transition", "continue"]
    assert got[1]["instruction"] == "Turn left along the measured pathway."


def test_canonical_json():
    assert lineage.canonical(json.loads('{"b":1e10,"a":[1.0,"é",true,null,0.1,1e21,1e-7]}')) == '{"a":[1,"é",true,null,0.1,1e+21,1e-7],"b":10000000000}'


def test_manifest_is_sealed():
    m = lineage.Manifest("run", {"spark": "4"})
    m.advance("extracted")
    m.stage("normalise", {"raw": "h1"}, {"units": "h2"})
    doc = m.sealed()
    assert lineage.verify_seal(doc) and not lineage.verify_seal(doc | {"state": "complete"})
    with pytest.raises(ValueError):
        m.advance("complete")
    with pytest.raises(ValueError):
        m.stage("graph", {"units": "other"}, {"graph": "h3"})


def test_content_digest_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    of = lambda df: lineage.content_digest(df).first()["digest"]
    assert of(a) == of(a.orderBy(F.desc("a")).select("b", "a"))
    assert of(a) != of(a.union(a))


def test_diff_is_null_safe(spark):
    old = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "fid int, c string")
    new = spark.createDataFrame([(1, None), (2, None), (4, "z")], "fid int, c string")
    assert {r["fid"]: r["status"] for r in review.diff(old, new, "fid", ["c"]).collect()} == {1: "unchanged", 2: "changed", 3: "removed", 4: "added"}


def test_resolve(spark):
    units = spark.createDataFrame([("U1", "R7"), ("U2", "R7"), ("R9", "R8")], "unit_id string, room_id string")
    asked = spark.createDataFrame([(1, "U1"), (2, "r7"), (3, "r8"), (4, ""), (5, None), (6, "R9"), (7, "no")], "request int, identifier string")
    assert {r["request"]: (r["status"], r["unit_id"]) for r in search.resolve(asked, units).collect()} == {1: (200, "U1"), 2: (409, None), 3: (200, "R9"), 4: (400, None), 5: (400, None), 6: (200, "R9"), 7: (404, None)}


def test_casefold(spark):
    assert one(spark, X.casefold(F.lit("Straße"))) == "strasse"


def test_install(spark, tmp_path):
    path = str(tmp_path / "layer")
    layers.install(spark.range(3), path)
    with pytest.raises(FileExistsError):
        layers.install(spark.range(4), path)
    layers.install(spark.range(4), path, overwrite=True)
    assert spark.read.parquet(path).count() == 4
    layers.append(spark.range(2), path)
    assert spark.read.parquet(path).count() == 6
    assert [p.name for p in tmp_path.iterdir()] == ["layer"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5, 2.5)], "fid int, x double, y double")
    layers.ledger(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["fid"] == "1"
    doc = json.loads(layers.geojson(rows, ["fid"], "x", "y").first()["value"])
    assert doc == {"type": "Feature", "properties": {"fid": 1}, "geometry": {"type": "Point", "coordinates": [0.5, 2.5]}}
    layers.documents(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first()["y"] == 2.5
    assert layers.file_digests(spark, str(tmp_path / "csv")).count() >= 1
    assert layers.metadata(rows, "l").first()["field"] == "fid"


def test_contracts(spark):
    df = spark.range(1)
    assert layers.require(df, "l", {"id"}) is df
    with pytest.raises(ValueError, match="lacks"):
        layers.require(df, "l", {"geom"})
    with pytest.raises(ValueError):
        layers.lookup(df.where("id > 5"), "id", "id")
    with pytest.raises(ValueError):
        normalise.expect(df, "l", rows=2)


def test_admission_needs_feedback(spark):
    times = [0, 10, 59, 60, 61, 70]
    rows = spark.createDataFrame([("c", "read", i, t) for i, t in enumerate(times)], "client string, category string, event_id long, t long").select("client", "category", "event_id", F.timestamp_seconds("t").alias("ts"))
    got = [r["allowed"] for r in admission.admitted(rows, 60, {"read": 2}).orderBy("event_id").collect()]
    assert got == [True, True, False, True, False, True]


def test_admission_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([("c", "read", i, t) for i, t in enumerate([0, 10, 59, 60, 61, 70])], "client string, category string, event_id long, t long")
    rows.select("client", "category", "event_id", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("client string, category string, event_id long, ts timestamp").parquet(src)
    run = admission.admit_stream(stream, 60, {"read": 2}).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert [r["allowed"] for r in spark.read.parquet(out).orderBy("event_id").collect()] == [True, True, False, True, False, True]


def test_node_map_orphans(spark):
    f = spark.createDataFrame([("f1", "pathway", 1, 2)], "feature_id string, mode string, src int, dst int")
    want = spark.createDataFrame([("PW", "f1", "start"), ("TR", "f1", "start")], "prefix string, feature_id string, role string")
    assert [r["prefix"] for r in network.orphans(want, network.node_map(f)).collect()] == ["TR"]
