"""Column expressions on lines, arrays of struct<x,y,z>, and on headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double,z:double>"
LINE = f"array<{POINT}>"


def snap(value: Column, digits: int = 2) -> Column:
    """Half-up on the binary value: floor(v * 10^d + 0.5) / 10^d."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


def planar(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(ax - bx, ay - by)


def segment_lengths(line: Column) -> Column:
    """3-D length of each segment; absent z counts as 0."""
    z = lambda p: F.coalesce(p["z"], F.lit(0.0))
    gap = lambda a, b: F.sqrt((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2 + (z(a) - z(b)) ** 2)
    n = F.size(line)
    return F.when(n < 2, F.array().cast("array<double>")).otherwise(F.zip_with(F.slice(line, 1, F.greatest(n - 1, F.lit(0))), F.slice(line, 2, F.greatest(n - 1, F.lit(0))), gap))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def length(line: Column) -> Column:
    return total(segment_lengths(line))


def endpoints(parts: Column) -> tuple[Column, Column]:
    """First point of the first part and last point of the last."""
    return F.element_at(F.element_at(parts, 1), 1), F.element_at(F.element_at(parts, -1), -1)


def flat(parts: Column) -> Column:
    """Parts joined as they are; a shared joint stays twice."""
    return F.flatten(parts)


def reverse_spans(spans: Column) -> Column:
    """Spans (feature_id, part_index, start_vertex, end_vertex) walked backwards."""
    return F.transform(F.reverse(spans), lambda s: F.struct(s["feature_id"].alias("feature_id"), s["part_index"].alias("part_index"), s["end_vertex"].alias("start_vertex"), s["start_vertex"].alias("end_vertex")))


def xy(line: Column) -> Column:
    return F.transform(line, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))


def bearing(dx: Column, dy: Column) -> Column:
    """Degrees counter-clockwise from +x; null without movement."""
    return F.when((dx != 0) | (dy != 0), F.degrees(F.atan2(dy, dx)))


def line_bearing(line: Column, departing: bool = True) -> Column:
    """Bearing of the first segment that moves, or of the last."""
    n = F.size(line)
    moves = F.zip_with(F.slice(line, 1, F.greatest(n - 1, F.lit(0))), F.slice(line, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct((b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy")))
    moves = F.filter(moves, lambda m: (m["dx"] != 0) | (m["dy"] != 0))
    one = F.get(moves, F.lit(0)) if departing else F.get(moves, F.size(moves) - 1)
    return F.degrees(F.atan2(one["dy"], one["dx"]))


def turn(previous: Column, current: Column) -> Column:
    """Signed change of heading in [-180, 180)."""
    return F.pmod(current - previous + 180.0, F.lit(360.0)) - 180.0


def action(previous: Column, current: Column) -> Column:
    """continue under 15 degrees, bear up to 45, turn up to 135, u_turn beyond; left if positive."""
    delta = turn(previous, current)
    size = F.abs(delta)
    kind = F.when(size <= 45, "bear").when(size <= 135, "turn").otherwise("u_turn")
    return F.when(size < 15, "continue").otherwise(F.concat(kind, F.when(delta > 0, "_left").otherwise("_right")))


def walking_text(act: Column, distance: Column) -> Column:
    """Instruction of a walk step; the wording is fixed by the results to match."""
    amount = F.when(distance >= 1, F.concat(F.lit("about "), F.floor(distance + 0.5).cast("string"), F.lit(" m"))).otherwise("less than 1 m")
    verb, side = F.split_part(act, F.lit("_"), F.lit(1)), F.split_part(act, F.lit("_"), F.lit(2))
    return (
        F.when(distance.isNull(), "Follow the highlighted route.")
        .when(act == "continue", F.concat(F.lit("Continue for "), amount, F.lit(".")))
        .when(act.startswith("u_turn"), F.concat(F.lit("Turn around, then continue for "), amount, F.lit(".")))
        .otherwise(F.concat(F.initcap(verb), F.lit(" "), side, F.lit(", then continue for "), amount, F.lit(".")))
    )


def agrees(geometric: Column, recorded: Column) -> Column:
    """Lengths agree within 0.05 m or half a percent of the recorded one."""
    return F.abs(geometric - recorded) <= F.greatest(F.lit(0.05), 0.005 * recorded)


def positive(value: Column) -> Column:
    """The value if it is a finite positive number, else null."""
    value = value.cast("double")
    return F.when(~F.isnan(value) & (value < float("inf")) & (value > 0), value)


def finite(value: Column) -> Column:
    value = value.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def allocate(recorded: Column, weights: Column) -> Column:
    """``recorded`` shared by ``weights``; the last piece takes the remainder."""
    n = F.size(weights)
    part = F.transform(weights, lambda w: recorded * w / total(weights))
    head = F.slice(part, 1, F.greatest(n - 1, F.lit(0)))
    return F.when(n == 0, part).otherwise(F.concat(head, F.array(recorded - total(head))))


def ring_valid(ring: Column) -> Column:
    """At least four points, all finite, closed in x and y."""
    ok = F.forall(ring, lambda p: finite(p["x"]).isNotNull() & finite(p["y"]).isNotNull())
    first, last = F.get(ring, F.lit(0)), F.get(ring, F.size(ring) - 1)
    return (F.size(ring) >= 4) & ok & (first["x"] == last["x"]) & (first["y"] == last["y"])


def bounds(ring: Column) -> Column:
    pick = lambda c: F.transform(ring, lambda p: p[c])
    return F.struct(F.array_min(pick("x")).alias("min_x"), F.array_min(pick("y")).alias("min_y"), F.array_max(pick("x")).alias("max_x"), F.array_max(pick("y")).alias("max_y"))


def ring_centroid(ring: Column) -> Column:
    """Area centroid of a closed ring by the shoelace sums."""
    n = F.size(ring)
    pairs = F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), lambda a, b: F.struct((a["x"] * b["y"] - b["x"] * a["y"]).alias("c"), (a["x"] + b["x"]).alias("sx"), (a["y"] + b["y"]).alias("sy")))
    area = total(F.transform(pairs, lambda p: p["c"])) * 3.0
    return F.struct((total(F.transform(pairs, lambda p: p["sx"] * p["c"])) / area).alias("x"), (total(F.transform(pairs, lambda p: p["sy"] * p["c"])) / area).alias("y"))


def _cross(o: Column, a: Column, b: Column) -> Column:
    return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])


def simple(line: Column) -> Column:
    """No two segments of the line that are not neighbours cross or touch."""
    n = F.size(line)
    seg = F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.struct(i.alias("i"), F.get(line, i).alias("a"), F.get(line, i + 1).alias("b")))

    def meets(s: Column, t: Column) -> Column:
        d1, d2 = _cross(s["a"], s["b"], t["a"]), _cross(s["a"], s["b"], t["b"])
        d3, d4 = _cross(t["a"], t["b"], s["a"]), _cross(t["a"], t["b"], s["b"])
        span = lambda p, q, r: (r["x"] >= F.least(p["x"], q["x"])) & (r["x"] <= F.greatest(p["x"], q["x"])) & (r["y"] >= F.least(p["y"], q["y"])) & (r["y"] <= F.greatest(p["y"], q["y"]))
        touch = ((d1 == 0) & span(s["a"], s["b"], t["a"])) | ((d2 == 0) & span(s["a"], s["b"], t["b"])) | ((d3 == 0) & span(t["a"], t["b"], s["a"])) | ((d4 == 0) & span(t["a"], t["b"], s["b"]))
        return ((d1 * d2 < 0) & (d3 * d4 < 0)) | touch

    return (n < 3) | ~F.exists(seg, lambda s: F.exists(seg, lambda t: (t["i"] > s["i"] + 1) & meets(s, t)))


#: WGS 84 ellipsoid and the central meridian of UTM zone 10 (fixed values).
_A, _FLAT, _K0, _LON0, _EAST0 = 6378137.0, 1 / 298.257223563, 0.9996, -123.0, 500000.0


def utm_forward(lon: Column, lat: Column) -> Column:
    """UTM 10N metres of longitude and latitude, by Krueger's series to the third order."""
    n = _FLAT / (2 - _FLAT)
    radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * n**0.5 / (1 + n)  # eccentricity
    phi, away = F.radians(lat), F.radians(lon - F.lit(_LON0))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi1, eta1 = F.atan2(t, F.cos(away)), F.asinh(F.sin(away) / F.sqrt(F.cos(away) ** 2 + t**2))
    xi, eta = xi1, eta1
    for j, a in enumerate(alpha, 1):
        xi = xi + a * F.sin(2 * j * xi1) * F.cosh(2 * j * eta1)
        eta = eta + a * F.cos(2 * j * xi1) * F.sinh(2 * j * eta1)
    return F.struct((_EAST0 + _K0 * radius * eta).alias("x"), (_K0 * radius * xi).alias("y"))


def reprojected(line: Column, to: str) -> Column:
    """A line in degrees (``EPSG:4326``) or in UTM 10N metres (``EPSG:26910``) from the other one; z stays."""
    def move(p: Column) -> Column:
        q = utm_inverse(p["x"], p["y"]) if to == "EPSG:4326" else utm_forward(p["x"], p["y"])
        a, b = ("lon", "lat") if to == "EPSG:4326" else ("x", "y")
        return F.struct(q[a].alias("x"), q[b].alias("y"), p["z"].alias("z"))

    return F.transform(line, move)


def utm_inverse(x: Column, y: Column) -> Column:
    """Longitude and latitude of UTM 10N metres, by Krueger's series to the third order."""
    n = _FLAT / (2 - _FLAT)
    radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi, eta = y / (_K0 * radius), (x - _EAST0) / (_K0 * radius)
    xi1, eta1 = xi, eta
    for j, b in enumerate(beta, 1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi
    for j, d in enumerate(delta, 1):
        lat = lat + d * F.sin(2 * j * chi)
    lon = F.lit(_LON0) + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1)))
    return F.struct(lon.alias("lon"), F.degrees(lat).alias("lat"))
