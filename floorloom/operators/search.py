"""Catalogue look-ups, literal and token search, and the intent of a message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from floorloom.functions import texts as X
from floorloom.plans.recovery import settled

#: Words that decide the intent of a message, in the order of the decision (fixed values).
ROUTING = ("route", "directions", "path", "get me to")
TRAVEL = ("distance", "travel time", "how far", "how long")
NEAREST = ("nearest", "closest")
LIVE = ("occupancy", "open now", "opening", "elevator status")
PLACES, FLOORS, MARKS, ABOUT = ("facilit", "building"), ("level", "floor"), ("landmark", "amenit"), ("artifact", "provenance", "limitation")


def levels(rows: DataFrame, facility=None) -> DataFrame:
    """Levels in their order, of one facility if given."""
    found = rows if facility is None else rows.where(F.col("facility_id") == facility)
    return found.orderBy("vertical_order", "facility_id", "short_name")


def one(rows: DataFrame, key: str, value) -> DataFrame:
    """The row with the key; an error if there is none."""
    found = rows.where(F.col(key) == value).limit(1)
    if found.isEmpty():
        raise LookupError(f"no {key} {value}")
    return found


def scene(level, **layers: DataFrame) -> DataFrame:
    """layer, id, kind of everything on one level, from layers (level_id, id, kind)."""
    out = None
    for name, rows in layers.items():
        part = rows.where(F.col("level_id") == level).select(F.lit(name).alias("layer"), F.col("id").cast("string").alias("id"), "kind")
        out = part if out is None else out.unionByName(part)
    return out


def labels(units: DataFrame) -> DataFrame:
    """label (folded), unit_ids sorted; more than one means the label is ambiguous."""
    return units.where("room_id IS NOT NULL").groupBy(X.casefold(F.col("room_id")).alias("label")).agg(F.array_sort(F.collect_list("unit_id")).alias("unit_ids"))


def extents(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))


def framed(rows: DataFrame, by: str, padding: float = 0.05) -> DataFrame:
    """Extents widened on every side by a share of the larger side."""
    box = extents(rows, by)
    pad = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")) * padding
    return box.select(by, *[(F.col(c) - pad).alias(c) for c in ("min_x", "min_y")], *[(F.col(c) + pad).alias(c) for c in ("max_x", "max_y")])


def sentence(rows: DataFrame, head: str, name: str, key: str) -> DataFrame:
    names = F.transform(F.array_sort(F.collect_list(F.struct(name, key))), lambda s: s[name])
    return rows.agg(F.concat(F.lit(head), F.array_join(names, ", ")).alias("text"))


def envelope(rows: DataFrame, *order: str) -> DataFrame:
    """One row: all rows, in order, and their number."""
    rest = [c for c in rows.columns if c not in order]
    return rows.agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias("rows"), F.count(F.lit(1)).alias("count"))


def placed(rows: DataFrame, *order) -> DataFrame:
    """Rows with their place in a total order: ranges are sorted by themselves, and each is moved by the rows of the ranges before it."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    mark = F.monotonically_increasing_id()
    kept = settled(ranged.withColumns({"_range": F.shiftright(mark, 33), "_at": mark.bitwiseAND(F.lit((1 << 33) - 1))}))
    per = kept.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # one row per range
    ahead = per.select(F.col("_range").alias("_r"), (F.sum("_n").over(W.Window.orderBy("_range")) - F.col("_n")).alias("_ahead"))
    return kept.join(F.broadcast(ahead), F.col("_range") == F.col("_r")).withColumn("place", (F.col("_ahead") + F.col("_at") + 1).cast("int")).drop("_range", "_at", "_r", "_ahead")


def resolve(requests: DataFrame, units: DataFrame) -> DataFrame:
    """request, status, unit_id, matches: exact id first, then a unique folded label; 400, 200, 409 or 404.

    ``requests`` has request and identifier (text).
    """
    ids = units.select(F.col("unit_id").cast("string").alias("_id"), F.col("unit_id").alias("_exact"))
    by = labels(units).select("label", "unit_ids")
    valid = F.col("identifier").isNotNull() & (F.length("identifier") > 0) & (F.length("identifier") <= 255)
    met = requests.withColumn("_folded", X.casefold(F.col("identifier"))).join(ids, F.col("identifier") == F.col("_id"), "left").join(by, F.col("_folded") == F.col("label"), "left")
    n = F.coalesce(F.size("unit_ids"), F.lit(0))
    status = F.when(~valid, 400).when(F.col("_exact").isNotNull(), 200).when(n == 1, 200).when(n > 1, 409).otherwise(404)
    unit = F.when(valid, F.coalesce(F.col("_exact"), F.when(n == 1, F.get("unit_ids", F.lit(0)))))
    return met.select("request", status.alias("status"), unit.alias("unit_id"), F.when(status == 409, n).otherwise(0).alias("matches"))


def unique_room(messages: DataFrame, units: DataFrame) -> DataFrame:
    """message_id, unit_id of the one unit whose collapsed, folded room id is the whole message; null if none or several."""
    rooms = units.groupBy(X.casefold(X.collapsed(F.coalesce("room_id", F.lit("")))).alias("_room")).agg(F.min("unit_id").alias("unit_id"), F.count(F.lit(1)).alias("_n")).where("_n = 1")
    return messages.withColumn("_folded", X.casefold(X.collapsed(F.col("message")))).join(rooms, F.col("_folded") == F.col("_room"), "left").select("message_id", "unit_id")


def intent(folded: Column, room_found: Column, can_route: Column, literal_matches: Column) -> Column:
    """Kind of answer to a folded message; the first rule that holds decides, on substrings anywhere."""
    directed = X.directions(folded)["origin"].isNotNull() & can_route
    return (
        F.when(directed, "route")
        .when(X.has_any(folded, ROUTING + TRAVEL) | X.mobility(folded), "refusal_routing")
        .when(X.has_any(folded, NEAREST), "refusal_nearest")
        .when(X.has_any(folded, LIVE), "refusal_live")
        .when(room_found, "room_match")
        .when(X.has_any(folded, PLACES), "facility_list")
        .when(X.has_any(folded, FLOORS), "level_list")
        .when(X.has_any(folded, MARKS), "landmark_list")
        .when(X.has_any(folded, ABOUT), "provenance")
        .when(literal_matches > 1, "choices").when(literal_matches == 1, "room_match")
        .otherwise("unknown")
    )


def literal(units: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """First units, by room and id, with the text in room, use type or category."""
    fields = [X.casefold(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("room_id", "use_type", "category") if c in units.columns]
    hit = F.lit(False)
    for f in fields:
        hit = hit | f.contains(text.casefold())
    return units.where(hit & F.lit(bool(text))).orderBy(F.coalesce("room_id", F.lit("")), "unit_id").limit(limit)


def tokens(units: DataFrame, text: str, fields: tuple[str, ...], **equal) -> DataFrame:
    """Units with every word of the text in some field, restricted to equal values where they are not None."""
    hay = F.array(*[F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields])
    words = F.array(*[F.lit(w) for w in text.lower().split()]).cast("array<string>")
    found = units.where(F.forall(words, lambda w: F.exists(hay, lambda h: h.contains(w))))
    for column, value in equal.items():
        found = found if value is None else found.where(F.col(column) == value)
    return found


def substring(rows: DataFrame, text: str, *fields: str) -> DataFrame:
    """Rows with the text in one of the fields, any case."""
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(F.lower(F.col(f).cast("string")).contains(text.lower()), F.lit(False))
    return rows.where(hit)


def resolve_either(requests: DataFrame, units: DataFrame) -> DataFrame:
    """request, unit_id where exactly one unit has the text as id or label, upper-cased; else null."""
    names = units.select("unit_id", F.explode(F.array_distinct(F.array(F.upper(F.col("unit_id").cast("string")), F.upper("room_id")))).alias("_name")).where("_name IS NOT NULL")
    only = names.groupBy("_name").agg(F.min("unit_id").alias("unit_id"), F.count_distinct("unit_id").alias("_n")).where("_n = 1")
    return requests.join(only, F.upper("identifier") == F.col("_name"), "left").select("request", "unit_id")
