"""Snapshots compared, rows diagnosed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from floorloom.functions import geometry as G


def fingerprint(attributes: list[str], geometry: Column) -> Column:
    """Digest of the digests of the attributes, as JSON with sorted keys, and of the geometry."""
    attrs = F.to_json(F.struct(*sorted(attributes)), {"ignoreNullFields": "false"})
    return F.sha2(F.concat(F.sha2(attrs, 256), F.lit("\0"), F.sha2(geometry, 256)), 256)


def diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, status (added, removed, changed, unchanged) by a full outer join on the key; nulls equal nulls."""
    a = old.select(F.col(key).alias("_a"), F.struct(*columns).alias("_x"))
    b = new.select(F.col(key).alias("_b"), F.struct(*columns).alias("_y"))
    met = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_x").eqNullSafe(F.col("_y")), "unchanged").otherwise("changed")
    return met.select(F.coalesce("_a", "_b").alias(key), status.alias("status"))


def schema_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """name, old_type, new_type of columns that differ."""
    a, b = dict(old.dtypes), dict(new.dtypes)
    rows = [(c, a.get(c), b.get(c)) for c in sorted(a.keys() | b.keys()) if a.get(c) != b.get(c)]
    return old.sparkSession.createDataFrame(rows, "name string, old_type string, new_type string")


def layer_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """layer, status (added, removed, kept), crs_changed, geometry_type_changed of layers described by layer, crs and geometry_type."""
    side = lambda df, p: df.select(F.col("layer").alias(p), F.col("crs").alias(p + "_crs"), F.col("geometry_type").alias(p + "_type"))
    met = side(old, "a").join(side(new, "b"), F.col("a") == F.col("b"), "full_outer")
    kept = F.col("a").isNotNull() & F.col("b").isNotNull()
    differs = lambda c: kept & ~F.col("a_" + c).eqNullSafe(F.col("b_" + c))
    status = F.when(kept, "kept").when(F.col("a").isNull(), "added").otherwise("removed")
    return met.select(F.coalesce("a", "b").alias("layer"), status.alias("status"), differs("crs").alias("crs_changed"), differs("type").alias("geometry_type_changed"))


def gates(before: DataFrame, after: DataFrame, rising: tuple[str, ...] = (), equal: tuple[str, ...] = ()) -> DataFrame:
    """name, before, after, ok for counts (name, n) of two builds: those in ``rising`` must not rise, those in ``equal`` must stay."""
    met = before.select("name", F.col("n").alias("before")).join(after.select("name", F.col("n").alias("after")), "name", "full_outer")
    ok = F.when(F.col("name").isin(*rising), F.col("after") <= F.col("before")).when(F.col("name").isin(*equal), F.col("after") == F.col("before")).otherwise(True)
    return met.withColumn("ok", F.coalesce(ok, F.lit(False)))


def enforce(rows: DataFrame) -> DataFrame:
    """``rows`` of ``gates`` if all of them hold; else an error that names those that do not."""
    failed = [r["name"] for r in rows.where("NOT ok").orderBy("name").limit(5).collect()]
    if failed:
        raise ValueError(f"regressed: {failed}")
    return rows


def row_tests(rows: DataFrame, layer: str) -> dict[str, Column]:
    """Reason codes of a row of a source layer, as tests.

    Rows have ``facility_known`` and ``level_known`` (their ids were found), ``level_facility`` (the facility of their level) and ``repeats`` (rows with the
    same identity) beside the layer's own columns; transitions have ``from_known``, ``to_known``, ``from_facility``, ``to_facility``.
    """
    gone = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    with_facility = layer in ("Facilities", "Levels", "Pathways", "Transitions") or "facility_id" in rows.columns
    tests: dict[str, Column] = {}
    if layer in ("Facilities", "Levels"):
        tests["duplicate_facility_id" if layer == "Facilities" else "duplicate_level_id"] = F.col("repeats") > 1
    if with_facility:
        tests["missing_facility_id"] = gone("facility_id")
        if layer != "Facilities":
            tests["orphan_facility_id"] = ~gone("facility_id") & ~F.col("facility_known")
    if layer == "Levels":
        order = F.col("vertical_order").cast("double")
        tests["invalid_vertical_order"] = order.isNull() | G.finite(order).isNull() | (order != F.floor(order))
    if layer not in ("Facilities", "Transitions"):
        tests["missing_level_id"] = gone("level_id")
        if layer != "Levels":
            tests["orphan_level_id"] = ~gone("level_id") & ~F.col("level_known")
            if with_facility:
                tests["facility_level_mismatch"] = F.col("level_known") & ~F.col("level_facility").eqNullSafe(F.col("facility_id"))
    if layer in ("Pathways", "Transitions"):
        tests["invalid_length_3d"] = G.positive(F.col("length_3d")).isNull()
        tests["unsupported_travel_direction"] = F.col("travel_direction").isNull() | (F.col("travel_direction") != 1)
        found = line_reasons(F.col("parts"))
        tests |= {name: F.array_contains(found, name) for name in ("missing_geometry", "degenerate_geometry", "nonfinite_coordinates", "discontinuous_multipart", "nonpositive_geometry_length")}
    if layer == "Transitions":
        tests["unsupported_transition_type"] = F.col("transition_type").isNull() | ~F.col("transition_type").isin(2, 4)
        for side in ("from", "to"):
            tests[f"missing_level_name_{side}"] = gone(f"level_name_{side}")
            tests[f"orphan_level_{side}"] = ~gone(f"level_name_{side}") & ~F.col(f"{side}_known")
        tests["facility_level_mismatch"] = (F.col("from_known") & ~F.col("from_facility").eqNullSafe(F.col("facility_id"))) | (F.col("to_known") & ~F.col("to_facility").eqNullSafe(F.col("facility_id")))
    return tests


def bag_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often, with the side; both sides empty means equal as bags."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def duplicated(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key occurs more than once."""
    many = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return rows.join(many, list(keys), "left_semi")


def reasons(tests: dict[str, Column]) -> Column:
    """Sorted names of the tests that hold; a null test does not."""
    names = F.array(*[F.when(test, name) for name, test in tests.items()])
    return F.array_sort(F.filter(names, lambda x: x.isNotNull()))


def line_reasons(parts: Column) -> Column:
    """What is wrong with a line of several parts (array of lines)."""
    bad = lambda p: (G.finite(p["x"]).isNull() | G.finite(p["y"]).isNull() | (p["z"].isNotNull() & G.finite(p["z"]).isNull()))
    empty = parts.isNull() | (F.size(parts) <= 0)
    whole = F.aggregate(parts, F.lit(0.0), lambda a, p: a + G.length(p))
    n = F.size(parts)
    jumps = F.zip_with(F.slice(parts, 1, F.greatest(n - 1, F.lit(0))), F.slice(parts, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.get(a, F.size(a) - 1) != F.get(b, F.lit(0)))
    return F.when(empty, F.array(F.lit("missing_geometry"))).otherwise(reasons({
        "degenerate_geometry": F.exists(parts, lambda p: F.size(p) < 2),
        "nonfinite_coordinates": F.exists(parts, lambda p: F.exists(p, bad)),
        "discontinuous_multipart": F.exists(jumps, lambda j: j),
        "nonpositive_geometry_length": F.isnan(whole) | (whole == float("inf")) | (whole <= 0),
    }))


def readiness(diagnostics: DataFrame) -> DataFrame:
    """One row: blocked if there is any diagnostic."""
    return diagnostics.agg(F.count(F.lit(1)).alias("diagnostics")).select("diagnostics", F.when(F.col("diagnostics") > 0, "blocked").otherwise("ready").alias("readiness"))


def diagnosed(rows: DataFrame, tests: dict[str, Column], *keys: str) -> DataFrame:
    """Keys and reasons of the rows that fail a test."""
    return rows.select(*keys, reasons(tests).alias("reasons")).where(F.size("reasons") > 0)


def repeated_identity(*keys: str) -> Column:
    return F.count(F.lit(1)).over(W.Window.partitionBy(*keys)) > 1


def edge_audit(edges: DataFrame, by: str, tolerance: float = 0.05) -> DataFrame:
    """by, weights, unsupported, without_spans: edges whose recorded weight is off by more than ``tolerance``, that have a segment the source does not support,
    or that have no spans.

    ``edges``: by, measured, recorded, segments and supported (arrays of comparable values), spans (array, null or empty if there are none).
    """
    off = F.abs(F.col("recorded") - F.col("measured")) > tolerance
    loose = F.size(F.array_except("segments", "supported")) > 0
    bare = F.col("spans").isNull() | (F.size("spans") <= 0)
    return edges.groupBy(by).agg(F.count_if(off).alias("weights"), F.count_if(loose).alias("unsupported"), F.count_if(bare).alias("without_spans"))
