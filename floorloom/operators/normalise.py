"""Typing and splitting of source layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Coded transition types (fixed values).
TRANSITIONS = {2: "stairs", 4: "elevator"}


def categorise(units: DataFrame, mapping: DataFrame, by: str, date: str) -> DataFrame:
    """Category of each use type; accessible as 1, 0 or null; who verified it, only where it is known."""
    made = ("category", "accessible", "verified_by", "verified_date")
    known = F.broadcast(mapping.select(F.col("use_type").alias("_t"), "category", "accessible"))  # one row per use type: a dimension
    rows = units.drop(*made).join(known, F.col("use_type") == F.col("_t"), "left").drop("_t")
    told = F.col("accessible").isNotNull()
    return rows.withColumns({"verified_by": F.when(told, by), "verified_date": F.when(told, date), "accessible": F.col("accessible").cast("int")})


def unmapped(units: DataFrame, mapping: DataFrame) -> DataFrame:
    return units.select("use_type").where("use_type IS NOT NULL").distinct().join(F.broadcast(mapping.select("use_type")), "use_type", "left_anti")


def split(rows: DataFrame, column: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Rows that differ from the value and rows that equal it; nulls are in neither."""
    return rows.where(F.col(column) != value), rows.where(F.col(column) == value)


def by_prefix(text: Column, names: dict[str, str]) -> Column:
    out = F.lit("unknown")
    for prefix, name in reversed(list(names.items())):
        out = F.when(text.startswith(prefix), name).otherwise(out)
    return out


def transition_mode(code: Column) -> Column:
    """Mode of a coded transition type; other codes fail the query."""
    out = F.raise_error(F.concat(F.lit("unsupported transition type "), F.coalesce(code.cast("string"), F.lit("null")))).cast("string")
    for k, name in TRANSITIONS.items():
        out = F.when(code == k, name).otherwise(out)
    return out


def level_key(facility: Column, name: Column) -> Column:
    return F.concat(facility.cast("string"), F.lit("_"), name)


def public_edge(edges: DataFrame) -> DataFrame:
    ids = F.coalesce("original_feature_ids", F.array("feature_id"))
    return edges.withColumn("original_feature_ids", ids).withColumn("source_id", F.coalesce(F.col("feature_id"), F.get("original_feature_ids", F.lit(0))))


def expect(df: DataFrame, name: str, **counts: int) -> DataFrame:
    """``df``, after its number of rows was found to be as expected; otherwise an error."""
    n = df.count()
    if "rows" in counts and n != counts["rows"]:
        raise ValueError(f"{name}: {n} rows, expected {counts['rows']}")
    return df
