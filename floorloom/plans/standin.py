"""Stand-in tables of the indoor model, derived from the star-schema tables.

Each view exists twice, as a DataFrame and as SQL for the oracle; distances are doubles throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

SQL = {
    "v_facility": "SELECT r_regionkey AS facility_id, upper(substr(r_name,1,2)) AS code, r_name AS name FROM region",
    "v_level": "SELECT n_nationkey AS level_id, n_regionkey AS facility_id, n_name AS short_name, CAST(floor(CAST(n_nationkey AS DOUBLE)/CAST(5 AS DOUBLE)) AS INT) - 2 AS vertical_order FROM nation",
    "v_unit": "SELECT c_custkey AS unit_id, concat('R', CAST(c_custkey % 1000 AS VARCHAR)) AS room_id, c_nationkey AS level_id, c_mktsegment AS use_type, CASE WHEN c_acctbal >= 0 THEN 'Y' ELSE 'N' END AS searchable, CAST(c_custkey*7919 % 10007 AS DOUBLE)/CAST(100 AS DOUBLE) AS x, CAST(c_custkey*6101 % 10007 AS DOUBLE)/CAST(100 AS DOUBLE) AS y FROM customer",
    "v_node": "SELECT s_suppkey AS node_id, s_nationkey AS level_id, CAST(s_suppkey*4801 % 10007 AS DOUBLE)/CAST(100 AS DOUBLE) AS x, CAST(s_suppkey*9311 % 10007 AS DOUBLE)/CAST(100 AS DOUBLE) AS y FROM supplier",
    "v_feature": "SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS feature_id, l_suppkey AS src, l_partkey % (SELECT max(s_suppkey)+1 FROM supplier) AS dst, CASE l_returnflag WHEN 'N' THEN 'pathway' WHEN 'R' THEN 'stairs' ELSE 'elevator' END AS mode, l_extendedprice AS length_3d FROM lineitem WHERE l_quantity = 1 AND l_tax = 0",
    "v_landmark_raw": "SELECT p_partkey AS fid, p_name AS description, CAST(p_partkey % 25 AS INT) AS level_id, CAST(p_partkey*7919 % 1009 AS DOUBLE)/CAST(100 AS DOUBLE) AS x, CAST(p_partkey*611 % 1009 AS DOUBLE)/CAST(100 AS DOUBLE) AS y FROM part",
    "v_linework": "SELECT l_orderkey, l_linenumber, l_partkey, nullif(l_returnflag,'N') AS use_type FROM lineitem",
    "v_vertex": "SELECT user_id AS edge_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS x, CAST(replace(replace(props,'{\"k\": ',''),'}','') AS DOUBLE) AS y, event_type AS level_id FROM events",
    "v_snap_old": "SELECT c_custkey AS fid, c_name, c_mktsegment, c_acctbal FROM customer",
    "v_snap_new": "SELECT c_custkey AS fid, c_name, CASE WHEN c_custkey % 53 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 97 <> 0 UNION ALL SELECT s_suppkey + 1000000, s_name, 'NEW', s_acctbal FROM supplier",
    "v_category": "SELECT * FROM (VALUES ('AUTOMOBILE','service',true), ('BUILDING','classroom',false), ('FURNITURE','office',CAST(NULL AS BOOLEAN)), ('HOUSEHOLD','washroom',true), ('MACHINERY','utility',CAST(NULL AS BOOLEAN))) AS t(use_type, category, accessible)",
}


def coordinate(key, factor: int, modulus: int):
    return (key * factor % modulus).cast("double") / F.lit(100.0)


class Views:
    """The views as DataFrames over one directory of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def facility(self) -> DataFrame:
        return self.table("region").select(F.col("r_regionkey").alias("facility_id"), F.upper(F.substring("r_name", 1, 2)).alias("code"), F.col("r_name").alias("name"))

    @property
    def level(self) -> DataFrame:
        order = F.floor(F.col("n_nationkey").cast("double") / F.lit(5.0)).cast("int") - 2
        return self.table("nation").select(F.col("n_nationkey").alias("level_id"), F.col("n_regionkey").alias("facility_id"), F.col("n_name").alias("short_name"), order.alias("vertical_order"))

    @property
    def unit(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").select(
            key.alias("unit_id"), F.concat(F.lit("R"), (key % 1000).cast("string")).alias("room_id"), F.col("c_nationkey").alias("level_id"),
            F.col("c_mktsegment").alias("use_type"), F.when(F.col("c_acctbal") >= 0, "Y").otherwise("N").alias("searchable"),
            coordinate(key, 7919, 10007).alias("x"), coordinate(key, 6101, 10007).alias("y"),
        )

    @property
    def node(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.table("supplier").select(key.alias("node_id"), F.col("s_nationkey").alias("level_id"), coordinate(key, 4801, 10007).alias("x"), coordinate(key, 9311, 10007).alias("y"))

    @property
    def feature(self) -> DataFrame:
        span = F.broadcast(self.table("supplier").agg((F.max("s_suppkey") + 1).alias("_n")))  # one row
        rows = self.table("lineitem").where("l_quantity = 1 AND l_tax = 0").crossJoin(span)
        mode = F.when(F.col("l_returnflag") == "N", "pathway").when(F.col("l_returnflag") == "R", "stairs").otherwise("elevator")
        return rows.select(
            F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))).alias("feature_id"),
            F.col("l_suppkey").alias("src"), (F.col("l_partkey") % F.col("_n")).alias("dst"), mode.alias("mode"), F.col("l_extendedprice").alias("length_3d"),
        )

    @property
    def landmark_raw(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.table("part").select(key.alias("fid"), F.col("p_name").alias("description"), (key % 25).cast("int").alias("level_id"), coordinate(key, 7919, 1009).alias("x"), coordinate(key, 611, 1009).alias("y"))

    @property
    def linework(self) -> DataFrame:
        return self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.nullif(F.col("l_returnflag"), F.lit("N")).alias("use_type"))

    @property
    def vertex(self) -> DataFrame:
        order = W.Window.partitionBy("user_id").orderBy("ts", "event_id")
        return self.table("events").select(
            F.col("user_id").alias("edge_id"), (F.row_number().over(order) - 1).cast("long").alias("i"), F.col("value").alias("x"),
            F.get_json_object("props", "$.k").cast("double").alias("y"), F.col("event_type").alias("level_id"),
        )

    @property
    def snap_old(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("fid"), "c_name", "c_mktsegment", "c_acctbal")

    @property
    def snap_new(self) -> DataFrame:
        kept = self.table("customer").where("c_custkey % 97 <> 0").select(
            F.col("c_custkey").alias("fid"), "c_name", F.when(F.col("c_custkey") % 53 == 0, "CHANGED").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), "c_acctbal"
        )
        return kept.union(self.table("supplier").select(F.col("s_suppkey") + 1000000, "s_name", F.lit("NEW"), "s_acctbal"))

    @property
    def category(self) -> DataFrame:
        rows = [("AUTOMOBILE", "service", True), ("BUILDING", "classroom", False), ("FURNITURE", "office", None), ("HOUSEHOLD", "washroom", True), ("MACHINERY", "utility", None)]
        return self.spark.createDataFrame(rows, "use_type string, category string, accessible boolean")
