"""Every query of the catalogue, against its oracle where it has one."""

import pytest
from pyspark.sql import functions as F

from floorloom import catalogue
from tests.oracle import database, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    columns, rows = spark_rows(catalogue.QUERIES[name](spark, SF))
    if name in catalogue.ORACLES:
        assert (columns, rows) == duck_rows(con, catalogue.ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_distances_are_compared_in_every_component(spark, monkeypatch):
    """A chain merged with a wrong length is noticed, whatever component it lies in."""
    from pyspark.sql import functions as F

    from floorloom.operators import connectivity, graph

    run = catalogue.QUERIES["g24_distance_preservation"]
    real, hurt = graph.contracted, []

    def damaged(edges, bound):
        merged = real(edges, bound)
        parts = connectivity.components(edges, "a", "b").withColumnRenamed("component", "_c")
        of = merged.where(F.size("terminals") == 2).join(parts, F.get("terminals", F.lit(0)) == F.col("node"))
        last = of.orderBy(F.desc("_c")).first()
        hurt.append((last["_c"], parts.agg(F.min("_c")).first()[0]))
        return merged.withColumn("length", F.col("length") + F.when(F.array_contains("terminals", last["node"]), 100.0).otherwise(0.0))

    monkeypatch.setattr(graph, "contracted", damaged)
    wrong = {r["component"]: r["mismatches"] for r in run(spark, SF).collect()}  # a row a component
    assert wrong[hurt[0][0]] > 0 and sum(wrong.values()) == wrong[hurt[0][0]]
    assert hurt[0][0] > hurt[0][1]  # a later component


def test_safe_cells_of_many_customers(spark, tmp_path):
    """With so many customers that a junction's other positions came to lie in its neighbours' cells."""
    con = database(SF)
    spark.range(900_000).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    con.sql(f"CREATE OR REPLACE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    found = spark_rows(catalogue.QUERIES["g15_safe_cells"](spark, str(tmp_path)))
    assert found == duck_rows(con, catalogue.ORACLES["g15_safe_cells"]) and len(found[1]) == 266


def test_guidance_of_repeated_events(spark, tmp_path):
    """Events of which every one comes twice: lines without length were a division by zero."""
    spark.read.parquet(f"{SF}/events.parquet").selectExpr("explode(array(event_id, event_id + 1000000)) AS event_id", "* EXCEPT (event_id)").write.parquet(f"{tmp_path}/events.parquet")
    own = database(SF)
    own.sql(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert spark_rows(catalogue.QUERIES["k1_guidance_documents"](spark, str(tmp_path))) == duck_rows(own, catalogue.ORACLES["k1_guidance_documents"])
