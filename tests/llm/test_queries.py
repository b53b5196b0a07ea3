"""The registered queries, against their oracles; the pipeline, stage by stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from floorloom.llm import queries, toxicity
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_setsketch import brute as classes
from tests.llm.test_suffixes import brute as cuts
from tests.oracle import database, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    columns, rows = spark_rows(queries.QUERIES[name](spark, SF))
    if name in queries.ORACLES:
        assert (columns, rows) == duck_rows(con, queries.ORACLES[name])


def test_suffix_query_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in queries.table(spark, SF, "documents").collect()]
    assert sorted(map(tuple, queries.op1_suffix_dedup(spark, SF).collect()), key=str) == cuts(docs)


def test_pipeline_stages(spark):
    docs = queries.table(spark, SF, "documents")
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    clean = corpus_pipeline.drop_toxic(spark, docs, SF).cache()
    scores = {r["doc_id"]: r["score"] for r in queries.op9_toxicity_ftrl(spark, SF).collect()}
    assert {i for i, _ in rows(clean)} == {i for i, s in scores.items() if s < toxicity.THRESHOLD}
    single = corpus_pipeline.drop_near_copies(spark, clean, SF).cache()
    assert sorted(i for i, _ in rows(single)) == sorted(i for i, _, _, kept in classes(rows(clean), corpus_pipeline.NEAR) if kept)
    cut = corpus_pipeline.cut_repeats(spark, single, SF).cache()
    left = {i: n - k for i, n, k, _, _ in cuts(rows(single))}
    assert cut.columns == docs.columns and {i: len((t or "").encode()) for i, t in rows(cut)} == left
    bench = [(r["item_id"], r["text"]) for r in queries.table(spark, SF, "benchmark").collect()]
    safe = corpus_pipeline.drop_contaminated(spark, cut, SF).cache()
    assert sorted(i for i, _ in rows(safe)) == sorted(i for i, _, _, _, bad in hits(rows(cut), bench) if not bad)
    mixed = corpus_pipeline.mix_sources(spark, safe, SF).toPandas()
    per = mixed.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert len(mixed) == safe.count() and ((per["taken"] - per["target"]).abs() <= 2).all()


def test_run_writes_every_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "taken", "target"} <= set(out.columns)
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and out.where(F.col("taken") > 3 * F.col("size")).count() == 0


def test_stage_drops_copies_from_eight_tenths(spark):
    """Four scattered words of 200 replaced: 176 of 216 runs are common, 0.81."""
    words = [f"w{k}" for k in range(200)]
    copy = [f"z{k}" if k in (30, 80, 130, 180) else w for k, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(copy)), (3, "something else that is quite different here")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == [1, 3]
