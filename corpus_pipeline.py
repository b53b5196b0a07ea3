"""Corpus preparation in five stages: toxicity, near-duplicates, repeated substrings, benchmark passages, source mix.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept.  All but the last return the columns of
``documents``; the last gives the mix, one row per document with the words that are taken of it.  ``run`` writes each stage's result
to the shared folder as Parquet and reads it again as the next one's input, so a lost executor costs at most one stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floorloom.llm import decontaminate, mixing, setsketch, suffixes, toxicity
from floorloom.llm.queries import held_out, table
from floorloom.plans.recovery import shared_folder

ORACLE_SQL = None  # a trained classifier decides in the first stage
#: Similarity in hundredths from which documents are near copies; that of op10's contract is 85.
NEAR = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold; the labels of the held-out fold are not used."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.where(F.col("toxicity") < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the smallest id."""
    judged = setsketch.near_duplicates(docs.select("doc_id", "text"), link=NEAR).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(judged, "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the strings of 50 bytes that an earlier one has; n_chars is that of the new text."""
    cut = suffixes.dedup(docs, texts=True)
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty is a benchmark's."""
    return decontaminate.judge(docs, table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words taken of every document, with its source's size and target."""
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken", "copies", "rate")


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
