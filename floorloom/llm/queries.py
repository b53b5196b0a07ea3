"""The ten ``opN_`` queries and their oracle SQL, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floorloom.llm import crossentropy, decontaminate, embeddings, mixing, preferences, setsketch, suffixes, toxicity, urlfilter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that an earlier one has in a string of 50."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixes.dedup(documents).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and class of every vector at a cosine of 0.9."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document in a mix of the corpus' own size, sources weighing 5, 2, 1 in turn."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(documents).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op4_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict for every page.  A labelled page outcome is the quality label of the document with the page's id."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("bad"))
    outcomes = pages.join(labels, F.col("page_id") == F.col("doc_id")).select("url", "bad")
    return urlfilter.judge(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


def op5_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of all pages, written to archives and read back through the merged index."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.archive(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and masked completions of all adjacent pairs of conversations."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return preferences.paired(preferences.segments(turns, preferences.adjacent(turns)))


def op7_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under a model of the documents labelled good and one of all."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = crossentropy.score(documents, table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))
    return scored.withColumns({c: F.round(c, 6) for c in ("target_loss", "background_loss", "score")})


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words hit in every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = decontaminate.judge(documents, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return judged.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )


def held_out(doc_id):
    """Fold 2 of 4 by crc32 of the id as text; an unknown id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op9_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt outside the held-out fold."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
    scored = toxicity.score(documents, toxicity.fit(documents, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op10_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near-duplicates of every document, by the smallest id of the class."""
    return setsketch.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_mix_sources": op3_mix_sources,
    "op4_url_reputation": op4_url_reputation,
    "op5_warc_index": op5_warc_index,
    "op6_preference_pairs": op6_preference_pairs,
    "op7_cross_entropy": op7_cross_entropy,
    "op8_decontaminate": op8_decontaminate,
    "op9_toxicity_ftrl": op9_toxicity_ftrl,
    "op10_setsketch_dedup": op10_setsketch_dedup,
}
ORACLES = {
    "op1_suffix_dedup": suffixes.SQL,
    "op2_embedding_dedup": embeddings.SQL,
    "op4_url_reputation": urlfilter.SQL,
    "op5_warc_index": warc.SQL,
    "op6_preference_pairs": preferences.SQL,
    "op7_cross_entropy": crossentropy.SQL,
    "op8_decontaminate": decontaminate.SQL,
    "op10_setsketch_dedup": setsketch.SQL,
}
