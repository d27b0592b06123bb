"""Queries over the training-data operators, one for each, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, hilbert_ann, html_extract, language_id, near_dedup, secrets, sentencepiece_trie, sharding, toxicity
from .workspace import prepare


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page from its text, markup, address and host."""
    model = language_id.train(_read(spark, sf_dir, "documents"))
    return language_id.identify(_read(spark, sf_dir, "pages"), model)


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract_main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_documents(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of three-word shingles have a Jaccard similarity of 0.85 or more."""
    found = near_dedup.near_duplicates(_read(spark, sf_dir, "documents"), near_dedup.Banding(words=3, percent=85, rows=6))
    return found.select(
        F.col("doc").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.col("doc").eqNullSafe(F.col("component")).alias("kept"),
    )


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as ids of the public 32k-piece vocabulary, and whether decoding gives it back."""
    return sentencepiece_trie.encode_documents(_read(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 24 shards by the external shuffle (law ``rows``)."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    shuffled = sharding.external_shuffle(docs, shards=24, seed=17)
    return shuffled.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and entropy spans of every document."""
    found = secrets.scan_secrets(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter(F.col("secrets"), lambda s: s["kind"] != "entropy")
    return found.select(
        "doc_id",
        *[secrets.count_kind(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secrets.span_string(base), 256).alias("base_sha256"),
        secrets.span_string(F.col("secrets")).alias("spans"),
        secrets.count_kind("entropy").alias("n_entropy"),
    )


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one made to test the escapes, formatted and read back."""
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    made = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    return chat_format.digest(chat_format.parse_conversations(chat_format.format_conversations(turns.unionByName(made))))


def op9_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found of every hundredth vector."""
    return hilbert_ann.nearest(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain at least 0.8 of a benchmark item's five-word shingles."""
    return decontaminate.find_contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_html_extract": op2_html_extract,
    "op3_toxicity": op3_toxicity,
    "op4_near_dedup": op4_near_dedup,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_sharding": op6_sharding,
    "op7_secret_scan": op7_secret_scan,
    "op8_chat_format": op8_chat_format,
    "op9_hilbert_ann": op9_hilbert_ann,
    "op10_decontaminate": op10_decontaminate,
}
