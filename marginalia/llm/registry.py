"""Queries over the whole test tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, licences, line_dedup, near_docs, near_vectors, packing, quality, sharding


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that no other document with a lesser doc_id equals byte for byte, with their SHA-256."""
    return exact_dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet").select("doc_id", "digest")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines that an earlier line resembles at a Jaccard similarity of 0.8 or more."""
    return line_dedup.dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, its own or its nearest directory's, in the tree of document_files."""
    files = licences.document_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return licences.licences(files).withColumn("cosine", F.round("cosine", 6))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability of good quality of every document, and whether it is kept."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.scored(docs.select("doc_id", "text"), labels).select("doc_id", "probability", (F.col("probability") >= quality.KEEP_AT).alias("kept"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document in the 50k byte-level vocabulary, and whether they decode to its text."""
    return bpe.encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens, 16 pieces and half of full attention at most."""
    return packing.packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every embedding and the number of its links: a cosine of at least 0.95."""
    return near_vectors.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document and the number of its links: word 3-grams, Jaccard similarity of at least 0.5."""
    return near_docs.near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with its derived tool calls, linked, ordered, validated and serialised."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return chat.chats(conversations, *chat.tool_view(conversations))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 64 shards of equal mixture, in a seeded order."""
    return sharding.sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_line_dedup, op3_licences, op4_quality, op5_bpe, op6_packing, op7_near_vectors, op8_ngram_join, op9_chat, op10_sharding)}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.SQL, "op10_sharding": sharding.SQL, "op2_line_dedup": line_dedup.SQL, "op3_licences": licences.sql(), "op8_ngram_join": near_docs.SQL}
