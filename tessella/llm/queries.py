"""Queries of this subpackage: thin digests of its operators over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import find_overlaps
from .embedding_dedup import link_vectors
from .html_extract import extract_pages
from .jaccard_join import join_similar
from .license_scan import scan_licenses
from .quality_classifier import score_quality
from .quality_rules import apply_quality_rules
from .secret_scan import scan_secrets
from .sentencepiece import encode
from .shared import table
from .sharding import md5_key, shard_by_bytes
from .spelling_variants import group_variants
from .suffix_dedup import repeated_passages
from .vector_codes import compress_vectors


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of 50 words or more; a document without one has no row."""
    return repeated_passages(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_similar(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps with the benchmark; a clean document has no row."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_overlaps(documents, table(spark, sf_dir, "benchmark"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(table(spark, sf_dir, "documents"), 8, key=md5_key)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_removed_lines", "removed_words"
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "licenses", "best_license", F.round("best_dice", 6).alias("best_dice"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_shared")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(table(spark, sf_dir, "embeddings"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_decontamination": op4_decontamination,
        "op5_html_extraction": op5_html_extraction,
        "op6_sharding": op6_sharding,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_quality_rules": op8_quality_rules,
        "op9_license_scan": op9_license_scan,
        "op10_secret_scan": op10_secret_scan,
        "op11_vector_codes": op11_vector_codes,
        "op12_embedding_dedup": op12_embedding_dedup,
        "op13_spelling_variants": op13_spelling_variants,
    }
