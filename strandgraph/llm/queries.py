"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jaccard_join import similar_documents
from .language_id import held_out, label, train
from .license_scan import scan_licenses
from .line_dedup import drop_frequent_lines
from .media_columns import store_payloads
from .mixing import mix_sources
from .packing import pack
from .substring_dedup import dedup_substrings
from .suffix_dedup import dedup_suffixes
from .topk_search import every_fiftieth, top_k


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path() -> str:
    """The vocabulary file: TOKENIZER_JSON, or that of the installed public files."""
    if given := os.environ.get("TOKENIZER_JSON"):
        return given
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_substrings(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(read(spark, sf_dir, "documents"), n=3, percent=90)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    rows = documents.select(F.col("doc_id"), held_out().alias("held_out"), "text")
    return label(rows, train(documents)).select("doc_id", "held_out", "lang_pred", "score")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_payloads(read(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_frequent_lines(read(spark, sf_dir, "documents"), min_docs=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return top_k(vectors, every_fiftieth(vectors), k=5)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_suffixes(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_substring_dedup, op3_ngram_jaccard_join, op4_language_id, op5_media_columns, op6_packing, op7_line_dedup, op8_topk_search, op9_suffix_dedup, op10_mixing)}
