"""The operators as queries over the tables, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_dir, spread, table
from .decontamination import decontamination
from .license_scan import license_scan
from .line_dedup import line_dedup
from .near_duplicates import near_duplicates
from .pieces import encode
from .quality_classifier import quality_classifier
from .quality_rules import quality_rules
from .substring_dedup import substring_dedup
from .url_filters import url_filters
from .warc import read_archive, write_archive

#: A SentencePiece model with byte fallback; a parameter of the operator.
PIECE_MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
Query = Callable[[SparkSession, str], DataFrame]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), whole_runs=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return decontamination(docs, table(spark, sf_dir, "benchmark"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = new_dir(spark, "warc")
    write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), uri)
    return read_archive(spark, uri).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return license_scan(docs).drop("text")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return quality_classifier(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters(pages).select("page_id", "host", "path", "rule", "verdict")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = quality_rules(docs).drop("text")
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return out.select(*first, *[c for c in out.columns if c not in first])


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = encode(docs, PIECE_MODEL, decoded="decoded")
    return out.select(
        "doc_id",
        F.coalesce(F.size("pieces"), F.lit(0)).cast("long").alias("n_pieces"),
        F.xxhash64("pieces").alias("pieces_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("text").eqNullSafe(F.col("decoded")).alias("lossless"),
    )


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
