"""The queries of this folder by name; oracle SQL where DuckDB can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_token_files, op2_byte_bpe, op3_toxicity, op4_fingerprint, op5_pii, op6_secrets, op7_warc, op8_near_dedup, op9_decontaminate, op10_exact_dedup
from .common import table


def pii_key(spark: SparkSession) -> str:
    """The key of surrogates: a setting whose name makes Spark redact its value; the queries here do with a public one."""
    return spark.conf.get("spark.hashwood.pii.secret", "public key of the queries")


def op1_token_files_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_token_files.token_files(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_byte_bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_byte_bpe.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_toxicity.toxicity(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op4_fingerprint_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_fingerprint.fingerprints(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_pii_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_pii.pii(table(spark, sf_dir, "documents", "doc_id", "text"), pii_key(spark))


def op6_secrets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_secrets.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_warc.archive(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op8_near_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_near_dedup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), size=3, num=85, den=100).drop("text_hash")


def op9_decontaminate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_decontaminate.scan(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")).drop("longest_match", "hit_runs")


def op10_exact_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_exact_dedup.exact_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files_query,
    "op2_byte_bpe": op2_byte_bpe_query,
    "op3_toxicity": op3_toxicity_query,
    "op4_fingerprint": op4_fingerprint_query,
    "op5_pii": op5_pii_query,
    "op6_secrets": op6_secrets_query,
    "op7_warc": op7_warc_query,
    "op8_near_dedup": op8_near_dedup_query,
    "op9_decontaminate": op9_decontaminate_query,
    "op10_exact_dedup": op10_exact_dedup_query,
}

ORACLE_SQL: dict[str, str] = {
    "op7_warc": op7_warc.SQL,
    "op8_near_dedup": op8_near_dedup.SQL,
    "op9_decontaminate": op9_decontaminate.SQL,
    "op10_exact_dedup": op10_exact_dedup.SQL,
}
