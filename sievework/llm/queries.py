"""Registered queries of the corpus operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontam import contaminations
from .licenses import license_scan
from .lines import removals
from .mixing import mixed
from .oracles import ORACLE_SQL
from .pagetext import main_texts
from .pii import pseudonymised
from .quality import quality_verdicts
from .secrets import digest_columns, secret_spans
from .sharding import shards
from .simhash import hex_fingerprint, simhash_groups
from .spelling import spelling_variants
from .urlrules import url_verdicts
from .whitening import whitened_embeddings


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_columns(secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", hex_fingerprint(groups.fp).alias("fingerprint"), "component_id")


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "removed")


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "source")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages").select("page_id", "url"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_pagetext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_embeddings(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_pii": op2_pii,
    "op3_simhash": op3_simhash,
    "op4_decontam": op4_decontam,
    "op5_quality": op5_quality,
    "op6_lines": op6_lines,
    "op7_shards": op7_shards,
    "op8_mix": op8_mix,
    "op9_licenses": op9_licenses,
    "op10_urls": op10_urls,
    "op11_spelling": op11_spelling,
    "op12_pagetext": op12_pagetext,
    "op13_whitening": op13_whitening,
}


__all__ = ["ORACLE_SQL", "QUERIES"]
