"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, divergence, dualtree, licenses, lm, packing, pii, quality, secrets, simhash, tiff, tokens, toxicity
from tidemark.llm.secrets import joined, of_kind

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_findings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[of_kind("base", k).alias(f"n_{k}") for k in secrets.KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), "faults")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"))


def op7_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tiff.tiff_pages(tiff.text_media(table(spark, sf_dir, "documents")), keep=["doc_id", "n_bytes"])
    return pages.select(
        "doc_id", "n_bytes", F.length("samples").cast("bigint").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"), F.crc32(F.expr("substring(samples, -64, 64)")).alias("tail_crc32"),
        "media_bytes", "media_sha256", F.concat_ws(":", F.concat_ws("x", "width", "height"), F.col("compression").cast("string"), F.col("predictor").cast("string"), "layout", F.array_join(F.col("histogram").cast("array<string>"), ",")).alias("feature"),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pii_findings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[of_kind("base", k).alias(f"n_{k}") for k in pii.KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dualtree.centroid_clusters(table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_toxicity, op2_secret_scan, op3_license_scan, op4_decontaminate, op5_best_fit_packing, op6_lm_scores, op7_tiff_pages, op8_token_counts, op9_quality, op10_simhash, op11_pii, op12_centroid_clusters, op13_source_divergence)}


def oracle_sql() -> dict[str, str]:
    return {"op3_license_scan": licenses.oracle_sql(), "op12_centroid_clusters": dualtree.oracle_sql(), "op13_source_divergence": divergence.oracle_sql()}
