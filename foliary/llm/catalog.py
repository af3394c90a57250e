"""The registered queries of this package: (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliary.llm import bitpack, drake_kmeans, exact_dedup, flac, hard_negatives, jaccard_rtree, langid, license_join, mixing, nn_descent, packing, quality_gam, token_count
from foliary.llm.scratch import tune


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.media_features(_docs(spark, sf_dir))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_docs(spark, sf_dir))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.quality(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_join.scan_licenses(_docs(spark, sf_dir))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_docs(spark, sf_dir))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.token_ids(_docs(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(_docs(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(_docs(spark, sf_dir))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_rtree.jaccard_components(_docs(spark, sf_dir))


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark, 4096)
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(_embeddings(spark, sf_dir))


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(_embeddings(spark, sf_dir))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drake_kmeans.clusters(_embeddings(spark, sf_dir))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_license_scan": op2_license_scan,
    "op3_mixing": op3_mixing,
    "op4_token_ids": op4_token_ids,
    "op5_language_id": op5_language_id,
    "op6_media": op6_media,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_packing": op8_packing,
    "op9_token_counts": op9_token_counts,
    "op10_jaccard": op10_jaccard,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_near_vectors": op12_near_vectors,
    "op13_centroids": op13_centroids,
}

ORACLE_SQL = {
    "op2_license_scan": license_join.oracle_sql(),
    "op3_mixing": mixing.ORACLE_SQL,
    "op7_exact_dedup": exact_dedup.ORACLE_SQL,
    "op10_jaccard": jaccard_rtree.ORACLE_SQL,
    "op11_hard_negatives": hard_negatives.ORACLE_SQL,
    "op12_near_vectors": nn_descent.ORACLE_SQL,
    "op13_centroids": drake_kmeans.oracle_sql(),
}
