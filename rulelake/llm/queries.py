"""The queries of the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from . import exact_dedup, filter_audit, langid, mixing, ngram_join, packing, piece_bpe, quality_gam, secret_forest, sharding, source_audit, sql, suffix_dedup, weak_quality
from .common import partitions


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/documents.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(_documents(spark, sf_dir))
    first = F.array_min(F.transform("placements", lambda p: p["position"]))
    rows = rows.select("doc_id", "size", "source_size", "target", "taken", F.size("placements").cast("long").alias("placements"), first.alias("first_position"))
    # in training order
    return rows.repartitionByRange(partitions(spark), F.col("first_position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("first_position").asc_nulls_last(), "doc_id")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(_documents(spark, sf_dir).select("doc_id", "text"))
    text = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    return rows.select("doc_id", sharding.record_size(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_forest.scan(_documents(spark, sf_dir))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, sf_dir)).drop("from_snapshot")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.judge(_documents(spark, sf_dir))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_documents(spark, sf_dir)).drop("spans")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_documents(spark, sf_dir)).withColumnRenamed("n_grams", "n_shingles")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.divergence(_documents(spark, sf_dir))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = piece_bpe.round_trip(_documents(spark, sf_dir))
    digest = F.sha2(F.encode("decoded", "UTF-8"), 256)
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), digest.alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_language_id": op1, "op2_curriculum_mix": op2, "op3_best_two_fit_packing": op3, "op4_two_pass_shuffle": op4, "op5_secret_forest": op5, "op6_exact_dedup": op6, "op7_weak_quality_rules": op7, "op8_suffix_array_dedup": op8, "op9_quality_gam": op9, "op10_ngram_jaccard_join": op10, "op11_filter_audit": op11, "op12_source_divergence": op12, "op13_piece_bpe": op13}


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": sql.EXACT_DEDUP, "op8_suffix_array_dedup": sql.REPEATS, "op10_ngram_jaccard_join": sql.NGRAM_JOIN, "op11_filter_audit": sql.FILTER_AUDIT, "op12_source_divergence": sql.DIVERGENCE}
