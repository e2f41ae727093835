"""The queries of the numbered operators: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontamination, exact_dedup, hard_negatives, licenses, mixing, near_dedup, packing, pfor, quality, sharding, substring_dedup, suffix_dedup, token_ids
from .common import documents, table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), shards=40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), window=13).drop("key")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(documents(spark, sf_dir), window=20).select("doc_id", F.col("n_units").alias("n_words"), "n_removed", "kept_sha256", "n_spans")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(documents(spark, sf_dir), window=200).select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(documents(spark, sf_dir), percent=85)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.score(documents(spark, sf_dir))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfor.encode_documents(documents(spark, sf_dir), token_ids.vocabulary("byte_bpe_50k.json"), spaced=True, end=0)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), token_ids.vocabulary("word_bpe_49k.json"), vocabulary=49408, spaced=False, end=2, window=4096)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(hard_negatives.quantised(table(spark, sf_dir, "embeddings")))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(documents(spark, sf_dir), stays="largest")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sharding, op2_decontamination, op3_substring_dedup, op4_suffix_dedup, op5_near_dedup, op6_quality, op7_license_scan, op8_mixing, op9_token_ids, op10_packing,
        op11_hard_negatives, op12_exact_dedup, op13_collocations,
    )
}
ORACLE_SQL = {
    "op7_license_scan": licenses.oracle_sql(),
    "op11_hard_negatives": hard_negatives.oracle_sql(),
    "op12_exact_dedup": exact_dedup.oracle_sql(),
    "op13_collocations": collocations.oracle_sql(),
}
