"""The corpus pipeline: quality rules, near-duplicates, repeated passages, contamination, packing.

Each stage takes the documents that its predecessor kept, with all their columns, and what it decides takes effect. Decisions
are carried by a number that each row has (ROW), not by doc_id, so rows that repeat an id, and those without one, are documents
like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metroframe.llm import decontamination, near_dedup, packing, quality, suffix_dedup, token_ids
from metroframe.llm.common import cut, scratch_path, table

#: A column with a number for each row; the first stage adds it.
ROW = "_corpus_row"


def numbered(docs: DataFrame) -> DataFrame:
    """docs with ROW; where it is new, the rows are written first, so that each keeps its number."""
    return docs if ROW in docs.columns else cut(docs.withColumn(ROW, F.monotonically_increasing_id()), "pipeline-rows")


def swapped(docs: DataFrame) -> DataFrame:
    """docs with the values of doc_id and ROW exchanged."""
    return docs.select(*(F.col({"doc_id": ROW, ROW: "doc_id"}.get(c, c)).alias(c) for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row is judged by itself, whatever its id; ROW is added, for the stages that follow."""
    return quality.keep(docs).withColumn(ROW, F.monotonically_increasing_id())


#: Percent of shared five-word shingles from which documents are near copies here; op5's 85 is its own. A pair at 0.80 misses
#: all bands with probability 3e-6, and its estimate is beyond the slack with probability 1e-6.
NEAR = {"percent": 80, "bands": 24, "slack": 0.19}


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, the one of least id, null ids last; a document without words has no group, and stays.

    Of rows that repeat id and text one stays; rows that repeat an id with different texts are different documents.
    """
    rows = numbered(docs)
    found = near_dedup.classes(rows.select(F.col(ROW).alias("doc_id"), "text"), **NEAR)
    found = cut(found.select(F.col("doc_id").alias(ROW), "component_id"), "pipeline-classes")
    order = rows.select(ROW, F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), ROW).alias("order"))
    stay = found.join(order, ROW).groupBy("component_id").agg(F.min("order").alias("least")).select(F.col(f"least.{ROW}").alias(ROW))
    gone = cut(found.select(ROW).join(stay, ROW, "left_anti"), "pipeline-gone")
    return rows.join(gone, ROW, "left_anti").select(*rows.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All occurrences of a repeated passage go, also in rows without id. Rows of equal texts would lose all; near-duplicates leaves one."""
    rows = numbered(docs)
    return swapped(suffix_dedup.cleaned(swapped(rows))).select(*rows.columns)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated rows go, also those without id; others that share their id stay."""
    rows = numbered(docs)
    found = decontamination.contamination(rows.select(F.col(ROW).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    gone = found.where("contaminated").select(F.col("doc_id").alias(ROW))
    return rows.join(gone, ROW, "left_anti").select(*rows.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces by doc_id; rows that repeat an id or have none are packed like others."""
    return packing.pack(docs.select("doc_id", "text"), token_ids.vocabulary("word_bpe_49k.json"), vocabulary=49408, spaced=False, end=2, window=4096)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("contamination", contamination),
    ("packing", pack),
]
#: Suffix arrays, expectation-maximisation and tokenizers are not for SQL: tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
