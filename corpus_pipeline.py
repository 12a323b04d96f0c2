"""Corpus pipeline: quality rules, exact and near deduplication, source mixing, packing.

Each stage works on everything its predecessor kept and returns the columns of its input; the last returns packed pieces. Rows
are judged one by one: two texts under one doc_id are two documents, and a null doc_id is in no near-duplicate group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillveil.llm import exact, mixing, near, packing, quality, store


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base limits or that the trees reject go."""
    return quality.kept_rows(docs, quality.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the longest stays, then the smallest doc_id; of rows alike one."""
    return exact.kept_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the smallest doc_id stays."""
    return near.kept_rows(docs, size=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to twice; one that it doesn't take goes."""
    return mixing.taken_rows(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, each with its sequence and offset."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("best_fit_packing", best_fit_packing)]

#: Trees, token ids and packing have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = store.written(docs, name)
    return docs
