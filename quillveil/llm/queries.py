"""Registered queries of the data-preparation operators: production parameters, whole tables, full results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import counts, dac, exact, lm, mixing, near, packing, quality, sharding, store, tagpaths


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = store.new_path(spark, "token-codes")
    dac.write_tokens(documents(spark, sf_dir), out)
    return dac.read_tokens(spark, out)


def op2_trie_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(documents(spark, sf_dir))


def op3_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(documents(spark, sf_dir), out=store.new_path(spark, "lm"))


def op4_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.judged(docs, quality.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op5_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagpaths.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_dedup(documents(spark, sf_dir))


def op7_progressive_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(documents(spark, sf_dir))


def op8_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op9_flow_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    old = F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")), F.lit(sharding.OLD_SHARDS))
    out = sharding.resharded(docs, old, store.new_path(spark, "resharded"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op10_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_token_codes, op2_trie_counts, op3_elias_fano_lm, op4_boosted_quality, op5_tag_path_text, op6_circulant_minhash, op7_progressive_dedup, op8_fair_queue_mix, op9_flow_reshard, op10_bin_slack_packing)}
ORACLE_SQL: dict[str, str] = {"op7_progressive_dedup": exact.ORACLE, "op8_fair_queue_mix": mixing.ORACLE}
