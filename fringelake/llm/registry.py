"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, clusters, decontam, mixing, pii, quality, simhash, substring_rlz, suffix_dedup, toxicity, urls, vector_codes, warc
from .session import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_rlz.dedup_words(table(spark, sf_dir, "documents"), text=False).drop("kept_text")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.linked_chats(chat.as_tool_traffic(table(spark, sf_dir, "conversations")), {**chat.TOOLS, **chat.REPLY})


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).withColumn("host_rate", F.round("host_rate", 9))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_bytes(table(spark, sf_dir, "documents"), text=False).drop("kept_text")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_verdicts(table(spark, sf_dir, "pages"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).drop("url")


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clustered(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_substring_dedup, op3_chat_format, op4_mixing, op5_quality_rules, op6_suffix_dedup, op7_decontamination, op8_simhash, op9_pii, op10_url_filter, op11_vector_codes, op12_warc, op13_clusters)}


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": substring_rlz.SQL, "op5_quality_rules": quality.SQL, "op6_suffix_dedup": suffix_dedup.SQL, "op11_vector_codes": vector_codes.SQL, "op12_warc": warc.SQL, "op13_clusters": clusters.SQL}
