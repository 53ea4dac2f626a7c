"""The queries ``opN_<name>`` with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stratalode.llm import bpe, decontamination, lm_scoring, near_dup, pii, quality_classifier, quality_rules, secrets, sharding, token_counts
from stratalode.llm.runtime import read_table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digests(secrets.scan(docs))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json")))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return lm_scoring.cross_entropy_difference(docs, labels.filter("quality = 1").select("doc_id"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read_table(spark, sf_dir, "documents"))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.similar(read_table(spark, sf_dir, "documents"), k=4)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(read_table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digests(pii.scan(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_secrets": op2_secrets,
    "op3_token_counts": op3_token_counts,
    "op4_bpe": op4_bpe,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_sharding": op7_sharding,
    "op8_near_dup": op8_near_dup,
    "op9_quality_rules": op9_quality_rules,
    "op10_pii": op10_pii,
}

ORACLE_SQL: dict[str, str] = {
    "op9_quality_rules": quality_rules.sql(),
}
