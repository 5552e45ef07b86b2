"""One query per operator, over its whole table, and the SQL twins where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from issuequarry.llm import (
    chat_format, decontaminate, importance, near_dedup, packing, pii, quality_crf, quality_rules, secret_scan, sentence_spans,
    sharding, suffix_dedup, vector_codes,
)
from issuequarry.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placements(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removals(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rule_verdicts(table(spark, sf_dir, "documents"))


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.removals(table(spark, sf_dir, "documents"))


def op8_passage_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.passages(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.detect(docs, pii.learn(docs))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_format.with_probe(table(spark, sf_dir, "conversations"))
    return chat_format.digest(chat_format.format_chats(rows))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digest(*vector_codes.compress(table(spark, sf_dir, "embeddings")))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.secrets(table(spark, sf_dir, "documents")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def registry() -> dict[str, Query]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_near_dedup": op2_near_dedup,
        "op3_sharding": op3_sharding,
        "op4_packing": op4_packing,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_decontamination": op6_decontamination,
        "op7_quality_rules": op7_quality_rules,
        "op8_sentence_spans": op8_sentence_spans,
        "op8_passage_spans": op8_passage_spans,
        "op9_pii": op9_pii,
        "op10_chat_formatting": op10_chat_formatting,
        "op11_vector_codes": op11_vector_codes,
        "op12_secret_scan": op12_secret_scan,
        "op13_importance_resampling": op13_importance_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_sharding": sharding.oracle(),
        "op6_decontamination": decontaminate.ORACLE,
        "op7_quality_rules": quality_rules.ORACLE,
        "op8_sentence_spans": sentence_spans.ORACLE,
        "op10_chat_formatting": chat_format.ORACLE,
        "op11_vector_codes": vector_codes.oracle(),
        "op12_secret_scan": secret_scan.oracle(),
    }
