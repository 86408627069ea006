"""The numbered queries: each operator over its whole table, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tessella.llm import bpe, chat, clustering, decontaminate, divergence, extract, langid, oracles, phrases, quality, secrets, simhash, topk, wordpiece
from tessella.session import table

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORD_PIECES = public_tokenizers.path("word_bpe_49k.json")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), RANKS, PATTERN)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(table(spark, sf_dir, "conversations"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"), WORD_PIECES)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extracted(table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mined(table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clustered(table(spark, sf_dir, "embeddings"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.judged(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_byte_bpe": op2_byte_bpe,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_chat_format": op4_chat_format,
        "op5_simhash_near_dedup": op5_simhash_near_dedup,
        "op6_exact_top_k": op6_exact_top_k,
        "op7_token_counts": op7_token_counts,
        "op8_html_extraction": op8_html_extraction,
        "op9_language_id": op9_language_id,
        "op10_benchmark_decontamination": op10_benchmark_decontamination,
        "op11_phrase_collocations": op11_phrase_collocations,
        "op12_centroid_clustering": op12_centroid_clustering,
        "op13_quality_rules": op13_quality_rules,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_scan": oracles.SECRETS,
        "op4_chat_format": oracles.CHAT,
        "op6_exact_top_k": oracles.TOP_K,
        "op10_benchmark_decontamination": oracles.CONTAMINATION,
        "op11_phrase_collocations": oracles.PHRASES,
        "op12_centroid_clustering": oracles.CLUSTERS,
        "op13_quality_rules": oracles.DIVERGENCE,
    }
