"""The operators of this folder as named queries over the test tables, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from callcause.llm import (alignment, byte_gru, chunk_bpe, decontamination, edit_counts, exact_dedup, hard_negatives, html_text,
                           near_duplicates, ngram_join, repeated_spans, rule_quality, token_files)
from callcause.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.query(read(spark, folder, "documents"))


def op2_html_template_removal(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.query(read(spark, folder, "pages"))


def op3_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.query(read(spark, folder, "documents"))


def op4_suffix_radix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_spans.query(read(spark, folder, "documents"))


def op5_rule_quality(spark: SparkSession, folder: str) -> DataFrame:
    return rule_quality.query(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op6_byte_gru_language(spark: SparkSession, folder: str) -> DataFrame:
    return byte_gru.query(read(spark, folder, "documents"))


def op7_chunk_reuse_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_bpe.query(read(spark, folder, "documents"), VOCABULARY)


def op8_edit_aware_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return edit_counts.query(read(spark, folder, "documents"), VOCABULARY)


def op9_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.query(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op10_mixing_range_coder(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.query(read(spark, folder, "documents"), VOCABULARY)


def op11_divide_skip_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.query(read(spark, folder, "documents"))


def op12_arrow_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.query(read(spark, folder, "documents"), VOCABULARY, PIECES)


def op13_spanning_tree_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.query(read(spark, folder, "embeddings"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_exact_dedup, op2_html_template_removal, op3_minhash_near_dedup, op4_suffix_radix_dedup, op5_rule_quality,
    op6_byte_gru_language, op7_chunk_reuse_bpe, op8_edit_aware_token_counts, op9_benchmark_decontamination,
    op10_mixing_range_coder, op11_divide_skip_join, op12_arrow_token_alignment, op13_spanning_tree_negatives)}
ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op9_benchmark_decontamination": decontamination.SQL,
    "op13_spanning_tree_negatives": hard_negatives.SQL,
}
