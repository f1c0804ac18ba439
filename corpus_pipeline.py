"""Stages that clean and encode a corpus: each takes what the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from callcause.llm import byte_gru, chunk_bpe, decontamination, exact_dedup, near_duplicates
from callcause.llm.common import Kept, read, small_batches
from callcause.llm.queries import VOCABULARY

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# A document goes if no language has at least this mean probability over its positions.
LEAST_SCORE = 0.35


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language the network is sure enough of.

    It learns from their own labels, less the held-out fifth; without labels all documents with letters stay.
    """
    small_batches(spark)
    network = byte_gru.train_network(docs.filter(~byte_gru.held_out(F.col("doc_id"))))
    if network is None:
        return docs.filter(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = byte_gru.identify(docs.select(*COLUMNS), network)
    return found.filter((F.col("lang_pred") != byte_gru.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document."""
    return exact_dedup.drop_duplicates(docs).select(*COLUMNS)


def distinct_contents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates one document."""
    small_batches(spark)
    return near_duplicates.drop_near_duplicates(docs).select(*COLUMNS)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a large share of benchmark passages."""
    found = decontamination.find_contamination(docs, read(spark, sf_dir, "benchmark"))
    return found.filter("not contaminated").select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, less those whose ids do not give the text back."""
    small_batches(spark)
    coded = chunk_bpe.decode(chunk_bpe.encode(docs.select(*COLUMNS), VOCABULARY), VOCABULARY)
    whole = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.filter(whole).select(*COLUMNS, "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES: list[tuple[str, Stage]] = [
    ("language", known_language),
    ("exact_dedup", distinct_texts),
    ("near_dedup", distinct_contents),
    ("decontamination", clean_of_benchmark),
    ("encoding", encoded),
]
# The language model of the first stage and the token ids of the last one are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each keeps is written, and read again by the next."""
    kept = Kept(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
