from __future__ import annotations

import os

import pytest
from compare import connect, differences
from pyspark.sql import functions as F
from test_chunk_bpe import library
from test_decontamination import brute as contaminated
from test_exact_dedup import lowered
from test_near_duplicates import brute as near

import __spark_entry__ as entry_module
import corpus_pipeline
from callcause.llm import byte_gru
from callcause.llm.common import read
from callcause.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_statement(spark, name):
    assert differences(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLE_SQL[name]) == []


def test_everything_is_registered():
    assert {*QUERIES, "pipeline"} <= set(entry_module.queries())
    assert set(ORACLE_SQL) <= set(entry_module.oracle_sql())
    assert [int(name[2:].split("_")[0]) for name in QUERIES] == list(range(1, 11))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The small test documents, with some that only one stage rejects."""
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = read(spark, FOLDER, "documents")
    benchmark = read(spark, FOLDER, "benchmark")
    passage = benchmark.orderBy("item_id").first()["text"]
    long = docs.filter("lang = 'en'").orderBy(F.length("text").desc()).first()["text"]
    more = [(90_001, "12 34 --", "en"), (90_002, None, None), (90_003, long.upper(), None), (90_004, long + " and", None),
            (90_005, passage, None), (90_006, "the and of to in is that for it was " * 3, None)]
    extra = spark.createDataFrame([(i, t, x, "planted", 0) for i, t, x in more], docs.schema)
    docs.unionByName(extra).write.parquet(os.path.join(folder, "documents.parquet"))
    benchmark.write.parquet(os.path.join(folder, "benchmark.parquet"))
    return folder


def test_stages_against_brute_force(spark, tables):
    docs = read(spark, tables, "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    network = byte_gru.train_network(docs.filter(~byte_gru.held_out(F.col("doc_id"))))
    labels = byte_gru.identify(docs, network).collect()
    kept = {r["doc_id"] for r in labels if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.LEAST_SCORE}
    assert not {90_001, 90_002} & kept and len(kept) > 0.9 * len(rows)

    largest = {}
    for i in kept:
        largest[lowered(rows[i])] = max(i, largest.get(lowered(rows[i]), i))
    kept = set(largest.values())
    kept = {i for i, (_, _, stays) in near([(i, rows[i]) for i in kept]).items() if stays}
    items = [(r["item_id"], r["text"]) for r in read(spark, tables, "benchmark").collect()]
    kept = {i for i, found in contaminated([(i, rows[i]) for i in kept], items).items() if not found[-1]}
    assert 90_005 not in kept

    found = corpus_pipeline.run(spark, tables).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(kept)
    assert all(r["text"] == rows[r["doc_id"]] and r["ids"] == library(r["text"]) and r["n_tokens"] == len(r["ids"]) for r in found)


def test_stages_return_the_columns_of_documents(spark, tables):
    docs = read(spark, tables, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, tables).columns == docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "decontamination", "encoding"]


def test_odd_documents(spark, tmp_path):
    docs = read(spark, FOLDER, "documents")
    odd = [(None, None, None, None, None), (None, "the and of", None, None, None), (None, "the and of", None, None, None),
           (5, "", "en", "s", 0), (5, "the and is it", "en", "s", 1), (5, "The and is it", "en", "s", 1)]
    for name, rows in (("odd", odd), ("empty", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(rows, docs.schema).write.parquet(os.path.join(folder, "documents.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(os.path.join(folder, "benchmark.parquet"))
        found = corpus_pipeline.run(spark, folder).collect()
        assert sorted((r["doc_id"] or 0, r["text"].lower()) for r in found) == (
            [(0, "the and of"), (5, "the and is it")] if rows else [])
