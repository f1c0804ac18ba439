from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from callcause.llm import rule_quality
from callcause.llm.common import read

FOLDER = "/root/testdata/sf0.01"


def test_held_out_labels(spark):
    docs, labels = read(spark, FOLDER, "documents"), read(spark, FOLDER, "labels")
    found = rule_quality.query(docs, labels)
    assert found.count() == docs.count()
    apart = found.filter("held_out").join(labels, "doc_id").collect()
    assert len(apart) > 50 and {r["quality"] for r in apart} == {0, 1}
    assert np.mean([r["quality"] == r["predicted"] for r in apart]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found.collect())


def test_rules_and_weights():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.7) & (x[:, 2] <= 0.5)).astype(float)
    names = ["a", "b", "c", "d"]
    model = rule_quality.fit(names, x, y)
    assert 0 < len(model.rules) < len(rule_quality.propose_rules(names, x, y))
    margin = model.intercept + sum(w * r.holds(names, x) for r, w in zip(model.rules, model.weights))
    assert np.mean((margin > 0) == (y == 1)) > 0.97


def test_lasso_is_sparse_and_at_its_optimum():
    rng = np.random.default_rng(2)
    x = (rng.random((500, 10)) < 0.5).astype(float)
    y = (rng.random(500) < 1 / (1 + np.exp(-(2 * x[:, 0] - 1)))).astype(float)
    w, b = rule_quality.lasso_logistic(x, y, 0.02)
    slope = x.T @ (1 / (1 + np.exp(-(x @ w + b))) - y) / 500
    assert (w != 0).sum() < 10
    assert np.abs(slope[w == 0]).max() <= 0.02 + 1e-4
    assert slope[w != 0] == pytest.approx(-0.02 * np.sign(w[w != 0]), abs=1e-4)


def test_column_agrees_with_numpy(spark):
    names = list(rule_quality.statistics(F.col("text")))
    docs = spark.createDataFrame([(1, "a b c"), (2, "X!! Y!!"), (3, ""), (4, "a | b | c %%%"), (5, "w w w w")], "doc_id long, text string")
    rules = (rule_quality.Rule((("upper", True, 0.1),)), rule_quality.Rule((("symbols", False, 0.05), ("distinct_words", True, 0.5))))
    model = rule_quality.Ensemble(rules, (-1.5, 2.0), 0.25)
    stats = docs.select("doc_id", *[c.alias(n) for n, c in rule_quality.statistics(F.col("text")).items()]).toPandas().set_index("doc_id")
    margin = 0.25 + sum(w * r.holds(names, stats[names].to_numpy()) for r, w in zip(rules, model.weights))
    expected = dict(zip(stats.index, 1 / (1 + np.exp(-margin))))
    for row in rule_quality.score(docs, model).collect():
        assert row["score"] == pytest.approx(expected[row["doc_id"]])


def test_odd_tables(spark, frame):
    docs = spark.createDataFrame([(1, None, 5.0), (None, "", 6.0), (1, "x y", 7.0), (3, "long " * 100_000, 8.0)],
                                 "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = rule_quality.query(docs, none).collect()
    assert len(found) == 4 and {r["score"] for r in found} == {0.5}
    one = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in rule_quality.score(docs, rule_quality.train(docs, one)).collect()} == {1}
    assert rule_quality.query(frame([]), none).count() == 0
