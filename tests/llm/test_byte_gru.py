from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from callcause.llm import byte_gru
from callcause.llm.common import read

FOLDER = "/root/testdata/sf0.01"


def test_gradients_against_differences():
    rng = np.random.default_rng(3)
    net = byte_gru.Network(["a", "b", "c"], hidden=3)
    for name in ("out", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    for d in net.directions:
        d.table, d.matrix, d.bias = (x.astype(np.float64) for x in (d.table, d.matrix, d.bias))
    window, labels = rng.integers(97, 101, (6, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    _, grads = net.gradients(window, labels)
    for weight, grad in zip(net._weights(), grads):
        flat = np.flatnonzero(np.abs(grad) > 1e-4)[:6]
        for k in flat:
            old = weight.flat[k]
            weight.flat[k] = old + 1e-2
            up = net.gradients(window, labels)[0]
            weight.flat[k] = old - 1e-2
            down = net.gradients(window, labels)[0]
            weight.flat[k] = old
            assert grad.flat[k] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=1e-4)


@pytest.mark.parametrize("count", [100, 20_000])
def test_training_visits_every_window_in_all_rounds(monkeypatch, count):
    net, seen = byte_gru.Network(["a", "b"], hidden=2), np.zeros(count, int)

    def gradients(window, labels):
        np.add.at(seen, window[:4].T.copy().view("<u4")[:, 0], 1)
        return 0.0, [np.zeros_like(w) for w in net._weights()]

    monkeypatch.setattr(net, "gradients", gradients)
    windows = np.zeros((count, byte_gru.WINDOW), np.uint8)
    windows[:, :4] = np.arange(count, dtype="<u4").view(np.uint8).reshape(-1, 4)
    net.train(windows, np.zeros(count, int))
    assert byte_gru.EPOCHS <= seen.min() and seen.max() <= byte_gru.EPOCHS + 3


def test_pooling_labels_every_position_once():
    net = byte_gru.Network(["a", "b"], hidden=4)
    rng = np.random.default_rng(0)
    sizes = [0, 1, 63, 64, 65, 200, 5000]
    data = rng.integers(0, 256, sum(sizes)).astype(np.uint8)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    pooled = net.pooled(data, offsets)
    for k, n in enumerate(sizes):
        if n == 0:
            assert (pooled[k] == 0).all()
            continue
        text = data[offsets[k]:offsets[k + 1]]
        total = np.zeros(2)
        for low in range(0, n, 64):
            start = max(min(low, n - 64), 0)
            p = net.label(text[start:start + 64][:, None])[:, :, 0]
            total += p[low - start:].sum(axis=0)
        assert pooled[k] == pytest.approx(total / n, abs=1e-4)
        assert pooled[k].sum() == pytest.approx(1, abs=1e-4)


@pytest.fixture(scope="module")
def found(spark):
    docs = read(spark, FOLDER, "documents")
    return byte_gru.query(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()


def test_held_out_accuracy(found):
    apart = [r for r in found if r["held_out"] and r["lang"] and r["lang_pred"] != byte_gru.UNKNOWN]
    assert len(apart) > 100
    assert np.mean([r["lang"] == r["lang_pred"] for r in apart]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)


def test_held_out_rows(found):
    assert len(found) == 1000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)


def test_odd_tables(spark, frame):
    rows = [(1, "Das ist ein Haus und das ist gut", "de"), (2, "this is a house and it is good", "en"), (3, None, "en"),
            (4, "", None), (5, "123 ### --", "de"), (None, "this here", None), (1, "Das ist ein Haus", "de"),
            (8, "é" * 100_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("old"))
    net = byte_gru.train_network(docs, steps=5)
    assert net.languages == ["de", "en"]
    out = byte_gru.identify(docs, net)
    assert sorted(out.columns) == ["doc_id", "lang", "lang_pred", "score", "text"]
    unknown = sorted(r["doc_id"] for r in out.filter("lang_pred = 'und'").collect())
    assert unknown == [3, 4, 5]
    assert out.count() == 8 and out.filter("score is null").count() == 0
    nothing = byte_gru.query(docs.withColumn("lang", F.lit(None).cast("string")).drop("score"))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}
    assert byte_gru.query(frame([])).count() == 0


def test_copies_crowd_out_no_language(spark):
    rows = [(f"the {k} text with copies", "en") for k in range(3)] * 200 + [(f"ein Text, Nummer {k}", "de") for k in range(40)]
    pieces = byte_gru._pieces(spark.createDataFrame(rows, "text string, lang string").repartition(7), 5)
    assert sorted(p for lang, p in pieces if lang == "en") == [f"the {k} text with copies" for k in range(3)]
    german = [p for lang, p in pieces if lang == "de"]
    assert len(german) == len(set(german)) == 5
    again = byte_gru._pieces(spark.createDataFrame(rows[::-1], "text string, lang string").repartition(3), 5)
    assert again == pieces
