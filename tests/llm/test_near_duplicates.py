from __future__ import annotations

import random

import numpy as np
import pytest

from callcause.llm import near_duplicates
from callcause.llm.components import components
from callcause.llm.common import Kept


def shingles(text):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1)))


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.fixture(scope="module")
def near(prose):
    """The prose and a dense group of copies, many of them further apart from each other than the threshold."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    rows = list(prose)
    for i in range(120):
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(200)] = f"e{rng.randrange(1000)}"
        rows.append((10_000 + i, " ".join(copy)))
    return rows


def test_against_brute_force(frame, near):
    found = {r[0]: tuple(r[1:]) for r in near_duplicates.query(frame(near)).collect()}
    assert found == brute(near)


def test_small_blocks_agree(frame, near, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 7)
    found = {r[0]: tuple(r[1:]) for r in near_duplicates.query(frame(near)).collect()}
    assert found == brute(near)


def test_one_of_each_component_stays(frame, near):
    stays = {r["doc_id"] for r in near_duplicates.drop_near_duplicates(frame(near)).collect()}
    assert stays == {i for i, (_, _, kept) in brute(near).items() if kept}


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    left = rng.integers(0, 60_000, (40_000, 125)).astype(np.uint16)
    right = np.where(rng.random(left.shape) < 0.85, left, left + 1).astype(np.uint16)
    assert len(near_duplicates.survivors(left, right)) >= 39_995
    apart = np.where(rng.random(left.shape) < 0.4, left, left + 1).astype(np.uint16)
    assert len(near_duplicates.survivors(left, apart)) == 0


def test_odd_tables(spark, frame):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text, 1), (5, text.upper(), 2), (5, text.upper(), 3), (6, None, 4), (7, "", 5), (8, "a b", 6), (9, "A  B", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    found = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"], r["kept"])
                   for r in near_duplicates.query(docs).collect())
    assert found == [(-1, 26, 5, False), (5, 26, 5, True), (5, 26, 5, True), (6, 0, 6, True), (7, 0, 7, True),
                     (8, 1, 8, True), (9, 1, 8, False)]
    assert near_duplicates.query(frame([])).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)]
    random.Random(2).shuffle(edges)
    labels = components(spark.createDataFrame(edges, "u long, v long"), Kept(spark))
    found = {r["u"]: r["v"] for r in labels.collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}}


def test_any_number_of_rows_in_a_batch(spark):
    """6,000 short texts in one partition, with the session's own batch size."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    try:
        docs = spark.createDataFrame([(i, f"a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(6_000)], "doc_id long, text string")
        found = near_duplicates.query(docs.coalesce(1)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {(r["n_shingles"], r["component_id"] == r["doc_id"]) for r in found} == {(2, True)}


def test_sets_of_texts_whose_cheap_hashes_agree():
    row, other = "x", "y"
    for _ in range(12):
        row, other = row + other, other + row
    data = np.frombuffer((row + other).encode(), np.uint8)
    sets, bounds = near_duplicates.shingle_sets(data, np.array([0, len(row), len(data)]))
    assert np.diff(bounds).tolist() == [1, 1] and sets[0] != sets[1]
