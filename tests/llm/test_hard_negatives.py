from __future__ import annotations

import math
import random

import numpy as np
import pytest

from callcause.llm import hard_negatives as H

ROWS = "vec_id long, embedding array<double>, label int, id string"


def brute(rows, positives=5, negatives=10):
    known = []
    for vec_id, vector, label, _ in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        known.append((vec_id, label, [math.floor(256 * x) for x in vector]))
    anchors = {}
    for i, label, v in sorted(known):
        if i % 100 == 0:
            anchors.setdefault(i, (label, v))
    out = []
    for i, (label, v) in anchors.items():
        scored = sorted((-max(min(sum(a * b for a, b in zip(v, w)), 2**63 - 1), -2**63), j, other == label)
                        for j, other, w in known if j != i)
        for score, j, _ in [s for s in scored if s[2]][:positives]:
            fit = [s for s in scored if not s[2] and 30 * -score <= 100 * -s[0] <= 90 * -score][:negatives]
            out += [(i, j, rank, s[1], -score, -s[0]) for rank, s in enumerate(fit, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = []
    for i in range(900):
        centre = rng.choice(centres)
        rows.append((i, [c + rng.gauss(0, 0.3) for c in centre], rng.choice([0, 0, 0, 1, 2, 3]), "x"))
    rows += [(1_000 + i, list(rows[3][1]), 1 + i % 2, "same") for i in range(400)]  # a third of all rows is one vector
    return rows


def run(spark, rows, **options):
    table = spark.createDataFrame(rows, ROWS).repartition(3)
    return sorted(tuple(r) for r in H.mine(H.participants(table), **options).collect())


@pytest.mark.parametrize("block", [2_048, 4])
def test_against_brute_force(spark, vectors, block):
    assert run(spark, vectors, block=block) == brute(vectors)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [0.5, 0.25]
    rows = [(0, v, 1, None), (0, [0.5, 0.5], 1, None), (None, v, 1, None), (1, None, 1, None), (2, v, None, None),
            (3, [nan, 1.0], 1, None), (4, [None, 1.0], 1, None), (5, [inf, 1.0], 1, None), (6, v, 1, None), (6, v, 1, None),
            (8, [0.25, 0.125], 2, None), (9, [0.25], 3, None), (10, [0.25, 0.125, 9.0], 3, None), (10, [0.25, 0.125, 9.0], 3, None),
            (11, [], 1, None), (100, [-0.5, 0.0], 1, None), (200, [], 4, None), (300, [1e300, 1.0], 1, None), (12, [1e5, 1e5], 5, None),
            (13, [1e12, 1e5], 1, None), (15, [4e11, 1e5], 6, None)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(0, v, 1, None)]) == []


def test_bounds_hold_and_save_work():
    rng = np.random.default_rng(3)
    anchors = np.floor(256 * (rng.normal(size=(5, 1, 16)) + rng.normal(size=(1, 20, 16)) * 0.02).reshape(-1, 16))
    candidates = np.floor(256 * rng.normal(size=(3_000, 16)))
    parent, edge = H.spanning_tree(anchors)
    assert (parent < 0).sum() == 1 and sum(len(level) for level in H.levels(parent)) == len(anchors)
    ends = np.full((len(anchors), 1), np.inf)
    search = H.Search(H.Block(np.arange(100) * -100 - 100, np.zeros(100), anchors, parent, edge, -ends, ends), 5, False)
    for at in range(0, 3_000, 500):
        search.meet(np.arange(at, at + 500), np.ones(500), candidates[at:at + 500])
    scores = anchors @ candidates.T
    for k in range(100):
        best = sorted((-s, j) for j, s in enumerate(scores[k]))[:5]
        assert search.best[k, 0] == best
    assert search.scored < search.met / 2
