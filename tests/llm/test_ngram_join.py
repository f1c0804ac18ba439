from __future__ import annotations

import random

import numpy as np
import pytest

from callcause.llm import ngram_join as J


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + 4]) for i in range(max(len(w) - 3, 1))) if w else frozenset()


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
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.fixture(scope="module")
def near(prose):
    """Prose, a dense group of copies many of which are too far apart, chains of small edits, and a shared template."""
    rng = random.Random(9)
    rows = list(prose)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(200)] = f"e{rng.randrange(1000)}"
        rows.append((10_000 + i, " ".join(copy)))
    chain = [f"c{k}" for k in range(60)]
    for i in range(25):
        chain = chain[2:] + [f"c{60 + 2 * i}", f"c{61 + 2 * i}"]
        rows.append((20_000 + i, " ".join(chain)))
    template = [f"t{k}" for k in range(80)]
    rows += [(30_000 + i, " ".join(template + [f"own{i}_{k}" for k in range(rng.randint(5, 30))])) for i in range(60)]
    rows += [(40_000 + i, " ".join(f"s{k}" for k in range(rng.randint(8, 12)))) for i in range(12)]
    return rows


@pytest.mark.parametrize("cell", [J.CELL, 1_500])
def test_against_brute_force(frame, near, cell):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.join(frame(near), cell=cell).collect()}
    assert found == brute(near)


def test_search_finds_what_reaches_the_threshold():
    rng = np.random.default_rng(2)
    pool = np.sort(rng.integers(0, 2**62, 400, dtype=np.uint64))
    sets = [pool[np.sort(rng.permutation(400)[:rng.integers(1, 5)])] for _ in range(50)]
    for size in (40, 100, 300):
        core = pool[:size]
        for _ in range(80):
            keep = core[rng.random(size) > rng.uniform(0, 0.2)]
            sets.append(np.unique(np.concatenate([keep, rng.choice(pool, rng.integers(0, 12))])))
    index = J.InvertedLists(sets)
    for k, s in enumerate(sets):
        allowed = np.arange(len(sets)) != k
        brute_ = [j for j, o in enumerate(sets) if j != k and
                  100 * len(np.intersect1d(s, o)) >= 85 * len(np.union1d(s, o))]
        assert sorted(index.search(s, allowed).tolist()) == brute_


def test_odd_tables(spark, frame):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text, 1), (5, text.upper(), 2), (5, text.upper(), 3), (6, None, 4), (7, "", 5), (8, "a b", 6), (9, "A  B", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    found = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in J.query(docs).collect())
    assert found == [(-1, 27, 5), (5, 27, 5), (5, 27, 5), (6, 0, 6), (7, 0, 7), (8, 1, 8), (9, 1, 8)]
    assert J.query(frame([])).count() == 0
