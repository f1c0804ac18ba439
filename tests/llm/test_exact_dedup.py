from __future__ import annotations

import hashlib

import pandas as pd
import pytest

from callcause.llm import exact_dedup


def lowered(text):
    return (text or "").encode().lower()


def test_against_brute_force(frame, prose):
    groups = {}
    for i, t in prose:
        groups.setdefault(lowered(t), []).append(i)
    expected = {i: (max(groups[lowered(t)]), len(groups[lowered(t)]), i == max(groups[lowered(t)]),
                    hashlib.sha256(lowered(t)).hexdigest()) for i, t in prose}
    found = {r[0]: tuple(r[1:]) for r in exact_dedup.query(frame(prose)).collect()}
    assert found == expected


def test_frequent_digests_take_the_broadcast_way(frame, prose):
    rows = prose + [(100_000 + i, "Hot") for i in range(500)]
    marks = exact_dedup.mark_duplicates(frame(rows), frequent=4, counters=8).collect()
    hot = [r for r in marks if r["group_size"] == 500]
    assert len(hot) == 500 and sum(r["kept"] for r in hot) == 1 and {r["keep_id"] for r in hot} == {100_499}
    assert len(marks) == len(rows)


def test_summary_bounds():
    values = [b"a"] * 50 + [b"b"] * 30 + [bytes([i]) for i in range(100)]
    batches = [pd.DataFrame({"_digest": values[i::7]}) for i in range(7)]
    out = pd.concat(exact_dedup.summarise(iter(batches), counters=4))
    lost = int(out[out["_digest"].isna()]["n"].iloc[0])
    held = out[out["_digest"].notna()].set_index("_digest")["n"]
    assert len(held) <= 4 and lost <= len(values) / 5
    assert held[b"a"] <= 50 <= held[b"a"] + lost


def test_too_few_counters(frame, prose):
    with pytest.raises(ValueError):
        exact_dedup.mark_duplicates(frame(prose), frequent=10, counters=10)


def test_nulls_ties_and_clashing_columns(spark):
    rows = [(None, "A", 1), (2, "a", 2), (2, "a", 3), (None, None, 4), (None, "", 5), (7, "b", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id long")
    found = exact_dedup.mark_duplicates(docs).collect()
    assert len(found) == 6 and sum(r["kept"] for r in found) == 3
    assert {r["keep_id"] for r in found if r["group_size"] == 3} == {2}
    assert exact_dedup.query(docs).count() == 6
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, ""), (2, "a"), (7, "b")]


def test_empty_table(frame):
    assert exact_dedup.query(frame([])).count() == 0
    assert exact_dedup.drop_duplicates(frame([])).count() == 0
