from __future__ import annotations

import hashlib

import pytest

from callcause.llm import repeated_spans


def brute(rows, length=100):
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            w = data[p:p + length]
            if w in seen:
                gone[p:p + length] = b"\x01" * length
            seen.add(w)
        left = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out


def run(df):
    return {r[0]: tuple(r[1:]) for r in repeated_spans.query(df).collect()}


def test_against_brute_force(frame, prose):
    assert run(frame(prose)) == brute(prose)


def test_anchors_of_many_runs_are_shuffled(frame, prose, monkeypatch):
    rows = prose + [(9000 + i, f"{i} " * (i % 9) + "one very common line of this corpus that stands in a great many of its texts, "
                     "always the same and long enough to be removed wherever it is found again" + f" {i * 7}" * 30) for i in range(60)]
    expected = brute(rows)
    assert run(frame(rows)) == expected
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    found = repeated_spans.find_repeats(frame(rows), group_runs=5).select(*columns).collect()
    assert {r[0]: tuple(r[1:]) for r in found} == expected


@pytest.mark.parametrize("length, gram", [(30, 8), (50, 50)])
def test_other_lengths(frame, prose, length, gram):
    found = repeated_spans.find_repeats(frame(prose), length=length, gram=gram)
    rows = found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert {r[0]: tuple(r[1:]) for r in rows} == brute(prose, length)


def test_removed_ranges(spark):
    line = "".join(chr(97 + (i * i) % 26) for i in range(120))
    docs = spark.createDataFrame([(1, "zz" + line), (2, line + "!")], "doc_id long, text string")
    rows = {r["doc_id"]: r["removed"] for r in repeated_spans.find_repeats(docs).collect()}
    assert rows == {1: [], 2: [0, 120]}


def test_odd_tables(spark, frame):
    long = "".join(f"{i * i}," for i in range(60))[:150]
    docs = spark.createDataFrame([(None, long, 1), (5, long, 2), (5, long, 3), (5, long[20:], 4), (6, None, 5), (7, "", 6)],
                                 "doc_id long, text string, n_bytes int")
    found = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"]) for r in repeated_spans.query(docs).collect())
    assert found == [(-1, 150, 0), (5, 130, 130), (5, 150, 150), (5, 150, 150), (6, 0, 0), (7, 0, 0)]
    assert repeated_spans.query(frame([])).count() == 0
