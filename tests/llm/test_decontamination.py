from __future__ import annotations

import hashlib
import re

from callcause.llm import decontamination

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for s in range(max(len(w) - 12, 1)) if w else ():
            windows.setdefault(tuple(w[s:s + 13]), set()).add(item)
    out = {}
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                named = windows.get(tuple(w[s:s + n]))
                if named:
                    hit.update(range(s, s + n))
                    found |= named
        names = ",".join(sorted(str(x) for x in found))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def planted(prose):
    long = " ".join(f"w{i}" for i in range(40))
    items = [(1, long), (10, long), (2, prose[2][1]), (3, "two words"), (4, "one"), (5, ""), (6, None),
             (7, " ".join(["again"] * 20)), (8, "ÖSS, été!")]
    docs = prose + [
        (9001, "x y " + " ".join(f"W{i}" for i in range(5, 20)) + " z"), (9002, "say Two  WORDS and one"),
        (9003, "again " * 15), (9004, " ".join(f"w{i}" for i in range(12))), (9005, "öss... été"),
        (9006, "ÖSS été"), (9007, "one " + "filler " * 30)]
    return docs, items


def test_against_brute_force(spark, frame, prose):
    docs, items = planted(prose)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {r[0]: tuple(r[1:]) for r in decontamination.query(frame(docs), benchmark).collect()}
    assert found == brute(docs, items)


def test_blocks_of_windows_agree(spark, frame, prose):
    docs, items = planted(prose)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "items", "contaminated"]
    whole = decontamination.find_contamination(frame(docs), benchmark).select(columns).collect()
    parted = decontamination.find_contamination(frame(docs), benchmark, block_windows=9).select(columns).collect()
    assert sorted(whole) == sorted(parted)


def test_ranges_cover_the_passage(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "a b " + item + " c " + item)], "doc_id long, text string")
    row = decontamination.find_contamination(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).first()
    assert row["hit_ranges"] == [2, 22, 23, 43] and row["items"] == [5] and row["n_hit"] == 40


def test_odd_tables(spark, frame):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b", 3), (None, None, None), (1, "a b", 3)], "doc_id long, text string, n_hit long")
    found = decontamination.find_contamination(docs, none)
    assert found.count() == 3 and found.filter("contaminated or n_hit > 0").count() == 0
    nameless = spark.createDataFrame([(None, "a b"), (4, None)], "item_id long, text string")
    rows = decontamination.find_contamination(docs, nameless).collect()
    assert sorted((r["n_hit"], r["n_items"]) for r in rows) == [(0, 0), (2, 0), (2, 0)]
    assert decontamination.find_contamination(frame([]), nameless).count() == 0
