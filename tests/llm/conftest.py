from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """A table of documents from (doc_id, text) pairs."""
    def build(rows, more=""):
        return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).repartition(3)
    return build


@pytest.fixture(scope="session")
def prose():
    """Deterministic texts with exact copies, near copies, shared passages, nulls, empty and very long ones."""
    import random

    rng = random.Random(5)
    words = ["".join(rng.choice(["the", "an", "ei", "öß", "tion", "rr", "é", "st"]) for _ in range(rng.randint(1, 4)))
             for _ in range(300)]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passage = text(60)
    rows = [text(rng.randint(1, 90)) for _ in range(60)]
    rows += [rows[3], rows[3].upper(), rows[7], rows[7] + " more"]
    for i in range(12):
        base = rows[i].split(" ")
        if len(base) > 20:
            base[rng.randrange(len(base))] = "edit"
            rows.append(" ".join(base))
    rows += [text(5) + " " + passage + " " + text(i) for i in range(8)]
    rows += ["", None, "   \n\t ", "a", "a b c d", "x" * 700, "ab" * 300, "\n".join(["same line again and again"] * 40), text(6000)]
    ids = list(range(0, 3 * len(rows), 3))
    rng.shuffle(ids)
    return list(zip(ids, rows))
