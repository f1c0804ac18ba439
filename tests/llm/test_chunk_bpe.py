from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from callcause.llm import chunk_bpe, pretokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def mixed(prose):
    """Prose with shared passages, runs of white space, contractions and marks, cut at many places."""
    rng = random.Random(8)
    bits = [" the", " and", "'s", "'re", "\n", "\n\n", "   ", " \n", "12", " 345", "é", " Über", "!!", " ...", "a", "%%%", "\t", " '", "ve"]
    shared = ["".join(rng.choice(bits) for _ in range(400)) for _ in range(6)]
    rows = [(i, t or "") for i, t in prose]
    rows += [(5000 + i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 300))) + rng.choice(shared)
              + "".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) + rng.choice(shared)) for i in range(60)]
    rows += [(8000, " " * 5000), (8001, "\n" * 3000), (8002, "'" * 2000), (8003, "日本 text" * 200), (8004, "x <|endoftext|> y" * 50)]
    return rows


def library(text):
    return pretokens.vocabulary(PATH).library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("mean, least", [(512, 96), (24, 1), (4, 1), (60, 20)])
def test_chunks_against_the_library(mixed, mean, least, monkeypatch):
    monkeypatch.setattr(chunk_bpe, "MEAN", mean)
    monkeypatch.setattr(chunk_bpe, "LEAST", least)
    chunks = chunk_bpe.Chunks(pretokens.Vocabulary(PATH))
    raw = [t.encode() for _, t in mixed]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    for _ in range(2):  # the second time all chunks are known
        before = chunks.encoded
        ids, counts = chunks.encode(np.frombuffer(b"".join(raw), np.uint8), offsets)
        cuts = np.concatenate([[0], np.cumsum(counts)])
        for k, (_, text) in enumerate(mixed):
            assert ids[cuts[k]:cuts[k + 1]].tolist() == library(text), k
    assert chunks.encoded == before


def test_shared_passages_are_encoded_once(mixed):
    chunks = chunk_bpe.Chunks(pretokens.Vocabulary(PATH))
    text = mixed[70][1] + " ".join(t for _, t in mixed[:40])
    raw = [(f"{k} " * k + text).encode() for k in range(20)]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    chunks.encode(np.frombuffer(b"".join(raw), np.uint8), offsets)
    assert chunks.encoded < 0.2 * chunks.asked


@pytest.mark.parametrize("mark", ["\u2019s", " \u2014 ", " Привет, мир", "日本。", "\u3000", "😀"])
def test_chunks_of_all_alphabets(mixed, mark):
    chunks = chunk_bpe.Chunks(pretokens.Vocabulary(PATH))
    text = mark.join([mixed[70][1], *(t for _, t in mixed[:40])])
    raw = [(f"{k}{mark} " * k + text).encode() for k in range(20)]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    ids, counts = chunks.encode(np.frombuffer(b"".join(raw), np.uint8), offsets)
    assert chunks.encoded < 0.2 * chunks.asked
    for r, mine in zip(raw, np.split(ids, np.cumsum(counts)[:-1])):
        assert mine.tolist() == library(r.decode())


def test_query_against_the_library(frame, mixed):
    found = {r[0]: tuple(r[1:]) for r in chunk_bpe.query(frame(mixed), PATH).collect()}
    assert len(found) == len(mixed)
    for i, text in mixed:
        ids = library(text)
        assert found[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                            hashlib.sha256(text.encode()).hexdigest())


def test_odd_tables(spark, frame):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "x y", 3), (1, "x y", 3), (2, "é " * 200_000, 4)],
                                 "doc_id long, text string, ids int")
    coded = chunk_bpe.decode(chunk_bpe.encode(docs, PATH), PATH)
    assert coded.columns == ["doc_id", "text", "ids", "decoded"]
    rows = coded.collect()
    assert len(rows) == 5 and all(r["decoded"] == (r["text"] or "") for r in rows)
    assert chunk_bpe.query(frame([]), PATH).count() == 0
    away = spark.createDataFrame([(1, None), (2, [15496])], "doc_id long, ids array<int>")
    assert [r["decoded"] for r in chunk_bpe.decode(away, PATH).orderBy("doc_id").collect()] == ["", "Hello"]


def thue_morse(a, b, doublings, between=""):
    row, other = [a], [b]
    for _ in range(doublings):
        row, other = row + other, other + row
    return between.join(row), between.join(other)


@pytest.mark.parametrize("pair", [thue_morse("a", "b", 11), thue_morse("x", "y", 10, " "), thue_morse("one ", "two ", 12)])
def test_texts_whose_cheap_hashes_agree(pair):
    """Polynomials modulo 2^64 cannot tell these texts apart, whatever the base."""
    chunks = chunk_bpe.Chunks(pretokens.Vocabulary(PATH))
    library = tokenizers.Tokenizer.from_file(PATH)
    texts = [t.encode() for t in (*pair, pair[0])]
    for part in (texts, texts[1:]):
        data = np.frombuffer(b"".join(part), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in part])])
        ids, counts = chunks.encode(data, offsets)
        for t, mine in zip(part, np.split(ids, np.cumsum(counts)[:-1])):
            assert mine.tolist() == library.encode(t.decode(), add_special_tokens=False).ids
