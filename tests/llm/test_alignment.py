from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers

from callcause.llm import alignment as A
from callcause.llm.common import doc_batches
from callcause.llm.queries import PIECES, VOCABULARY


def byte_table():
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def spans(parts):
    out, at = [], 0
    for part in parts:
        out.append((at, at + len(part)))
        at += len(part)
    return out


def brute(rows):
    first = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = byte_table()
    coded, count = [], Counter()
    for doc_id, text in rows:
        a = first.encode(" " + (text or ""), add_special_tokens=False)
        b = second.encode(text or "")
        a_bytes = [bytes(letters[c] for c in t) for t in a.tokens]
        b_bytes = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()
                   for p in (second.id_to_piece(i) for i in b)]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            coded.append((doc_id, [], [], [], ""))
            continue
        a_spans, b_spans = spans(a_bytes), spans(b_bytes)
        links = [(a.ids[i], b[j]) for i, (s, e) in enumerate(a_spans) for j, (t, f) in enumerate(b_spans) if s < f and t < e]
        count.update(set(links))
        cuts = sorted({e for _, e in a_spans} & {e for _, e in b_spans})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, (_, e) in zip(ids, sp) if low < e <= cut)
                                   for ids, sp in ((a.ids, a_spans), (b, b_spans))))
            low = cut
        coded.append((doc_id, a.ids, b, links, ";".join(groups)))
    best = Counter()
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    return sorted((d, len(a), len(b), len(g.split(";")) if g else 0, len(links),
                   sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links),
                   hashlib.sha256(g.encode()).hexdigest() if a else "") for d, a, b, links, g in coded)


@pytest.fixture(scope="module")
def rows(prose):
    short = [(i, t if t is None or len(t) < 3_000 else t[:3_000]) for i, t in prose]
    odd = ["<|endoftext|> and <s> here", "naïve café “quoted” — 漢字 😀́", "two  spaces\n\n\ttabs ", " leading", "▁under",
           "nul\x00byte", " hard space", "ﬁ ligature", "it's we'll  'tis", "   ", "\r\n", "a" * 2_000, "0x41 <0x41>"]
    return short + [(5_000 + i, t) for i, t in enumerate(odd)] + [(6_000 + i, "the same text again") for i in range(30)]


def test_against_brute_force(frame, rows):
    assert sorted(tuple(r) for r in A.query(frame(rows), VOCABULARY, PIECES).collect()) == brute(rows)


def test_rare_pairs_by_join(frame, rows):
    few = rows[-60:]
    found = A.align(frame(few).select("doc_id", "text"), VOCABULARY, PIECES, hot_pairs=7)
    got = sorted((r["doc_id"], r["n_links"], r["n_best"], r["count_sum"]) for r in found.collect())
    assert got == [(r[0], r[4], r[5], r[6]) for r in brute(few)]


def test_odd_tables(spark, frame):
    docs = spark.createDataFrame([(1, "a word", 7, 8), (1, "a word", 7, 8), (None, None, 9, 9)], "doc_id long, text string, groups int, _a int")
    found = A.align(docs, VOCABULARY, PIECES)
    assert found.columns == ["doc_id", *A.RESULTS]
    assert sorted((r["doc_id"] or 0, r["n_a"], r["groups"]) for r in found.collect())[0] == (0, 0, "")
    assert A.query(frame([]), VOCABULARY, PIECES).count() == 0


def test_words_are_encoded_once_and_texts_of_odd_words_whole(monkeypatch):
    rng = random.Random(12)
    bits = [" ", "  ", "a", "b c", " the", "\n", "\t", "é", "日本", " ", "　", "▁", "<0x0A>", "<s>", "<|endoftext|>", "'s", "12",
            "!!", "\x1c", "́", "😀", " \n", "\n ", " x", "word "]
    rows = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(3000)] + [None, "", "plain words " * 300]
    calls, whole = [], A._encode_whole
    expected = [whole(data, offsets, VOCABULARY, PIECES) for data, offsets, _, _ in doc_batches(pa.array(rows), 20_000)]

    def counted(data, offsets, *paths):
        calls.append(len(data))
        return whole(data, offsets, *paths)

    monkeypatch.setattr(A, "_encode_whole", counted)
    monkeypatch.setattr(A, "REMEMBERED", 500)
    A._known_words.cache_clear()
    found = [A._encode(data, offsets, VOCABULARY, PIECES) for data, offsets, _, _ in doc_batches(pa.array(rows), 20_000)]
    assert [[side.to_pylist() for side in pair] for pair in found] == [[side.to_pylist() for side in pair] for pair in expected]
    calls.clear()
    text = np.frombuffer(b"several plain words, " * 1000, np.uint8)
    A._encode(text[:-1], np.array([0, len(text) - 1]), VOCABULARY, PIECES)
    assert sum(calls) < 100
