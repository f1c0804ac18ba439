from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from callcause.llm import pretokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["the", " and", "'s", "'re", "'LL", "''ll", "'", " '", " 've", "'vex", "\n", "\n\n", "  ", "   x", "\t", " \n", "12", " 345", "½",
          "é", "ß", " Über", "!!", " ...", "a'b", "'d'm", "x's's", "%%%", "|", "<|endoftext|>", " ", "\u0085", "日本", " ",
          "á", "ǅ", "\x00", "\x1c", "\x1c \x1d", "…", "\u201cquoted\u201d", "don\u2019t", "\u2014", " \u2014 ", "Привет", " мир", "'ж", "'sж",
          "\u3000", "\u2003x", "\u2028", " \u3000", "\u3000 ", "٣٤", " Ⅷ", "e\u0301", "😀", " 👩\u200d👧", "\ufeff", "𝒜x", "हिन्दी", "한국", "\u1680!"]


def texts(items):
    raw = [t.encode() for t in items]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def check(items):
    vocabulary = pretokens.vocabulary(PATH)
    ids, counts = vocabulary.encode(*texts(items))
    expected = [vocabulary.library.encode(t, add_special_tokens=False).ids for t in items]
    cuts = np.concatenate([[0], np.cumsum(counts)])
    assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])] == expected
    data, ends = vocabulary.decode(ids, cuts)
    for k, text in enumerate(items):
        assert data[ends[k]:ends[k + 1]].tobytes().decode() == text
        assert vocabulary.library.decode(expected[k], skip_special_tokens=False) == text


def test_mixed_pieces():
    rng = random.Random(4)
    check(["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12))) for _ in range(4000)])
    check(["".join(rng.choice(PIECES[:28]) for _ in range(rng.randint(0, 12))) for _ in range(4000)])


def test_every_character_below_the_limit():
    check([f"{a}{chr(p)}{b}" for p in range(0x300) for a in ("", "x", " ", "'") for b in ("", "y", " z", "s")])


def test_every_character_of_many_blocks():
    points = [p for p in range(0x240, 0x110000) if not 0xD800 <= p < 0xE000]
    check([f"a{chr(p)} {chr(p)}1 b{chr(p)}{chr(p)} {chr(p)}c '{chr(p)}s'" for p in [*points[:0x3000], *points[0x3000::97]]])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=6))
def test_any_texts_of_all_alphabets(items):
    check([t for t in items])


def test_bytes_that_are_no_text():
    vocabulary = pretokens.vocabulary(PATH)
    raw = [b"fine \xe2\x80\x99s", b"cut \xe2\x80", b"\x99 off", "日本".encode(), b"\xff"]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    ids, counts = vocabulary.encode(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for r, mine in zip(raw, np.split(ids, np.cumsum(counts)[:-1])):
        assert mine.tolist() == vocabulary.library.encode(r.decode("utf-8", "replace"), add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", max_codepoint=0x260), max_size=30), max_size=6))
def test_any_texts(items):
    check(items)


def test_memory_starts_anew(monkeypatch, prose):
    monkeypatch.setattr(pretokens, "REMEMBERED", 3)
    check([t or "" for _, t in prose[:50]])
    check([t or "" for _, t in prose[20:]])


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_vocabularies_use_the_library(name):
    vocabulary = pretokens.Vocabulary(public_tokenizers.path(name))
    assert not vocabulary.fast
    items = ["Some words here", "", "and é more"]
    ids, counts = vocabulary.encode(*texts(items))
    assert ids.tolist() == sum((vocabulary.library.encode(t, add_special_tokens=False).ids for t in items), [])


def test_new_pretokens_are_merged_together(monkeypatch):
    """The merger is called once for all new pre-tokens of a step, and apart only for those of several lines."""
    vocabulary, calls = pretokens.Vocabulary(PATH), []
    alone = type(vocabulary._merger)._encode_single_piece
    monkeypatch.setattr(type(vocabulary._merger), "_encode_single_piece", lambda self, piece: calls.append(piece) or alone(self, piece))
    items = [f"word{k} éa{k}!\n\n \u3000 x{k} 日本{k}" for k in range(300)] + ["\n\n\n", "a\nb", "\n"]
    ids, counts = vocabulary.encode(*texts(items))
    assert ids.tolist() == sum((vocabulary.library.encode(t, add_special_tokens=False).ids for t in items), [])
    assert len(calls) == len(set(calls)) <= 6 and all(b"\n" in bytes(c) for c in calls)


def test_frequent_pretokens_stay_remembered(monkeypatch):
    monkeypatch.setattr(pretokens, "REMEMBERED", 40)
    vocabulary, merged = pretokens.Vocabulary(PATH), []
    remember = vocabulary._remember
    monkeypatch.setattr(vocabulary, "_remember", lambda pieces: merged.extend(pieces) or remember(pieces))
    for k in range(12):
        items = [f"often again {' '.join(f'w{n}q' for n in range(20 * k, 20 * k + 20))}"]
        ids, _ = vocabulary.encode(*texts(items))
        assert ids.tolist() == vocabulary.library.encode(items[0], add_special_tokens=False).ids
        assert vocabulary.known <= 40 + 63
    assert merged.count(b"often") == merged.count(b" again") == 1
