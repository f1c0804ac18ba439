from __future__ import annotations

import random

import public_tokenizers
import pytest

from callcause.llm import edit_counts, pretokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["\u201c", "\u2019s", "\u3000", " мир", "日本", "😀", " the", " and", "'s", "'re", "'", "\n", "\n\n", "   ", " ", " \n", "12", " 345", "é", " Über", "!!", " ...", "a", "%%%", "\t", "ve", "l"]


def library(text):
    return len(pretokens.vocabulary(PATH).library.encode(text, add_special_tokens=False).ids)


def edited(text, edits):
    for at, drop, put in edits:
        text = text[:at] + put + text[at + drop:]
    return text


@pytest.mark.parametrize("leaf", [1, 3, 32])
def test_random_edits_against_the_library(leaf, monkeypatch):
    monkeypatch.setattr(edit_counts, "LEAF", leaf)
    rng = random.Random(leaf)
    vocab = pretokens.vocabulary(PATH)
    originals = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 150))) for _ in range(150)] + [" " * 300, "x" * 400, "日本 " * 30]
    trees = edit_counts.trees_of(vocab, [t.encode() for t in originals])
    assert [int(t.tokens[1]) for t in trees] == [library(t) for t in originals]
    documents, finals = [], []
    for text, tree in zip(originals, trees):
        edits, now = [], text
        for _ in range(rng.randint(0, 8)):
            at, drop = rng.randint(0, len(now)), rng.choice([0, 0, 1, 2, 5, 60])
            put = "".join(rng.choice(BITS) for _ in range(rng.choice([0, 1, 1, 2, 40])))
            edits.append((at, drop, put))
            now = edited(now, edits[-1:])
        documents.append(edit_counts.Document(text.encode(), tree, edits))
        finals.append(now)
    edit_counts.apply_edits(vocab, documents)
    for document, final in zip(documents, finals):
        assert document.text.decode() == final
        assert int(document.tree.tokens[1]) == library(final)
        assert int(document.tree.bytes[1]) == len(final.encode())
        heap = document.tree.tokens
        assert all(heap[k] == heap[2 * k] + heap[2 * k + 1] for k in range(1, document.tree.leaves))


def test_many_new_pretokens_at_once():
    vocab = pretokens.Vocabulary(PATH)
    rng = random.Random(11)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(40_000))
    assert int(edit_counts.trees_of(vocab, [text.encode()])[0].tokens[1]) == library(text)


def test_exotic_characters_may_come_by_an_edit():
    vocab = pretokens.vocabulary(PATH)
    text = "plain words " * 50
    tree = edit_counts.trees_of(vocab, [text.encode()])[0]
    document = edit_counts.Document(text.encode(), tree, [(100, 2, "日本"), (300, 0, "<|endoftext|>"), (5, 1, "x")])
    edit_counts.apply_edits(vocab, [document])
    assert int(document.tree.tokens[1]) == library(edited(text, [(100, 2, "日本"), (300, 0, "<|endoftext|>"), (5, 1, "x")]))


@pytest.mark.parametrize("mark", ["\u2019s", "日本。", "\u00a0", "мир", "😀"])
def test_surroundings_are_enough_in_all_alphabets(mark):
    vocab = pretokens.vocabulary(PATH)
    text = f"some words{mark} of a long text, " * 2000
    tree = edit_counts.trees_of(vocab, [text.encode()])[0]
    document = edit_counts.Document(text.encode(), tree, [(20_000, 3, f"new{mark} "), (10, 0, mark), (40_000, 1, "")])
    edit_counts.apply_edits(vocab, [document])
    assert document.encoded < 0.1 * len(text.encode())
    assert int(document.tree.tokens[1]) == library(edited(text, document.edits))


def test_only_the_surroundings_are_encoded():
    vocab = pretokens.vocabulary(PATH)
    text = "some words of a long text, " * 4000
    tree = edit_counts.trees_of(vocab, [text.encode()])[0]
    document = edit_counts.Document(text.encode(), tree, [(50_000, 3, "new "), (10, 0, "y"), (90_000, 0, "z")])
    edit_counts.apply_edits(vocab, [document])
    assert document.encoded < 0.1 * len(text)
    assert int(document.tree.tokens[1]) == library(edited(text, document.edits))


def test_query_against_the_library(frame, prose):
    docs = frame(prose)
    edits = {}
    for r in edit_counts.sample_edits(docs).orderBy("seq").collect():
        edits.setdefault(r["doc_id"], []).append((r["at"], r["drop"], r["put"]))
    found = {r["doc_id"]: r for r in edit_counts.query(docs, PATH).collect()}
    assert len(found) == len(prose)
    for i, text in prose:
        r = found[i]
        assert (r["n_tokens"], r["n_edits"]) == (library(text or ""), 3)
        assert r["n_tokens_after"] == library(edited(text or "", edits[i]))


def test_odd_tables(spark, frame):
    docs = spark.createDataFrame([(None, "a b", 1), (1, None, 2), (1, "x y", 3), (1, "x y", 3), (2, "w " * 100_000, 4)],
                                 "doc_id long, text string, n_tokens int")
    trees = edit_counts.build_trees(docs, PATH)
    edits = spark.createDataFrame([(1, 1, None, None, "hi "), (1, 2, 99, 5, None), (2, 1, 50, 3, "q"), (7, 1, 0, 0, "z")],
                                  "doc_id long, seq int, at int, drop int, put string")
    rows = edit_counts.count_after_edits(docs, trees, edits, PATH).collect()
    assert sorted((r["doc_id"] or 0, r["text"][:6], r["n_edits"]) for r in rows) == [
        (0, "a b", 0), (1, "hi ", 2), (1, "hi x y", 2), (1, "hi x y", 2), (2, "w w w ", 1)]
    assert all(r["n_tokens_after"] == library(r["text"]) and r["tree_tokens"][1] == r["n_tokens_after"] for r in rows)
    assert edit_counts.query(frame([]), PATH).count() == 0
