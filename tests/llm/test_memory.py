"""What one batch of texts takes in a worker: the steps bound it, not the batch."""

from __future__ import annotations

import random
import tracemalloc

import public_tokenizers
import pyarrow as pa
import pytest

from callcause.llm import byte_gru, edit_counts, near_duplicates, pretokens
from callcause.llm.common import doc_batches


@pytest.fixture(scope="module")
def batch():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(4_000)]
    return pa.RecordBatch.from_pydict({"text": [" ".join(rng.choices(words, k=500)) for _ in range(1_000)]})


def peak(work) -> float:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_near_duplicates(batch):
    near_duplicates._sign(batch.slice(0, 10))
    assert peak(lambda: near_duplicates._sign(batch)) < 50
    assert peak(lambda: near_duplicates._sets(batch)) < 50


def test_byte_gru(batch):
    network = byte_gru.Network(["a", "b", "c", "d"])
    step = next(iter(doc_batches(batch.column("text"), byte_gru._STEP)))
    assert peak(lambda: network.pooled(*step[:2])) < 25


def test_edit_counts(batch):
    vocab = pretokens.vocabulary(public_tokenizers.path("byte_bpe_50k.json"))

    def build():
        for data, offsets, _, _ in doc_batches(batch.column("text"), edit_counts._STEP):
            raw = data.tobytes()
            edit_counts.trees_of(vocab, [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:])])

    build()
    assert peak(build) < 20
