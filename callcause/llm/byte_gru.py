"""Language of texts, from a bidirectional gated recurrent network over bytes.

The network reads windows of WINDOW bytes from both ends, labels every position
with a probability for each language, and a document's probabilities are the
mean over all its positions. It is trained by backpropagation through time, in
numpy, on pieces of a bounded number of labelled documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from callcause.llm.common import doc_batches, map_batches

WINDOW = 64
HIDDEN = 8
# Different labelled texts per language that training sees at most, and characters of a piece of each.
TRAIN_DOCS = 600
TRAIN_CHARS = 300
# How often training sees each window of the sample, and windows of a step of the optimiser.
EPOCHS, BATCH = 30, 256
UNKNOWN = "und"
RESULTS = ("lang_pred", "score")
_LANES = 1_024
# Bytes of text that go through the array steps at once; a longer text is a step of its own.
_STEP = 250_000
_BUCKETS = 1_000_003


def held_out(id_column: Column) -> Column:
    """Rows that no model here learns from: crc32 of the id as text leaves no rest by 5."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Direction:
    """Weights of one reading direction: input table, recurrent matrix, its bias; gates in the order update, reset, new."""

    table: np.ndarray
    matrix: np.ndarray
    bias: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x += np.float32(1)
    x *= np.float32(0.5)
    return x


def _forward(d: Direction, window: np.ndarray, alive: np.ndarray | None, tape: list | None) -> np.ndarray:
    """Hidden states (time, hidden, lanes) of bytes (time, lanes); where ``alive`` is 0 the state stays empty."""
    steps, lanes = window.shape
    size = d.matrix.shape[1]
    h = np.zeros((size, lanes), np.float32)
    out = np.empty((steps, size, lanes), np.float32)
    for t in range(steps):
        x = np.take(d.table, window[t], axis=1)
        u = d.matrix @ h
        u += d.bias[:, None]
        gates = _sigmoid(x[:2 * size] + u[:2 * size])
        z, r = gates[:size], gates[size:]
        new = np.tanh(x[2 * size:] + r * u[2 * size:])
        before = h
        h = new + z * (h - new)
        if alive is not None:
            h *= alive[t]
        out[t] = h
        if tape is not None:
            tape.append((before, z, r, new, u[2 * size:]))
    return out


def _backward(d: Direction, window: np.ndarray, tape: list, grads: np.ndarray) -> Direction:
    """Gradients of a direction's weights, from those of its states."""
    size = d.matrix.shape[1]
    matrix, bias, inputs = np.zeros_like(d.matrix), np.zeros_like(d.bias), []
    carry = np.zeros_like(grads[0])
    for t in range(len(grads) - 1, -1, -1):
        before, z, r, new, u_new = tape[t]
        g = grads[t] + carry
        g_new = g * (1 - z) * (1 - new * new)
        g_z = g * (before - new) * z * (1 - z)
        g_r = g_new * u_new * r * (1 - r)
        x = np.concatenate([g_z, g_r, g_new])
        u = np.concatenate([g_z, g_r, g_new * r])
        matrix += u @ before.T
        bias += u.sum(axis=1)
        inputs.append(x)
        carry = g * z + d.matrix.T @ u
    each, bytes_ = np.concatenate(inputs, axis=1), window[::-1].ravel()
    table = np.stack([np.bincount(bytes_, row, 256) for row in each]).astype(d.table.dtype)
    return Direction(table, matrix, bias)


class Network:
    """Both directions and the labels of positions."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 6):
        rng = np.random.default_rng(seed)
        self.languages = languages

        def normal(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.directions = [Direction(normal(3 * hidden, 256, scale=0.5), normal(3 * hidden, hidden, scale=hidden**-0.5),
                                     np.zeros(3 * hidden, np.float32)) for _ in range(2)]
        self.out = normal(len(languages), 2 * hidden, scale=(2 * hidden) ** -0.5)
        self.bias = np.zeros(len(languages), np.float32)

    def _weights(self) -> list[np.ndarray]:
        return [w for d in self.directions for w in (d.table, d.matrix, d.bias)] + [self.out, self.bias]

    def _positions(self, window: np.ndarray, alive: np.ndarray | None, tapes: list | None = None):
        ahead = _forward(self.directions[0], window, alive, tapes and tapes[0])
        back = _forward(self.directions[1], window[::-1], None if alive is None else alive[::-1], tapes and tapes[1])
        states = np.concatenate([ahead, back[::-1]], axis=1)
        logits = self.out @ states
        logits += self.bias[:, None]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return states, logits

    def label(self, window: np.ndarray, alive: np.ndarray | None = None) -> np.ndarray:
        """Probabilities (time, language, lane) of every position."""
        return self._positions(window, alive)[1]

    def gradients(self, window: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over positions and lanes, and its gradient for all weights."""
        tapes: list = [_Tape(), _Tape()]
        states, probabilities = self._positions(window, None, tapes)
        steps, lanes = window.shape
        at = np.arange(lanes)
        loss = -float(np.log(probabilities[:, labels, at] + 1e-9).mean())
        g = probabilities.copy()
        g[:, labels, at] -= 1
        g /= steps * lanes
        out = np.einsum("tcl,thl->ch", g, states)
        g_states = self.out.T @ g
        size = self.out.shape[1] // 2
        ahead = _backward(self.directions[0], window, tapes[0], np.ascontiguousarray(g_states[:, :size]))
        back = _backward(self.directions[1], window[::-1], tapes[1], np.ascontiguousarray(g_states[::-1, size:]))
        return loss, [*vars(ahead).values(), *vars(back).values(), out, g.sum(axis=(0, 2))]

    def train(self, windows: np.ndarray, labels: np.ndarray, steps: int | None = None, batch: int = BATCH,
              rate: float = 0.02, seed: int = 7) -> None:
        """Adam over shuffled batches of windows (lane, time), at a rate that falls to nothing; EPOCHS rounds if no steps are given."""
        rng = np.random.default_rng(seed)
        steps = -(-EPOCHS * len(windows) // batch) if steps is None else steps
        weights = self._weights()
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        order = np.concatenate([rng.permutation(len(windows)) for _ in range(-(-steps * batch // len(windows)))])
        for step in range(1, steps + 1):
            chosen = order[(step - 1) * batch:step * batch]
            _, grads = self.gradients(np.ascontiguousarray(windows[chosen].T), labels[chosen])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            now = rate * (1 - (step - 1) / steps)
            for w, g, m, v in zip(weights, grads, first, second):
                g = g * np.float32(min(1.0, 1.0 / (norm + 1e-9)))
                m += np.float32(0.1) * (g - m)
                v += np.float32(0.01) * (g * g - v)
                w -= np.float32(now / (1 - 0.9**step)) * m / (np.sqrt(v / np.float32(1 - 0.99**step)) + np.float32(1e-8))

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities (text, language) over all positions of each text; zero for empty texts."""
        sizes = np.diff(offsets)
        counts = -(-sizes // WINDOW)
        doc = np.repeat(np.arange(len(sizes)), counts)
        step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        fresh = offsets[doc] + step * WINDOW  # first position that this window is the first to label
        # The last window of a text ends with it, so that it is a whole one if the text has one.
        start = np.maximum(np.minimum(fresh, offsets[doc + 1] - WINDOW), offsets[doc])
        sums = np.zeros((len(sizes), len(self.languages)))
        at = np.arange(WINDOW)[:, None]
        for low in range(0, len(doc), _LANES):
            s, d = start[low:low + _LANES], doc[low:low + _LANES]
            place = at + s
            inside = place < offsets[d + 1]
            window = data[np.minimum(place, len(data) - 1)]
            alive = None if inside.all() else inside.astype(np.float32)
            counted = inside & (place >= fresh[low:low + _LANES])
            probabilities = np.einsum("tcl,tl->lc", self.label(window, alive), counted.astype(np.float32))
            np.add.at(sums, d, probabilities)
        return sums / np.maximum(sizes, 1)[:, None]


class _Tape(list):
    """A list that counts as true while it is empty."""

    def __bool__(self) -> bool:
        return True


def _pieces(labelled: DataFrame, docs: int) -> list[tuple[str, str]]:
    """Language and a piece, from anywhere in it, of the ``docs`` different texts of lowest hash in each language."""
    known = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(
        F.approx_count_distinct(F.xxhash64("text", F.lit(1))).alias("n")).collect()}
    if not known:
        return []
    # Some more than are wanted, as numbers of different texts are known to a few percent and draws vary.
    wanted = 1.25 * docs + 5 * docs**0.5 + 10
    share = F.create_map(*[F.lit(x) for lang, n in sorted(known.items()) for x in (lang, min(1.0, wanted / n))])
    draw = F.shiftrightunsigned(F.xxhash64("text", F.lit(1)), 1)
    start = 1 + F.pmod(F.xxhash64("text", F.lit(2)), F.greatest(F.length("text") - TRAIN_CHARS, F.lit(1)))
    chosen = labelled.withColumn("draw", draw).filter(F.col("draw") <= share[F.col("lang")] * F.lit(2.0**63))
    rows = chosen.select("lang", "draw", F.col("text").substr(start.cast("int"), F.lit(TRAIN_CHARS)).alias("text")).distinct()
    found: dict[str, list[str]] = {}
    for lang, _, piece in sorted(tuple(r) for r in rows.collect()):  # about ``wanted`` rows a language
        found.setdefault(lang, []).append(piece)
    return [(lang, piece) for lang, pieces in found.items() for piece in pieces[:docs]]


def train_network(docs: DataFrame, text: str = "text", lang: str = "lang", train_docs: int = TRAIN_DOCS,
                  hidden: int = HIDDEN, steps: int | None = None) -> Network | None:
    """A network for the languages in ``lang``; None if no row has both a language and a letter.

    Training sees at most ``train_docs`` different texts of each language, whatever the order or copies of the rows.
    """
    labelled = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).filter(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = sorted(_pieces(labelled, train_docs))
    if not rows:
        return None
    languages = sorted({r[0] for r in rows})
    windows, labels = [], []
    for language, piece in rows:
        data = np.frombuffer(piece.encode(), np.uint8)
        data = np.tile(data, -(-WINDOW // len(data))) if len(data) < WINDOW else data
        for low in range(0, len(data) - WINDOW + 1, WINDOW):
            windows.append(data[low:low + WINDOW])
            labels.append(languages.index(language))
    network = Network(languages, hidden)
    network.train(np.array(windows), np.array(labels), steps)
    return network


def identify(docs: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """All rows and columns with lang_pred and score, the mean probability of that language over all positions.

    A text that is null or has no letter is ``und`` with score 0, and so is every
    text if there is no network. Input columns of the result's names give way.
    """
    letter = F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False))
    if network is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        found = [network.pooled(data, offsets) for data, offsets, _, _ in doc_batches(batch.column("_read"), _STEP)]
        means = np.concatenate(found)
        best = means.argmax(axis=1)
        known = batch.column("_letter").to_numpy(zero_copy_only=False).astype(bool)
        names = [network.languages[k] if ok else UNKNOWN for k, ok in zip(best, known)]
        scores = np.where(known, np.clip(means[np.arange(len(best)), best], 0, 1), 0.0)
        return {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores)}

    keep = [c for c in docs.columns if c not in RESULTS]
    return map_batches(docs.withColumns({"_read": F.col(text).cast("string"), "_letter": letter}), work, fields, keep)


def query(documents: DataFrame) -> DataFrame:
    apart = held_out(F.col("doc_id"))
    network = train_network(documents.filter(~apart))
    return identify(documents.select("doc_id", apart.alias("held_out"), "text"), network).select(
        "doc_id", "held_out", "lang_pred", "score")
