"""Token counts of texts that are edited, without encoding them anew.

A document's pre-tokens are the leaves, LEAF at a time, of a segment tree that
holds the bytes and tokens below every node. An edit re-encodes the leaves it
touches, a little context on their left, and as much on their right as it takes
until a pre-token begins where a leaf began before; then the sums on the paths
from the changed leaves to the root are set anew.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from callcause.llm.common import Kept, doc_batches, map_batches, texts, without
from callcause.llm.pretokens import Vocabulary, pretoken_starts, vocabulary

LEAF = 128
# A leaf that edits have made longer than this many times LEAF pre-tokens has the tree dealt anew.
SWOLLEN = 4
# Bytes left of an edit that may decide a boundary: two characters, with room to spare.
CONTEXT = 16
# Bytes of text that go through the array steps at once; a longer text is a step of its own.
_STEP = 250_000
_TREE = [T.StructField("tree_bytes", T.ArrayType(T.LongType())), T.StructField("tree_tokens", T.ArrayType(T.LongType()))]
RESULTS = ("n_tokens", "n_edits", "n_tokens_after", "bytes_encoded", "tree_bytes", "tree_tokens")


class Tree:
    """Sums over leaves, as two heaps: node k has the children 2k and 2k + 1, and the root is 1."""

    def __init__(self, sizes: np.ndarray, tokens: np.ndarray):
        self.leaves = 1 << max(len(sizes) - 1, 0).bit_length()
        self.bytes, self.tokens = (self._heap(x) for x in (sizes, tokens))

    @classmethod
    def stored(cls, tree_bytes, tree_tokens) -> Tree:
        tree = cls.__new__(cls)
        tree.bytes, tree.tokens = np.array(tree_bytes, np.int64), np.array(tree_tokens, np.int64)
        tree.leaves = len(tree.bytes) // 2
        return tree

    def _heap(self, values: np.ndarray) -> np.ndarray:
        heap = np.zeros(2 * self.leaves, np.int64)
        heap[self.leaves:self.leaves + len(values)] = values
        low = self.leaves
        while low > 1:
            heap[low // 2:low] = heap[low:2 * low:2] + heap[low + 1:2 * low:2]
            low //= 2
        return heap

    def find(self, byte: int) -> tuple[int, int]:
        """The leaf that holds a byte, and where it starts; past the end the last leaf with bytes."""
        byte = min(byte, max(int(self.bytes[1]) - 1, 0))
        node, start = 1, 0
        while node < self.leaves:
            node *= 2
            if byte >= start + self.bytes[node]:
                start += int(self.bytes[node])
                node += 1
        return node - self.leaves, start

    def replace(self, first: int, last: int, sizes: np.ndarray, tokens: np.ndarray) -> bool:
        """Put new leaves in the places first..last; false if they do not fit and were put together."""
        room = last - first + 1
        fits = len(sizes) <= room
        for heap, values in ((self.bytes, sizes), (self.tokens, tokens)):
            new = np.zeros(room, np.int64)
            new[:min(len(values), room)] = values[:room]
            new[-1] += values[room:].sum()
            heap[self.leaves + first:self.leaves + last + 1] = new
            low, high = (self.leaves + first) // 2, (self.leaves + last) // 2
            while low:
                heap[low:high + 1] = heap[2 * low:2 * high + 2:2] + heap[2 * low + 1:2 * high + 3:2]
                low, high = low // 2, high // 2
        return fits


def leaves_of(starts: np.ndarray, end: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and tokens of the leaves of pre-tokens that begin at ``starts``."""
    heads = np.arange(0, len(starts), LEAF)
    if not len(heads):
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    return np.diff(np.append(starts[heads], end)), np.add.reduceat(counts, heads)


def _cut(vocab: Vocabulary, pieces: list[bytes]) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """Starts and token counts of the pre-tokens of each piece; None where the library must encode it whole."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
    slow = set(vocab.slow_rows(data, offsets).tolist()) if len(data) or not vocab.fast else set()
    if slow:
        found = iter(_cut(vocab, [p for k, p in enumerate(pieces) if k not in slow]) if len(slow) < len(pieces) else [])
        return [None if k in slow else next(found) for k in range(len(pieces))]
    starts = pretoken_starts(data, offsets)
    slots = vocab.slots_of(data, starts, len(data))  # may put the counts in a larger array
    counts = vocab.counts[slots]
    bounds = np.searchsorted(starts, offsets)
    return [(starts[a:b] - offsets[k], counts[a:b]) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]))]


def trees_of(vocab: Vocabulary, pieces: list[bytes]) -> list[Tree]:
    """A tree for each text; one leaf if the library must encode the text whole."""
    if vocab.full:
        vocab.clear()
    found = []
    for piece, cut in zip(pieces, _cut(vocab, pieces)):
        if cut is None:
            found.append(Tree(np.array([len(piece)]), np.array([len(vocab.library_ids(piece))])))
        else:
            found.append(Tree(*leaves_of(cut[0], len(piece), cut[1])))
    return found


@dataclass
class Document:
    """A text with its tree, and the edits that wait."""

    text: bytes
    tree: Tree
    edits: list[tuple[int, int, str]]
    done: int = 0
    encoded: int = 0

    def next_edit(self) -> Change:
        at, drop, put = self.edits[self.done]
        self.done += 1
        data = np.frombuffer(self.text, np.uint8)
        places = np.flatnonzero((data & 0xC0) != 0x80)
        borders = np.append(places, len(data))
        begin = int(borders[min(max(at, 0), len(places))])
        end = int(borders[min(max(at, 0) + max(drop, 0), len(places))])
        new = put.encode()
        self.text = self.text[:begin] + new + self.text[end:]
        first, start = self.tree.find(max(begin - CONTEXT, 0))
        if start > max(begin - CONTEXT, 0):
            first, start = 0, 0
        return Change(self, first, start, begin + len(new), end, len(new) - (end - begin))


@dataclass
class Change:
    """An edit whose surroundings are to be encoded: old bytes from ``end`` on stand ``shift`` further right now."""

    document: Document
    first: int
    start: int
    new_end: int
    end: int
    shift: int
    widen: int = 0

    def stretch(self) -> bytes:
        """What to encode: from ``start`` to some bytes past the old leaf border that is hoped to last."""
        tree = self.document.tree
        total = int(tree.bytes[1])
        self.last, begin = tree.find(self.end + self.widen)
        self.border = begin + int(tree.bytes[tree.leaves + self.last])
        if self.border < self.end or self.border + CONTEXT >= total:
            self.last, self.border = tree.leaves - 1, total
        text, stop = self.document.text, min(self.border + CONTEXT, total) + self.shift
        while stop < len(text) and text[stop] & 0xC0 == 0x80:
            stop += 1
        return text[self.start:stop]

    def settle(self, vocab: Vocabulary, piece: bytes, cut) -> bool:
        """Take the encoding over, if a pre-token begins at the border; else ask for more."""
        document, tree = self.document, self.document.tree
        document.encoded += len(piece)
        if cut is None:  # the special token, which only the library cuts: one leaf for all
            tokens = len(vocab.library_ids(document.text))
            document.encoded += len(document.text) - len(piece)
            document.tree = Tree(np.array([len(document.text)]), np.array([tokens]))
            return True
        starts, counts = cut
        border = self.border + self.shift - self.start
        whole = self.border == int(tree.bytes[1])
        at = len(starts) if whole else int(np.searchsorted(starts, border))
        if not whole and (at == len(starts) or starts[at] != border):
            self.widen = 2 * self.widen + self.border - self.end + 1
            return False
        sizes, tokens = leaves_of(starts[:at], border, counts[:at])
        fits = tree.replace(self.first, self.last, sizes, tokens)
        if not fits and (tree.bytes[tree.leaves + self.last] > SWOLLEN * max(LEAF * 8, int(sizes.max()))):
            leaves = tree.bytes[tree.leaves:], tree.tokens[tree.leaves:]
            document.tree = Tree(*(np.concatenate([x[:self.first], new, x[self.last + 1:]])
                                   for x, new in zip(leaves, (sizes, tokens))))
        return True


def apply_edits(vocab: Vocabulary, documents: list[Document]) -> None:
    """All edits of all documents; stretches of different documents are encoded together."""
    open_: list[Change] = []
    while True:
        busy = {id(c.document) for c in open_}
        open_ += [d.next_edit() for d in documents if d.done < len(d.edits) and id(d) not in busy]
        if not open_:
            return
        if vocab.full:
            vocab.clear()
        pieces = [c.stretch() for c in open_]
        open_ = [c for c, piece, cut in zip(open_, pieces, _cut(vocab, pieces)) if not c.settle(vocab, piece, cut)]


def build_trees(docs: DataFrame, path: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per input row: its id, ``_text`` (hash of the text), tree_bytes and tree_tokens (heaps, the root at 1)."""
    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        trees = []
        for data, offsets, _, _ in doc_batches(batch.column("_read"), _STEP):
            raw = data.tobytes()
            trees += trees_of(vocabulary(path), [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:])])
        return {"tree_bytes": pa.array([t.bytes for t in trees], pa.list_(pa.int64())),
                "tree_tokens": pa.array([t.tokens for t in trees], pa.list_(pa.int64()))}

    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    read = docs.select(F.col(id_column).alias(id_column), F.xxhash64(whole, F.length(whole)).alias("_text"), whole.alias("_read"))
    return map_batches(read, work, _TREE, keep=(id_column, "_text"))


def count_after_edits(docs: DataFrame, trees: DataFrame, edits: DataFrame, path: str, text: str = "text",
                      id_column: str = "doc_id") -> DataFrame:
    """Every row's id with the edited text, its tree, and n_tokens, n_edits, n_tokens_after, bytes_encoded.

    ``trees`` are those of the same rows, from ``build_trees``. ``edits`` has the
    columns id, seq, at, drop and put: in the order of seq, ``drop`` characters
    from character ``at`` give way to ``put``, in the text as it stands then.
    Places beyond the text mean its end; a null place is 0, a null text is
    empty. Rows that repeat an id all get its edits; rows without an id none.
    """
    listed = edits.groupBy(F.col(id_column).alias("_e")).agg(F.sort_array(F.collect_list(F.struct(
        "seq", F.coalesce("at", F.lit(0)).cast("int").alias("at"), F.coalesce("drop", F.lit(0)).cast("int").alias("drop"),
        F.coalesce("put", F.lit("")).alias("put")))).alias("_edits"))
    # Rows equal in id and text have equal trees; one of them is enough.
    once = trees.dropDuplicates([id_column, "_text"])
    armed = once.join(listed, once[id_column] == F.col("_e"), "left").select(
        F.col(id_column).alias("_i"), F.col("_text").alias("_t"), "tree_bytes", "tree_tokens", "_edits")
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    mine = docs.select(F.col(id_column).alias(id_column), F.xxhash64(whole, F.length(whole)).alias("_text"), whole.alias("_read"))
    joined = mine.join(armed, mine[id_column].eqNullSafe(F.col("_i")) & (mine["_text"] == F.col("_t")))

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        vocab = vocabulary(path)
        data, offsets = texts(batch.column("_read"))
        raw = data.tobytes()
        columns = [batch.column(n).to_pylist() for n in ("tree_bytes", "tree_tokens", "_edits")]
        documents = [Document(raw[a:b], Tree.stored(x, y), [(e["at"], e["drop"], e["put"]) for e in z or ()])
                     for a, b, x, y, z in zip(offsets[:-1], offsets[1:], *columns)]
        before = [int(d.tree.tokens[1]) for d in documents]
        apply_edits(vocab, documents)
        return {"text": pa.array([d.text.decode("utf-8", "replace") for d in documents], pa.string()),
                "tree_bytes": pa.array([d.tree.bytes for d in documents], pa.list_(pa.int64())),
                "tree_tokens": pa.array([d.tree.tokens for d in documents], pa.list_(pa.int64())),
                "n_tokens": pa.array(before, pa.int64()), "n_edits": pa.array([len(d.edits) for d in documents], pa.int64()),
                "n_tokens_after": pa.array([int(d.tree.tokens[1]) for d in documents], pa.int64()),
                "bytes_encoded": pa.array([d.encoded for d in documents], pa.int64())}

    fields = [T.StructField("text", T.StringType()), *_TREE,
              *(T.StructField(n, T.LongType()) for n in ("n_tokens", "n_edits", "n_tokens_after", "bytes_encoded"))]
    return map_batches(joined, work, fields, keep=(id_column,))


def sample_edits(documents: DataFrame) -> DataFrame:
    """Three edits of every document, at its quarters: characters go, its source is noted, a character changes."""
    n = F.char_length(F.coalesce("text", F.lit("")))

    def edit(seq, at, drop, put):
        return F.struct(F.lit(seq).alias("seq"), F.floor(at).cast("int").alias("at"), F.lit(drop).alias("drop"), put.alias("put"))

    note = F.concat(F.lit(" ["), F.coalesce("source", F.lit("")), F.lit("'s copy]\n"))
    return documents.select("doc_id", F.inline(F.array(
        edit(1, n / 4, 7, F.lit("")), edit(2, n / 2, 0, note), edit(3, 3 * n / 4, 1, F.lit("É ")))))


def query(documents: DataFrame, path: str) -> DataFrame:
    documents = without(documents, RESULTS)
    trees = Kept(documents.sparkSession).keep(build_trees(documents, path), "trees")
    return count_after_edits(documents, trees, sample_edits(documents), path).select(
        "doc_id", "n_tokens", "n_edits", "n_tokens_after", "bytes_encoded")
