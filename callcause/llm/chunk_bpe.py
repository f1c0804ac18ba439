"""BPE with reuse of content-defined chunks.

A rolling hash cuts texts where their content says so, so a passage that many
documents share is cut into the same chunks in all of them. Documents with
chunks in common are brought together, and each distinct chunk is encoded once.
At a join of two chunks the tokens may differ from those of the whole text: the
stretch around it is encoded again, from a boundary left of the join that cannot
depend on it, until a boundary falls on one of the right chunk; from there on
both agree. A stretch that does not agree is widened, at last to the whole text.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from callcause.llm import hashing
from callcause.llm.common import doc_batches, lists, map_batches, steps
from callcause.llm.hashing import expand
from callcause.llm.pretokens import Vocabulary, pretoken_starts, vocabulary, without_rows

# Bytes that the rolling hash sees, and mean distance of cuts; a cut within LEAST bytes after another is dropped.
ROLLING, MEAN, LEAST = 16, 512, 96
# Pre-tokens of the left chunk that are encoded again, and of the right chunk in the first and the second attempt.
BACK, AHEAD = 2, (4, 24)
# Pre-tokens of chunks that are remembered at most, in one task.
REMEMBERED = 1_000_000
# Bytes of text that go through the array steps at once; a longer text is a step of its own.
STEP = 250_000
RESULTS = ("ids",)


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the chunks of texts end to end: those of the texts, and content-defined cuts at character borders."""
    first = offsets[:-1][offsets[1:] > offsets[:-1]]
    if len(data) <= ROLLING:
        return first
    hashes = hashing.fixed_ranges(hashing.byte_prefix(data), ROLLING)
    cuts = np.flatnonzero((hashes >> np.uint64(20)) % np.uint64(MEAN) == 0) + ROLLING
    if len(cuts):  # the rolling window must lie inside one text, and the cut too
        doc = hashing.doc_of(offsets, cuts - 1)
        cuts = cuts[(cuts - ROLLING >= offsets[doc]) & (cuts < offsets[doc + 1])]
    for _ in range(3):
        inside = (data[cuts] & 0xC0) == 0x80
        cuts = np.where(inside & (cuts + 1 < len(data)), cuts + 1, cuts)
    cuts = np.setdiff1d(cuts, first)
    if len(cuts):
        cuts = cuts[np.concatenate([[True], np.diff(cuts) >= LEAST])]
    return np.union1d(first, cuts)


class Chunks:
    """Chunks that were encoded before, as lists of pre-tokens and where these start."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.slots = self.places = np.zeros(0, np.int64)
        self.starts = self.counts = np.zeros(0, np.int64)
        # The bytes of the chunks themselves: a chunk is known if they agree, not only the hash.
        self.bytes, self.used = np.zeros(1 << 16, np.uint8), 0
        self.byte_starts = self.sizes = np.zeros(0, np.int64)
        self.encoded = self.asked = 0

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """The numbers of chunks; those that are new are encoded, each once."""
        hashes = hashing.ranges(sums, starts, ends)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        number = np.array([self.known.get(h, -1) for h in distinct.tolist()], np.int64)
        self.asked += len(starts)
        new = np.flatnonzero(number < 0)
        number[new] = self._add(data, starts[first[new]], ends[first[new]])
        self.known.update(zip(distinct[new].tolist(), number[new].tolist()))
        found, sizes = number[which], ends - starts
        alike = sizes == self.sizes[found]
        alike[alike] = hashing.same_bytes(data, starts[alike], sizes[alike], self.bytes, self.byte_starts[found[alike]])
        other = np.flatnonzero(~alike)
        found[other] = self._add(data, starts[other], ends[other])
        return found

    def _add(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Encode chunks; their numbers."""
        self.encoded += len(starts)
        first = len(self.starts)
        if not len(starts):
            return np.zeros(0, np.int64)
        sizes = ends - starts
        joined = data[expand(starts, sizes)]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        places = pretoken_starts(joined, offsets)
        slots = self.vocab.slots_of(joined, places, len(joined))
        bounds = np.searchsorted(places, offsets)
        places = places - np.repeat(offsets[:-1], np.diff(bounds))
        self.starts = np.concatenate([self.starts, len(self.slots) + bounds[:-1]])
        self.counts = np.concatenate([self.counts, np.diff(bounds)])
        self.slots = np.concatenate([self.slots, slots])
        self.places = np.concatenate([self.places, places])
        if self.used + len(joined) > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros(max(len(self.bytes), len(joined)), np.uint8)])
        self.bytes[self.used:self.used + len(joined)] = joined
        self.byte_starts = np.concatenate([self.byte_starts, self.used + offsets[:-1]])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.used += len(joined)
        return first + np.arange(len(starts))

    def _joins(self, data, starts, chunk, left, ahead: int):
        """Encode the stretch around each join of chunk ``left`` with the next one.

        Gives the pre-tokens of each stretch up to the boundary it shares with the right
        chunk: their slots, bounds, and that boundary's index in the right chunk (-1: none).
        """
        right = left + 1
        counts, first = self.counts[chunk], self.starts[chunk]
        begin = starts[left] + self.places[first[left] + counts[left] - BACK]
        last = first[right] + np.minimum(ahead + 2, counts[right] - 1)
        # The stretch ends where a pre-token of the right chunk begins, or with that chunk.
        whole = counts[right] <= ahead + 2
        end = np.where(whole, self._ends(starts, len(data))[right], starts[right] + self.places[last])
        sizes = end - begin
        joined = data[expand(begin, sizes)]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        places = pretoken_starts(joined, offsets)
        slots = self.vocab.slots_of(joined, places, len(joined))
        bounds = np.searchsorted(places, offsets)
        join = np.repeat(np.arange(len(left)), np.diff(bounds))
        absolute = places - offsets[join] + begin[join]
        # Boundaries 1..ahead of the right chunk, as far as two pre-tokens of the chunk follow them.
        usable = np.maximum(np.minimum(ahead, counts[right] - 2), 0)
        owner = np.repeat(np.arange(len(left)), usable)
        index = expand(np.ones(len(left), np.int64), usable)
        wanted = starts[right][owner] + self.places[first[right][owner] + index]
        span = np.int64(len(data) + 1)
        produced = join * span + absolute
        at = np.searchsorted(produced, owner * span + wanted)
        hit = (at < len(produced)) & (produced[np.minimum(at, len(produced) - 1)] == owner * span + wanted)
        agreed = np.full(len(left), -1, np.int64)
        length = np.zeros(len(left), np.int64)
        if hit.any():
            hits = np.flatnonzero(hit)[::-1]  # the first agreement of each join is written last
            agreed[owner[hits]] = index[hits]
            length[owner[hits]] = at[hits] - bounds[owner[hits]]
        return slots, bounds[:-1], length, agreed

    @staticmethod
    def _ends(starts: np.ndarray, size: int) -> np.ndarray:
        return np.append(starts[1:], size)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts end to end and how many each has; the same as without chunks."""
        if self.vocab.full or len(self.slots) > REMEMBERED:
            self.vocab.clear()
            self.clear()
        slow = self.vocab.slow_rows(data, offsets)
        quick, quick_offsets, rows = without_rows(data, offsets, slow)
        ids, counts = self._encode_quick(quick, quick_offsets)
        return self.vocab.put_back(data, offsets, slow, rows, ids, counts)

    def _encode_quick(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        starts = chunk_starts(data, offsets)
        chunk = self.look_up(data, starts, self._ends(starts, len(data)), hashing.byte_prefix(data))
        doc = hashing.doc_of(offsets, starts)
        counts = self.counts[chunk]
        left = np.flatnonzero(doc[1:] == doc[:-1])
        low, high = np.zeros(len(chunk), np.int64), counts.copy()
        agreed = np.full(len(left), -1, np.int64)
        stretch_from, stretch_size = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
        pool = [self.slots]
        base = len(self.slots)
        for ahead in AHEAD:
            todo = np.flatnonzero((agreed < 0) & (counts[left] > BACK))
            if not len(todo):
                break
            slots, begin, size, found = self._joins(data, starts, chunk, left[todo], ahead)
            agreed[todo], stretch_size[todo], stretch_from[todo] = found, size, begin + base
            pool.append(slots)
            base += len(slots)
        high[left] = counts[left] - BACK
        low[left + 1] = np.maximum(agreed, 0)
        # What could not be repaired, or has repairs that overlap, is encoded as a whole.
        failed = np.unique(np.concatenate([doc[left[agreed < 0]], doc[np.flatnonzero(low > high)]]))
        bounds = np.searchsorted(doc, failed), np.searchsorted(doc, failed, "right")
        stays = np.ones(len(chunk), bool)
        for a, b in zip(*bounds):
            stays[a:b] = False
        sizes = offsets[failed + 1] - offsets[failed]
        again = data[expand(offsets[failed], sizes)]
        again_offsets = np.concatenate([[0], np.cumsum(sizes)])
        places = pretoken_starts(again, again_offsets)
        pool.append(self.vocab.slots_of(again, places, len(again)))
        whole = np.searchsorted(places, again_offsets)
        # In order of place: chunks, the stretches between them, and texts encoded as a whole.
        pieces = [(doc[stays], starts[stays] * 2, self.starts[chunk[stays]] + low[stays], (high - low)[stays])]
        kept = stays[left]
        pieces.append((doc[left[kept]], starts[left[kept]] * 2 + 1, stretch_from[kept], stretch_size[kept]))
        pieces.append((failed, offsets[failed] * 2, base + whole[:-1], np.diff(whole)))
        of, order, begin, size = (np.concatenate(x) for x in zip(*pieces))
        by_place = np.argsort(order, kind="stable")
        of, begin, size = of[by_place], begin[by_place], size[by_place]
        slots = np.concatenate(pool)[expand(begin, size)]
        in_doc = np.bincount(of, size, len(offsets) - 1).astype(np.int64)
        totals = np.concatenate([[0], np.cumsum(self.vocab.counts[slots])])
        return self.vocab.ids_of(slots), np.diff(totals[np.concatenate([[0], np.cumsum(in_doc)])])


def _sketch(batch: pa.RecordBatch, text: str) -> dict[str, pa.Array]:
    """The least hash of a text's chunks: texts that share most chunks mostly share it."""
    found = []
    for data, offsets, _, _ in doc_batches(batch.column(text), STEP):
        least = np.zeros(len(offsets) - 1, np.uint64)
        starts = chunk_starts(data, offsets)
        if len(starts):
            hashes = hashing.ranges(hashing.byte_prefix(data), starts, np.append(starts[1:], len(data)))
            doc = hashing.doc_of(offsets, starts)
            heads = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            least[doc[heads]] = np.minimum.reduceat(hashes, heads)
        found.append(least.view(np.int64))
    return {"_sketch": pa.array(np.concatenate(found))}


def encode(docs: DataFrame, path: str, text: str = "text", together: bool = True,
           keep: Sequence[str] | None = None) -> DataFrame:
    """All rows and columns with ids, the tokenizers library's encoding without special tokens added.

    A null or empty text has no ids. ``together`` first deals the rows by their
    sketch, so that shared chunks meet in one task; partitions that get too many
    rows are split again by the engine. ``keep`` names the columns that stay
    (None: all). A text of another type comes out as a string, and an input
    column named ids gives way.
    """
    keep = [c for c in docs.columns if c not in RESULTS and (keep is None or c in keep)]
    read = docs.select(*[F.col(c).cast("string").alias(c) if c == text else F.col(c) for c in {**dict.fromkeys(keep), text: None}])
    if together:
        sketched = map_batches(read, lambda batch: _sketch(batch, text), [T.StructField("_sketch", T.LongType())])
        read = sketched.hint("rebalance", "_sketch").drop("_sketch")

    def work_of(batches):
        chunks = Chunks(vocabulary(path))
        for batch in batches:
            if batch.num_rows:
                parts = [chunks.encode(data, offsets) for data, offsets, _, _ in doc_batches(batch.column(text), STEP)]
                ids = lists(np.concatenate([p[0] for p in parts]).view(np.int32), np.concatenate([p[1] for p in parts]), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + [ids], keep + ["ids"])

    fields = [f for f in read.schema.fields if f.name in keep]
    return read.mapInArrow(work_of, T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All rows and columns with the text of their ids, special tokens included; null ids give an empty text."""
    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        column = batch.column(ids).cast(pa.large_list(pa.int32()))
        sizes = column.value_lengths().fill_null(0).to_numpy()
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        numbers, found = column.flatten().to_numpy(), []
        for low, high in steps(offsets, 200_000):
            here = offsets[low:high + 1]
            data, ends = vocabulary(path).decode(numbers[here[0]:here[-1]], here - here[0])
            raw = data.tobytes()
            found += [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]
        return {out: pa.array(found, pa.string())}

    return map_batches(docs, work, [T.StructField(out, T.StringType())])


def query(documents: DataFrame, path: str) -> DataFrame:
    coded = decode(encode(documents.select("doc_id", "text"), path, keep=("doc_id",)), path)
    joined = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
