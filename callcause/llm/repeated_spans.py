"""Removal of repeated 100-byte strings, by a depth-limited radix sort of suffixes.

Only whether suffixes agree on their first LENGTH bytes matters, so they are
sorted to that depth, one digit after another, most significant first. Groups
that a digit leaves with one member hold no repeat and go no further; groups
left after the last digit are exactly the repeated strings.

Digit 1 is the anchor: of all GRAM-byte grams in a window, the leftmost of least
hash. It depends on the window's bytes alone, so equal windows have equal
anchors, and about 35 neighbouring windows share one: the first pass deals runs
of windows, not single ones. Digit 2 is the run's whole stretch of bytes; runs
equal in it repeat entirely. Digit 3 is the whole window, and is looked at only
for runs that agree in digit 1 and differ in digit 2: the ends of repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from callcause.llm import hashing
from callcause.llm.common import Kept, doc_batches, map_batches, release, texts, without

LENGTH = 100
GRAM = 24
# Runs that share an anchor are compared in one task up to this number, beyond it in a shuffle of their windows.
GROUP_RUNS = 20_000
RESULTS = ("n_bytes", "n_removed", "n_spans", "removed", "kept_sha256")
_STEP = 1_000_000
_PLACE = np.uint64((1 << 24) - 1)
_FULL = np.uint64(2**64 - 1)


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, _FULL)
    padded[:n] = values
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def window_runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows of one anchor: first and last window, anchor, its hash, hash of the stretch."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if len(data) < length:
        return none
    sums = hashing.byte_prefix(data)
    grams = hashing.fixed_ranges(sums, gram)
    anchors = np.empty(len(data) - length + 1, np.int64)
    for low in range(0, len(anchors), 1 << 23):  # places must fit into the low bits
        high = min(low + (1 << 23), len(anchors))
        part = grams[low:high + length - gram]
        ranked = (part & ~_PLACE) | np.arange(len(part), dtype=np.uint64)
        anchors[low:high] = low + (_window_min(ranked, length - gram + 1) & _PLACE).astype(np.int64)
    edge = np.zeros(len(anchors) + 1, np.int64)
    first, last = offsets[:-1], offsets[1:] - length + 1
    long = last > first
    np.add.at(edge, first[long], 1)
    np.add.at(edge, last[long], -1)
    windows = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    if not len(windows):
        return none
    chosen = anchors[windows]
    starts = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (windows[1:] != windows[:-1] + 1)]))
    low, high = windows[starts], windows[np.append(starts[1:], len(windows)) - 1]
    anchor = chosen[starts]
    stretch = hashing.ranges(sums, low, high + length)
    stretch = hashing.mix(stretch ^ hashing.mix((anchor - low).astype(np.uint64) + np.uint64(1)))
    return low, high, anchor, grams[anchor], stretch


def _runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """One row per run: key (anchor), f (stretch), document, and packed first window, number of windows, anchor."""
    def run(batches):
        for batch in batches:
            ids, subs = batch.column("_id"), batch.column("_sub")
            for data, offsets, row, _ in doc_batches(batch.column("text"), _STEP):
                low, high, anchor, key, f = window_runs(data, offsets, length, gram)
                if len(low):
                    doc = hashing.doc_of(offsets, low)
                    at = ((low - offsets[doc]) << 16) | ((high - low) << 8) | (anchor - low)
                    rows = pa.array(doc + row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((key >> np.uint64(16)).view(np.int64)), pa.array(f.view(np.int64)), ids.take(rows),
                         subs.take(rows), pa.array(at)], ["key", "f", "_id", "_sub", "at"])

    return docs.mapInArrow(run, "key long, f long, _id long, _sub long, at long")


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _first_two_digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, f and place: runs that repeat an earlier one (repeat true), and the first
    runs of their stretch whose anchor has other stretches too (repeat false). Single runs go."""
    held = None  # the last first-of-its-stretch seen, not yet known to have company
    last_key = last_f = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        key, f = _column(batch, "key"), _column(batch, "f")
        new_key = np.concatenate([[last_key is None or key[0] != last_key], key[1:] != key[:-1]])
        new_f = new_key | np.concatenate([[last_f is None or f[0] != last_f], f[1:] != f[:-1]])
        last_key, last_f = key[-1], f[-1]
        firsts = np.flatnonzero(new_f)
        company = ~new_key[firsts]  # an earlier stretch of the same anchor
        company[:-1] |= ~new_key[firsts[1:]]  # or a later one
        out = []
        if held is not None and len(firsts):
            if not new_key[firsts[0]]:
                out.append(held)
            held = None
        chosen = firsts[company]
        if len(firsts) and not company[-1]:
            held = _flagged(batch, firsts[-1:], False)
        elif len(firsts):
            held = None
        out.append(_flagged(batch, chosen, False))
        out.append(_flagged(batch, np.flatnonzero(~new_f), True))
        yield from (b for b in out if b.num_rows)


def _flagged(batch: pa.RecordBatch, rows: np.ndarray, repeat: bool) -> pa.RecordBatch:
    part = batch.take(pa.array(rows))
    return pa.RecordBatch.from_arrays(
        [part.column(n) for n in ("key", "_id", "_sub", "at")] + [pa.array(np.full(len(rows), repeat))],
        ["key", "_id", "_sub", "at", "repeat"])


def _window_hashes(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For rows with the bytes of their stretch: row, first byte in the document, offset to the anchor, hash of each window."""
    data, offsets = texts(batch.column("bytes"))
    at = _column(batch, "at")
    counts = ((at >> 8) & 255) + 1
    row = np.repeat(np.arange(batch.num_rows), counts)
    step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[row] + step
    sums = hashing.byte_prefix(data)
    return row, (at >> 16)[row] + step, (at & 255)[row] - step, hashing.ranges(sums, start, start + length)


def _third_digit(length: int):
    """Of rows sorted by key and place: the windows that repeat one of an earlier run, as byte ranges."""
    def settle(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, place, offset, window = _window_hashes(batch, length)
        key = _column(batch, "key").view(np.uint64)[row]
        group = hashing.mix(window ^ hashing.mix(key * np.uint64(128) + offset.astype(np.uint64)))
        order = np.lexsort((row, group))
        repeats = order[1:][group[order[1:]] == group[order[:-1]]]
        repeats = np.sort(repeats)
        return _ranges(batch, row[repeats], place[repeats], length)

    def run(batches):
        rest = None
        for batch in batches:
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            key = _column(batch, "key")
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last key may go on
            if cut:
                yield settle(batch.slice(0, cut))
            rest = batch.slice(cut)
        if rest is not None and rest.num_rows:
            yield settle(rest)

    return run


def _ranges(batch: pa.RecordBatch, row: np.ndarray, place: np.ndarray, length: int) -> pa.RecordBatch:
    """Neighbouring windows of one row as one byte range."""
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
    starts = np.flatnonzero(fresh)
    ends = np.append(starts[1:], len(row)) - 1 if len(row) else starts
    part = pa.array(row[starts])
    return pa.RecordBatch.from_arrays(
        [batch.column("_id").take(part), batch.column("_sub").take(part), pa.array(place[starts]),
         pa.array(place[ends] + length)], ["_id", "_sub", "begin", "end"])


_RANGE = "_id long, _sub long, begin long, end long"


def _stretches(docs: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """Runs with the bytes of their stretch, from the texts of their documents."""
    lists = runs.groupBy("_id", "_sub").agg(F.collect_list(F.struct("key", "at")).alias("_runs"))
    joined = docs.join(lists.select(F.col("_id").alias("_i"), F.col("_sub").alias("_s"), "_runs"),
                       docs["_id"].eqNullSafe(F.col("_i")) & (docs["_sub"] == F.col("_s")))
    # Rows equal in id and text would bring their runs twice.
    joined = joined.select("_id", "_sub", "text", "_runs")

    def run(batches):
        for batch in batches:
            data, offsets = texts(batch.column("text"))
            found = batch.column("_runs")
            owner = np.repeat(np.arange(batch.num_rows), np.diff(found.offsets.to_numpy()))
            values = found.flatten()
            key, at = values.field("key"), values.field("at").to_numpy(zero_copy_only=False)
            begin = offsets[owner] + (at >> 16)
            size = ((at >> 8) & 255) + length
            bounds = np.concatenate([[0], np.cumsum(size)])
            picks = np.arange(bounds[-1]) - np.repeat(bounds[:-1], size) + np.repeat(begin, size)
            stretch = pa.Array.from_buffers(pa.binary(), len(at), [
                None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[picks]))])
            rows = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [key, batch.column("_id").take(rows), batch.column("_sub").take(rows), pa.array(at), stretch],
                ["key", "_id", "_sub", "at", "bytes"])

    return joined.mapInArrow(run, "key long, _id long, _sub long, at long, bytes binary")


def _shuffled_third_digit(runs: DataFrame, length: int) -> DataFrame:
    """The same as ``_third_digit`` for anchors of very many runs: their windows meet in an aggregate."""
    def run(batches):
        for batch in batches:
            row, place, offset, window = _window_hashes(batch, length)
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(rows), batch.column("_id").take(rows), batch.column("_sub").take(rows),
                 pa.array(window.view(np.int64)), pa.array(offset), pa.array(place)],
                ["key", "_id", "_sub", "window", "shift", "place"])

    windows = runs.mapInArrow(run, "key long, _id long, _sub long, window long, shift long, place long")
    who = F.struct("_id", "_sub", "place")
    first = windows.groupBy("key", "window", "shift").agg(F.min(who).alias("first"), F.count(F.lit(1)).alias("n"))
    return (windows.join(first.filter("n > 1").drop("n"), ["key", "window", "shift"]).filter(who != F.col("first"))
            .select("_id", "_sub", F.col("place").alias("begin"), (F.col("place") + length).alias("end")))


def _cut(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    """Merge a document's ranges and digest what is left of it."""
    data, offsets = texts(batch.column("text"))
    found = batch.column("_ranges").to_pylist()
    removed, digests, n_removed = [], [], []
    for i, ranges in enumerate(found):
        text = data[offsets[i]:offsets[i + 1]]
        spans: list[list[int]] = []
        for packed in sorted(ranges or ()):
            begin, end = packed >> 32, packed & 0xFFFFFFFF
            if spans and begin <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], end)
            else:
                spans.append([begin, end])
        digest, at = hashlib.sha256(), 0
        for begin, end in spans:
            digest.update(text[at:begin])
            at = end
        digest.update(text[at:])
        removed.append([x for span in spans for x in span])
        n_removed.append(sum(end - begin for begin, end in spans))
        digests.append(digest.hexdigest())
    return {"n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(n_removed, pa.int64()),
            "n_spans": pa.array([len(r) // 2 for r in removed], pa.int64()),
            "removed": pa.array(removed, pa.list_(pa.int64())), "kept_sha256": pa.array(digests, pa.string())}


def find_repeats(docs: DataFrame, text: str = "text", id_column: str = "doc_id", length: int = LENGTH,
                 gram: int = GRAM, group_runs: int = GROUP_RUNS) -> DataFrame:
    """Every row's id with n_bytes, n_removed, n_spans, removed (byte ranges, end to end) and kept_sha256.

    A byte is removed if a string of ``length`` bytes that covers it also starts
    earlier: in a document of smaller id, or further left in the same one. A
    null text is empty; a null id is smaller than any other. Rows that repeat an
    id are ordered by the hash of their text, and rows equal in id and text are
    one document: they get the same answer. Texts are below 4 GB.
    """
    if not gram <= length <= gram + 200:
        raise ValueError("length must be at least gram and at most gram + 200")
    spark = docs.sparkSession
    kept = Kept(spark)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    ids = docs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col(id_column)).alias("d")).first()
    # The text's hash is only carried along when ids alone do not tell documents apart.
    sub = F.lit(0).cast("long") if ids["n"] == ids["d"] else F.xxhash64(whole)
    source = docs.select(F.col(id_column).cast("long").alias("_id"), sub.alias("_sub"), whole.alias("text"))
    once = source if ids["n"] == ids["d"] else source.dropDuplicates(["_id", "_sub"])

    digits = _runs(once, length, gram).repartition("key").sortWithinPartitions("key", "f", "_id", "_sub", "at")
    found = kept.keep(digits.mapInArrow(
        _first_two_digits, "key long, _id long, _sub long, at long, repeat boolean"), "digits")
    del digits
    release(spark)
    open_ = found.filter("not repeat")
    hot = kept.keep(open_.groupBy("key").count().filter(F.col("count") > group_runs).select("key"), "hot")
    stretches = kept.keep(_stretches(once, open_.select("key", "_id", "_sub", "at"), length), "stretches")
    release(spark)
    few = stretches.join(hot, "key", "left_anti").repartition("key").sortWithinPartitions("key", "_id", "_sub", "at")
    ends = few.mapInArrow(_third_digit(length), _RANGE).unionByName(
        _shuffled_third_digit(stretches.join(hot, "key", "left_semi"), length))
    begin = F.shiftright("at", 16)
    entire = found.filter("repeat").select(
        "_id", "_sub", begin.alias("begin"), (begin + F.shiftright("at", 8).bitwiseAND(F.lit(255)) + length).alias("end"))
    packed = F.shiftleft("begin", 32).bitwiseOR(F.col("end")).alias("range")
    per_doc = kept.keep(entire.unionByName(ends).select("_id", "_sub", packed)
                        .groupBy("_id", "_sub").agg(F.collect_list("range").alias("_ranges")), "ranges")
    kept.drop(found, stretches)
    release(spark)
    joined = source.join(per_doc.select(F.col("_id").alias("_i"), F.col("_sub").alias("_s"), "_ranges"),
                         source["_id"].eqNullSafe(F.col("_i")) & (source["_sub"] == F.col("_s")), "left")
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
              T.StructField("n_spans", T.LongType()), T.StructField("removed", T.ArrayType(T.LongType())),
              T.StructField("kept_sha256", T.StringType())]
    return map_batches(joined.select(F.col("_id").alias(id_column), "text", "_ranges"), _cut, fields, keep=(id_column,))


def query(documents: DataFrame) -> DataFrame:
    found = find_repeats(without(documents, RESULTS))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
