"""Benchmark passages in documents, by a prefix-filtered join of word shingles.

Every window of a benchmark item is a set of shingles that must be contained
whole, so one shingle of it is a sufficient prefix: its rarest one in the
corpus. Documents meet windows on that shingle only; the shingle's place and the
lengths bound where the window can lie, and what is left is compared word by word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from callcause.llm import hashing
from callcause.llm.common import Kept, doc_batches, lists, map_batches, texts, without

WINDOW = 13
SHINGLE = 3
# Windows that are broadcast at once, about 200 bytes each; more are joined block by block.
BLOCK_WINDOWS = 200_000
RESULTS = ("n_words", "n_hit", "n_items", "items", "hit_ranges", "contaminated")

# Words are runs of 0-9, a-z and all bytes beyond ASCII, after lower-casing A-Z.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[0x30:0x3A] = WORD_BYTES[0x61:0x7B] = WORD_BYTES[0x80:] = True


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def windows_of(benchmark: DataFrame, text: str = "text", id_column: str = "item_id", window: int = WINDOW) -> DataFrame:
    """One row per window: item, word hashes. Items of fewer words are one window; without words, none."""
    def run(batches):
        for batch in batches:
            ids, column = batch.column(0).to_pylist(), batch.column(1)
            data, offsets = texts(column)
            words = hashing.Words(data, offsets, WORD_BYTES)
            items, rows = [], []
            for i, (low, high) in enumerate(zip(words.offsets[:-1], words.offsets[1:])):
                for start in range(low, max(high - window, low) + 1) if high > low else ():
                    items.append(ids[i])
                    rows.append(_signed(words.hashes[start:min(start + window, high)]))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(items, pa.int64()),
                     lists(np.concatenate(rows), np.array([len(r) for r in rows]), pa.int64())], ["item", "words"])

    return benchmark.select(F.col(id_column).cast("long"), F.col(text).cast("string")).mapInArrow(
        run, "item long, words array<long>").dropDuplicates()


class Index:
    """A block of windows, found by their prefix shingle."""

    def __init__(self, items: list, words: list[np.ndarray]):
        self.items = np.array([-1 if i is None else i for i in items], np.int64)
        self.no_item = np.array([i is None for i in items], bool)
        self.sizes = np.array([len(w) for w in words])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.words = np.concatenate(words).view(np.uint64)
        spans = np.minimum(self.sizes, SHINGLE)
        sums = hashing.prime_prefix(self.words)
        counts = self.sizes - spans + 1
        self.owner = np.repeat(np.arange(len(words)), counts)
        self.place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        first = self.starts[self.owner] + self.place
        self.shingles = hashing.prime_ranges(sums, first, first + spans[self.owner])
        self.span = spans[self.owner]
        self.spans = sorted(set(spans.tolist()))

    def known(self) -> dict[int, np.ndarray]:
        """The distinct shingles by their number of words."""
        return {s: np.unique(self.shingles[self.span == s]) for s in self.spans}

    def choose(self, frequency: dict[int, int]) -> None:
        """Make each window's rarest shingle its prefix; of equally rare ones the smaller hash."""
        seen = np.array([frequency.get(int(h), 0) for h in _signed(self.shingles)], np.int64)
        order = np.lexsort((self.place, self.shingles, seen, self.owner))
        heads = order[np.concatenate([[True], np.diff(self.owner[order]) > 0])]
        self.prefix = {}
        for s in self.spans:
            mine = heads[self.span[heads] == s]
            mine = mine[np.argsort(self.shingles[mine], kind="stable")]
            keys, at = np.unique(self.shingles[mine], return_index=True)
            self.prefix[s] = (keys, np.append(at, len(mine)), self.owner[mine], self.place[mine])


class Lookup:
    """Positions of sorted hashes in a batch; a bit table turns most away at once."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - 22)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[keys >> self.shift] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the hashes that are keys, and which key each is."""
        maybe = np.flatnonzero(self.bits[hashes >> self.shift])
        at = np.searchsorted(self.keys, hashes[maybe])
        at[at == len(self.keys)] = 0
        same = self.keys[at] == hashes[maybe] if len(self.keys) else np.zeros(0, bool)
        return maybe[same], at[same]


def _count_shingles(docs: DataFrame, text: str, known: dict[int, np.ndarray]) -> DataFrame:
    """In how many places of the corpus each known shingle stands."""
    def run(batches):
        lookups = {s: Lookup(keys) for s, keys in known.items()}
        counts = {s: np.zeros(len(keys), np.int64) for s, keys in known.items()}
        for batch in batches:
            for data, offsets, _, _ in doc_batches(batch.column(0)):
                words = hashing.Words(data, offsets, WORD_BYTES)
                for s, lookup in lookups.items():
                    _, which = lookup.find(words.runs(s)[1])
                    counts[s] += np.bincount(which, minlength=len(lookup.keys))
        for s, keys in known.items():
            seen = counts[s] > 0
            yield pa.RecordBatch.from_arrays([pa.array(_signed(keys[seen])), pa.array(counts[s][seen])], ["shingle", "n"])

    found = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "shingle long, n long")
    return found.groupBy("shingle").agg(F.sum("n").alias("n"))


def hits(words: hashing.Words, index: Index, lookups: dict[int, Lookup]) -> tuple[np.ndarray, np.ndarray]:
    """First word and window of every occurrence of a window inside one text."""
    found = []
    for s, lookup in lookups.items():
        _, bounds, owner, place = index.prefix[s]
        first, hashes = words.runs(s)
        at, which = lookup.find(hashes)
        entries = hashing.expand(bounds[which], bounds[which + 1] - bounds[which])
        position = np.repeat(first[at], bounds[which + 1] - bounds[which])
        window = owner[entries]
        start = position - place[entries]
        doc = hashing.doc_of(words.offsets, position)
        fits = (start >= words.offsets[doc]) & (start + index.sizes[window] <= words.offsets[doc + 1])
        start, window = start[fits], window[fits]
        for step in range(int(index.sizes.max())):  # word by word; what differs goes
            here = index.sizes[window] > step
            equal = np.ones(len(window), bool)
            equal[here] = words.hashes[start[here] + step] == index.words[index.starts[window[here]] + step]
            start, window = start[equal], window[equal]
        found.append((start, window))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _search(docs: DataFrame, text: str, index: Index, again: bool) -> DataFrame:
    """Add n_words, hit_ranges (word ranges, ends exclusive, end to end) and items; ``again`` joins those of earlier blocks."""
    fields = [T.StructField("n_words", T.LongType()), T.StructField("hit_ranges", T.ArrayType(T.IntegerType())),
              T.StructField("items", T.ArrayType(T.LongType()))]

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        lookups = {s: Lookup(index.prefix[s][0]) for s in index.spans}
        n_words, ranges_, items = [], [], []
        before = (batch.column("hit_ranges").to_pylist(), batch.column("items").to_pylist()) if again else None
        for data, offsets, low, high in doc_batches(batch.column(text)):
            words = hashing.Words(data, offsets, WORD_BYTES)
            start, window = hits(words, index, lookups)
            doc = hashing.doc_of(words.offsets, start)
            n_words.append(np.diff(words.offsets))
            by_doc = np.argsort(doc, kind="stable")
            cuts = np.searchsorted(doc[by_doc], np.arange(high - low + 1))
            for i in range(high - low):
                mine = by_doc[cuts[i]:cuts[i + 1]]
                old_ranges, old_items = (before[0][low + i], before[1][low + i]) if again else ((), ())
                if not len(mine):
                    ranges_.append(list(old_ranges))
                    items.append(list(old_items))
                    continue
                begins = start[mine] - words.offsets[i]
                ends = begins + index.sizes[window[mine]]
                begins = np.concatenate([begins, np.array(old_ranges[0::2], np.int64)])
                ends = np.concatenate([ends, np.array(old_ranges[1::2], np.int64)])
                ranges_.append(merge_ranges(begins, ends))
                named = window[mine][~index.no_item[window[mine]]]
                items.append(sorted({*old_items, *index.items[named].tolist()}))
        return {"n_words": pa.array(np.concatenate(n_words)), "hit_ranges": pa.array(ranges_, pa.list_(pa.int32())),
                "items": pa.array(items, pa.list_(pa.int64()))}

    return map_batches(docs, work, fields)


def merge_ranges(begins: np.ndarray, ends: np.ndarray) -> list[int]:
    """Touching or overlapping ranges made one, as begin, end, begin, end, ..."""
    order = np.argsort(begins, kind="stable")
    begins, reach = begins[order], np.maximum.accumulate(ends[order])
    fresh = np.concatenate([[True], begins[1:] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(fresh)[1:] - 1, [len(begins) - 1]])
    return np.column_stack([begins[fresh], reach[last]]).ravel().tolist()


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_column: str = "item_id",
                       item_text: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Every row with n_words, n_hit, hit_ranges, items, n_items and contaminated (at least one word in twenty hit).

    A null or empty text has no words and is clean. Windows of an item without
    an id hit words but name no item. An empty benchmark leaves all rows clean.
    Rows that repeat are judged one by one. Input columns of the result's names
    give way to them.
    """
    kept = Kept(docs.sparkSession)
    docs = without(docs, RESULTS)
    windows = kept.keep(windows_of(benchmark, item_text, item_column, window), "windows")
    blocks = max(1, -(-windows.count() // block_windows))
    windows = windows.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(blocks)))
    found, any_block = docs, False
    for block in range(blocks):
        rows = windows.filter(F.col("block") == block).select("item", "words").toArrow()  # about block_windows rows
        if not rows.num_rows:
            continue
        column = rows.column("words").combine_chunks()
        index = Index(rows.column("item").to_pylist(), [np.array(w.values, np.int64) for w in column])
        counted = _count_shingles(docs, text, index.known()).toArrow()  # at most the block's shingles
        index.choose(dict(zip(counted.column("shingle").to_pylist(), counted.column("n").to_pylist())))
        found, any_block = _search(found, text, index, any_block), True
    if not any_block:
        empty = Index([None], [np.array([0], np.int64)])
        empty.choose({})
        found = _search(found, text, empty, False)
    signed = F.transform("hit_ranges", lambda x, i: x * F.when(i % 2 == 0, -1).otherwise(1))
    n_hit = F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)
    return (found.withColumn("n_hit", n_hit.cast("long")).withColumn("n_items", F.size("items").cast("long"))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))))


def query(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_contamination(documents.select("doc_id", "text"), benchmark)
    names = F.concat_ws(",", F.array_sort(F.transform("items", lambda i: i.cast("string"))))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(names, 256).alias("items_sha256"), "contaminated")


# DuckDB: every run of words of each length that a window has, joined with the windows as text.
SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w
  from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w
  from benchmark),
win as (
  select distinct item_id, least(len(w), 13) as l, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') as t
  from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as s from b where len(w) > 0)),
lengths as (select distinct l from win),
runs as (
  select doc_id, s, l, array_to_string(w[s:s + l - 1], ' ') as t
  from (select doc_id, w, l, unnest(range(1, len(w) - l + 2)) as s from d, lengths where len(w) >= l)),
found as (select r.doc_id, r.s, r.l, win.item_id from runs r join win on r.l = win.l and r.t = win.t),
words_hit as (select doc_id, count(distinct p) as n_hit
  from (select doc_id, unnest(range(s, s + l)) as p from found) group by doc_id),
items as (
  select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as names
  from (select distinct doc_id, cast(item_id as varchar) as i from found) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join words_hit using (doc_id) left join items using (doc_id)
"""
