"""Jaccard join of shingle sets by T-occurrence search over inverted lists.

A set of n shingles reaches the threshold only with sets that hold at least
T = 85 % of its shingles. Its inverted lists are divided: the L longest stand
aside, the others are merged, and a document that stands in at least T - L of
them is looked up in the long ones by binary search (DivideSkip). What reaches
the exact overlap is a link.

Spark deals the sets to lists that fit a task, and loses no link by it. Of each
set the shingles of least hash are its prefix; two linked sets share several of
these. Shingles that only one prefix has drop out, and with them every set that
keeps too few. The lists of the rest are divided as well: two sets are gathered
if their short lists, and at most all their long ones, give as many common
prefix shingles as linked sets have; sets with that many long lists are gathered
by these. Small gatherings share a cell; a large one is dealt into cells by size
and number, and a few guests of each size stand in all cells around it. Last, sets
outside the largest component of a large gathering meet its cells in blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from callcause.llm import hashing
from callcause.llm.common import Kept, doc_batches, lists, map_batches, without
from callcause.llm.components import components
from callcause.llm.near_duplicates import WORD_BYTES, distinct_by_row

SHINGLE, PERCENT = 4, 85
# Shingles in a cell, and the rounds in which shingles and sets drop out.
CELL, ROUNDS = 400_000, 2
# Sets in the longest list whose pairs are counted one by one; longer lists stand aside.
SHORT = 12
# Weight of a binary search against a merged entry, by which DivideSkip picks the long lists.
PROBE = 0.01
RESULTS = ("n_shingles", "component_id")
# Linked sets differ less in size than the width of a band, so they lie in one band or in two adjoining ones.
_BAND = math.log(1 / 0.84)
_KEY = ("home", "band", "part")


def sets_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, end to end, and where each text's begin."""
    words = hashing.Words(data, offsets, WORD_BYTES)
    first, hashes = words.runs(SHINGLE)
    counts = np.diff(words.offsets)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    whole = hashing.prime_ranges(words.sums, words.offsets[short], words.offsets[short + 1])
    row = np.concatenate([hashing.doc_of(words.offsets, first), short])
    return distinct_by_row(row, np.concatenate([hashes, whole]), len(offsets) - 1)


def least_overlap(n):
    """Shingles that a set of n must share with any linked one."""
    return -(-PERCENT * n // 100)


def common(n):
    """Prefix shingles that two linked sets share, if both have at least n."""
    return 1 + n // 10


def prefix_size(n: np.ndarray) -> np.ndarray:
    return np.minimum(n - least_overlap(n) + common(n), n)


def _describe(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    found = []
    for data, offsets, _, _ in doc_batches(batch.column("text")):
        values, bounds = sets_of(data, offsets)
        n = np.diff(bounds)
        prints = [hashing.prime_ranges(hashing.prime_prefix(v), bounds[:-1], bounds[1:]).view(np.int64)
                  for v in (values, hashing.mix(values ^ np.uint64(0x5BD1E995)))]
        kept = prefix_size(n)
        found.append((n, *prints, values[hashing.expand(bounds[:-1], kept)].view(np.int64), kept))
    n, p, q, prefix, kept = (np.concatenate(x) for x in zip(*found))
    return {"n": pa.array(n), "_p": pa.array(p), "_q": pa.array(q), "_prefix": lists(prefix, kept, pa.int64())}


def _set_bytes(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    found = []
    for data, offsets, _, _ in doc_batches(batch.column("text")):
        values, bounds = sets_of(data, offsets)
        found += [values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
    return {"set": pa.array(found, pa.binary())}


class InvertedLists:
    """The documents of each shingle, for a few thousand sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        values = np.concatenate([*sets, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(values, kind="stable")
        values, self.owner = values[order], owner[order]
        heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
        self.shingles = values[heads]
        self.starts = np.append(heads, len(values))
        self.lengths = np.diff(self.starts)
        # List and document in one number, ascending: what binary searches look in.
        self.places = np.repeat(np.arange(len(heads)), self.lengths) * np.int64(len(sets) + 1) + self.owner

    def search(self, query: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        """The allowed documents that reach the threshold with a set."""
        n = len(query)
        need = least_overlap(n)
        at = np.searchsorted(self.shingles, query)
        at[at == len(self.shingles)] = 0
        at = at[self.shingles[at] == query] if len(self.shingles) else at[:0]
        if len(at) < need:
            return np.zeros(0, np.int64)
        fits = allowed & (100 * self.sizes >= PERCENT * n) & (PERCENT * self.sizes <= 100 * n)
        if not fits.any():
            return np.zeros(0, np.int64)
        at = at[np.argsort(self.lengths[at], kind="stable")]
        aside = min(int(need / (PROBE * math.log2(self.lengths[at[-1]] + 1) + 1)), need - 1)
        short, long = at[:len(at) - aside], at[len(at) - aside:]
        # The short lists, each ascending, are merged by one stable sort, which merges runs.
        merged = np.sort(self.owner[hashing.expand(self.starts[short], self.lengths[short])], kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]]))
        found, counts = merged[heads], np.diff(np.append(heads, len(merged)))
        enough = (counts >= need - aside) & fits[found]
        found, counts = found[enough], counts[enough]
        for low in range(0, len(found), 4_096):
            some = found[low:low + 4_096]
            wanted = (long * np.int64(len(self.sizes) + 1))[:, None] + some[None, :]
            place = np.minimum(np.searchsorted(self.places, wanted), len(self.places) - 1)
            counts[low:low + 4_096] += (self.places[place] == wanted).sum(axis=0)
        return found[100 * counts >= PERCENT * (n + self.sizes[found] - counts)]


class _Forest:
    """Components of the classes in one task."""

    def __init__(self, labels: np.ndarray):
        _, self.parent = np.unique(labels, return_inverse=True)
        self.node = self.parent.copy()
        self.parent = np.arange(self.node.max(initial=-1) + 1)
        self.weight = np.bincount(self.node, minlength=len(self.parent))

    def root(self, k: int) -> int:
        k = self.node[k]
        while self.parent[k] != k:
            self.parent[k] = k = self.parent[self.parent[k]]
        return int(k)

    def roots(self) -> np.ndarray:
        while True:
            above = self.parent[self.parent]
            if (above == self.parent).all():
                return self.parent[self.node]
            self.parent = above

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        a, b = (a, b) if self.weight[a] >= self.weight[b] else (b, a)
        self.parent[b] = a
        self.weight[a] += self.weight[b]
        return True


def links_within(ids: np.ndarray, sets: list[np.ndarray], labels: np.ndarray, is_query: np.ndarray,
                 is_member: np.ndarray) -> list[tuple[int, int]]:
    """Links that join components: each query is searched among the members of other components.

    Members that the largest component holds need no search while all others have theirs.
    """
    members = np.flatnonzero(is_member)
    index, forest, found = InvertedLists([sets[k] for k in members]), _Forest(labels), []
    pending = np.flatnonzero(is_query)
    while len(pending):
        roots = forest.roots()
        outside = pending[roots[pending] != int(np.argmax(np.bincount(roots)))]
        if not len(outside):
            break
        for k in outside[:max(16, len(outside) // 8)]:
            roots = forest.roots()
            for other in members[index.search(sets[k], roots[members] != roots[k])]:
                if forest.join(int(k), int(other)):
                    found.append((int(ids[k]), int(ids[other])))
        pending = np.setdiff1d(pending, outside[:max(16, len(outside) // 8)], assume_unique=True)
    return found


def _search(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("query", kind="stable").drop_duplicates(["c", "query", "member"])
    ids, sets = group["c"].to_numpy(), [np.frombuffer(s, np.uint64) for s in group["set"]]
    found = links_within(ids, sets, group["label"].to_numpy(), group["query"].to_numpy(), group["member"].to_numpy())
    return pd.DataFrame(found, columns=["u", "v"], dtype="int64")


def _content(docs: DataFrame, text: str, id_column: str) -> list[Column]:
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return [F.col(id_column).alias("_id"), F.xxhash64(whole, F.length(whole)).alias("_text")]


def _needed(n: Column) -> Column:
    """Prefix shingles that a set shares with any linked one, which may be smaller."""
    return F.lit(1) + F.floor(F.ceil(n * PERCENT / 100) / 10)


def _survivors(rows: DataFrame, kept: Kept) -> DataFrame:
    """(t, c, n) of the prefix shingles that several sets share, of the sets that keep enough of them."""
    for _ in range(ROUNDS):
        shared = rows.groupBy("t").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").select("t")
        several = kept.keep(rows.join(shared, "t"), "shared")
        enough = (several.groupBy("c").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n"))
                  .filter(F.col("k") >= _needed(F.col("n"))).select("c"))
        before, rows = rows, kept.keep(several.join(enough, "c"), "shared")
        kept.drop(several)
        if _:
            kept.drop(before)
    return rows


def _gathered(rows: DataFrame, kept: Kept) -> DataFrame:
    """(c, n, gathering): sets that may be linked come together, whatever chain leads from one to the other."""
    df = rows.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    counted = kept.keep(rows.join(df, "t"), "counted")
    sets = kept.keep(counted.groupBy("c").agg(F.max("n").alias("n"), F.count(F.when(F.col("df") > SHORT, 1)).alias("aside")), "sizes")
    # Short lists, merged: in how many of them two sets stand together.
    members = F.collect_list(F.struct("c", "n", "aside"))
    short = (counted.filter(F.col("df") <= SHORT).select("t", "c").join(sets, "c").groupBy("t").agg(members.alias("m"))
             .select("m", F.explode("m").alias("a")).select("a", F.explode("m").alias("b")).filter("a.c < b.c"))
    small, large = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    pairs = (short.filter(100 * small >= PERCENT * large).groupBy(F.col("a.c").alias("u"), F.col("b.c").alias("v"))
             .agg(F.count(F.lit(1)).alias("k"), F.max(small).alias("n"), F.max(F.least("a.aside", "b.aside")).alias("aside"))
             .filter(F.col("k") + F.col("aside") >= 1 + F.floor(F.col("n") / 10)).select("u", "v"))
    # Long lists join only sets that could be linked by long lists alone.
    order = F.struct(F.xxhash64("c"), F.col("c"))
    heavy = counted.filter(F.col("df") > SHORT).select("t", "c").join(
        sets.filter(F.col("aside") >= _needed(F.col("n"))).select("c"), "c")
    pivots = heavy.groupBy("t").agg(F.min(order).alias("p")).select("t", F.col("p.c").alias("p"))
    stars = heavy.join(pivots, "t").filter("c != p").select(F.col("c").alias("u"), F.col("p").alias("v"))
    labels = components(pairs.unionByName(stars), kept)
    found = sets.join(labels, sets["c"] == labels["u"]).select("c", "n", F.col("v").alias("gathering"))
    least = labels.select(F.col("v").alias("c")).distinct().join(sets, "c").select("c", "n", F.col("c").alias("gathering"))
    return found.unionByName(least)


def _placed(gathered: DataFrame, cell: int) -> DataFrame:
    """(c, n, home, band, part): the cell of each set. Small gatherings have shared homes below zero."""
    totals = gathered.groupBy("gathering").agg(F.sum("n").alias("total"))
    small = F.col("total") <= cell
    packs = totals.filter(small).agg(F.ceil(F.sum("total") / cell)).first()[0] or 1
    home = F.when(small, -1 - F.pmod(F.xxhash64("gathering"), F.lit(packs))).otherwise(F.col("gathering"))
    band = F.when(small, 0).otherwise(F.floor(F.log("n") / _BAND)).cast("int")
    placed = gathered.join(totals, "gathering").select("c", "n", home.alias("home"), band.alias("band"))
    parts = placed.groupBy("home", "band").agg(F.ceil(F.sum("n") / cell).alias("parts"))
    parts = parts.withColumn("parts", F.when(F.col("home") < 0, 1).otherwise(F.col("parts")).cast("int"))
    return placed.join(parts, ["home", "band"]).select(
        "c", "n", "home", "band", F.pmod(F.xxhash64("c"), "parts").cast("int").alias("part"))


def _visits(visitors: DataFrame, cells: DataFrame) -> DataFrame:
    """Visitors of a home in every cell of their own and the adjoining bands."""
    near = visitors.withColumn("band", F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])))
    return near.join(cells, ["home", "band"])


def _links(sets: DataFrame, kept: Kept, cell: int) -> DataFrame:
    """Links (u, v) that join all linked sets (c, n, home, band, part, set) to components."""
    true, false = F.lit(True), F.lit(False)
    cells = kept.keep(sets.filter("home >= 0").select(*_KEY).distinct(), "cells")
    best = sets.filter("home >= 0").groupBy("home", "band").agg(F.min(F.struct(F.xxhash64("c"), F.col("c"))).alias("g"))
    guests = sets.join(best.select(F.col("g.c").alias("c")), "c").select("home", "band", "c", "set")
    own = sets.select(*_KEY, "c", "set")
    first = own.unionByName(_visits(guests, cells)).withColumns({"label": F.col("c"), "query": true, "member": true})
    links = kept.keep(first.groupBy(*_KEY).applyInPandas(_search, "u long, v long"), "links")

    labels = components(links, kept)
    large = sets.filter("home >= 0").select("c", "n", *_KEY)
    named = large.join(labels, large["c"] == labels["u"], "left").select("c", "n", *_KEY, F.coalesce("v", "c").alias("label"))
    named = kept.keep(named, "named")
    major = (named.groupBy("home", "label").count().groupBy("home")
             .agg(F.max(F.struct("count", "label")).alias("m")).select("home", F.col("m.label").alias("major")))
    outside = named.join(major, "home").filter("label != major")
    blocks = outside.groupBy("home").agg(F.ceil(F.sum("n") / cell).cast("int").alias("blocks"))
    hosts = named.join(blocks, "home").select(
        *_KEY, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "c", "label", false.alias("query"), true.alias("member"))
    asking = outside.join(blocks, "home").select(
        "home", "band", F.pmod(F.xxhash64("c"), "blocks").cast("int").alias("block"), "c", "label", true.alias("query"), false.alias("member"))
    second = hosts.unionByName(_visits(asking, cells)).join(sets.select("c", "set"), "c")
    more = kept.keep(second.groupBy(*_KEY, "block").applyInPandas(_search, "u long, v long"), "links")
    return links.unionByName(more)


def join(docs: DataFrame, text: str = "text", id_column: str = "doc_id", cell: int = CELL) -> DataFrame:
    """One row per input row: its id, ``_text`` (hash of the text), n_shingles and component_id.

    Words are cut at ASCII white space after lower-casing A-Z; a text of fewer
    than SHINGLE words has its whole sequence as one shingle. Texts without words
    (null or empty among them) have an empty set and are linked with nothing.
    Two sets are linked if 100 * intersection >= PERCENT * union. component_id is
    the smallest id that links lead to, nulls aside, the row's own included.
    Equal texts, under whatever ids, are one set; rows equal in id and text
    repeat. Other columns have no effect. An empty table gives none.
    """
    kept = Kept(docs.sparkSession)
    fields = [T.StructField(n, T.LongType()) for n in ("n", "_p", "_q")] + [T.StructField("_prefix", T.ArrayType(T.LongType()))]
    source = docs.select(*_content(docs, text, id_column), F.col(text).cast("string").alias("text"))
    described = kept.keep(map_batches(source, _describe, fields, keep=("_id", "_text")), "described")

    # One class per distinct set, with the row that stands for it.
    who = F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_text"))
    groups = kept.keep(described.filter("n > 0").groupBy("_p", "_q").agg(F.min(who).alias("who"))
                       .select("_p", "_q", F.monotonically_increasing_id().alias("c"), "who._id", "who._text"), "groups")
    owners = groups.select("_p", "_q", "c", F.col("_id").alias("_i"), F.col("_text").alias("_t"))
    prefixes = (described.join(owners, ["_p", "_q"]).filter(F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_text") == F.col("_t")))
                .select("c", "n", F.explode("_prefix").alias("t")))
    rows = _survivors(prefixes.select("t", "c", "n"), kept)
    placed = kept.keep(_placed(kept.keep(_gathered(rows, kept), "gathered"), cell), "placed")
    wanted = placed.join(owners.select("c", "_i", "_t"), "c")
    found = source.join(wanted, source["_id"].eqNullSafe(wanted["_i"]) & (source["_text"] == wanted["_t"]))
    sets = kept.keep(map_batches(found.select("text", "c", "n", *_KEY), _set_bytes, [T.StructField("set", T.BinaryType())],
                                 keep=("c", "n", *_KEY)).dropDuplicates(["c"]), "sets")
    labels = components(_links(sets, kept, cell), kept)

    named = groups.join(labels, groups["c"] == labels["u"], "left").select("_p", "_q", F.coalesce("v", "c").alias("component"), "_id")
    least = named.groupBy("component").agg(F.min("_id").alias("owner"))
    owned = named.join(least, "component").select("_p", "_q", "owner")
    marked = described.select("_id", "_text", "n", "_p", "_q").join(owned, ["_p", "_q"], "left")
    return marked.select(F.col("_id").alias(id_column), "_text", F.col("n").alias("n_shingles"),
                         F.when(F.col("n") == 0, F.col("_id")).otherwise(F.col("owner")).alias("component_id"))


def query(documents: DataFrame) -> DataFrame:
    return join(without(documents, RESULTS)).select("doc_id", *RESULTS)
