"""Near duplicates: banded MinHash candidates, sequential Bayesian pruning, exact verification.

Documents whose shingle sets are equal are one class, and only one member of a
class goes on. Classes that share a band of their signatures are candidates. A
pair's signatures are compared batch by batch; it is dropped as soon as the
posterior probability that its similarity reaches the threshold is below MISS.
All pairs that survive are verified on the full sets.

Candidates come in two rounds. First every member of a bucket meets the bucket's
pivot, so a group of copies makes as many pairs as members. Links found so join
classes to components. Then, only in buckets that still hold several components,
members of different components meet, block by block, and are verified on the
spot. Pairs inside one component cannot change the result and are left out; no
other candidate is.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from callcause.llm import hashing
from callcause.llm.common import Kept, doc_batches, map_batches, without
from callcause.llm.components import components

SHINGLE = 5
PERCENT = 85
# 25 bands of 5 miss a pair of similarity 0.85 with probability 4e-7.
BANDS, ROWS = 25, 5
# Probability at which a pair that reaches the threshold may be pruned by its signatures.
MISS = 1e-6
BLOCK = 1_024
RESULTS = ("n_shingles", "component_id", "kept")
_STEP = 250_000
_CONTENT = ("_id", "_text")

# Words are runs of bytes that are no ASCII white space.
WORD_BYTES = np.ones(256, bool)
WORD_BYTES[[0x20, *range(0x09, 0x0E)]] = False
_random = np.random.default_rng(85)
_FACTORS = _random.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _random.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, end to end, and where each text's begin.

    A text of fewer words has its whole sequence as one shingle; without words none.
    """
    words = hashing.Words(data, offsets, WORD_BYTES)
    first, hashes = words.runs(SHINGLE)
    counts = np.diff(words.offsets)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    whole = hashing.prime_ranges(words.sums, words.offsets[short], words.offsets[short + 1])
    doc = np.concatenate([hashing.doc_of(words.offsets, first), short])
    return distinct_by_row(doc, np.concatenate([hashes, whole]), len(offsets) - 1)


def distinct_by_row(row: np.ndarray, values: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, ascending, end to end, and where each row's begin."""
    order = np.argsort(values, kind="stable")
    order = order[np.argsort(row[order], kind="stable")]
    row, values = row[order], values[order]
    if len(values):
        new = np.concatenate([[True], (values[1:] != values[:-1]) | (row[1:] != row[:-1])])
        row, values = row[new], values[new]
    return values, np.searchsorted(row, np.arange(rows + 1))


def _sign(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    n_shingles, prints, more_prints, signatures, bands = [], [], [], [], []
    for data, offsets, low, high in doc_batches(batch.column("text"), _STEP):
        sets, bounds = shingle_sets(data, offsets)
        sizes = np.diff(bounds)
        n_shingles.append(sizes)
        for seen, out in ((sets, prints), (hashing.mix(sets ^ np.uint64(0x5BD1E995)), more_prints)):
            out.append(hashing.prime_ranges(hashing.prime_prefix(seen), bounds[:-1], bounds[1:]).view(np.int64))
        filled = np.flatnonzero(sizes)
        least = np.zeros((high - low, BANDS * ROWS), np.uint32)
        if len(filled):
            spread = hashing.mix(sets)
            for k in range(BANDS * ROWS):
                values = ((spread * _FACTORS[k] + _SHIFTS[k]) >> np.uint64(32)).astype(np.uint32)
                least[filled, k] = np.minimum.reduceat(values, bounds[:-1][filled])
        signatures.append(least.astype(np.uint16))
        key = np.zeros((high - low, BANDS), np.uint64)
        for r in range(ROWS):
            key = hashing.mix(key * np.uint64(31) + least[:, r::ROWS].astype(np.uint64) + np.arange(BANDS, dtype=np.uint64))
        bands.append(key.view(np.int64))
    width = 2 * BANDS * ROWS
    signature = np.ascontiguousarray(np.concatenate(signatures))
    flat = pa.array(np.concatenate(bands).ravel())
    rows = batch.num_rows
    return {
        "n_shingles": pa.array(np.concatenate(n_shingles).astype(np.int64)), "_p": pa.array(np.concatenate(prints)),
        "_q": pa.array(np.concatenate(more_prints)),
        "_signature": pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(
            np.arange(rows + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(signature)]),
        "_bands": pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * np.int32(BANDS)), flat)}


def least_matches(threshold: float, batch: int, hashes: int, miss: float) -> list[tuple[int, int]]:
    """(hashes seen, matches needed to go on): fewer leave P(similarity >= threshold) below ``miss``.

    The prior is uniform, so the posterior after m matches of n is Beta(m + 1, n - m + 1),
    whose upper tail is the chance of at most m successes of n + 1 at the threshold.
    """
    found = []
    for n in range(batch, hashes + 1, batch):
        tail, m = 0.0, -1
        while tail < miss and m < n:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        found.append((n, m))
    return found


_NEEDED = least_matches(PERCENT / 100, ROWS * 5, BANDS * ROWS, MISS)


def survivors(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Indices of the signature pairs that no batch of hashes rules out."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int64)
    done = 0
    for n, needed in _NEEDED:
        matches = matches + (left[alive, done:n] == right[alive, done:n]).sum(axis=1)
        stay = matches >= needed
        alive, matches, done = alive[stay], matches[stay], n
    return alive


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(-1, BANDS * ROWS)


def _prune(pairs: DataFrame) -> DataFrame:
    """Pairs (u, v, su, sv) less those that their signatures rule out."""
    def run(batches):
        for batch in batches:
            if len(batch):
                alive = survivors(_matrix(batch["su"]), _matrix(batch["sv"]))
                yield batch.iloc[alive][["u", "v"]]

    return pairs.mapInPandas(run, "u long, v long")


def _with_signatures(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    signed = classes.select("c", "_signature")
    return (pairs.join(signed.select(F.col("c").alias("u"), F.col("_signature").alias("su")), "u")
            .join(signed.select(F.col("c").alias("v"), F.col("_signature").alias("sv")), "v"))


def _pivot_pairs(buckets: DataFrame) -> DataFrame:
    """Each member of a bucket with its pivot, the member of least hash; also within buckets of two bands."""
    order = F.struct(F.xxhash64("c"), F.col("c"))
    found = None
    for place in (["key"], ["key", "next"]):
        pivots = (buckets.groupBy(*place).agg(F.min(order).alias("p"), F.count(F.lit(1)).alias("n"))
                  .filter("n > 1").select(*place, F.col("p.c").alias("p")))
        pairs = buckets.join(pivots, place).filter("c != p").select(
            F.least("c", "p").alias("u"), F.greatest("c", "p").alias("v"))
        found = pairs if found is None else found.unionByName(pairs)
    return found.distinct()


def _linked(a: bytes, b: bytes, percent: int) -> bool:
    """Whether two sets have 100 * intersection >= percent * union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate([np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)]), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def _cross_links(buckets: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components of a bucket: one for every two components that have any there.

    A bucket's members are dealt into blocks of about BLOCK; every two blocks
    meet in a group of their own, so no group grows with the bucket. Pairs that
    signatures do not rule out are verified on the sets, likely ones first, and
    a pair is passed over once a link has joined its components.
    """
    tagged = buckets.join(labels, buckets["c"] == labels["u"], "left").select(
        "key", "c", F.coalesce("v", "c").alias("component"))
    open_ = tagged.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"),
                                      F.count(F.lit(1)).alias("n")).filter("a != b")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    members = (tagged.join(open_.select("key", blocks.alias("blocks")), "key")
               .join(classes.select("c", "_signature"), "c").join(sets, "c")
               .withColumn("block", F.pmod(F.xxhash64("c"), "blocks").cast("int"))
               .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
               .select("key", "c", "component", "_signature", "set", "block", F.least("block", "other").alias("i"),
                       F.greatest("block", "other").alias("j")))

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
        left, right = group[group["block"] == i], group[group["block"] == j]
        parent = {c: c for c in group["component"]}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        a, b = _matrix(left["_signature"]), _matrix(right["_signature"])
        mine, theirs = left["component"].to_numpy(), right["component"].to_numpy()
        u, v = left["c"].to_numpy(), right["c"].to_numpy()
        my_sets, their_sets = left["set"].to_list(), right["set"].to_list()
        found = []
        for k in range(len(left)):
            partners = np.flatnonzero((theirs != mine[k]) & ((v > u[k]) if i == j else True))
            if not len(partners):
                continue
            partners = partners[survivors(np.broadcast_to(a[k], (len(partners), a.shape[1])), b[partners])]
            likely = np.argsort(-(b[partners] == a[k]).sum(axis=1), kind="stable")
            for partner in partners[likely]:
                one, other = root(mine[k]), root(theirs[partner])
                if one != other and _linked(my_sets[k], their_sets[partner], percent):
                    parent[one] = other
                    found.append((min(u[k], v[partner]), max(u[k], v[partner])))
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return members.groupBy("key", "i", "j").applyInPandas(meet, "u long, v long").distinct()


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union."""
    def run(batches):
        for batch in batches:
            good = [_linked(a, b, percent) for a, b in zip(batch["set_u"], batch["set_v"])]
            yield batch[np.array(good, bool)][["u", "v"]]

    return (pairs.join(sets.select(F.col("c").alias("u"), F.col("set").alias("set_u")), "u")
            .join(sets.select(F.col("c").alias("v"), F.col("set").alias("set_v")), "v")
            .mapInPandas(run, "u long, v long"))


def _sets(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    found = []
    for data, offsets, _, _ in doc_batches(batch.column("text"), _STEP):
        sets, bounds = shingle_sets(data, offsets)
        found += [sets[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
    return {"set": pa.array(found, pa.binary())}


def _content(docs: DataFrame, text: str, id_column: str) -> list[Column]:
    """What tells rows apart: the id and the text's hash. Rows equal in both are interchangeable here."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return [F.col(id_column).alias("_id"), F.xxhash64(whole, F.length(whole)).alias("_text")]


def mark_near_duplicates(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per input row: its id, ``_text`` (hash of the text), n_shingles, component_id, ``_first`` and kept.

    Words are cut at ASCII white space after lower-casing A-Z. Texts without
    words (null or empty among them) have an empty set and are linked with
    nothing. component_id is the smallest id of the component, nulls aside;
    kept tells whether the row has that id. ``_first`` marks the rows that stay
    if one document of each component may: those of the smallest id, and of that
    id the smallest text hash.
    """
    kept = Kept(docs.sparkSession)
    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("_p", T.LongType()), T.StructField("_q", T.LongType()),
              T.StructField("_signature", T.BinaryType()), T.StructField("_bands", T.ArrayType(T.LongType()))]
    source = docs.select(*_content(docs, text, id_column), F.col(text).cast("string").alias("text"))
    signed = kept.keep(map_batches(source, _sign, fields, keep=_CONTENT), "signed")

    # One class per distinct set; its number is the hash of its representative's place among the classes.
    who = F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_text"))
    groups = kept.keep(
        signed.filter("n_shingles > 0").groupBy("_p", "_q").agg(F.min(who).alias("who"))
        .select("_p", "_q", F.monotonically_increasing_id().alias("c"), "who._id", "who._text"), "groups")
    classes = kept.keep(
        signed.join(groups.select("_p", "_q", "c", F.col("_id").alias("_i"), F.col("_text").alias("_t")), ["_p", "_q"])
        .filter(F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_text") == F.col("_t")))
        .select("c", "_id", "_text", "_signature", "_bands").dropDuplicates(["c"]), "classes")
    pairs_of = classes.select("c", F.posexplode("_bands").alias("band", "key"), "_bands")
    buckets = kept.keep(pairs_of.select(
        "c", "key", F.get("_bands", (F.col("band") + 1) % BANDS).alias("next")), "buckets")
    shared = buckets.groupBy("key").count().filter("count > 1").select("key")
    busy = kept.keep(buckets.join(shared, "key"), "busy")
    kept.drop(buckets)

    candidates = kept.keep(_prune(_with_signatures(_pivot_pairs(busy), classes)), "pairs")
    # Sets of all classes that share a bucket: these alone can have links.
    involved = classes.join(busy.select("c").distinct(), "c").select("c", F.col("_id").alias("_i"), F.col("_text").alias("_t"))
    wanted = source.join(involved, source["_id"].eqNullSafe(involved["_i"]) & (source["_text"] == involved["_t"]))
    sets = kept.keep(map_batches(wanted.select("c", "text"), _sets, [T.StructField("set", T.BinaryType())], keep=("c",))
                     .dropDuplicates(["c"]), "sets")
    links = kept.keep(_verify(candidates, sets, PERCENT), "links")
    labels = components(links, kept)
    more = kept.keep(_cross_links(busy, labels, classes, sets, PERCENT), "links")
    labels = components(labels.unionByName(more), kept)

    named = groups.join(labels, groups["c"] == labels["u"], "left").select(
        "_p", "_q", F.coalesce("v", "c").alias("component"), "_id", "_text")
    owners = named.groupBy("component").agg(
        F.min(F.struct(F.col("_id").isNull().alias("no"), F.col("_id"), F.col("_text"))).alias("owner"))
    owned = named.join(owners, "component").select("_p", "_q", "owner")
    marked = signed.select(*_CONTENT, "n_shingles", "_p", "_q").join(owned, ["_p", "_q"], "left")
    alone = F.col("n_shingles") == 0
    component = F.when(alone, F.col("_id")).otherwise(F.col("owner._id"))
    first = alone | (F.col("_id").eqNullSafe(F.col("owner._id")) & (F.col("_text") == F.col("owner._text")))
    return marked.select(
        F.col("_id").alias(id_column), "_text", "n_shingles", component.alias("component_id"),
        first.alias("_first"), F.col("_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The rows that stay, with all their columns: one document of each component (rows equal in id and text together)."""
    stays = mark_near_duplicates(docs, text, id_column).filter("_first").select(
        F.col(id_column).alias("_keep_id"), F.col("_text").alias("_keep_text")).distinct()
    mine = docs.withColumns({"_my_id": F.col(id_column), "_my_text": _content(docs, text, id_column)[1]})
    return mine.join(stays, mine["_my_id"].eqNullSafe(stays["_keep_id"]) & (mine["_my_text"] == stays["_keep_text"]),
                     "left_semi").drop("_my_id", "_my_text")


def query(documents: DataFrame) -> DataFrame:
    marks = mark_near_duplicates(without(documents, RESULTS))
    return marks.select("doc_id", "n_shingles", "component_id", "kept")
