"""Alignment of two tokenizers' tokens over the same bytes, in Arrow arrays from end to end.

Token ids are flattened lists with parent indices; their byte ends are sums that
start anew with each document. A full outer Acero join on (document, end) gives
every end that either tokenizer has. In order of the ends, each row is the one
overlap of one token of A and one of B: the null sides take the next token
(fill backward). Rows with both sides cut the tokens into groups.

Pairs of ids are counted by documents: ``Table.group_by`` makes partial counts
in each task, and Spark merges them. The most frequent pairs, at most HOT_PAIRS,
return to the tasks; the links of rarer ones meet their counts in a Spark join.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, functions as F, types as T
from sentencepiece import sentencepiece_model_pb2

from callcause.llm.common import Kept, doc_batches, lists, without
from callcause.llm.hashing import doc_of
from callcause.llm.pretokens import Vocabulary, distinct_words, joined, without_rows

# Fixed value: how byte-level vocabularies of this make cut a text before they merge.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Pairs whose counts are handed to every task: at most 24 MB.
HOT_PAIRS = 1_000_000
# Rows of partial counts that a task holds before it passes them on.
PARTIAL = 500_000
RESULTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
# Bytes of text, and tokens, that go through the array steps at once; a longer text is a step of its own.
_STEP, _TOKENS = 500_000, 150_000
# Distinct words that the tokenizers get at once, and those that a task remembers.
_LOT, REMEMBERED = 500, 200_000
_SHIFT = 32
_LOW = np.int64((1 << _SHIFT) - 1)


class _ByteTokens:
    """The first tokenizer; special tokens inside texts are plain text."""

    def __init__(self, path: str):
        vocab = Vocabulary(path)
        self.strings, self.merger, self.vocab = vocab.strings, None, vocab
        if vocab.fast:
            ends = np.cumsum(self.strings.sizes)
            raw = self.strings.data.tobytes()
            ranks = {raw[end - size:end]: k for k, (end, size) in enumerate(zip(ends.tolist(), self.strings.sizes.tolist()))
                     if k not in vocab.special.values()}
            self.merger = tiktoken.Encoding("byte tokens", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        else:
            vocab.library.encode_special_tokens = True

    def encode(self, texts: list[bytes]) -> pa.ListArray:
        words = [t.decode("utf-8", "replace") for t in texts]
        if self.merger is not None:
            ids = [self.merger.encode_ordinary(t) for t in words]
        else:
            ids = [e.ids for e in self.vocab.library.encode_batch_fast(words, add_special_tokens=False)]
        return pa.array(ids, pa.list_(pa.int32()))


@functools.lru_cache(maxsize=2)
def _byte_tokens(path: str) -> _ByteTokens:
    return _ByteTokens(path)


def piece_bytes(piece: str) -> bytes:
    """The bytes that a piece of the second tokenizer stands for."""
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


@functools.lru_cache(maxsize=2)
def _piece_tokens(path: str) -> tuple[sentencepiece.SentencePieceProcessor, pa.Array]:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, pa.array([piece_bytes(model.id_to_piece(k)) for k in range(model.get_piece_size())], pa.binary())


@functools.lru_cache(maxsize=2)
def _sizes(a_path: str, b_path: str) -> tuple[pa.Array, pa.Array]:
    """Bytes of every token of both."""
    return (pa.array(_byte_tokens(a_path).strings.sizes),
            pc.cast(pc.binary_length(_piece_tokens(b_path)[1]), pa.int64()))


@functools.lru_cache(maxsize=2)
def _by_words(a_path: str, b_path: str) -> bool:
    """Whether no token of either tokenizer reaches from a word into a space behind it, and texts are taken as they are."""
    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(_piece_tokens(b_path)[0].serialized_model_proto())
    norm = spec.normalizer_spec
    plain = (norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
             and not norm.precompiled_charsmap and not norm.normalization_rule_tsv
             and not spec.denormalizer_spec.precompiled_charsmap)
    return bool(plain and spec.trainer_spec.model_type == spec.trainer_spec.BPE and not spec.trainer_spec.treat_whitespace_as_suffix
                and not any("▁" in p.piece.lstrip("▁") for p in spec.pieces) and _byte_tokens(a_path).merger is not None)


def _encode(data: np.ndarray, offsets: np.ndarray, a_path: str, b_path: str) -> tuple[pa.Array, pa.Array]:
    """Ids by both tokenizers, as lists; without any for texts that are empty or come back otherwise.

    Texts are cut at single spaces, and each distinct word is encoded once, while it is remembered. Texts with other runs of
    white space around a space, or with words that do not come back, are encoded whole.
    """
    if not _by_words(a_path, b_path):
        return _encode_whole(data, offsets, a_path, b_path)
    words, numbers, bounds = distinct_words(data, offsets)
    known = _known_words(a_path, b_path)
    numbers = known.look_up(words)[numbers]
    a_words, b_words = known.lists
    odd = a_words.value_lengths().to_numpy() == 0
    whole = np.unique(doc_of(bounds, np.flatnonzero(odd[numbers])))
    if not len(whole):
        return _texts_of(a_words, numbers, bounds), _texts_of(b_words, numbers, bounds)
    again = _encode_whole(*without_rows(data, offsets, np.setdiff1d(np.arange(len(offsets) - 1), whole))[:2], a_path, b_path)
    stays = ~np.isin(doc_of(bounds, np.arange(len(numbers))), whole)
    rest = np.setdiff1d(np.arange(len(offsets) - 1), whole)
    rest_bounds = np.concatenate([[0], np.cumsum(np.diff(bounds)[rest])])
    order = pa.array(np.argsort(np.concatenate([rest, whole]), kind="stable"))
    return tuple(pc.take(pa.concat_arrays([_texts_of(of_words, numbers[stays], rest_bounds), of_texts]), order)
                 for of_words, of_texts in zip((a_words, b_words), again))


class _Words:
    """Words that were encoded before, at most REMEMBERED (or those of one step); beyond it the memory starts anew."""

    def __init__(self, a_path: str, b_path: str):
        self.paths = a_path, b_path
        self.clear()

    def clear(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.lists = [pa.array([], pa.list_(pa.int32())) for _ in range(2)]

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """The numbers of distinct words; those that are new are encoded."""
        new = [w for w in words if w not in self.slots]
        if len(self.slots) + len(new) > REMEMBERED:
            self.clear()
            new = words
        if new:
            self.lists = [pa.concat_arrays(pair) for pair in zip(self.lists, _encode_words(new, *self.paths))]
            self.slots.update(zip(new, range(len(self.slots), len(self.slots) + len(new))))
        return np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))


@functools.lru_cache(maxsize=2)
def _known_words(a_path: str, b_path: str) -> _Words:
    return _Words(a_path, b_path)


def _texts_of(of_words: pa.ListArray, numbers: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    """Lists of texts from those of their words."""
    found = pc.take(of_words, pa.array(numbers))
    return pa.ListArray.from_arrays(pc.take(found.offsets, pa.array(bounds)), found.values)


def _encode_words(words: list[bytes], a_path: str, b_path: str) -> tuple[pa.Array, pa.Array]:
    """Ids of a space and each word; without any for words that are empty, begin with white space or come back otherwise.

    Many words go to the tokenizers at once, and their tokens are told apart by their byte ends.
    """
    plain = np.flatnonzero([bool(w) and not w[:4].decode("utf-8", "ignore")[:1].isspace() for w in words])
    lots = [plain[low:low + _LOT] for low in range(0, len(plain), _LOT)]
    a, b = _encode_whole(*joined([b" ".join([words[k] for k in lot.tolist()]) for lot in lots]), a_path, b_path)
    bad = a.value_lengths().to_numpy() == 0
    good = np.concatenate([np.zeros(0, np.int64), *[lot for lot, x in zip(lots, bad) if not x]])
    apart = np.setdiff1d(plain, good)
    again = _encode_whole(*joined([words[k] for k in apart.tolist()]), a_path, b_path)
    ends = np.cumsum([len(words[k]) + 1 for k in good.tolist()], dtype=np.int64)
    order = np.full(len(words), len(good) + len(apart))
    order[good], order[apart] = np.arange(len(good)), len(good) + np.arange(len(apart))
    found = []
    for lists_, sizes, apart_lists in zip((a, b), _sizes(a_path, b_path), again):
        flat = pc.list_flatten(lists_)
        cuts = np.searchsorted(np.cumsum(pc.take(sizes, flat).to_numpy()), ends) + 1
        of_good = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], cuts]).astype(np.int32)), flat)
        none = pa.array([[]], pa.list_(pa.int32()))
        found.append(pc.take(pa.concat_arrays([of_good, apart_lists, none]), pa.array(order)))
    return found[0], found[1]


def _encode_whole(data: np.ndarray, offsets: np.ndarray, a_path: str, b_path: str) -> tuple[pa.Array, pa.Array]:
    """The same, each text as a whole."""
    vocab, (model, pieces) = _byte_tokens(a_path), _piece_tokens(b_path)
    raw = data.tobytes()
    plain = [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
    texts = [b" " + t if t else b"" for t in plain]
    spaced = pa.array(texts, pa.binary())
    a = vocab.encode(texts)
    b = pa.array(model.encode([t.decode("utf-8", "replace") for t in plain], num_threads=1), pa.list_(pa.int32()))
    a_ids, a_ends = pc.list_flatten(a).to_numpy(), a.offsets.to_numpy()
    starts = np.concatenate([[0], np.cumsum(vocab.strings.sizes[a_ids])])[a_ends]
    back = vocab.strings.join(a_ids).tobytes()
    a_text = pa.array([back[s:e] for s, e in zip(starts[:-1], starts[1:])], pa.binary())
    b_text = pc.binary_join(pa.ListArray.from_arrays(b.offsets, pc.take(pieces, pc.list_flatten(b))), b"")
    good = pc.and_(pc.equal(a_text, spaced), pc.equal(b_text, spaced))
    none = pa.scalar([], pa.list_(pa.int32()))
    return pc.if_else(good, a, none), pc.if_else(good, b, none)


def tokens(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """All rows and columns but the text, with the ids of both tokenizers in ``_a`` and ``_b``."""
    names = [n for n in docs.columns if n not in (text, "_a", "_b")]
    read = docs.select(*names, F.col(text).cast("string").alias("_t"))

    def run(batches):
        for batch in batches:
            for data, offsets, low, high in doc_batches(batch.column("_t"), _STEP):
                a, b = _encode(data, offsets, a_path, b_path)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(n).slice(low, high - low) for n in names] + [a, b], [*names, "_a", "_b"])

    ids = T.ArrayType(T.IntegerType())
    fields = [f for f in read.schema.fields if f.name in names]
    return read.mapInArrow(run, T.StructType([*fields, T.StructField("_a", ids), T.StructField("_b", ids)]))


def _ends(ids: pa.ListArray, sizes: pa.Array, side: str) -> tuple[pa.Table, pa.Array]:
    """(doc, end, token number) of every token, and the bytes before each document."""
    parent, flat = pc.list_parent_indices(ids), pc.list_flatten(ids)
    total = pc.cumulative_sum(pc.take(sizes, flat))
    padded = pa.concat_arrays([pa.array([0], pa.int64()), total.combine_chunks() if isinstance(total, pa.ChunkedArray) else total])
    base = pc.take(padded, ids.offsets.slice(0, len(ids)))
    end = pc.subtract(total, pc.take(base, parent))
    doc = pc.cast(parent, pa.int64())
    return pa.table({"doc": doc, "end": end, side: pa.array(np.arange(len(flat)))}), base


class Aligned:
    """The tokens of a few documents side by side."""

    def __init__(self, a: pa.ListArray, b: pa.ListArray, a_sizes: pa.Array, b_sizes: pa.Array):
        self.docs = len(a)
        self.a, self.b = pc.list_flatten(a), pc.list_flatten(b)
        self.n_a, self.n_b = pc.list_value_length(a), pc.list_value_length(b)
        left, base = _ends(a, a_sizes, "at_a")
        right, _ = _ends(b, b_sizes, "at_b")
        both = left.join(right, ["doc", "end"], join_type="full outer", use_threads=False).combine_chunks()
        place = pc.add(pc.take(base, both["doc"]), both["end"])
        both = both.take(pc.sort_indices(place))
        self.doc = both["doc"].combine_chunks()
        at_a, at_b = both["at_a"].combine_chunks(), both["at_b"].combine_chunks()
        self.cut = pc.and_(at_a.is_valid(), at_b.is_valid())
        self.a_cut = self.cut.filter(at_a.is_valid())
        self.b_cut = self.cut.filter(at_b.is_valid())
        # Links: one row for each overlap of a token of A with one of B.
        self.link_a = pc.take(self.a, pc.fill_null_backward(at_a))
        self.link_b = pc.take(self.b, pc.fill_null_backward(at_b))

    def keys(self) -> pa.Array:
        """Both ids of each link in one number."""
        return pc.bit_wise_or(pc.shift_left(pc.cast(self.link_a, pa.int64()), _SHIFT), pc.cast(self.link_b, pa.int64()))

    def per_doc(self, values: pa.Array | None = None) -> np.ndarray:
        """Sum over the links of each document, or their number."""
        weights = None if values is None else values.to_numpy(zero_copy_only=False)
        return np.bincount(self.doc.to_numpy(), weights, self.docs)

    def groups(self) -> tuple[pa.Array, np.ndarray]:
        """Each document's groups as text, and their number: ids by commas, sides by ``|``, groups by ``;``."""
        def side(ids: pa.Array, cut: pa.Array) -> pa.Array:
            ends = np.flatnonzero(cut.to_numpy(zero_copy_only=False)) + 1
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            return pc.binary_join(pa.ListArray.from_arrays(offsets, pc.cast(ids, pa.string())), ",")

        groups = pc.binary_join_element_wise(side(self.a, self.a_cut), side(self.b, self.b_cut), "|")
        counts = np.bincount(self.doc.filter(self.cut).to_numpy(), minlength=self.docs)
        return pc.binary_join(lists_of(groups, counts), ";"), counts


def lists_of(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def _parts(batch: pa.RecordBatch, tokens_in_part: int = _TOKENS) -> Iterator[tuple[int, pa.ListArray, pa.ListArray]]:
    """Ids of both sides, a few documents at a time, and the first row of each part."""
    a, b = (pc.if_else(c.is_valid(), c, pa.scalar([], c.type)) for c in (batch.column("_a"), batch.column("_b")))
    ends = np.cumsum(a.value_lengths().to_numpy() + b.value_lengths().to_numpy())
    low = 0
    while low < len(a):
        before = ends[low - 1] if low else 0
        high = max(int(np.searchsorted(ends, before + tokens_in_part, "right")), low + 1)
        yield low, _compact(a.slice(low, high - low)), _compact(b.slice(low, high - low))
        low = high


def _compact(part: pa.ListArray) -> pa.ListArray:
    """The same lists with offsets from zero."""
    return lists_of(pc.list_flatten(part), part.value_lengths().to_numpy())


def pair_counts(coded: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(pair, documents): in how many rows each pair of ids is linked."""
    def merged(parts: list[pa.Table]) -> pa.Table:
        found = pa.concat_tables(parts).group_by("pair", use_threads=False).aggregate([("n", "sum")])
        return pa.table({"pair": found["pair"], "n": found["n_sum"]})

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            for _, a, b in _parts(batch):
                found = Aligned(a, b, *_sizes(a_path, b_path))
                once = pa.table({"doc": found.doc, "pair": found.keys()}).group_by(["doc", "pair"], use_threads=False).aggregate([])
                counted = once.group_by("pair", use_threads=False).aggregate([("doc", "count")])
                held.append(pa.table({"pair": counted["pair"], "n": counted["doc_count"]}))
                rows += len(counted)
                if rows > PARTIAL:
                    held = [merged(held)]
                    rows = len(held[0])
                    if rows > PARTIAL // 2:
                        yield from held.pop().to_batches(max_chunksize=100_000)
                        rows = 0
        if held:
            yield from merged(held).to_batches(max_chunksize=100_000)

    partial = coded.select("_a", "_b").mapInArrow(run, "pair long, n long")
    return partial.groupBy("pair").agg(F.sum("n").alias("documents"))


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """All rows and columns but the text, with RESULTS: numbers of tokens, groups and links, link scores, groups as text.

    ``a_path`` names a byte-level vocabulary of the tokenizers library, which
    encodes a space and the text; ``b_path`` a sentencepiece model, which adds
    the space itself. No special tokens are added, and their strings in a text
    are plain text. A link is an overlap of two tokens; its count is the number
    of rows that hold its pair of ids linked. n_best counts the links whose
    count is the highest that their A id has; count_sum adds all counts.

    Null and empty texts, and texts that a tokenizer does not give back byte by
    byte, have zeros and empty groups. Equal rows count as often as they stand.
    A text of another type is read as a string. Input columns named as results
    give way. Runs jobs: ids and counts are kept in the shared folder.
    """
    kept = Kept(docs.sparkSession)
    docs = without(docs, (*RESULTS, "_row")).withColumn("_row", F.monotonically_increasing_id())
    coded = kept.keep(tokens(docs, a_path, b_path, text), "ids")
    pairs = kept.keep(pair_counts(coded, a_path, b_path), "pairs")
    a_id = F.shiftright("pair", _SHIFT)
    # One row per id of the first vocabulary, and the pairs that most documents hold.
    best_rows = pairs.groupBy(a_id.alias("a")).agg(F.max("documents").alias("n")).toArrow()
    best = np.zeros(int(pc.max(best_rows["a"]).as_py() or 0) + 1, np.int64)
    best[best_rows["a"].to_numpy()] = best_rows["n"].to_numpy()
    all_pairs = pairs.count()
    hot_rows = pairs if all_pairs <= hot_pairs else pairs.orderBy(F.col("documents").desc(), "pair").limit(hot_pairs)
    hot = hot_rows.toArrow().sort_by("pair")
    hot_keys, hot_counts = hot["pair"].to_numpy(), hot["documents"].to_numpy()
    names = [n for n in coded.columns if n not in ("_a", "_b")]

    def run(batches):
        for batch in batches:
            for low, a, b in _parts(batch):
                found = Aligned(a, b, *_sizes(a_path, b_path))
                keys = found.keys().to_numpy()
                at = np.minimum(np.searchsorted(hot_keys, keys), max(len(hot_keys) - 1, 0))
                known = hot_keys[at] == keys if len(hot_keys) else np.zeros(len(keys), bool)
                counts = np.where(known, hot_counts[at] if len(hot_keys) else 0, 0)
                is_best = known & (counts == best[keys >> _SHIFT])
                groups, n_groups = found.groups()
                doc = found.doc.to_numpy()
                rare = lists(keys[~known], np.bincount(doc[~known], minlength=found.docs), pa.int64())
                numbers = [found.n_a, found.n_b, n_groups, found.per_doc(), found.per_doc(pa.array(is_best)),
                           np.bincount(doc, counts, found.docs)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(n).slice(low, found.docs) for n in names]
                    + [pa.array(np.asarray(x).astype(np.int64)) for x in numbers] + [groups, rare], [*names, *RESULTS, "_rare"])

    fields = [f for f in coded.schema.fields if f.name in names]
    fields += [T.StructField(n, T.StringType() if n == "groups" else T.LongType()) for n in RESULTS]
    made = coded.mapInArrow(run, T.StructType([*fields, T.StructField("_rare", T.ArrayType(T.LongType()))]))
    if all_pairs > hot_pairs:
        made = _add_rare(kept.keep(made, "aligned"), pairs, kept)
    return made.drop("_row", "_rare")


def _add_rare(made: DataFrame, pairs: DataFrame, kept: Kept) -> DataFrame:
    """Counts of the links whose pairs were not handed to the tasks."""
    links = made.select("_row", F.explode("_rare").alias("pair")).groupBy("_row", "pair").count()
    top = pairs.groupBy(F.shiftright("pair", _SHIFT).alias("a")).agg(F.max("documents").alias("top"))
    scored = links.join(pairs, "pair").withColumn("a", F.shiftright("pair", _SHIFT)).join(top, "a")
    more = scored.groupBy("_row").agg(
        F.sum(F.when(F.col("documents") == F.col("top"), F.col("count")).otherwise(0)).alias("_best"),
        F.sum(F.col("documents") * F.col("count")).alias("_sum"))
    return made.join(more, "_row", "left").withColumns({
        "n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)),
        "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))}).drop("_best", "_sum")


def query(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    digest = F.when(F.col("n_a") == 0, F.lit("")).otherwise(F.sha2("groups", 256))
    return align(documents.select("doc_id", "text"), a_path, b_path).select(
        "doc_id", *RESULTS[:-1], digest.alias("groups_sha256"))
