"""Byte-level BPE of whole batches: texts are cut into pre-tokens by array operations, and each distinct
pre-token is encoded once.

The cuts follow the tokenizer's pattern for characters of all alphabets; the
tokenizers library itself says what kind a character from U+0240 on is, when it
is first seen. Texts with the special token, and bytes that are no UTF-8, go to
the library as a whole. So do all texts if the vocabulary file is of another
make than the cuts are written for.
"""

from __future__ import annotations

import functools
import itertools
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import tokenizers

from callcause.llm import hashing
from callcause.llm.hashing import expand

SPECIAL = "<|endoftext|>"
# Distinct pre-tokens that are remembered at most; beyond it the memory starts anew.
REMEMBERED = 200_000
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
_CONTRACTIONS = (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll")


def _classes() -> np.ndarray:
    found = np.zeros(0x240, np.uint8)
    for point in range(0x240):
        if regex.match(r"\p{L}", chr(point)):
            found[point] = _LETTER
        elif regex.match(r"\p{N}", chr(point)):
            found[point] = _NUMBER
    found[[*range(9, 14), 32, 0x85, 0xA0]] = _SPACE
    return found


_CLASS = _classes()
_UNSEEN = 255
_BYTE_LEVEL = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)


class _Wide:
    """Kinds of the characters from U+0240 on, each asked of the tokenizers library once."""

    def __init__(self):
        self.kinds = np.full(0x110000, _UNSEEN, np.uint8)

    def of(self, points: np.ndarray) -> np.ndarray:
        for point in np.unique(points[self.kinds[points] == _UNSEEN]).tolist():
            # One pre-token with a neighbour means of its kind; white space makes one with none of these.
            joins = (kind for kind, before in ((_LETTER, "a"), (_NUMBER, "1"), (_OTHER, "!"))
                     if len(_BYTE_LEVEL.pre_tokenize_str(before + chr(point))) == 1)
            self.kinds[point] = next(joins, _SPACE)
        return self.kinds[points]


_WIDE = _Wide()


def _wide_kinds(data: np.ndarray, kind: np.ndarray) -> None:
    """Set the kinds of characters of three and four bytes, and of those of two from U+0240 on, at all their bytes."""
    leads = np.flatnonzero(data >= 0xC9)
    size = 2 + (data[leads] >= 0xE0) + (data[leads] >= 0xF0).astype(np.int64)
    for n in (2, 3, 4):
        at = leads[size == n]
        if not len(at):
            continue
        point = data[at].astype(np.int64) & (0x7F >> n)
        for k in range(1, n):
            point = point << 6 | data[at + k] & 0x3F
        found = _WIDE.of(point)
        for k in range(n):
            kind[at + k] = found


def pretoken_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of texts end to end begin. The bytes of each text must be UTF-8."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = _CLASS[data]
    lead = np.flatnonzero(data >= 0xC2)
    lead = lead[lead + 1 < n]
    wide = ((data[lead].astype(np.int64) & 0x1F) << 6) | (data[lead + 1] & 0x3F)
    kind[lead] = kind[lead + 1] = _CLASS[np.minimum(wide, 0x23F)]
    if len(lead) and data[lead].max() >= 0xC9:
        _wide_kinds(data, kind)
    first = offsets[:-1][offsets[1:] > offsets[:-1]]
    is_first = np.zeros(n, bool)
    is_first[first] = True
    start = np.empty(n, bool)
    start[0] = True
    start[1:] = kind[1:] != kind[:-1]
    start |= is_first
    # A last space before a word belongs to it; other white space before a word stands alone.
    after_space = np.flatnonzero(start & (kind != _SPACE) & ~is_first)
    after_space = after_space[kind[after_space - 1] == _SPACE]
    last = after_space - 1
    for _ in range(2):  # white space of two or three bytes
        last = last - ((data[last] & 0xC0) == 0x80)
    start[last] = True
    start[after_space[data[after_space - 1] == 0x20]] = False
    # An apostrophe that begins a pre-token takes the letters of a contraction.
    marks = np.flatnonzero((data == 0x27) & start)
    marks = marks[marks + 1 < n]
    marks = marks[(kind[marks + 1] == _LETTER) & ~is_first[marks + 1]]
    for letters in _CONTRACTIONS:
        size = len(letters)
        mine = marks[marks + size < n]
        for k, letter in enumerate(letters):
            mine = mine[(data[mine + 1 + k] == letter) & ~is_first[mine + 1 + k]]
        start[mine + 1] = False
        after = mine + 1 + size
        after = after[after < n]
        start[after[(kind[after] == _LETTER) & ~is_first[after]]] = True
    return np.flatnonzero(start)


class Strings:
    """Byte strings by number, kept end to end, so that many are looked up at once."""

    def __init__(self, strings: list[bytes]):
        self.sizes = np.array([len(s) for s in strings], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def join(self, numbers: np.ndarray) -> np.ndarray:
        return self.data[expand(self.starts[numbers], self.sizes[numbers])]


def _byte_letters() -> dict[str, int]:
    """The printable characters that stand for bytes in vocabulary files of this kind."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """A vocabulary file of the tokenizers library, for encoding and decoding of batches."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.path = path
        letters = _byte_letters()
        tokens: dict[int, bytes] = {}
        for token, number in described["model"]["vocab"].items():
            tokens[number] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        ranks = {token: number for number, token in tokens.items() if number not in self.special.values()}
        for content, number in self.special.items():
            tokens[number] = content.encode()
        self.strings = Strings([tokens.get(k, b"") for k in range(max(tokens) + 1)])
        before = described["pre_tokenizer"] or {}
        self.fast = (before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
                     and not described["normalizer"] and not described["post_processor"]
                     and set(self.special) <= {SPECIAL} and not described["model"].get("dropout"))
        self._merger = tiktoken.Encoding(
            "vocabulary", pat_str=r"[^\n]+|\n", mergeable_ranks=ranks, special_tokens={}) if self.fast else None
        self._line = ranks.get(b"\n")
        self.clear()

    @functools.cached_property
    def library(self) -> tokenizers.Tokenizer:
        """The tokenizers library itself, loaded when a text needs it."""
        found = tokenizers.Tokenizer.from_file(self.path)
        found.no_truncation()
        found.no_padding()
        return found

    @property
    def full(self) -> bool:
        return self.known > REMEMBERED

    def clear(self) -> None:
        """Forget all pre-tokens."""
        self.slots: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.counts = np.zeros(1 << 14, np.int64)
        self.steps = np.zeros(1 << 14, np.int32)  # in how many steps each was looked up
        self.used = self.known = 0

    def renew(self) -> None:
        """Forget the pre-tokens of one step only; all, if that leaves more than half of what may be remembered."""
        stay = np.flatnonzero(self.steps[:self.known] > 1)
        if len(stay) > REMEMBERED // 2:
            return self.clear()
        pieces, ids, counts = list(self.slots), self.ids_of(stay), self.counts[stay]
        self.clear()
        if len(stay):
            self._add([pieces[k] for k in stay.tolist()], ids, counts)

    def slow_rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts that the library must encode as a whole."""
        rows = len(offsets) - 1
        if not self.fast:
            return np.arange(rows)
        raw = data.tobytes()
        bad = [np.array(_not_utf8(data, raw, offsets), np.int64)]
        if b"|" in raw:  # the second byte of the special token
            marks = np.array([m.start() for m in re.finditer(re.escape(SPECIAL.encode()), raw)], np.int64)
            bad.append(hashing.doc_of(offsets, marks))
        return np.unique(np.concatenate(bad))

    def _merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens end to end, and how many each has. The merger gets them together, as lines, if each is one."""
        raw = b"\n".join(pieces)
        if raw.count(b"\n") < len(pieces) and (text := _decoded(raw)) is not None:
            found = self._merger.encode_to_numpy(text, disallowed_special=())
            is_end = found == self._line
            return found[~is_end], np.diff(np.flatnonzero(is_end), prepend=-1, append=len(found)) - 1
        # Those of several lines, and bytes that are no UTF-8, one at a time.
        line = np.array([b"\n" not in p and _decoded(p) is not None for p in pieces])
        order = np.argsort(~line, kind="stable")
        lists = [self._merger._encode_single_piece(pieces[k]) for k in order[line.sum():].tolist()]
        ids, counts = np.fromiter(itertools.chain.from_iterable(lists), np.uint32), np.array([len(x) for x in lists], np.int64)
        if line.any():
            line_ids, line_counts = self._merged([pieces[k] for k in order[:line.sum()].tolist()])
            ids, counts = np.concatenate([line_ids, ids]), np.concatenate([line_counts, counts])
        starts, back = np.cumsum(counts) - counts, np.argsort(order)
        return ids[expand(starts[back], counts[back])], counts[back]

    def _remember(self, pieces: list[bytes]) -> np.ndarray:
        """Encode different pre-tokens; their numbers."""
        return self._add(pieces, *self._merged(pieces))

    def _add(self, pieces: list[bytes], ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total, first, end = len(ids), self.known, self.known + len(pieces)
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), total), np.uint32)])
        if end > len(self.starts):
            more = np.zeros(max(len(self.starts), len(pieces)), np.int64)
            self.starts, self.counts = np.concatenate([self.starts, more]), np.concatenate([self.counts, more])
            self.steps = np.concatenate([self.steps, more.astype(np.int32)])
        self.ids[self.used:self.used + total] = ids
        self.starts[first:end], self.counts[first:end] = self.used + np.cumsum(counts) - counts, counts
        self.used += total
        self.known = end
        self.slots.update(zip(pieces, range(first, end)))
        return np.arange(first, end)

    def slots_of(self, data: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
        """The numbers of pre-tokens [start, next start); new ones are encoded."""
        if not len(starts):
            return np.zeros(0, np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [
            None, pa.py_buffer(np.append(starts, end).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        return self._slots(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]

    def _slots(self, pieces: list[bytes]) -> np.ndarray:
        """The numbers of different pre-tokens."""
        found = np.fromiter(map(self.slots.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(found < 0)
        if len(new):
            found[new] = self._remember([pieces[k] for k in new.tolist()])
        self.steps[found] += 1
        return found

    def ids_of(self, slots: np.ndarray) -> np.ndarray:
        return self.ids[expand(self.starts[slots], self.counts[slots])]

    def library_ids(self, text: bytes) -> np.ndarray:
        encoded = self.library.encode(text.decode("utf-8", "replace"), add_special_tokens=False)
        return np.array(encoded.ids, np.uint32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts end to end, and how many each text has."""
        if self.full:
            self.renew()
        slow = self.slow_rows(data, offsets)
        quick, quick_offsets, rows = without_rows(data, offsets, slow)
        starts = pretoken_starts(quick, quick_offsets)
        slots = self.slots_of(quick, starts, len(quick))
        bounds = np.searchsorted(starts, quick_offsets)
        totals = np.concatenate([[0], np.cumsum(self.counts[slots])])
        return self.put_back(data, offsets, slow, rows, self.ids_of(slots), np.diff(totals[bounds]))

    def put_back(self, data, offsets, slow, rows, ids, counts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, from those of the quick rows, with slow rows encoded by the library."""
        if not len(slow):
            return ids, counts
        parts: list = [None] * (len(offsets) - 1)
        cuts = np.concatenate([[0], np.cumsum(counts)])
        for k, row in enumerate(rows):
            parts[row] = ids[cuts[k]:cuts[k + 1]]
        for row in slow:
            parts[row] = self.library_ids(data[offsets[row]:offsets[row + 1]].tobytes())
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of id lists end to end, and where each list's begin and end."""
        sizes = np.concatenate([[0], np.cumsum(self.strings.sizes[ids])])
        return self.strings.join(ids), sizes[offsets]


def _decoded(raw: bytes) -> str | None:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return None


def _not_utf8(data: np.ndarray, raw: bytes, offsets: np.ndarray) -> list[int]:
    """Texts whose bytes are no UTF-8."""
    if raw.isascii():
        return []
    first = offsets[:-1][offsets[1:] > offsets[:-1]]
    if not ((data[first] & 0xC0) == 0x80).any():
        try:
            raw.decode()
            return []
        except UnicodeDecodeError:
            pass
    found = []
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        try:
            raw[a:b].decode()
        except UnicodeDecodeError:
            found.append(row)
    return found


def distinct_words(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts cut at each space: the distinct words, the number of every word in turn, and where each text's words begin."""
    texts = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [
        None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    split = pc.split_pattern(texts, b" ")
    coded = split.values.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), split.offsets.to_numpy().astype(np.int64)


def joined(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings end to end, and where each begins and ends."""
    return np.frombuffer(b"".join(pieces), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in pieces], dtype=np.int64)])


def without_rows(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts that are not in ``rows``, end to end, and their numbers."""
    stay = np.setdiff1d(np.arange(len(offsets) - 1), rows)
    if not len(rows):
        return data, offsets, stay
    sizes = np.diff(offsets)[stay]
    return data[expand(offsets[:-1][stay], sizes)], np.concatenate([[0], np.cumsum(sizes)]), stay


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, once per process."""
    return Vocabulary(path)
