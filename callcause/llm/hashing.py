"""Hashes of byte ranges, words and word runs, for whole batches of texts at once.

A range hash is a polynomial over random values of the bytes, read off prefix
sums, so that any range costs the same whatever its length. There are two kinds.
Modulo the prime 2^61 - 1 (``prime_...``) two different ranges of n values agree
at no more than n of its bases. Modulo 2^64 a hash is cheaper, but there are long
texts that agree at every odd base: who takes such hashes for equality must
compare the bytes as well.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)
_PRIME = (1 << 61) - 1
_P = np.uint64(_PRIME)
_BASE = 0x9E3779B97F4A7C15 | 1
_PRIME_BASE = _BASE % _PRIME
_LOW32, _LOW29 = np.uint64((1 << 32) - 1), np.uint64((1 << 29) - 1)
_B3, _B29, _B32, _B61 = np.uint64(3), np.uint64(29), np.uint64(32), np.uint64(61)
_MASK = (1 << 64) - 1
_SIZE_FACTOR = 0xD6E8FEB86659FD93
_VALUES = np.random.default_rng(20_24).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + _ONE
_PRIME_VALUES = np.random.default_rng(20_25).integers(1, _PRIME, 256, dtype=np.uint64)
_powers = {name: np.ones(1, np.uint64) for name in ("up", "down", "prime up", "prime down")}
# Numbers that are multiplied at once, so that intermediate results stay in the processor's cache.
_PIECE = 1 << 14


def _reduce(x: np.ndarray) -> np.ndarray:
    """64-bit numbers modulo the prime."""
    x = (x & _P) + (x >> _B61)
    return np.where(x >= _P, x - _P, x)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, by halves; both below it."""
    high_a, high_b, low_a, low_b = a >> _B32, b >> _B32, a & _LOW32, b & _LOW32
    cross = high_a * low_b + low_a * high_b
    low = low_a * low_b
    total = ((high_a * high_b) << _B3) + (cross >> _B29) + ((cross & _LOW29) << _B32) + (low & _P) + (low >> _B61)
    return _reduce(total)


def _multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if len(a) <= _PIECE:
        return _product(a, b)
    out = np.empty(len(a), np.uint64)
    for low in range(0, len(a), _PIECE):
        out[low:low + _PIECE] = _product(a[low:low + _PIECE], b[low:low + _PIECE])
    return out


def _less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a - b modulo the prime."""
    return np.where(a >= b, a - b, a + _P - b)


def _table(which: str, size: int) -> np.ndarray:
    """Powers of the base modulo 2^64, or of its inverse."""
    if len(_powers[which]) < size:
        base = _BASE if which == "up" else pow(_BASE, -1, 1 << 64)
        steps = np.full(max(size + size // 8, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[which] = np.cumprod(steps, dtype=np.uint64)
    return _powers[which][:size]


def _prime_table(which: str, size: int) -> np.ndarray:
    """The same modulo the prime, by doubling."""
    found = _powers[which]
    while len(found) < size:
        base = _PRIME_BASE if which == "prime up" else pow(_PRIME_BASE, -1, _PRIME)
        step = np.uint64(pow(base, len(found), _PRIME))
        found = _powers[which] = np.concatenate([found, _multiply(found, np.full(len(found), step, np.uint64))])
    return found[:size]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _sums(terms: np.ndarray) -> np.ndarray:
    """Running sums modulo the prime, by halves, with a zero in front."""
    out = np.zeros(len(terms) + 1, np.uint64)
    high = np.cumsum(terms >> _B32, dtype=np.uint64)
    low = np.cumsum(terms & _LOW32, dtype=np.uint64)
    out[1:] = _reduce((high >> _B29) + ((high & _LOW29) << _B32) + (low & _P) + (low >> _B61))
    return out


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums that ``ranges`` reads; one more entry than there are values."""
    n = len(values)
    out = np.empty(n + 1, np.uint64)
    out[0] = 0
    np.cumsum(values * _table("up", n), out=out[1:])
    return out


def byte_prefix(data: np.ndarray) -> np.ndarray:
    return prefix(_VALUES[data])


def ranges(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each range [start, end) of the values behind the sums."""
    spans = (sums[end] - sums[start]) * _table("down", len(sums))[start]
    return mix(spans + (end - start).astype(np.uint64) * np.uint64(_SIZE_FACTOR))


def fixed_ranges(sums: np.ndarray, size: int) -> np.ndarray:
    """Hash of the range of ``size`` values at every start."""
    n = len(sums) - size
    return mix((sums[size:] - sums[:n]) * _table("down", n) + np.uint64(size * _SIZE_FACTOR & _MASK))


def prime_prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums that ``prime_ranges`` reads; one more entry than there are values."""
    return _sums(_multiply(_reduce(values), _prime_table("prime up", len(values))))


def prime_byte_prefix(data: np.ndarray) -> np.ndarray:
    return _sums(_multiply(_PRIME_VALUES[data], _prime_table("prime up", len(data))))


def prime_ranges(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each range [start, end) of the values behind the sums."""
    spans = _multiply(_less(sums[end], sums[start]), _prime_table("prime down", len(sums))[start])
    return mix(spans + (end - start).astype(np.uint64) * np.uint64(_SIZE_FACTOR))


def prime_fixed_ranges(sums: np.ndarray, size: int) -> np.ndarray:
    """Hash of the range of ``size`` values at every start."""
    n = len(sums) - size
    return mix(_multiply(_less(sums[size:], sums[:n]), _prime_table("prime down", n)) + np.uint64(size * _SIZE_FACTOR & _MASK))


def lower_table() -> np.ndarray:
    """Lower-cases A-Z and leaves other bytes."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = lower_table()


class Words:
    """The words of a batch of texts: where they start and end, their hashes, and each text's range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray):
        data = LOWER[data]
        inside = word_bytes[data]
        filled = offsets[1:] > offsets[:-1]
        before = np.empty_like(inside)
        before[:1], before[1:] = False, inside[:-1]
        before[offsets[:-1][filled]] = False
        after = np.empty_like(inside)
        after[-1:], after[:-1] = False, inside[1:]
        after[offsets[1:][filled] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.hashes = prime_ranges(prime_byte_prefix(data), self.starts, self.ends)
        self.offsets = np.searchsorted(self.starts, offsets)
        self.sums = prime_prefix(self.hashes)

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of ``size`` words inside one text."""
        n = len(self.hashes)
        if n < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        hashes = prime_fixed_ranges(self.sums, size)
        whole = np.ones(len(hashes), bool)
        for back in range(1, size):  # starts too near the end of a text
            ends = self.offsets[1:] - back
            ends = ends[(ends >= 0) & (ends < len(whole))]
            whole[ends] = False
        first = np.flatnonzero(whole)
        return first, hashes[first]


def doc_of(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Which text each position lies in."""
    return np.searchsorted(offsets, positions, "right") - 1


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start and count, end to end."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


def same_bytes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray,
               other: np.ndarray, other_starts: np.ndarray, step: int = 1 << 17) -> np.ndarray:
    """Whether each range of ``data`` equals the range of ``other`` of the same size, byte by byte."""
    same = np.ones(len(starts), bool)
    ends = np.cumsum(sizes)
    low = 0
    while low < len(starts):  # about ``step`` bytes at a time
        before = ends[low - 1] if low else 0
        high = max(int(np.searchsorted(ends, before + step, "right")), low + 1)
        part = slice(low, high)
        differ = np.flatnonzero(data[expand(starts[part], sizes[part])] != other[expand(other_starts[part], sizes[part])])
        same[low + np.searchsorted(ends[part] - before, differ, "right")] = False
        low = high
    return same
