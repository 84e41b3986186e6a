"""Words, lines and shingles of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D``. A run of bytes is hashed as
a polynomial over a random table of byte values, so the hash of any slice costs two lookups
for each of three moduli. Modulo 2^64 alone, words can be built whose hashes are equal for
every base (Thue-Morse words); so two values modulo the prime 2^31 - 1, with random bases,
are mixed in. Two different slices of n bytes agree in both with a chance of at most
(n / 2^31)^2 over the bases, however the slices are built.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_PRIME = (1 << 31) - 1
GRAM = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PRIME_BASES = [int(b) for b in _RNG.integers(1 << 20, _PRIME, 2)]
_PRIME_BYTES = _RNG.integers(1, _PRIME, (2, 256), dtype=np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_PRIME_BYTES_LOWER = _PRIME_BYTES.copy()
_PRIME_BYTES_LOWER[:, ord("A") : ord("Z") + 1] = _PRIME_BYTES[:, ord("a") : ord("z") + 1]
_powers: dict[int, np.ndarray] = {}
_prime_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, SLICE_BYTES + 1)
        steps = np.full(size, base & (2**64 - 1), np.uint64)
        steps[0] = 1
        known = np.multiply.accumulate(steps)
        if size <= 4 * SLICE_BYTES:
            _powers[base] = known
    return known[:n]


def _fold(x: np.ndarray) -> np.ndarray:
    """A smaller value equal modulo the prime; below 2^32 for products of residues."""
    return (x & np.uint64(_PRIME)) + (x >> np.uint64(31))


def _prime_power(base: int, n: int) -> np.ndarray:
    """Powers of ``base`` modulo the prime, from 0 on."""
    known = _prime_powers.get(base)
    if known is None or len(known) < n:
        size = max(n, SLICE_BYTES + 1)
        known = np.ones(size, np.uint32)
        done = 1
        while done < size:
            more = min(done, size - done)
            step = np.uint64(pow(base, done, _PRIME))
            known[done : done + more] = known[:more].astype(np.uint64) * step % np.uint64(_PRIME)
            done += more
        if size <= 4 * SLICE_BYTES:
            _prime_powers[base] = known
    return known[:n]


class _PrimeSums:
    """Polynomial sums of a byte array modulo the prime. A term is below 2^32, so the running
    sum of any array that fits in memory stays below 2^64."""

    def __init__(self, data: np.ndarray, table: np.ndarray, base: int):
        terms = _fold(table[data] * _prime_power(base, len(data)))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(terms, out=self.sums[1:])
        self.inverse = _prime_power(pow(base, -1, _PRIME), len(data) + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        prime = np.uint64(_PRIME)
        return (self.sums[ends] - self.sums[starts]) % prime * self.inverse[starts] % prime


class Hasher:
    """Hashes of slices ``[start, end)`` of one byte array."""

    def __init__(self, data: np.ndarray, lower: bool = False):
        values = (_BYTE_LOWER if lower else _BYTE)[data] * _power(_BASE, len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values, out=self.sums[1:])
        self.inverse = _power(_INVERSE, len(data) + 1)
        tables = _PRIME_BYTES_LOWER if lower else _PRIME_BYTES
        self.primes = [_PrimeSums(data, t, b) for t, b in zip(tables, _PRIME_BASES)]

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        a, b = (p(starts, ends) for p in self.primes)
        own = mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])
        return mix(own + mix(a << np.uint64(31) | b))


def slices(
    column: pa.Array, most_bytes: int = SLICE_BYTES
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole rows of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset :][: len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + most_bytes, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes; a run never crosses a row."""
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(inside))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


class Words:
    """Words of a slice: ``starts``, ``ends``, ``hashes``; row ``r`` has ``first[r]:first[r + 1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.starts, self.ends = runs(~SPACE[data], offsets)
        self.hashes = Hasher(data, lower)(self.starts, self.ends)
        self.first = np.searchsorted(self.starts, offsets)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``k`` words from each word, and whether they are all of its row."""
        n = len(self.hashes)
        grams = np.zeros(n, np.uint64)
        for j in range(k):
            grams[: n - j] += self.hashes[j:] * GRAM[j] if j < n else np.uint64(0)
        last = np.repeat(self.first[1:], np.diff(self.first))
        return mix(grams), np.arange(n) + k <= last


def shingle_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """For every row the sorted distinct hashes of its ``k``-word shingles.

    A row of fewer words has its whole sequence as one shingle; one without words has none.
    """
    grams, whole = words.shingles(k)
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a >= k:
            yield np.unique(grams[a:b][whole[a:b]])
        elif b > a:
            short = words.hashes[a:b] * GRAM[k : k + b - a]
            short[:1] += GRAM[40 + b - a]
            yield mix(short.sum(dtype=np.uint64, keepdims=True))
        else:
            yield np.zeros(0, np.uint64)
