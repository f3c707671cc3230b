"""Vectorised text primitives over Arrow string columns.

Everything here works on the raw UTF-8 bytes of a batch with numpy, so that no
Python code runs per word. A word is a maximal run of bytes outside
``[\\x20\\x09-\\x0D]``; its 64-bit hash is a polynomial of seeded per-byte values,
finished with the splitmix64 mixer. Polynomials modulo 2**64 can be made to agree for
long words (whatever the base, in Thue-Morse order), so words over ``LONG_WORD`` bytes take
BLAKE2b. Blocks hold whole documents of at most ``BLOCK_BYTES`` together, or one longer one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
#: Bytes that are summed at a time, and over which a word is hashed by BLAKE2b.
SUM_BYTES = 1 << 18
LONG_WORD = 48
#: Most powers of a base that a worker holds on to.
KEPT_POWERS = 1 << 19
#: Words that make up a shingle, and the similarity from which texts are near-duplicates.
SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 75

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeded(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix64((np.arange(1, n + 1, dtype=np.uint64) + _U(seed << 32)) * _U(0x9E3779B97F4A7C15))


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32

_BYTE_VALUES = seeded(11, 256)
_FOLDED_VALUES = _BYTE_VALUES[FOLD]
_TERMS = seeded(12, 64) | _U(1)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; at most KEPT_POWERS of them stay in memory."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1024), base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= KEPT_POWERS:
            _powers[base] = have
    return have[:n]


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return offsets, data


def hash_words(data: np.ndarray, bounds: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of data, and where each document's words begin (len(bounds) values).

    bounds: byte offsets of the documents in data, with the end. Beside the hashes this takes a
    few bytes for each byte of data: sums are made for ``SUM_BYTES`` at a time.
    """
    n = len(data)
    if n == 0:
        return np.empty(0, np.uint64), np.zeros(len(bounds), np.int64)
    space = SPACE[data]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    inner = bounds[1:-1]
    inner = inner[inner < n]
    before[inner] = True
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = space[1:]
    after[inner[inner > 0] - 1] = True
    word = ~space
    starts = np.flatnonzero(word & before)
    ends = np.flatnonzero(word & after) + 1
    hashes = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + SUM_BYTES)))
        lo, hi = int(starts[first]), min(n, int(starts[last - 1]) + LONG_WORD)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((_FOLDED_VALUES if fold else _BYTE_VALUES)[data[lo:hi]] * powers(_BASE, hi - lo), out=sums[1:])
        at = starts[first:last] - lo
        hashes[first:last] = (sums[np.minimum(ends[first:last] - lo, hi - lo)] - sums[at]) * powers(_BASE_INV, hi - lo)[at]
        first = last
    hashes = mix64(hashes)
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        raw = data[starts[i] : ends[i]]
        hashes[i] = int.from_bytes(hashlib.blake2b((FOLD[raw] if fold else raw).tobytes(), digest_size=8).digest(), "little")
    return hashes, np.searchsorted(starts, bounds)


def word_blocks(column: pa.Array, fold: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first document, word hashes, word offsets) for blocks of whole documents."""
    offsets, data = utf8_parts(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, side="right")) - 1)
        lo = offsets[at]
        hashes, begin = hash_words(data[lo : offsets[upto]], offsets[at : upto + 1] - lo, fold)
        yield at, hashes, begin
        at = upto


def shingle_set(words: np.ndarray, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word sequences of the given size; fewer words make one."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    if n < size:
        return mix64((words * _TERMS[:n]).sum(dtype=np.uint64, keepdims=True) + _U(n) * _TERMS[63])
    sums = words[: n - size + 1] * _TERMS[0]
    for t in range(1, size):
        sums += words[t : n - size + 1 + t] * _TERMS[t]
    return np.unique(mix64(sums))
