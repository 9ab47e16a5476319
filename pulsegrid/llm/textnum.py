"""Whole-batch text arithmetic: words and hashes of many documents without a Python loop per word.

An Arrow string column already is one run of UTF-8 bytes plus offsets. Every function here works on
that run, so cost is a few array passes per byte. Hashes are 64-bit polynomial hashes over a random
byte table, computed from prefix sums, so the hash of any byte range is two look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E6D62D06F6A9A9B  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

#: Bytes handled at a time; a longer document is handled alone.
SLICE_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[32, 9, 10, 11, 12, 13]] = False

LETTER_WORDS = np.zeros(256, bool)  # digits, A-Z, a-z and every byte of a non-ASCII character
LETTER_WORDS[48:58] = LETTER_WORDS[65:91] = LETTER_WORDS[97:123] = LETTER_WORDS[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 2 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offset of each row (n + 1 values); null reads as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    n = len(col)
    _, offs, data = col.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``limit`` bytes each."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the index of each document's first word (n + 1 values)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class Hasher:
    """Hashes of byte ranges of ``data``."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(BYTE_CODE[data] * _power(_BASE, n), out=self.sums[1:])
        self.back = _power(_INVERSE, n + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts])


def hash_text(text: str) -> int:
    """The hash that ``Hasher`` gives a range holding ``text``."""
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    return int(Hasher(data)(np.array([0]), np.array([len(data)]))[0])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each document's ``width``-word shingles.

    A-Z is lower-cased and words are runs without ASCII white space. A document of fewer words has one
    shingle, its whole word sequence; one without words has none.
    """
    data = LOWER[data]
    starts, ends, first = spans(data, offsets, SPACE_WORDS)
    words = Hasher(data)(starts, ends)
    mult = mix(np.arange(11, 11 + width, dtype=U64))
    count = np.diff(first)
    total = len(words)
    out: list[np.ndarray] = []
    body = np.zeros(max(0, total - width + 1), U64)
    for k in range(width):
        body += words[k : k + len(body)] * (mult[k] | U64(1))
    body = mix(body + U64(width))
    for d in range(len(count)):
        a, n = int(first[d]), int(count[d])
        if n >= width:
            out.append(np.unique(body[a : a + n - width + 1]))
        elif n:
            whole = np.sum(words[a : a + n] * (mult[:n] | U64(1)), dtype=U64) + U64(n)
            out.append(mix(np.array([whole], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


def minhash(sets: list[np.ndarray], size: int, seed: int = 1) -> np.ndarray:
    """(documents, size) uint32 minimum hashes; rows of empty sets are all ones bits."""
    out = np.full((len(sets), size), 0xFFFFFFFF, np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    flat = np.concatenate([sets[i] for i in full])
    at = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
    mult = (mix(np.arange(1, size + 1, dtype=U64) * U64(2 * seed + 1)) >> U64(32)).astype(np.uint32) | np.uint32(1)
    flat = (flat >> U64(32)).astype(np.uint32)  # already well mixed: odd multiples are permutations of it
    for k in range(size):
        out[full, k] = np.minimum.reduceat(flat * mult[k], at)
    return out
