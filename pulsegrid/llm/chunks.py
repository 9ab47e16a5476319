"""Token ids of many texts from the ids of their distinct chunks.

A tokenizer that never joins characters across a chunk border gives a text the ids of its chunks end to
end. Chunks are byte ranges of a batch; each is known by its 64-bit hash, so that no string is made of a
chunk that a bounded cache holds already. Texts are put together by array gathers.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from pulsegrid.llm.textnum import U64, Hasher

#: Chunks kept in a worker, some 50 bytes each; beyond it the cache starts anew.
CACHE = 250_000
#: Bytes hashed at a time, some 30 bytes of arrays each.
HASH_BYTES = 256 << 10
_MARK = U64(0x9E3779B97F4A7C15)


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``flat[s : s + n]`` of every start and size, end to end."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64  # half the memory
    at = np.repeat((starts - ends + sizes).astype(kind), sizes)
    at += np.arange(total, dtype=kind)
    return flat[at]


class ChunkIds:
    """``cut`` gives the chunks of bytes and offsets: begin, end, each text's first chunk (n + 1 values) and a mark
    that tells apart chunks of equal bytes. ``encode`` maps a list of (chunk, mark) to their ids end to end
    and the number of each."""

    def __init__(self, cut: Callable, encode: Callable[[list[tuple[str, bool]]], tuple[np.ndarray, np.ndarray]], cache: int = CACHE):
        self.cut, self.encode, self.cache = cut, encode, cache
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, U64)  # sorted
        self.slots = np.zeros(0, np.int32)  # of each key
        self.flat = np.zeros(0, np.int32)
        self.sizes = np.zeros(0, np.int32)  # by slot
        self.starts = np.zeros(0, np.int64)

    def _hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of chunk ranges, some ``HASH_BYTES`` of bytes at a time."""
        out = np.empty(len(starts), U64)
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + HASH_BYTES, side="right")))
            base = starts[i]
            out[i:j] = Hasher(data[base : ends[j - 1]])(starts[i:j] - base, ends[i:j] - base)
            i = j
        return out

    def _place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where sorted keys are, or belong, among the cache's, and whether they are there."""
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        return at, known

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids (int32) end to end, and where each text's begin (n + 1 values)."""
        if len(self.keys) > self.cache:
            self._clear()
        starts, ends, first, mark = self.cut(data, offsets)
        keys = self._hashes(data, starts, ends)
        if mark is not None:
            keys[mark] ^= _MARK
        keys, where, which = np.unique(keys, return_index=True, return_inverse=True)
        at, known = self._place(keys)
        fresh = np.flatnonzero(~known)
        if len(fresh):
            w = where[fresh]
            marks = mark[w].tolist() if mark is not None else [False] * len(w)
            texts = [(data[s:e].tobytes().decode("utf-8", "replace"), m) for s, e, m in zip(starts[w].tolist(), ends[w].tolist(), marks, strict=True)]
            ids, sizes = self.encode(texts)
            slots = np.arange(len(self.sizes), len(self.sizes) + len(fresh), dtype=np.int32)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
            self.sizes = np.concatenate([self.sizes, sizes.astype(np.int32)])
            self.keys, self.slots = np.insert(self.keys, at[fresh], keys[fresh]), np.insert(self.slots, at[fresh], slots)
            at = np.searchsorted(self.keys, keys)
        slots = self.slots[at][which.reshape(-1)]
        sizes = self.sizes[slots].astype(np.int64)
        ids = gather(self.flat, self.starts[slots], sizes)
        return ids, np.concatenate([[0], np.cumsum(sizes)])[first]
