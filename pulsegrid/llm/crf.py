"""Linear-chain conditional random field over words, in numpy.

A word's emission scores are sums of weights of hashed features: the word, its prefixes, suffixes and
optionally its byte trigrams, plus lexicon features. Emissions are computed once per distinct word of a
batch. Forward-backward runs over blocks of ``BLOCK`` words of all documents at once: each block's
transfer matrix first, then one pass over the blocks of each document, then the words inside all blocks,
so that one very long document costs few array operations and marginals are exact.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from pulsegrid.llm.textnum import LETTER_WORDS, LOWER, U64, Hasher, mix, spans

BLOCK = 48
#: Bytes of whole texts whose marginals are taken at a time, some 60 bytes of arrays each; a longer text is taken alone.
FIELD_BYTES = 256 << 10


@dataclass
class Words:
    """Words of a batch: per token the index of its distinct word, and feature ids of the distinct words."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    which: np.ndarray
    hashes: np.ndarray
    fixed: np.ndarray
    grams: np.ndarray
    gram_at: np.ndarray


@dataclass
class Features:
    """Which features a word has. ``bits``: the weight table has 2**bits rows; row 0 weighs nothing."""

    prefixes: tuple[int, ...] = (2, 3, 4, 5, 6)
    suffixes: tuple[int, ...] = (2, 3, 4)
    trigrams: bool = False
    bits: int = 20
    lexicon: tuple[np.ndarray, np.ndarray] | None = None  # sorted word hashes and the class of each

    def slot(self, hashes: np.ndarray, kind: int) -> np.ndarray:
        salted = mix(hashes + U64(kind * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        return np.maximum((salted >> U64(64 - self.bits)).astype(np.int64), 1)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> Words:
        data = LOWER[data]
        starts, ends, first = spans(data, offsets, LETTER_WORDS)
        hasher = Hasher(data)
        hashes, at, which = np.unique(hasher(starts, ends), return_index=True, return_inverse=True)
        s, e = starts[at], ends[at]
        columns = [self.slot(hashes, 1)]
        for k in self.prefixes:
            columns.append(np.where(e - s > k, self.slot(hasher(s, np.minimum(s + k, e)), 10 + k), 0))
        for k in self.suffixes:
            columns.append(np.where(e - s > k, self.slot(hasher(np.maximum(e - k, s), e), 30 + k), 0))
        if self.lexicon is not None and len(self.lexicon[0]):
            known, kind = self.lexicon
            at_known = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            found = known[at_known] == hashes
            columns.append(np.where(found, self.slot(kind[at_known].astype(U64), 70), 0))
        grams, gram_at = np.zeros(0, np.int64), np.zeros(len(s) + 1, np.int64)
        if self.trigrams and len(s):
            n = np.maximum(e - s - 2, 1)
            gram_at[1:] = np.cumsum(n)
            inside = np.arange(gram_at[-1]) - np.repeat(gram_at[:-1], n) + np.repeat(s, n)
            grams = self.slot(hasher(inside, np.minimum(inside + 3, np.repeat(e, n))), 50)
        fixed = np.stack(columns, 1).astype(np.int32) if len(s) else np.zeros((0, len(columns)), np.int32)
        return Words(starts, ends, first, which.reshape(-1), hashes, fixed, grams, gram_at)


@dataclass
class Crf:
    features: Features
    weights: np.ndarray  # (2**bits, states)
    transitions: np.ndarray  # (states, states)
    start: np.ndarray  # (states,)
    extra: dict = field(default_factory=dict)

    @property
    def states(self) -> int:
        return len(self.start)

    def emissions(self, words: Words) -> np.ndarray:
        """(distinct words, states) scores."""
        out = self.weights[words.fixed].sum(1)
        if len(words.grams):
            sums = np.add.reduceat(self.weights[words.grams], words.gram_at[:-1], axis=0)
            out = out + sums / np.sqrt(np.diff(words.gram_at))[:, None]
        return out


def forward_backward(score: np.ndarray, first: np.ndarray, transitions: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Marginals of every token, exact over whole documents.

    score: (tokens, K) emission scores of all documents end to end; first: index of each document's first
    token (n + 1 values). Returns (tokens, K) marginals and, with ``pairs``, the expected number of each
    transition and of each starting state.
    """
    total, states = score.shape
    lengths = np.diff(first)
    blocks = -(-lengths // BLOCK)
    block_at = np.concatenate([[0], np.cumsum(blocks)])
    n_blocks = int(block_at[-1])
    if not n_blocks:
        return np.zeros((0, states)), np.zeros((states, states)), np.zeros(states)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    inside = np.arange(total) - first[doc]
    row, col = block_at[doc] + inside // BLOCK, inside % BLOCK
    emit = np.ones((BLOCK, n_blocks, states))
    real = np.zeros((BLOCK, n_blocks), bool)
    emit[col, row] = np.exp(score - score.max(1, keepdims=True))
    real[col, row] = True
    move = np.exp(transitions - transitions.max())
    begin = np.exp(start - start.max())
    head = np.zeros(n_blocks, bool)
    head[block_at[:-1][lengths > 0]] = True

    carry = np.broadcast_to(np.eye(states), (n_blocks, states, states)).copy()  # transfer of each block
    for t in range(BLOCK):
        live = real[t]
        if not live.any():
            break
        step = np.matmul(carry, move)
        if t == 0:  # a document's first word has no word before it
            step[head] = np.eye(states)
        step *= emit[t][:, None, :]
        step /= step.sum((1, 2), keepdims=True)
        carry = np.where(live[:, None, None], step, carry)

    alpha_in = np.ones((n_blocks, states))
    beta_out = np.ones((n_blocks, states))
    order = np.argsort(-blocks, kind="stable")
    ranked = blocks[order]
    deepest = int(ranked[0]) if len(ranked) else 0
    live_docs = [order[: np.searchsorted(-ranked, -(k + 1), side="right")] for k in range(deepest)]
    now = np.tile(begin, (len(lengths), 1))
    for k in range(deepest):
        docs = live_docs[k]
        at = block_at[docs] + k
        alpha_in[at] = now[docs]
        x = np.einsum("nk,nkj->nj", now[docs], carry[at])
        now[docs] = x / x.sum(1, keepdims=True)
    now = np.ones((len(lengths), states))
    for k in range(deepest - 1, -1, -1):
        docs = live_docs[k]
        at = block_at[docs] + k
        beta_out[at] = now[docs]
        x = np.einsum("nkj,nj->nk", carry[at], now[docs])
        now[docs] = x / x.sum(1, keepdims=True)

    alphas = np.empty((BLOCK, n_blocks, states))
    now = alpha_in
    for t in range(BLOCK):
        x = now @ move
        if t == 0:
            x[head] = alpha_in[head]
        x = x * emit[t]
        x /= x.sum(1, keepdims=True)
        now = np.where(real[t][:, None], x, now)
        alphas[t] = now
    expected, began = np.zeros((states, states)), np.zeros(states)
    gamma = np.empty((BLOCK, n_blocks, states))
    after = beta_out
    for t in range(BLOCK - 1, -1, -1):
        live = real[t][:, None]
        g = alphas[t] * after
        gamma[t] = g / g.sum(1, keepdims=True)
        ahead = emit[t] * after
        back = ahead @ move.T
        if pairs:
            prev = alpha_in if t == 0 else alphas[t - 1]
            rows = real[t] & ~head if t == 0 else real[t]
            joint = prev[rows][:, :, None] * move[None] * ahead[rows][:, None, :]
            expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        after = np.where(live, back / back.sum(1, keepdims=True), after)
    if pairs:
        began = gamma[0][head].sum(0)
    return gamma[col, row], expected, began


def train(features: Features, batches: list[tuple[Words, np.ndarray]], states: int, epochs: int = 6, rate: float = 0.5, decay: float = 1e-6) -> Crf:
    """Maximise the conditional likelihood of token labels by AdaGrad over the batches.

    batches: words of some documents and a label per token.
    """
    size = 1 << features.bits
    model = Crf(features, np.zeros((size, states), np.float32), np.zeros((states, states)), np.zeros(states))
    seen = np.full((size, 1), 1e-6, np.float32)
    seen_moves, seen_start = 1e-6, 1e-6
    touched = []
    for words, _ in batches:  # each batch updates only the weights of its own features
        slots, at = np.unique(np.concatenate([words.fixed.ravel(), words.grams]), return_inverse=True)
        at = at.astype(np.int32)
        touched.append((slots, at[: words.fixed.size], at[words.fixed.size :]))
    for _ in range(epochs):
        for (words, labels), (slots, at_fixed, at_grams) in zip(batches, touched, strict=True):
            if not len(words.which):
                continue
            emit = model.emissions(words).astype(np.float64)
            gamma, expected, began = forward_backward(emit[words.which], words.first, model.transitions, model.start, True)
            tokens = len(labels)
            one = np.zeros((tokens, states))
            one[np.arange(tokens), labels] = 1
            diff = one - gamma
            by_word = np.stack([np.bincount(words.which, diff[:, k], len(words.hashes)) for k in range(states)], 1)
            wide = np.repeat(by_word, words.fixed.shape[1], axis=0)
            grad = np.stack([np.bincount(at_fixed, wide[:, k], len(slots)) for k in range(states)], 1)
            if len(words.grams):
                n = np.diff(words.gram_at)
                share = np.repeat(by_word / np.sqrt(n)[:, None], n, axis=0)
                grad += np.stack([np.bincount(at_grams, share[:, k], len(slots)) for k in range(states)], 1)
            grad /= np.sqrt(tokens)
            grad -= decay * model.weights[slots]
            grad[slots == 0] = 0
            seen[slots] += (grad * grad).max(1, keepdims=True)
            model.weights[slots] += rate * grad / np.sqrt(seen[slots])
            docs = words.first[:-1][np.diff(words.first) > 0]
            nxt = np.ones(tokens, bool)
            nxt[docs] = False
            at = np.flatnonzero(nxt)
            moved = np.zeros((states, states))
            np.add.at(moved, (labels[at - 1], labels[at]), 1)
            g = (moved - expected) / np.sqrt(tokens)
            seen_moves += float((g * g).max())
            model.transitions += 0.3 * g / np.sqrt(seen_moves)
            g = (np.bincount(labels[docs], minlength=states) - began) / np.sqrt(max(1, len(docs)))
            seen_start += float((g * g).max())
            model.start += 0.3 * g / np.sqrt(seen_start)
    model.weights[0] = 0
    return model
