"""Toxic spans by a two-state conditional random field, and document scores from its marginals.

Only documents carry labels, so tokens are labelled first: a word, prefix or suffix whose share of toxic
documents is significantly above its share of clean ones (a G test, Bonferroni-corrected over all
features) marks its tokens inside toxic documents; every other token is clean. A token that an earlier
document of its label has among the same neighbours does not count again, else the words of copied
passages would look significant.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import crf, sampling
from pulsegrid.llm.scratch import release, small_batches
from pulsegrid.llm.textnum import U64, column_bytes, mix, slices

#: Labelled documents that the field is fitted on: at most so many of each label.
SAMPLE_PER_LABEL = 2500
THRESHOLD = 0.3
#: Words on either side by which a token in a copied passage is known.
AROUND = 4


def _fresh(parts) -> list[np.ndarray]:
    """Tokens of each part that no earlier document of the same label has among the same ``AROUND`` neighbours on
    either side. What documents copy from each other, whole or in passages, thus counts once, and what they
    add counts in full."""
    seen = []
    for words, label in parts:
        own = words.hashes[words.which]
        doc = np.repeat(np.arange(len(label)), np.diff(words.first))
        found = mix(own + label[doc].astype(U64))
        edge = np.full(AROUND, -1)
        wide, docs = np.concatenate([edge.astype(U64), own, edge.astype(U64)]), np.concatenate([edge, doc, edge])
        for step in (k for k in range(-AROUND, AROUND + 1) if k):
            at = slice(AROUND + step, AROUND + step + len(own))
            found += mix(np.where(docs[at] == doc, wide[at], U64(0)) + U64(step + AROUND)) * U64(2 * (step + AROUND) + 3)
        seen.append(found)
    every = np.concatenate([np.zeros(0, U64), *seen])
    fresh = np.zeros(len(every), bool)
    fresh[np.unique(every, return_index=True)[1]] = True
    return np.split(fresh, np.cumsum([len(x) for x in seen])[:-1]) if seen else []


def _feature_counts(parts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of either label that hold each feature in a fresh token, and how many documents the fresh tokens
    of either label amount to."""
    counts, totals = np.zeros((size, 2), np.float32), np.zeros(2)
    for words, label, fresh in parts:
        n = np.diff(words.first)
        doc = np.repeat(np.arange(len(label)), n)
        totals += np.bincount(label, np.bincount(doc[fresh], minlength=len(label)) / np.maximum(n, 1), 2)
        once = np.unique(doc[fresh] * np.int64(len(words.hashes)) + words.which[fresh])
        d, w = once // max(1, len(words.hashes)), once % max(1, len(words.hashes))
        slots = words.fixed[w]
        flat = np.unique(np.repeat(d, slots.shape[1]) * np.int64(size) + slots.ravel())
        d, slot = flat // size, flat % size
        for k in (0, 1):
            found, n = np.unique(slot[label[d] == k], return_counts=True)
            counts[found, k] += n
    counts[0] = 0
    return counts, totals


def _marked(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Features whose documents are toxic far too often for chance."""
    marked = np.zeros(len(counts), bool)
    tested = np.flatnonzero(counts[:, 1] >= 3)
    counts, seen = counts[tested].astype(float), len(tested)
    rate = totals[1] / max(1, totals.sum())
    n = counts.sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * sum(np.where(counts[:, k] > 0, counts[:, k] * np.log(counts[:, k] / (n * p)), 0) for k, p in ((0, 1 - rate), (1, rate)))
        toxic_share = counts[:, 1] / max(1, totals[1])
        clean_share = counts[:, 0] / max(1, totals[0])
    marked[tested] = (g >= 2 * np.log(max(2, seen))) & (toxic_share >= 8 * clean_share)
    return marked


def _document_logit(gamma: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Logit of the noisy-or of the tokens' squared marginals; squares keep many faint tokens from adding up."""
    quiet = np.bincount(doc, np.log1p(-np.clip(gamma * gamma, 0, 1 - 1e-9)), n)
    p = np.clip(-np.expm1(quiet), 1e-9, 1 - 1e-9)
    return np.clip(np.log(p / (1 - p)), -12, 12)


def _platt(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic fit of y on x, by Newton steps with a small ridge."""
    a, b = 0.5, 0.0
    for _ in range(40):
        p = 1 / (1 + np.exp(-(a * x + b)))
        r, w = weight * (p - y), weight * p * (1 - p) + 1e-9
        grad = np.array([np.sum(r * x) + 1e-3 * a, np.sum(r) + 1e-3 * b])
        hess = np.array([[np.sum(w * x * x) + 1e-3, np.sum(w * x)], [np.sum(w * x), np.sum(w) + 1e-3]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 1.0 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
    return float(a), float(b)


def _lean(words: crf.Words) -> crf.Words:
    """Without what only offsets need."""
    return dataclasses.replace(words, starts=np.zeros(0), ends=np.zeros(0), which=words.which.astype(np.int32))


def fit(sample: pa.Table, totals: dict[str, int], epochs: int = 8, batch_bytes: int = 400_000) -> crf.Crf:
    """Fit on (text, label '0' or '1') rows. totals: labelled rows of each label, to calibrate for their share."""
    order = np.random.default_rng(11).permutation(len(sample))
    sample = sample.take(pa.array(order)) if len(sample) else sample
    label = np.array([int(x) for x in sample["label"].to_pylist()], np.int64)
    data, offsets = column_bytes(sample["text"])
    features = crf.Features(prefixes=(3, 4, 5, 6, 7), suffixes=(3, 4, 5), bits=21)
    raw = [(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], label[i:j]) for i, j in slices(offsets, batch_bytes)]
    parts = [(_lean(features.words(d, o)), y) for d, o, y in raw]
    in_sample = np.bincount(label, minlength=2).astype(float)
    marked = _marked(*_feature_counts([(w, y, f) for (w, y), f in zip(parts, _fresh(parts), strict=True)], 1 << features.bits))
    batches = []
    for words, y in parts:
        hit = marked[words.fixed].any(1)
        doc = np.repeat(np.arange(len(y)), np.diff(words.first))
        batches.append((words, (hit[words.which] & (y[doc] == 1)).astype(np.int64)))
    model = crf.train(features, batches, 2, epochs=epochs)
    x = np.zeros(len(label))
    at = 0
    for words, y in parts:
        n = len(y)
        if len(words.which):
            gamma, _, _ = crf.forward_backward(model.emissions(words).astype(np.float64)[words.which], words.first, model.transitions, model.start)
            x[at : at + n] = _document_logit(gamma[:, 1], np.repeat(np.arange(n), np.diff(words.first)), n)
        else:
            x[at : at + n] = -12
        at += n
    weight = np.array([totals.get(str(k), 0) / max(1.0, in_sample[k]) for k in (0, 1)])[label] if len(label) else np.zeros(0)
    model.extra["platt"] = _platt(x, label.astype(float), weight) if len(set(label.tolist())) == 2 else (1.0, 0.0)
    model.weights = model.weights.astype(np.float32)
    return model


def score_documents(model: crf.Crf, data: np.ndarray, offsets: np.ndarray):
    """Per document: score and the (start, end) character offsets of offending tokens (marginal over half)."""
    n = len(offsets) - 1
    x = np.full(n, -12.0)
    spans: list[list[dict]] = [[] for _ in range(n)]
    for i, j in slices(offsets, crf.FIELD_BYTES):
        raw, offs = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        words = model.features.words(raw, offs)
        if not len(words.which):
            continue
        emit = model.emissions(words).astype(np.float64)[words.which]
        gamma, _, _ = crf.forward_backward(emit, words.first, model.transitions, model.start)
        doc = np.repeat(np.arange(j - i), np.diff(words.first))
        x[i:j] = np.where(np.diff(words.first) > 0, _document_logit(gamma[:, 1], doc, j - i), -12)
        hits = np.flatnonzero(gamma[:, 1] > 0.5)
        if len(hits):
            chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            base = chars[offs[doc[hits]]]
            for d, s, e in zip(doc[hits] + i, chars[words.starts[hits]] - base, chars[words.ends[hits]] - base, strict=True):
                spans[d].append({"start": int(s), "end": int(e)})
    a, b = model.extra["platt"]
    return 1 / (1 + np.exp(-(a * x + b))), spans


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", train: Column | None = None, threshold: float = THRESHOLD, per_label: int = SAMPLE_PER_LABEL) -> DataFrame:
    """Score each whole text for toxicity and give the offsets of offending words.

    ``labels`` has key and label (0 or 1; repeated keys count as toxic if any row is; other values and
    nulls are left out); ``train`` restricts its rows. The field is fitted on a bounded sample of each label.
    A null or empty text scores as one without any toxic word. With no labelled rows of both kinds scores
    come from an unfitted field. Repeated documents get equal scores. Returns key, score, predicted, spans.
    """
    model = _fitted(docs, labels, key, text, label, train, per_label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            value, spans = score_documents(model.value, *column_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(value), pa.array((value >= threshold).astype(np.int32)), pa.array(spans, span)],
                names=[key, "score", "predicted", "spans"],
            )
        release()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double, predicted int, spans array<struct<start:int,end:int>>")


def clean(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", train: Column | None = None, threshold: float = THRESHOLD, per_label: int = SAMPLE_PER_LABEL) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores under ``threshold``; see ``score``."""
    model = _fitted(docs, labels, key, text, label, train, per_label)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, _ = score_documents(model.value, *column_bytes(batch.column(at)))
            yield batch.filter(pa.array(value < threshold))
        release()

    return docs.mapInArrow(run, docs.schema)


def _fitted(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, train: Column | None, per_label: int):
    """The field, broadcast."""
    spark = docs.sparkSession
    small_batches(spark)
    marks = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1))
    if train is not None:
        marks = marks.where(train)
    keys = marks.groupBy(key).agg(F.max(label).cast("int").alias("label"))
    totals = {str(r[0]): r[1] for r in keys.groupBy("label").count().collect()}
    sample = sampling.texts_of(docs, key, text, sampling.hashed_sample(keys, key, "label", per_label))
    model = fit(sample, totals)
    release()
    return spark.sparkContext.broadcast(model)
