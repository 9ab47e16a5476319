"""Language identification of code-switched text by a linear-chain conditional random field over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import crf, sampling
from pulsegrid.llm.scratch import release, small_batches
from pulsegrid.llm.textnum import column_bytes, slices

#: Labelled documents that the field is fitted on: at most so many of each language.
SAMPLE_PER_LANGUAGE = 600
UNDETERMINED = "und"


def _lexicon(batches, labels: list[np.ndarray], states: int, least: int = 3, purity: float = 0.9):
    """Words of at least ``least`` sampled documents, ``purity`` of whose documents have one language."""
    pairs = []
    for words, label in zip(batches, labels, strict=True):
        doc = np.repeat(np.arange(len(label)), np.diff(words.first))
        once = np.unique(np.stack([doc, words.which], 1), axis=0)
        pairs.append((words.hashes[once[:, 1]], label[once[:, 0]]))
    hashes = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.uint64)
    marks = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, np.int64)
    known, at = np.unique(hashes, return_inverse=True)
    counts = np.zeros((len(known), states))
    np.add.at(counts, (at, marks), 1)
    keep = (counts.sum(1) >= least) & (counts.max(1, initial=0) >= purity * counts.sum(1))
    return known[keep], counts.argmax(1)[keep] if len(known) else np.zeros(0, np.int64)


def fit(sample: pa.Table, epochs: int = 5, batch_bytes: int = 400_000) -> crf.Crf:
    """Fit on (text, label) rows; every word of a document carries its language. Labels sort as states."""
    names = sorted(set(sample["label"].to_pylist()))
    state = {name: i for i, name in enumerate(names)}
    order = np.random.default_rng(7).permutation(len(sample))
    sample = sample.take(pa.array(order)) if len(sample) else sample
    label = np.array([state[x] for x in sample["label"].to_pylist()], np.int64)
    data, offsets = column_bytes(sample["text"])
    ranges = list(slices(offsets, batch_bytes))
    parts = [(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], label[i:j]) for i, j in ranges]
    plain = crf.Features(bits=18)
    lexicon = _lexicon([plain.words(d, o) for d, o, _ in parts], [x for _, _, x in parts], max(1, len(names)))
    features = crf.Features(trigrams=True, bits=18, lexicon=lexicon)
    batches = []
    for d, o, x in parts:
        words = features.words(d, o)
        batches.append((words, np.repeat(x, np.diff(words.first))))
    model = crf.train(features, batches, max(1, len(names)), epochs=epochs)
    model.weights = model.weights.astype(np.float32)
    model.extra["names"] = names
    return model


def predict(model: crf.Crf, data: np.ndarray, offsets: np.ndarray, found: list | None = None):
    """Per document: state, mean marginal of it, words, and how often the best state changes inside. ``found`` gets
    (document, start, end, state) arrays: runs of words of one best state, with their character offsets."""
    n = len(offsets) - 1
    best, score = np.zeros(n, np.int64), np.zeros(n)
    words_of, changes = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, j in slices(offsets, crf.FIELD_BYTES):
        words = model.features.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        counts = np.diff(words.first)
        words_of[i:j] = counts
        if not len(words.which):
            continue
        emit = model.emissions(words).astype(np.float64)[words.which]
        gamma, _, _ = crf.forward_backward(emit, words.first, model.transitions, model.start)
        doc = np.repeat(np.arange(j - i), counts)
        mean = np.stack([np.bincount(doc, gamma[:, k], j - i) for k in range(model.states)], 1)
        mean /= np.maximum(counts, 1)[:, None]
        best[i:j] = mean.argmax(1)
        score[i:j] = mean.max(1)
        top = gamma.argmax(1)
        turned = (top[1:] != top[:-1]) & (doc[1:] == doc[:-1])
        changes[i:j] = np.bincount(doc[1:][turned], minlength=j - i)
        if found is not None:
            raw, offs = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            new = np.flatnonzero(np.concatenate([[True], turned | (doc[1:] != doc[:-1])]))
            last = np.concatenate([new[1:], [len(doc)]]) - 1
            base = chars[offs[doc[new]]]
            found.append((doc[new] + i, chars[words.starts[new]] - base, chars[words.ends[last]] - base, top[new]))
    return best, np.clip(score, 0, 1), words_of, changes


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", train: Column | None = None, per_language: int = SAMPLE_PER_LANGUAGE, runs: bool = True) -> DataFrame:
    """Predict each document's language from its whole text.

    The field is fitted on a bounded sample of the rows that ``train`` admits and whose ``lang`` is not
    null. A null text, or one without a letter, is ``und`` with score 0; with no labelled row at all every
    document is. Repeated keys are scored row by row. Only ``key`` and ``text`` are read for predictions, so
    further columns of any name do no harm. Returns key, lang_pred, score, n_words, n_switches and, unless ``runs``
    is false, runs: (start, end, lang) of the stretches of one language, in characters; none where it is ``und``.
    """
    model = _fitted(docs, key, text, lang, train, per_language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = model.value
        names = np.array([*field.extra["names"], UNDETERMINED], object)
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            stretches: list | None = [] if runs else None
            best, score, words, changes = predict(field, data, offsets, stretches)
            known = np.array(batch.column(2).fill_null(False)) & (words > 0) & (len(names) > 1)
            columns = [batch.column(0), pa.array(names[np.where(known, best, len(names) - 1)], pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(words), pa.array(changes)]
            if runs:
                doc, start, end, state = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*stretches) if stretches else [()] * 4))
                keep = known[doc]
                at = np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=batch.num_rows))])
                values = pa.StructArray.from_arrays([pa.array(start[keep].astype(np.int32)), pa.array(end[keep].astype(np.int32)), pa.array(names[state[keep]], pa.string())], names=["start", "end", "lang"])
                columns.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values))
            yield pa.RecordBatch.from_arrays(columns, names=[key, "lang_pred", "score", "n_words", "n_switches", *["runs"] * runs])
        release()

    rows = docs.select(key, text, F.col(text).rlike(r"\p{L}").alias("has_letter"))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double, n_words long, n_switches long" + ", runs array<struct<start:int,end:int,lang:string>>" * runs)


def _fitted(docs: DataFrame, key: str, text: str, lang: str, train: Column | None, per_language: int):
    """The field, broadcast."""
    spark = docs.sparkSession
    small_batches(spark)
    fit_rows = docs.where(F.col(lang).isNotNull() & F.col(key).isNotNull())
    if train is not None:
        fit_rows = fit_rows.where(train)
    keys = fit_rows.groupBy(key).agg(F.min(lang).alias("label"))
    sample = sampling.texts_of(docs, key, text, sampling.hashed_sample(keys, key, "label", per_language))
    model = fit(sample)
    release()
    return spark.sparkContext.broadcast(model)


def readable(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", train: Column | None = None, least: float = 0.3, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is determined with a score of ``least``."""
    model = _fitted(docs, key, text, lang, train, per_language)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, score, words, _ = predict(model.value, *column_bytes(batch.column(at)))
            yield batch.filter(pa.array((score >= least) & (words > 0)))
        release()

    return docs.where(F.col(text).rlike(r"\p{L}")).mapInArrow(run, docs.schema)
