"""Lempel-Ziv phrase fingerprints.

A document is parsed as LZ78 does: the shortest string not yet in the dictionary is the next phrase and
enters it. Phrases are hashed to 32 bits and the ``SKETCH`` least distinct hashes are the fingerprint; two
fingerprints are compared by the share of the least hashes of their union that both hold. Documents that
repeat each other's strings, and so compress each other, share phrases.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.scratch import small_batches
from pulsegrid.llm.textnum import U64, mix

SKETCH = 128
_BASE = U64(0x9E6D62D06F6A9A9B)
_INVERSE = U64(pow(0x9E6D62D06F6A9A9B, -1, 1 << 64))
#: Documents that are hashed together have about so many characters.
BATCH_CHARS = 1_000_000
#: Bytes of texts in a range of keys, which is one task, if the session's shuffle partitions do not make it less.
RANGE_BYTES = 32 << 20


def parse(text: str, known: set[str], phrase: str = "", at: int = 0) -> tuple[list[int], str]:
    """LZ78 on from a state: ends of the phrases completed in ``text`` (counted from ``at``), and the open phrase.

    ``known`` gains the phrases."""
    ends = []
    add, done = known.add, ends.append
    for i, c in enumerate(text, at + 1):
        phrase += c
        if phrase not in known:
            add(phrase)
            done(i)
            phrase = ""
    return ends, phrase


def _phrase_hashes(texts: list[str], ends: list[list[int]]) -> list[np.ndarray]:
    """32-bit hashes of the phrases of each text, which lie end to end from its beginning."""
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(raw)
    powers = np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(n, _BASE, U64)]))
    back = np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(n, _INVERSE, U64)]))
    sums = np.zeros(n + 1, U64)
    np.cumsum(mix(raw.astype(U64) + U64(1)) * powers[:n], out=sums[1:])
    begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    out = []
    for k, stops in enumerate(ends):
        e = np.array(stops, np.int64) + begin[k]
        s = np.concatenate([[begin[k]], e[:-1]]) if len(e) else e
        out.append((mix((sums[e] - sums[s]) * back[s]) >> U64(32)).astype(np.uint32))
    return out


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The least distinct hashes, sorted."""
    if len(hashes) > 4 * SKETCH:
        hashes = np.partition(hashes, 2 * SKETCH)[: 2 * SKETCH]
        least = np.unique(hashes)
        if len(least) >= SKETCH:
            return least[:SKETCH]
    return np.unique(hashes)[:SKETCH]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of the phrase sets; exact for small ones, 1 for two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    twice = both[1:] == both[:-1]
    first = np.concatenate([[True], ~twice])
    k = min(SKETCH, int(first.sum()))
    last = both[np.flatnonzero(first)[k - 1]]
    return float(np.count_nonzero(twice & (both[1:] <= last))) / k


def encoded(found: np.ndarray) -> str:
    return base64.b64encode(found.astype("<u4").tobytes()).decode()


def fingerprint(text: str) -> np.ndarray:
    """Fingerprint of one text."""
    ends, _ = parse(text, set())
    return sketch(_phrase_hashes([text], [ends])[0])


def _work(rows: list[tuple], following: str) -> list[tuple]:
    """Results of consecutive rows (key, text); ``following`` is the text after the last."""
    texts = [t for _, t in rows]
    after = [*texts[1:], following]
    whole, tails, tail_ends, kept, lengths = [], [], [], [], []
    for text, nxt in zip(texts, after, strict=True):
        n = len(text)
        cut = n - n // 2
        known: set[str] = set()
        ends, phrase = parse(text[:cut], known)
        seen, keep, start = known.copy(), len(ends), cut - len(phrase)
        rest, _ = parse(text[cut:], known, phrase, cut)
        more, _ = parse(nxt[: n // 2], seen, phrase, cut - start)
        whole.append(ends + rest)
        tails.append(text[start:cut] + nxt[: n // 2])
        tail_ends.append(more)
        kept.append(keep)
        lengths.append(n)
    last_ends, _ = parse(following, set())
    hashes = _phrase_hashes([*texts, following], [*whole, last_ends])
    tail_hashes = _phrase_hashes(tails, tail_ends)
    prints = [sketch(h) for h in hashes]
    out = []
    for i, (key, text) in enumerate(rows):
        n = lengths[i]
        edited = sketch(np.concatenate([hashes[i][: kept[i]], tail_hashes[i]]))
        sha = hashlib.sha256((text[: n - n // 2] + after[i][: n // 2]).encode("utf-8", "surrogatepass")).hexdigest()
        out.append((key, n, sha, encoded(prints[i]), encoded(edited), likeness(prints[i], edited), likeness(prints[i], prints[i + 1])))
    return out


def _heads(docs: DataFrame, buckets: int) -> list:
    """Least keys of about ``buckets`` ranges of keys with like numbers of rows: one row per range travels."""
    found = docs.where("key is not null").agg(F.percentile_approx("key", F.array(*[F.lit(i / buckets) for i in range(buckets)]), F.lit(20 * buckets)).alias("q")).collect()[0][0]
    edges = np.array(sorted(set(found or [])), np.int64)
    if not len(edges):
        return []

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.array(batch.column(0))
            if not len(keys):
                continue
            at = np.maximum(np.searchsorted(edges, keys, side="right") - 1, 0)
            low = np.full(len(edges), np.iinfo(np.int64).max)
            np.minimum.at(low, at, keys)
            has = np.unique(at)
            yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(low[has])], names=["at", "low"])

    rows = docs.where("key is not null").select("key").mapInArrow(least, "at long, low long").groupBy("at").agg(F.min("low").alias("low"))
    return sorted(r.low for r in rows.collect())


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit, whose last half is the first part of the next text.

    The next text is that of the next row by key (rows with a null key first, equal keys by text), after the
    last that of the first. A null text reads as empty; an empty text has an empty fingerprint, like
    another empty one (1.0) and unlike all others (0.0). A table of one row is its own next. Other columns
    are not read. Returns key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long")), F.count_if(F.col("key").isNull())).collect()[0]
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size[0] or 0) // RANGE_BYTES))
    heads = np.array(_heads(rows, buckets), np.int64)
    nulls = bool(size[1])
    last = max(0, len(heads) - 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row to the range of its key; the first of a range also follows the range before."""
        for batch in batches:
            keys = batch.column(0)
            none = np.array(keys.is_null())
            values = np.array(keys.fill_null(0))
            at = np.where(none, 0, np.maximum(np.searchsorted(heads, values, side="right") - 1, 0)) if len(heads) else np.zeros(len(values), np.int64)
            first = ~none & (heads[at] == values) if len(heads) else np.zeros(len(values), bool)
            leads = np.flatnonzero(first & (at > 0))  # to the range before
            wraps = np.flatnonzero(none if nulls else first & (at == 0))  # to the last range
            if nulls and len(wraps):  # the least text of the batch will do
                texts = batch.column(1)
                wraps = wraps[[min(range(len(wraps)), key=lambda i: texts[int(wraps[i])].as_py().encode("utf-8", "surrogatepass"))]]
            take = np.concatenate([np.arange(len(values)), leads, wraps])
            place = np.concatenate([at, at[leads] - 1, np.full(len(wraps), last)])
            copied = np.concatenate([np.zeros(len(values), np.int32), np.ones(len(leads), np.int32), np.full(len(wraps), 2, np.int32)])
            # In the last range, a copy of the very first row comes after everything else.
            moved = batch.take(pa.array(take))
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(copied), *moved.columns], names=["range", "copied", "key", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

        def out(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=names)

        held: list[tuple] = []
        chars, where, over = 0, None, False
        for batch in batches:
            for place, copied, k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != where:
                    where, over = place, False
                if over:  # further copies of the same head
                    continue
                if held and (copied or chars > BATCH_CHARS):
                    yield out(_work(held, t))
                    held, chars = [], 0
                if copied:
                    over = True
                else:
                    held.append((k, t))
                    chars += len(t)

    dealt = rows.mapInArrow(deal, "range long, copied int, key long, text string")
    ordered = dealt.repartitionByRange("range").sortWithinPartitions("range", "copied", "key", "text")
    found = ordered.mapInArrow(run, "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return found.withColumnRenamed("key", key)
