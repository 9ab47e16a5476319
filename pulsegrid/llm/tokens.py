"""Token ids of a corpus in Parquet list columns, and reads of them.

Layout: rows in ascending key order, one file per range of keys. ``ids`` is a list of 32-bit integers with
dictionary encoding (a vocabulary's dictionary is under the page limit, so an id takes about two bytes);
keys, counts and positions are delta-encoded. Row groups and pages are kept small and page indexes are
written, so that a reader of some keys, or of metadata without ids, reads a few pages.
"""

from __future__ import annotations

import os
import re
import string
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.chunks import ChunkIds
from pulsegrid.llm.scratch import release, small_batches
from pulsegrid.llm.textnum import LOWER, column_bytes, slices, spans

END_ID = 1
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 5_000

_MARKS = "".join(c for c in string.punctuation if c != "'")  # an apostrophe may begin a word of its own
_CONTEXT = re.compile("[\u03a3\u0130]")  # lower-cased by context, or to two characters
#: Chunks a worker keeps: more than the usual number, since new words cost most here.
CACHE = 800_000
#: Bytes of whole texts that are encoded at a time; a longer text is encoded alone.
ENCODE_BYTES = 2 << 20
#: Bytes that no token spans; other white space stays inside chunks, which the whole tokenizer then splits.
_INSIDE = np.ones(256, bool)
_INSIDE[[9, 10, 13, 32]] = False
_words: dict[str, _Words] = {}
_codecs: dict[str, ChunkIds] = {}


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 stands for itself, and
    the other bytes, in order, for the letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Words:
    """Ids of chunks without white space. A run of letters with marks behind it is what the tokenizer's
    normaliser and splitter make of it at sight, so its model is asked directly; all else goes through the
    whole tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one thread; more would wait for each other
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # chunks hold no added token; lower-cased ones may look so
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.marks: dict[str, list[int]] = {"": []}
        probe = "Zq,! é."
        words = ["zq", ",!", "é", "."]
        self.direct = self.tokenizer.encode(probe, add_special_tokens=False).ids == [i for w in words for i in self.ask(w)]

    def ask(self, word: str) -> list[int]:
        """Ids of one normalised word by the model alone."""
        written = word if word.isascii() else word.encode("utf-8").decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(written)]

    def slow(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def whole(self, text: str) -> list[int]:
        """Ids of an uncut text by the library's default, which finds added tokens inside it."""
        self.tokenizer.encode_special_tokens = False
        try:
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        finally:
            self.tokenizer.encode_special_tokens = True

    def encode(self, chunks: list[tuple[str, bool]]) -> tuple[np.ndarray, np.ndarray]:
        chunks = [c for c, _ in chunks]
        found: list = [None] * len(chunks)
        rest = []
        tokenize = self.model.tokenize
        for i, chunk in enumerate(chunks):
            if self.direct and chunk.isascii() and chunk.isalpha() and len(chunk) < 200:
                found[i] = [t.id for t in tokenize(chunk.lower())]
                continue
            word = chunk.rstrip(_MARKS)
            if not (self.direct and word.isalpha() and len(word) < 200):
                rest.append(i)
                continue
            if word.isascii():
                ids = [t.id for t in tokenize(word.lower())]
            elif unicodedata.is_normalized("NFC", word) and not _CONTEXT.search(word):
                ids = [t.id for t in tokenize(word.lower().encode("utf-8").decode("latin-1").translate(self.letters))]
            else:
                rest.append(i)
                continue
            tail = chunk[len(word) :]
            if tail:
                more = self.marks.get(tail)
                if more is None:
                    more = self.marks[tail] = self.ask(tail)
                ids += more
            found[i] = ids
        for lo in range(0, len(rest), 5_000):
            some = rest[lo : lo + 5_000]
            for i, ids in zip(some, self.slow([chunks[i] for i in some]), strict=True):
                found[i] = ids
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())), sizes


def _cut(data: np.ndarray, offsets: np.ndarray):
    """Runs of bytes without white space."""
    return *spans(data, offsets, _INSIDE), None


def _codec(path: str) -> ChunkIds:
    """The tokenizer of a file, read once in each process. White space is dropped by it and ends every
    token, so a text's ids are those of its runs without white space; added tokens are left to ``encode``."""
    if path not in _codecs:
        _words[path] = _Words(path)
        _codecs[path] = ChunkIds(_cut, _words[path].encode, CACHE)
    return _codecs[path]


def encode(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a string column end to end, and where each text's begin (n + 1 values); null reads as empty.

    Texts that hold an added token's literal go through the whole tokenizer uncut and are not cached. The
    tokenizer lower-cases; doing so first for A to Z leaves fewer distinct chunks.
    """
    codec, words = _codec(path), _words[path]
    held = np.zeros(len(texts), bool)
    for literal in words.added:
        held |= np.array(pc.fill_null(pc.match_substring(texts, literal), False))
    if not held.any():
        data, offsets = column_bytes(texts)
        return codec(LOWER[data], offsets)
    data, offsets = column_bytes(pc.if_else(pa.array(held), "", texts))
    ids, starts = codec(LOWER[data], offsets)
    where = np.flatnonzero(held)
    whole = [words.whole(texts[int(i)].as_py()) for i in where]
    sizes = np.zeros(len(texts), np.int64)
    sizes[where] = list(map(len, whole))
    ids = np.insert(ids, np.repeat(starts[where], sizes[where]), np.fromiter(chain.from_iterable(whole), np.int32, int(sizes.sum())))
    return ids, starts + np.concatenate([[0], np.cumsum(sizes)])


def write(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int | None = END_ID) -> None:
    """Encode every whole text and write its ids, ``end_id`` appended, in ascending key order.

    Null and empty texts have only the end id. Rows with a null key come first, rows that repeat a key in
    the order of their texts. Other columns are not written. An empty table writes files without rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi in slices(column_bytes(batch.column(1))[1], ENCODE_BYTES):
                rows = batch.slice(lo, hi - lo)
                ids, starts = encode(tokenizer, rows.column(1))
                if end_id is not None:
                    ids = np.insert(ids, starts[1:], end_id)
                    starts = starts + np.arange(len(starts))
                lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.astype(np.int32)))
                n = rows.num_rows
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), lists, pa.array(np.diff(starts)), pa.array(np.full(n, part, np.int32)), pa.array(done + starts[:-1])],
                    names=["key", "ids", "n_tokens", "part", "part_start"],
                )
                done += int(starts[-1])
        release()

    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).repartitionByRange("key").sortWithinPartitions("key", "text")
    rows = rows.mapInArrow(run, f"key {kind}, ids array<int>, n_tokens long, part int, part_start long")
    options = {
        "parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size": PAGE_BYTES, "parquet.page.row.count.limit": PAGE_ROWS, "parquet.writer.version": "v2",
        "parquet.enable.dictionary": "true", "compression": "snappy",
        **{f"parquet.enable.dictionary#{c}": "false" for c in ("key", "n_tokens", "part_start")},
    }
    rows.write.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def read(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """key, ids, n_tokens and start, the number of ids before each row in the whole table."""
    rows = spark.read.parquet(path)
    totals = sorted(tuple(r) for r in rows.groupBy("part").agg(F.sum("n_tokens")).collect())  # a row per file
    before = np.concatenate([[0], np.cumsum([n for _, n in totals])])
    first = spark.createDataFrame([(p, int(b)) for (p, _), b in zip(totals, before[:-1], strict=True)], "part int, before long")
    rows = rows.join(F.broadcast(first), "part")
    return rows.select(F.col("key").alias(key), "ids", "n_tokens", (F.col("before") + F.col("part_start")).alias("start"))


def metadata(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """key, n_tokens and start only; no page of ids is read."""
    return read(spark, path, key).drop("ids")


def checksums(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens and the unsigned crc32 of the ids as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            offsets = np.array(lists.offsets)
            raw = memoryview(np.ascontiguousarray(np.array(lists.values), dtype="<u4")).cast("B")
            crcs = np.fromiter((zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(crcs)], names=[key, "start", "n_tokens", "ids_crc32"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "ids", "start", "n_tokens").mapInArrow(run, f"`{key}` {kind}, start long, n_tokens long, ids_crc32 long")
