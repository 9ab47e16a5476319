"""A corpus pipeline of five stages over ``documents``; each stage's output is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import decontaminate, langid, neardup, pieces, sampling, toxicity
from pulsegrid.llm.queries import table, tokenizer_file
from pulsegrid.llm.scratch import Scratch

#: Keys to drop that are broadcast at most; more are joined by shuffle.
BROADCAST_KEYS = 1_000_000


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` but for the rows of these keys."""
    keys = keys.select("doc_id").distinct()
    return docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, "doc_id", "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, table(spark, sf_dir, "labels"), train=sampling.fold("doc_id", 4) != 2)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.readable(docs, train=sampling.fold("doc_id", 3) != 1)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, neardup.group(docs, percent=80).where(~F.col("kept")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode_pieces),
]

#: SQL has no conditional random field, so no SQL gives these rows; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    scratch.close(STAGES[-1][0])
    return docs
