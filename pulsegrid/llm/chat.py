"""Chat transcripts: roles of turns by a hidden Markov model, then canonical rendering.

A turn's observation combines a speaker marker at its start, a question mark, list or code lines, its
length class and whether it opens the conversation. Start, transition and emission probabilities are
smoothed counts over all labelled turns. Viterbi runs in blocks of ``BLOCK`` turns: the best score between
each pair of states across a block is a small max-plus matrix; matrices of up to ``BLOCK`` blocks combine
into one, again and again, until a conversation is one matrix; the best end states then come back down
the same tree. So no task holds a whole conversation, however long, and the path is the exact best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.scratch import Scratch

BLOCK = 256
STATES = ("system", "user", "assistant")
K = len(STATES)

#: Speaker markers at the start of a turn, by role. Fixed values.
MARKERS = {
    "system": r"(?i)^\s*(<\|im_start\|>\s*system|<\|system\|>|\[system\]|#+\s*system\b|system(\s+prompt)?\s*:)",
    "user": r"(?i)^\s*(<\|im_start\|>\s*user|<\|user\|>|\[inst\]|\[user\]|#+\s*(user|human)\b|(user|human|question|q)\s*:)",
    "assistant": r"(?i)^\s*(<\|im_start\|>\s*assistant|<\|assistant\|>|\[assistant\]|#+\s*(assistant|response)\b|(assistant|bot|ai|answer|a)\s*:)",
}
_STRIP = r"(?is)^\s*(<\|im_start\|>\s*(system|user|assistant)\s*|<\|(system|user|assistant)\|>\s*|\[/?(inst|system|user|assistant)\]\s*|#+\s*(system|user|human|assistant|response)\b:?\s*|(system(\s+prompt)?|user|human|question|q|assistant|bot|ai|answer|a)\s*:\s*)"


def observation(text: Column, opens: Column) -> Column:
    """Line features of a turn as one number below ``OBSERVATIONS``."""
    marker = F.lit(0)
    for i, role in enumerate(STATES):
        marker = F.when(text.rlike(MARKERS[role]), i + 1).otherwise(marker)
    size = F.length(text)
    length = F.when(size < 40, 0).when(size < 120, 1).when(size < 400, 2).when(size < 1200, 3).otherwise(4)
    asks, shaped = text.rlike(r"\?\s*$"), text.rlike(r"(?m)^\s*([-*] |\d+[.)] |```)")
    code = ((marker * 5 + length) * 2 + asks.cast("int")) * 2 + shaped.cast("int")
    return F.coalesce(code * 2 + opens.cast("int"), F.lit(0)).cast("int")


OBSERVATIONS = 4 * 5 * 2 * 2 * 2


def _tables(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smoothed log start, transition and emission tables from the labelled turns. A turn's predecessor is
    the turn numbered one less, so the join's keys spread even when one conversation is most of the rows."""
    state = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("role")) - 1
    known = rows.where(F.col("role").isin(*STATES)).select("conv", "turn", "obs", state.cast("int").alias("s"), F.col("opens"))
    emit, start, move = np.full((K, OBSERVATIONS), 0.1), np.full(K, 0.5), np.full((K, K), 0.5)
    for r in known.groupBy("s", "obs").count().collect():
        emit[r[0], r[1]] += r[2]
    for r in known.where("opens").groupBy("s").count().collect():
        start[r[0]] += r[1]
    before = known.select("conv", (F.col("turn") + 1).alias("turn"), F.col("s").alias("p"))
    for r in known.join(before, ["conv", "turn"]).groupBy("p", "s").count().collect():
        move[r[0], r[1]] += r[2]
    return np.log(start / start.sum()), np.log(move / move.sum(1, keepdims=True)), np.log(emit / emit.sum(1, keepdims=True))


def _block_matrix(obs: np.ndarray, head: bool, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Best score of the block's turns for each state before it and state of its last turn. Before the first
    block of a conversation there is no state: its rows are equal."""
    now = np.tile(start, (K, 1)) + emit[:, obs[0]] if head else move + emit[:, obs[0]]
    for o in obs[1:]:
        now = (now[:, :, None] + move[None]).max(1) + emit[:, o]
    return now


def _block_path(obs: np.ndarray, head: bool, before: int, last: int, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Best states of the block's turns given the state before it and that of its last turn; ties take the
    lower state."""
    score = (start if head else move[before]) + emit[:, obs[0]]
    back = np.zeros((len(obs), K), np.int64)
    for t in range(1, len(obs)):
        step = score[:, None] + move
        back[t] = step.argmax(0)
        score = step.max(0) + emit[:, obs[t]]
    path = np.empty(len(obs), np.int64)
    path[-1] = last
    for t in range(len(obs) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def _runs(batches: Iterator[pa.RecordBatch], keys: int):
    """Rows of sorted batches, grouped by the leading ``keys`` columns; a group has at most ``BLOCK`` keys' rows."""
    where, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != where:
                if held:
                    yield where, held
                where, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield where, held


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)


def _chunked(found: Iterator[tuple], schema: pa.Schema, size: int = 4000):
    rows = []
    for row in found:
        rows.append(row)
        if len(rows) >= size:
            yield _batch(rows, schema)
            rows = []
    if rows:
        yield _batch(rows, schema)


def recover(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", role: str | None = "role", train: Column | None = None) -> DataFrame:
    """Role of every turn by the best path of its conversation, and the turn in canonical form.

    Probabilities are learned from the rows of known ``role`` that ``train`` admits; predictions use the text
    and order of turns only. Turns follow their numbers, gaps notwithstanding; rows that repeat a number
    follow each other by their texts' hashes, and rows that repeat a text as well share a role. Texts are
    shuffled once, for the result; all steps before go by hashes. A null text reads as empty. Rows with a null conversation or turn have no
    order: role_pred and rendered are null. Other columns are not read. Returns conv, turn, role_pred,
    rendered (``<|role|>``, line end, the text without its speaker marker, line end).
    """
    spark = turns.sparkSession
    scratch = Scratch(spark, "chat")
    said = F.coalesce(F.col(text), F.lit(""))
    named = F.col(role) if role else F.lit(None).cast("string")
    admitted = F.coalesce(train, F.lit(False)) if train is not None else F.lit(True)
    base = turns.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), said.alias("text"), F.when(admitted, named).alias("role"))
    first = scratch.put(base.where("conv is not null and turn is not null").groupBy("conv").agg(F.min("turn").alias("first")), "first")
    rows = base.join(first, "conv", "left").withColumn("opens", F.coalesce(F.col("turn") == F.col("first"), F.lit(False)))
    rows = rows.withColumn("obs", observation(F.col("text"), F.col("opens"))).withColumn("h", F.xxhash64("text"))
    light = scratch.put(rows.drop("text"), "rows")
    start, move, emit = _tables(light)

    placed = light.where("conv is not null and turn is not null").select("conv", F.floor((F.col("turn") - F.col("first")) / BLOCK).cast("long").alias("block"), "turn", "h", "obs")
    # Rows of one block meet in one task; equal numbers are told apart by hash, equal texts count as one row.
    once = scratch.put(placed.distinct(), "once")
    sorted_blocks = lambda df, *order: df.repartition("conv", "block").sortWithinPartitions("conv", "block", *order)
    states = [f"m{i}" for i in range(K * K)]
    matrix_schema = pa.schema([("conv", pa.int64()), ("block", pa.int64()), *[(m, pa.float64()) for m in states]])
    ddl = "conv long, block long, " + ", ".join(f"{m} double" for m in states)

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for (c, b), held in _runs(batches, 2):
                yield c, b, *_block_matrix(np.array([r[0] for r in held]), b == 0, start, move, emit).ravel().tolist()

        yield from _chunked(found(), matrix_schema)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for (c, p), held in _runs(batches, 2):
                now = None
                for r in held:
                    m = np.array(r[1:]).reshape(K, K)
                    now = m if now is None else (now[:, :, None] + m[None]).max(1)
                yield c, p, *now.ravel().tolist()

        yield from _chunked(found(), matrix_schema)

    levels = [scratch.put(sorted_blocks(once, "turn", "h").select("conv", "block", "obs").mapInArrow(up, ddl), "level0")]
    while levels[-1].agg(F.max("block")).collect()[0][0]:
        parents = levels[-1].select("conv", F.floor(F.col("block") / BLOCK).cast("long").alias("parent"), "block", *states)
        ordered = parents.repartition("conv", "parent").sortWithinPartitions("conv", "parent", "block")
        levels.append(scratch.put(ordered.mapInArrow(combine, ddl), f"level{len(levels)}"))

    # The best last state of each conversation; then, level by level, the states around each block.
    best = F.array(*[F.struct(F.col(f"m{j}").alias("score"), F.lit(-j).alias("low")) for j in range(K)])
    around = levels[-1].select("conv", "block", F.lit(0).alias("before"), (-F.array_max(best)["low"]).cast("int").alias("last"))
    around_schema = pa.schema([("conv", pa.int64()), ("block", pa.int64()), ("before", pa.int32()), ("last", pa.int32())])

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for (c, _), held in _runs(batches, 2):
                before, last = held[0][1], held[0][2]
                score = np.full(K, -np.inf)
                score[before] = 0
                backs = []
                for r in held:
                    step = score[:, None] + np.array(r[3:]).reshape(K, K)
                    backs.append(step.argmax(0))
                    score = step.max(0)
                ends = [last]
                for back in backs[:0:-1]:
                    ends.append(int(back[ends[-1]]))
                ends = ends[::-1]
                for i, r in enumerate(held):
                    yield c, r[0], before if i == 0 else ends[i - 1], ends[i]

        yield from _chunked(found(), around_schema)

    for level in levels[-2::-1]:
        parents = level.withColumn("parent", F.floor(F.col("block") / BLOCK).cast("long"))
        up_there = scratch.put(around.select("conv", F.col("block").alias("parent"), "before", "last"), "around")
        both = parents.join(up_there, ["conv", "parent"]).select("conv", "parent", "block", "before", "last", *states)
        around = both.repartition("conv", "parent").sortWithinPartitions("conv", "parent", "block").mapInArrow(down, "conv long, block long, before int, last int")
    around = scratch.put(around, "around_blocks")
    path_schema = pa.schema([("conv", pa.int64()), ("turn", pa.int64()), ("h", pa.int64()), ("s", pa.int32())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for (c, b), held in _runs(batches, 2):
                path = _block_path(np.array([r[2] for r in held]), b == 0, held[0][3], held[0][4], start, move, emit)
                for r, s in zip(held, path, strict=True):
                    yield c, r[0], r[1], int(s)

        yield from _chunked(found(), path_schema)

    told = once.join(around, ["conv", "block"]).select("conv", "block", "turn", "h", "obs", "before", "last")
    path = scratch.put(sorted_blocks(told, "turn", "h").mapInArrow(decode, "conv long, turn long, h long, s int"), "path")
    names = F.array(*[F.lit(s) for s in STATES])
    texts = base.select("conv", "turn", "text", F.xxhash64("text").alias("h"))
    out = texts.join(path, ["conv", "turn", "h"], "left").withColumn("role_pred", F.get(names, F.col("s")))
    body = F.rtrim(F.regexp_replace(F.regexp_replace("text", _STRIP, ""), r"<\|im_end\|>\s*$", ""))
    out = out.select(F.col("conv").alias(conv), F.col("turn").alias(turn), "role_pred", F.concat(F.lit("<|"), F.col("role_pred"), F.lit("|>\n"), body, F.lit("\n")).alias("rendered"))
    result = scratch.put(out, "result")
    scratch.close("result")
    return result
