"""Bounded training samples: chosen by a hash of the key, so the same rows whatever the partitioning."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of sampled texts that are sent to the driver at most; those whose keys' hashes are largest are left out.
SAMPLE_BYTES = 64 << 20


def fold(key: str, parts: int):
    """crc32 of the key as text, modulo ``parts``; null for a null key."""
    return F.crc32(F.col(key).cast("string")) % F.lit(parts)


def hashed_sample(keys: DataFrame, key: str, label: str, per_label: int) -> list[tuple]:
    """(key, label) of the ``per_label`` rows of each label whose keys' hashes are least.

    Labels are counted, then each label's rows under the hash that admits some more than so many are collected:
    nothing is ranked in one task. Only keys travel; the bound is the caller's.
    """
    keys = keys.where(F.col(label).isNotNull())
    counts = {r[0]: r[1] for r in keys.groupBy(label).count().collect()}  # a row per label
    if not counts:
        return []
    wanted = per_label + 8 * math.sqrt(per_label) + 20
    edges = F.create_map(*[F.lit(x) for v, n in sorted(counts.items()) for x in (v, min((1 << 63) - 1, int(wanted / n * (1 << 64)) - (1 << 63)))])
    hashed = F.xxhash64(key)
    rows = keys.where(hashed <= F.element_at(edges, F.col(label))).select(key, label, hashed).collect()
    out: list[tuple] = []
    taken = dict.fromkeys(counts, 0)
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        if taken[r[1]] < per_label:
            taken[r[1]] += 1
            out.append((r[0], r[1]))
    return out


def texts_of(docs: DataFrame, key: str, text: str, chosen: list[tuple], most: int = SAMPLE_BYTES) -> pa.Table:
    """Whole texts of the chosen keys with their labels, the first ones that fit into ``most`` bytes, and one at
    least of each label. ``chosen`` is bounded, so it is broadcast; sizes are looked up before any text travels."""
    spark = docs.sparkSession
    if not chosen:
        return pa.table({"k": pa.array([], pa.int64()), "label": pa.array([], pa.string()), "text": pa.array([], pa.string())})
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
    picked = lambda some: F.broadcast(spark.createDataFrame([(c[0], str(c[1])) for c in some], f"k {kind}, label string"))
    sizes = dict(rows.join(picked(chosen), "k").groupBy("k").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))).collect())
    kept, total, seen = [], 0, set()
    for c in chosen:
        total += sizes.get(c[0], 0)
        if total <= most or c[1] not in seen:
            kept.append(c)
            seen.add(c[1])
    table = rows.join(picked(kept), "k").select("k", "label", "text").toArrow()
    return table.sort_by("k")
