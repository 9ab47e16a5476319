"""Connected components: of a few edges on the driver, of more by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.scratch import Scratch


#: Edges (16 bytes each) that are joined on the driver at most; rounds over so few are all overhead.
DRIVER_EDGES = 200_000


def _joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the edges (a, b) and the smallest of each one's component."""
    v, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(v)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, j in at.reshape(2, -1).T.tolist():
        i, j = root(i), root(j)
        parent[max(i, j)] = min(i, j)
    return v, v[np.array([root(i) for i in range(len(v))], np.int64)]


def _round(edges: DataFrame, scratch: Scratch, large: bool) -> DataFrame:
    """One star operation on edges (u, v) with u > v.

    Large: every larger neighbour of u is linked to the smallest vertex around u. Small: u and its smaller
    neighbours are. Minima are pre-aggregated and written, so the join back has a plain shuffle on either
    side and a hub's rows can be split.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = scratch.put(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return scratch.put(out.where("u != v").distinct(), "edges")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, comp): for each vertex of an edge (a, b), the smallest vertex of its component."""
    if edges.count() <= DRIVER_EDGES:
        found = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a != b").toArrow()
        v, comp = _joined(*(found[c].to_numpy() for c in ("a", "b")))
        return scratch.put(scratch.spark.createDataFrame(pa.table({"v": v, "comp": comp}), "v long, comp long"), "comps")
    now = scratch.put(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    while True:
        now = _round(_round(now, scratch, True), scratch, False)
        # Done when all edges are stars: no vertex that an edge leads to has an edge of its own.
        if now.join(now.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            break
    roots = now.select(F.col("v").alias("u"), "v").distinct()
    return scratch.put(now.union(roots).groupBy(F.col("u").alias("v")).agg(F.min("v").alias("comp")), "comps")
