"""Learned detectors: isolation forest, linear autoencoder, k-means, boosted trees."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Trees of a forest, and the rows that each is grown from.
SUBSAMPLE, TREES = 256, 200


def _sample(df: DataFrame, features: Sequence[str], key: str, rows: int) -> np.ndarray:
    """A bounded sample chosen by hash of the key, missing values as 0."""
    picked = df.select(*[F.coalesce(F.col(c), F.lit(0.0)).cast("double").alias(c) for c in features], F.xxhash64(key).alias("_h")).orderBy("_h").limit(rows).drop("_h")
    return picked.toPandas().to_numpy(float)


def _draws(df: DataFrame, features: Sequence[str], key: str, trees: int = TREES, subsample: int = SUBSAMPLE) -> list[np.ndarray]:
    """For each tree the ``subsample`` rows of all with the least hashes of key and tree, missing values as 0.

    Hashes under a bound that 8 deviations more rows than needed are expected to meet are collected, so the
    driver gets a bounded number of rows of any table."""
    n, most = df.count(), subsample + 8 * int(np.ceil(np.sqrt(subsample)))
    if not n:
        return []
    least = -(2**63)
    bound = F.lit(2**63 - 1 if n <= most else least + int(2.0**64 * most / n))
    picked = df.withColumn("_t", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.xxhash64(F.col(key), t) <= bound)))
    rows = picked.select("_t", F.xxhash64(key, "_t").alias("_h"), *[F.coalesce(F.col(c), F.lit(0.0)).cast("double").alias(c) for c in features]).toPandas()
    rows = rows.sort_values(["_t", "_h", *features])
    return [part[list(features)].to_numpy(float)[:subsample] for _, part in rows.groupby("_t")]


def _quantile(df: DataFrame, column: str, q: float, step: float = 1e-5) -> float:
    """Linear quantile of all values of a column in [-1, 0]. Values are counted by ranges of ``step`` first, then
    those of the ranges that hold it, so that no task holds all distinct values."""
    at = F.floor(F.col(column) / step)
    ranges = sorted(tuple(r) for r in df.groupBy(at.alias("_at")).count().collect())  # one row per range
    upto = np.cumsum([c for _, c in ranges])
    place = q * (int(upto[-1]) - 1)
    ranks = [int(np.floor(place)), int(np.ceil(place))]
    held = [int(np.searchsorted(upto, k, side="right")) for k in ranks]
    values = sorted(tuple(r) for r in df.where(at.isin([ranges[i][0] for i in held])).groupBy(column).count().collect())
    ends = np.cumsum([c for _, c in values]) + int(upto[held[0]]) - ranges[held[0]][1]
    low, high = (values[int(np.searchsorted(ends, k, side="right"))][0] for k in ranks)
    return low + (high - low) * (place - ranks[0])


def _path_constant(n: float) -> float:
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


class IsolationForest:
    """Isolation forest (Liu et al., 2008): trees in arrays, scored level by level for all rows at once."""

    def __init__(self, data: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.psi = max(2, min(subsample, len(data)))
        self.depth = int(np.ceil(np.log2(self.psi)))
        self.trees = [self._grow(data[rng.choice(len(data), self.psi, replace=len(data) < self.psi)], rng) for _ in range(trees)] if len(data) else []

    @classmethod
    def of(cls, draws: Sequence[np.ndarray], seed: int = 42) -> IsolationForest:
        """A forest with a tree for each table of rows, which are equally long."""
        forest, rng = cls(np.zeros((0, 1))), np.random.default_rng(seed)
        forest.psi = max(2, max(map(len, draws), default=0))
        forest.depth = int(np.ceil(np.log2(forest.psi)))
        forest.trees = [forest._grow(data, rng) for data in draws]
        return forest

    def _grow(self, data: np.ndarray, rng: np.random.Generator):
        feature, cut, left, length = [], [], [], []

        def node(rows: np.ndarray, depth: int) -> int:
            i = len(feature)
            feature.append(-1)
            cut.append(0.0)
            left.append((0, 0))
            length.append(depth + _path_constant(len(rows)))
            span = rows.max(0) - rows.min(0) if len(rows) else np.zeros(data.shape[1])
            if depth < self.depth and len(rows) > 1 and (span > 0).any():
                f = int(rng.choice(np.flatnonzero(span > 0)))
                c = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
                feature[i], cut[i] = f, c
                left[i] = (node(rows[rows[:, f] < c], depth + 1), node(rows[rows[:, f] >= c], depth + 1))
            return i

        node(data, 0)
        return np.array(feature), np.array(cut), np.array(left), np.array(length)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Negative anomaly score of each row; lower is more anomalous."""
        if not self.trees or not len(x):
            return np.zeros(len(x))
        total = np.zeros(len(x))
        for feature, cut, child, length in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                right = x[np.arange(len(x)), np.maximum(f, 0)] >= cut[at]
                at = np.where(f >= 0, child[at, right.astype(int)], at)
            total += length[at]
        return -(2.0 ** (-(total / len(self.trees)) / _path_constant(self.psi)))


def isolation_scores(df: DataFrame, features: Sequence[str], key: str, host: str, contamination: float = 0.005) -> DataFrame:
    """Adds if_raw (decision value, anomalous under 0) and if_anomaly_score (1 for the host's most, 0 for its
    least anomalous row; 0.5 if all are equal). Each tree draws its rows from all; every row is scored by Arrow
    batches, and the threshold is the ``contamination`` quantile of all scores."""
    forest = IsolationForest.of(_draws(df, features, key))
    model = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in parts:
            yield pd.Series(model.value.score(np.stack([c.fillna(0).to_numpy(float) for c in columns], 1)))

    scored = score(*[F.col(c).cast("double") for c in features])
    offset = _quantile(df.select(scored.alias("_s")), "_s", contamination) if forest.trees else 0.0

    from pyspark.sql import Window

    w = Window.partitionBy(host)
    out = df.withColumn("if_raw", scored - F.lit(offset))
    low, high = F.min("if_raw").over(w), F.max("if_raw").over(w)
    return out.withColumn("if_anomaly_score", F.coalesce(1 - (F.col("if_raw") - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.5))).withColumn("if_is_anomaly", F.col("if_raw") < 0)


def linear_autoencoder(df: DataFrame, features: Sequence[str], key: str, keep: int = 2) -> DataFrame:
    """Adds recon_error: mean absolute error of each row's reconstruction from ``keep`` principal components of
    the standardised features. It stands in for a recurrent autoencoder where no such library exists."""
    cols = [F.coalesce(F.col(c), F.lit(0.0)) for c in features]
    got = df.agg(F.count("*"), *[F.sum(c) for c in cols], *[F.sum(a * b) for i, a in enumerate(cols) for b in cols[i:]]).collect()[0]
    n, k = max(1, got[0]), len(features)
    mean = np.array([float(x or 0) for x in got[1 : 1 + k]]) / n
    cross, it = np.zeros((k, k)), iter(got[1 + k :])
    for i in range(k):
        for j in range(i, k):
            cross[i, j] = cross[j, i] = float(next(it) or 0) / n
    scale = np.sqrt(np.maximum(np.diag(cross) - mean**2, 0))
    scale[scale < 1e-9] = 1
    _, vectors = np.linalg.eigh((cross - np.outer(mean, mean)) / np.outer(scale, scale))
    basis = vectors[:, ::-1][:, :keep]
    z = [(c - float(mean[i])) / float(scale[i]) for i, c in enumerate(cols)]
    project = basis @ basis.T
    errors = [F.abs(z[i] - sum((z[j] * float(project[i, j]) for j in range(k)), F.lit(0.0))) for i in range(k)]
    return df.withColumn("recon_error", sum(errors, F.lit(0.0)) / k)


def kmeans(df: DataFrame, vector: str, ks: Sequence[int] = (4, 8, 12), least: int = 2, seed: int = 42):
    """Best k by silhouette among those whose clusters have ``least`` members; the first k otherwise."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    data = df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    best, first = None, None
    for k in ks:
        model = KMeans(k=k, seed=seed, initMode="k-means||").fit(data)
        first = first or model
        if min(model.summary.clusterSizes) >= least:
            quality = ClusteringEvaluator().evaluate(model.transform(data))
            if best is None or quality > best[0]:
                best = (quality, model)
    model = best[1] if best else first
    return model.transform(data).withColumnRenamed("prediction", "cluster_id").drop("features"), model


def boosted_trees(train: DataFrame, rows: DataFrame, features: Sequence[str], label: str, depth: int = 5, rounds: int = 20, step: float = 0.1) -> DataFrame:
    """Adds prob: probability of the label by gradient-boosted trees with balanced weights; missing features are 0."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    assemble = VectorAssembler(inputCols=list(features), outputCol="_f", handleInvalid="keep")
    n = train.groupBy(label).count().collect()
    total = sum(r[1] for r in n)
    weight = F.element_at(F.create_map(*[x for r in n for x in (F.lit(float(r[0])), F.lit(total / (len(n) * r[1])))]), F.col(label).cast("double"))
    fit = assemble.transform(train.na.fill(0, list(features))).withColumn("_w", weight).withColumn("_y", F.col(label).cast("double"))
    model = GBTClassifier(featuresCol="_f", labelCol="_y", weightCol="_w", maxDepth=depth, maxIter=rounds, stepSize=step, seed=42).fit(fit)
    out = model.transform(assemble.transform(rows.na.fill(0, list(features))))
    return out.withColumn("prob", vector_to_array("probability")[1]).drop("_f", "rawPrediction", "probability", "prediction")


def sliding_windows(df: DataFrame, by, order, value: str, width: int, stride: int) -> DataFrame:
    """Windows of ``width`` consecutive rows, every ``stride`` rows: by, end row number, values."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(*order)
    frame = w.rowsBetween(-(width - 1), 0)
    rows = df.withColumns({"_rn": F.row_number().over(w), "window": F.collect_list(F.coalesce(F.col(value), F.lit(0.0))).over(frame)})
    return rows.where((F.col("_rn") >= width) & ((F.col("_rn") - width) % stride == 0)).select(*by, F.col("_rn").cast("long").alias("end_row"), "window")


#: Profiles that density clustering looks at: its distances are quadratic in them, so it takes a bounded sample.
DENSITY_ROWS = 2_000


def density_clusters(x: np.ndarray, least: int = 5) -> np.ndarray:
    """Hierarchical density clustering (Campello et al., 2013): mutual-reachability distances, their minimum
    spanning tree, the condensed hierarchy, and its most stable clusters. Returns labels, -1 for noise."""
    n = len(x)
    if n < 2 * least:
        return np.full(n, -1)
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(-1), 0))
    core = np.partition(d, min(least, n - 1), axis=1)[:, min(least, n - 1)]
    d = np.maximum(d, np.maximum(core[:, None], core[None]))
    near, link, seen, edges = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool), []
    at = 0
    for _ in range(n - 1):  # Prim
        seen[at] = True
        closer = ~seen & (d[at] < near)
        near[closer], link[closer] = d[at][closer], at
        at = int(np.where(seen, np.inf, near).argmin())
        edges.append((near[at], link[at], at))
    parent, members, height, kids = list(range(n)), {i: [i] for i in range(n)}, {}, {}
    find = lambda i: i if parent[i] == i else find_root(i)

    def find_root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for w, a, b in sorted(edges):
        a, b, new = find(a), find(b), len(parent)
        parent.append(new)
        parent[a] = parent[b] = new
        members[new], height[new], kids[new] = members[a] + members[b], w, (a, b)
    # Walk down: a cluster lasts while splits shed fewer than ``least`` points.
    stability, below, points, stack = {}, {}, {}, [(len(parent) - 1, 0.0, len(parent) - 1)]
    born = {len(parent) - 1: 0.0}
    while stack:
        node, _, cluster = stack.pop()
        points.setdefault(cluster, members[node])
        lam = 1 / max(height.get(node, 0.0), 1e-12)
        if node not in kids:
            stability[cluster] = stability.get(cluster, 0.0) + lam - born[cluster]
            continue
        big = [k for k in kids[node] if len(members[k]) >= least]
        if len(big) == 2:
            stability[cluster] = stability.get(cluster, 0.0) + (lam - born[cluster]) * len(members[node])
            below[cluster] = big
            for k in big:
                born[k] = lam
                stack.append((k, lam, k))
        else:
            lost = len(members[node]) - sum(len(members[k]) for k in big)
            stability[cluster] = stability.get(cluster, 0.0) + (lam - born[cluster]) * lost
            stack += [(k, lam, cluster) for k in big]
    root, best, chosen = len(parent) - 1, {}, {}
    for c in sorted(born):  # children have smaller numbers than their parents
        inner = sum(best.get(k, 0.0) for k in below.get(c, []))
        own = stability.get(c, 0.0)
        best[c], chosen[c] = (own, [c]) if own >= inner and c != root else (inner, [y for k in below.get(c, []) for y in chosen[k]])
    labels = np.full(n, -1)
    for i, c in enumerate(chosen[root]):
        labels[points[c]] = i
    return labels


def cluster_profiles(df: DataFrame, features: Sequence[str], key: str, least: int = 5) -> DataFrame:
    """Adds cluster_id and cluster_dist: density clusters of a bounded sample of standardised profiles, then
    every profile to the nearest centroid (0 everywhere if no cluster is found)."""
    from pulsegrid.operators.jobs import nearest_centroid

    data = _sample(df, features, key, DENSITY_ROWS)
    mean, scale = (data.mean(0), data.std(0)) if len(data) else (np.zeros(len(features)), np.ones(len(features)))
    scale = np.where(scale < 1e-9, 1, scale)
    z = (data - mean) / scale
    labels = density_clusters(z, least)
    centres = [z[labels == c].mean(0) for c in range(labels.max(initial=-1) + 1)] or [np.zeros(len(features))]
    vector = F.array(*[(F.coalesce(F.col(f), F.lit(0.0)) - float(m)) / float(s) for f, m, s in zip(features, mean, scale, strict=True)])
    return nearest_centroid(df.withColumn("_v", vector), "_v", centres).drop("_v")
