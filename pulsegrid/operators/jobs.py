"""Job segments, profiles, peer coherence and attribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.windows import persistent
from pulsegrid.operators.joins import point_in_interval


def profile(segments: DataFrame, rows: DataFrame, by: Sequence[str], seg: str, ts: str, value: str, span: tuple[str, str], bucket_s: int = 86400) -> DataFrame:
    """Statistics of the rows within each segment (ends included), for segments of two rows at least."""
    inside = point_in_interval(rows, segments, by, ts, span[0], span[1], True, bucket_s)
    out = inside.groupBy(*by, seg).agg(
        F.count("*").alias("n_rows"), F.avg(value).alias("v_mean"), F.stddev_samp(value).alias("v_std"), F.max(value).alias("v_max"), F.min(value).alias("v_min"),
        F.percentile(value, 0.95).alias("v_p95"), F.max_by(value, ts).alias("v_last"), F.min_by(value, ts).alias("v_first"),
    )
    return out.where("n_rows >= 2")


def running_profile(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Adds the expanding profile at each row: n, mean, std, max."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({"run_n": F.count(value).over(w), "run_mean": F.avg(value).over(w), "run_std": F.stddev_samp(value).over(w), "run_max": F.max(value).over(w)})


def reproducibility(profiles: DataFrame, job: str, metrics: Sequence[str]) -> DataFrame:
    """Per job with two runs at least: 1 minus the mean coefficient of variation, clipped to [0, 1]."""
    cvs = [F.when(F.abs(F.avg(m)) > 1e-9, F.stddev_samp(m) / F.abs(F.avg(m))).alias(f"_{m}") for m in metrics]
    out = profiles.groupBy(job).agg(F.count("*").alias("n_runs"), *cvs).where("n_runs >= 2")
    values = F.filter(F.array(*[F.col(f"_{m}") for m in metrics]), lambda x: x.isNotNull())
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(values), F.lit(0))
    score = F.greatest(F.least(1 - mean, F.lit(1.0)), F.lit(0.0))
    return out.select(job, "n_runs", mean.alias("mean_cv"), score.alias("score"), (score >= 0.5).alias("is_reproducible"))


def nearest_centroid(vectors: DataFrame, vector: str, centroids: Sequence[Sequence[float]]) -> DataFrame:
    """Adds cluster_id and cluster_dist (Euclidean; the lower id on ties). Centroids are a model's: a few."""
    far = lambda c: F.sqrt(F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(x)) for x in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    best = F.array_min(F.array(*[F.struct(far(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centroids)]))
    return vectors.withColumn("_b", best).withColumns({"cluster_id": F.col("_b.i"), "cluster_dist": F.col("_b.d")}).drop("_b")


def coherence(vectors: DataFrame, group: Sequence[str], member: str, vector: str, limit: float = 2.0) -> DataFrame:
    """Distance of each member to its group's median vector, its robust z in the group, and score d / max d.

    Groups of one are left out. Vectors are exploded to (group, dimension, value), so medians are ordinary
    aggregates and no group's vectors are collected.
    """
    flat = vectors.select(*group, member, F.posexplode(vector).alias("_d", "_x"))
    middle = flat.groupBy(*group, "_d").agg(F.percentile("_x", 0.5).alias("_m"))
    joined = flat.join(middle, [*group, "_d"])
    each = joined.groupBy(*group, member).agg(F.sqrt(F.sum((F.col("_x") - F.col("_m")) * (F.col("_x") - F.col("_m")))).alias("dist"))
    centre = each.groupBy(*group).agg(F.percentile("dist", 0.5).alias("peer_median_dist"), F.max("dist").alias("_max"), F.count("*").alias("n_peers")).where("n_peers >= 2")
    each = each.join(centre, list(group))
    mad = each.groupBy(*group).agg(F.percentile(F.abs(F.col("dist") - F.col("peer_median_dist")), 0.5).alias("peer_mad_dist"))
    z = F.when(1.4826 * F.col("peer_mad_dist") > 1e-6, (F.col("dist") - F.col("peer_median_dist")) / (1.4826 * F.col("peer_mad_dist"))).otherwise(0.0)
    out = each.join(mad, list(group)).withColumn("coherence_z", z)
    return out.withColumns({"coherence_score": F.when(F.col("_max") > 0, F.col("dist") / F.col("_max")).otherwise(0.0), "is_anomaly": F.col("coherence_z") > limit}).drop("_max")


def peer_z(rows: DataFrame, at: Sequence[str], host: str, value: str, order: Sequence[str], run_by: Sequence[str], peers: int = 3, limit: float = 3.5, run: int = 5) -> DataFrame:
    """Adds peer_mean, pwr_z and is_peer_anomaly: each row against the others at the same time and job.

    The row itself is taken out of sums; a peer deviation of 0 has no z. Runs of ``run`` rows count.
    """
    w = Window.partitionBy(*at)
    n, s, q = F.count(value).over(w), F.sum(value).over(w), F.sum(F.col(value) * F.col(value)).over(w)
    df = rows.withColumns({"_n": n, "_s": s, "_q": q}).where(F.col("_n") >= peers)
    mean = (F.col("_s") - F.col(value)) / (F.col("_n") - 1)
    spread = F.greatest((F.col("_q") - F.col(value) * F.col(value)) / (F.col("_n") - 1) - mean * mean, F.lit(0.0))
    df = df.withColumn("peer_mean", mean).withColumn("pwr_z", (F.col(value) - F.col("peer_mean")) / F.nullif(F.sqrt(spread), F.lit(0.0)))
    df = df.withColumn("peer_count", F.col("_n")).drop("_n", "_s", "_q")
    return persistent(df, F.abs(F.col("pwr_z")) > limit, run_by, order, run, "is_peer_anomaly")


def deviants(df: DataFrame, key: Sequence[str], names: Sequence[str], vector: str, median: str, k: int = 5) -> DataFrame:
    """Adds top_deviant_features_json: the ``k`` largest absolute deviations from the median vector."""
    pairs = F.zip_with(F.array(*[F.lit(n) for n in names]), F.zip_with(vector, median, lambda a, b: a - b), lambda n, d: F.struct((-F.abs(d)).alias("o"), n.alias("feature"), d.alias("delta")))
    top = F.slice(F.array_sort(F.filter(pairs, lambda x: F.abs(x["delta"]) > 1e-6)), 1, k)
    return df.withColumn("top_deviant_features_json", F.to_json(F.transform(top, lambda x: F.struct(x["feature"].alias("feature"), x["delta"].alias("delta")))))


#: Weights of the attribution signals: power residual, onset, cluster deviation, coherence. Fixed values.
WEIGHTS = {"power": 0.30, "onset": 0.30, "cluster": 0.25, "coherence": 0.15}


def onset_alignment(first_seen: Column, onset: Column) -> Column:
    """exp(-delta / 15 min) for a job that began before the onset, exp(delta / 30 min) for a later one."""
    minutes = (F.unix_micros(onset.cast("timestamp")) - F.unix_micros(first_seen.cast("timestamp"))) / 6e7
    return F.when(minutes >= 0, F.exp(-minutes / 15)).otherwise(F.exp(minutes / 30))


def attribute(candidates: DataFrame, alert: Sequence[str], job: str, signals: dict[str, str] | None = None) -> DataFrame:
    """Adds score and rank: weighted sum over signals that any candidate of the alert has; missing ones are 0."""
    signals = signals or {s: s for s in WEIGHTS}
    w = Window.partitionBy(*alert)
    live = {s: F.max(F.col(c).isNotNull().cast("double")).over(w) * WEIGHTS[s] for s, c in signals.items()}
    total = sum(live.values(), F.lit(0.0))
    score = sum((live[s] * F.coalesce(F.col(c), F.lit(0.0)) for s, c in signals.items()), F.lit(0.0)) / F.nullif(total, F.lit(0.0))
    out = candidates.withColumn("score", F.coalesce(score, F.lit(0.0)))
    return out.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), job)))


def per_job(scores: DataFrame, job: str, node: str, flag: str, score: str) -> DataFrame:
    """Anomalous and clean nodes of each job with the range of its scores."""
    out = scores.groupBy(job).agg(
        F.array_sort(F.collect_set(F.when(F.col(flag), F.col(node)))).alias("_a"), F.array_sort(F.collect_set(node)).alias("_all"),
        F.min(score).alias("score_min"), F.max(score).alias("score_max"), F.sum(score).alias("score_sum"), F.avg(score).alias("score_mean"),
    )
    return out.select(job, F.array_join("_a", "|").alias("anomalous_nodes"), F.array_join(F.array_except("_all", "_a"), "|").alias("clean_nodes"), "score_min", "score_max", "score_sum", "score_mean")


def dominant_job(running: DataFrame, key: Sequence[str], job: str, cpus: str) -> DataFrame:
    """The job with the most requested cpus, the lowest id on ties."""
    return running.groupBy(*key).agg(F.min_by(job, F.struct(-F.coalesce(F.col(cpus), F.lit(0.0)), F.col(job))).alias("dominant_job"))


#: States in which a job counts as failed, and exit codes that say nothing. Fixed values.
FAILED_STATES = ("FAILED", "TIMEOUT", "CANCELLED", "NODE_FAIL", "OUT_OF_MEMORY")
QUIET_EXITS = ("0:0", "", "None")


def failed_override(context: Column, state: Column, exit_code: Column | None = None) -> Column:
    """An explained or ambiguous anomaly of a dominant job that failed, or ended with an exit code, is over expectation."""
    failed = F.coalesce(state.isin(*FAILED_STATES), F.lit(False))
    if exit_code is not None:
        failed = failed | F.coalesce(~exit_code.isin(*QUIET_EXITS), F.lit(False))
    return F.when(context.isin("JOB_EXPLAINED", "AMBIGUOUS") & failed, "JOB_OVER_EXPECTATION").otherwise(context)


#: Contexts that outrank others, the most urgent first, and how each moves an alert's confidence. Fixed values.
CONTEXT_PRIORITY = {"INFRA_FAULT": 3, "COOLING_FAULT": 2, "JOB_OVER_EXPECTATION": 1}
CONFIDENCE_STEP = {"INFRA_FAULT": -0.15, "COOLING_FAULT": -0.15, "JOB_OVER_EXPECTATION": 0.15}


def enrich(alerts: DataFrame, contexts: DataFrame, host: str, minute: str, alert: str, context: str, confidence: str, position: str | None = None) -> DataFrame:
    """The most urgent context over an alert's hosts at its first minute, and the confidence it leaves, within [0, 1].

    ``alerts`` has a row per alert and host. Of equally urgent contexts that of the first host counts, by
    ``position`` or by name. A fault of the machine speaks against the job, an excess of the job for it."""
    known = contexts.where((F.col(context).isNotNull()) & (F.col(context) != "")).select(host, minute, context)
    urgency = F.coalesce(*[F.when(F.col(context) == c, F.lit(n)) for c, n in CONTEXT_PRIORITY.items()], F.lit(0))
    found = alerts.join(known, [host, minute], "left")
    order = F.when(F.col(context).isNotNull(), F.struct(-urgency, F.col(position or host)))
    out = found.groupBy(alert).agg(F.max(confidence).alias(confidence), F.min_by(context, order).alias("context"))
    step = F.coalesce(*[F.when(F.col("context") == c, F.lit(x)) for c, x in CONFIDENCE_STEP.items()], F.lit(0.0))
    moved = F.when(step < 0, F.greatest(F.col(confidence) + step, F.lit(0.0))).when(step > 0, F.least(F.col(confidence) + step, F.lit(1.0))).otherwise(F.col(confidence))
    return out.withColumn(confidence, moved).select(alert, confidence, "context")


def oom_windows(rows: DataFrame, jobs: DataFrame, by: Sequence[str], ts: str, end: str, minutes: int = 30) -> DataFrame:
    """Adds ``oom_window``: within the last ``minutes`` before an out-of-memory job's end on the host."""
    spans = jobs.select(*by, (F.col(end) - F.expr(f"INTERVAL '{minutes}' MINUTE")).alias("_a"), F.col(end).alias("_b"))
    hit = point_in_interval(rows.select(*by, ts).distinct(), spans, by, ts, "_a", "_b").select(*by, ts).distinct().withColumn("_h", F.lit(True))
    return rows.join(hit, [*by, ts], "left").withColumn("oom_window", F.coalesce("_h", F.lit(False))).drop("_h")


def merge_small(assigned: DataFrame, vector: str, cluster: str, centroids: dict[int, Sequence[float]], least: int) -> DataFrame:
    """Members of clusters under ``least`` join the nearest centroid of the others."""
    sizes = {r[0]: r[1] for r in assigned.groupBy(cluster).count().collect()}  # one row per cluster of the model
    large = [c for c in centroids if sizes.get(c, 0) >= least] or list(centroids)
    near = nearest_centroid(assigned.drop("cluster_id", "cluster_dist") if cluster == "cluster_id" else assigned, vector, [centroids[c] for c in large])
    names = F.array(*[F.lit(c) for c in large])
    return near.withColumn("cluster_id", F.element_at(names, F.col("cluster_id") + 1))
