"""Labels, event matching and ranking metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.joins import overlaps, point_in_interval, with_wildcard


def padded(events: DataFrame, start: str, end: str, lead_min: int = 60, lag_min: int = 30) -> DataFrame:
    """Events with their match window as ``w_start``, ``w_end``."""
    return events.withColumns({"w_start": F.col(start) - F.expr(f"INTERVAL '{lead_min}' MINUTE"), "w_end": F.col(end) + F.expr(f"INTERVAL '{lag_min}' MINUTE")})


def row_labels(rows: DataFrame, key: str, events: DataFrame, host: str, ts: str, lead_min: int = 60, lag_min: int = 30) -> DataFrame:
    """Keys of rows within the window of an event of their host or of all hosts."""
    wide = padded(events, "event_start", "event_end", lead_min, lag_min)
    join = lambda a, b: point_in_interval(a, b, [host], ts, "w_start", "w_end")
    return with_wildcard(rows, wide.select(host, "w_start", "w_end"), host, join).select(key).distinct()


def matched(alerts: DataFrame, events: DataFrame, host: str, a_span: tuple[str, str], lead_min: int = 60, lag_min: int = 30) -> DataFrame:
    """Pairs of alert and event whose windows share a moment."""
    wide = padded(events, "event_start", "event_end", lead_min, lag_min)
    return with_wildcard(alerts, wide, host, lambda a, b: overlaps(a, b, [host], a_span, ("w_start", "w_end")))


def event_metrics(alerts: DataFrame, events: DataFrame, alert: str, event: str, host: str, a_span: tuple[str, str]) -> DataFrame:
    """One row: tp and fp count alerts, fn counts events; precision, recall and F1 of them."""
    pairs = matched(alerts, events, host, a_span)
    hit = pairs.agg(F.count_distinct(alert).alias("tp"), F.count_distinct(event).alias("found"))
    all_ = alerts.agg(F.count("*").alias("n")).join(events.agg(F.count("*").alias("m")), how="cross").join(hit, how="cross")
    tp, fp, fn = F.col("tp"), F.col("n") - F.col("tp"), F.col("m") - F.col("found")
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return all_.select("tp", fp.alias("fp"), fn.alias("fn"), p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def score_groups(df: DataFrame, score: str, label: str) -> DataFrame:
    """Positives and negatives per distinct score: all that ranking metrics need, and as few rows."""
    return df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label)).alias("p"), F.count_if(~F.col(label)).alias("n"))


def _cumulated(groups: DataFrame, buckets: int = 64) -> DataFrame:
    """Adds cp, cn: counts at scores above each. Scores are cut into ranges whose totals are summed first, so
    the running sums inside a range are one task's and no task sorts all scores."""
    edges = groups.agg(F.percentile_approx("s", F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), 1000).alias("_e"))
    placed = groups.join(F.broadcast(edges), how="cross").withColumn("_b", F.size(F.filter("_e", lambda e: e < F.col("s")))).drop("_e")
    totals = placed.groupBy("_b").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    later = totals.select(F.col("_b").alias("_b2"), F.col("_p").alias("_p2"), F.col("_n").alias("_n2"))
    above = totals.join(F.broadcast(later), F.col("_b2") > F.col("_b"), "left").groupBy("_b").agg(F.coalesce(F.sum("_p2"), F.lit(0)).alias("_pa"), F.coalesce(F.sum("_n2"), F.lit(0)).alias("_na"))
    w = Window.partitionBy("_b").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(F.broadcast(above), "_b")
    return out.select("s", "p", "n", (F.col("_pa") + F.sum("p").over(w)).alias("cp"), (F.col("_na") + F.sum("n").over(w)).alias("cn"))


def auroc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: area under the ROC curve; ties count half. Null without both labels."""
    c = _cumulated(score_groups(df, score, label))
    wins = F.sum(F.col("n") * (F.col("cp") - F.col("p")) + 0.5 * F.col("n") * F.col("p"))
    return c.agg(F.try_divide(wins, F.sum("p").cast("double") * F.sum("n")).alias("auroc"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: sum over distinct scores of recall gained times precision there."""
    c = _cumulated(score_groups(df, score, label))
    return c.agg(F.try_divide(F.sum(F.col("p") * F.col("cp") / (F.col("cp") + F.col("cn"))), F.sum("p")).alias("auprc"))


def precision_at(df: DataFrame, score: str, label: str, key: str, ks: Sequence[int]) -> DataFrame:
    """One row per k: share of positives among the k highest scores, ties by key."""
    top = df.where(F.col(score).isNotNull()).orderBy(F.desc(score), key).limit(max(ks)).withColumn("_rn", F.row_number().over(Window.orderBy(F.desc(score), key)))
    grid = df.sparkSession.createDataFrame([(int(k),) for k in ks], "k int")
    return top.join(F.broadcast(grid), F.col("_rn") <= F.col("k")).groupBy("k").agg(F.avg(F.col(label).cast("double")).alias("precision"))


def threshold_grid(df: DataFrame, prob: str, label: str, grid: Sequence[float]) -> DataFrame:
    """Precision, recall and F1 at each threshold. Rows are first counted per cell between thresholds, so the
    grid meets a count per cell and not the rows."""
    edges = F.array(*[F.lit(float(t)) for t in grid])
    cell = F.size(F.filter(edges, lambda t: t <= F.col(prob)))
    cells = df.groupBy(cell.alias("_c")).agg(F.count_if(F.col(label)).alias("p"), F.count_if(~F.col(label)).alias("n"))
    steps = df.sparkSession.createDataFrame([(i + 1, float(t)) for i, t in enumerate(grid)], "i int, t double")
    total = cells.agg(F.sum("p").alias("_all"))
    at = cells.join(F.broadcast(steps), F.col("_c") >= F.col("i")).groupBy("t").agg(F.sum("p").alias("tp"), F.sum("n").alias("fp")).join(F.broadcast(total), how="cross")
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", "_all")
    return at.select("t", "tp", "fp", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def confusion(df: DataFrame, actual: str, predicted: str, labels: Sequence[str]) -> DataFrame:
    return df.groupBy(actual).pivot(predicted, list(labels)).count().na.fill(0)


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """2 x 2 counts of two flags, missing as false, and the share of equal ones."""
    x, y = F.coalesce(F.col(a), F.lit(False)), F.coalesce(F.col(b), F.lit(False))
    return df.agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"), F.avg((x == y).cast("double")).alias("agree"))


def autocorrelation(df: DataFrame, by, order, value: str, lag: int = 1) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_l", F.lag(value, lag).over(w)).groupBy(*by).agg(F.corr(value, "_l").alias("autocorr"))


def label_episodes(episodes: DataFrame, events: DataFrame, host: str, rack: str, lead_min: int = 60, lag_min: int = 30) -> DataFrame:
    """Adds ``label``: the episode overlaps an event's window of its host, of all hosts, or of a feeder
    (``pdu-<rack>-…``) of its rack."""
    wide = padded(events, "event_start", "event_end", lead_min, lag_min).select(F.col(host).alias("_g"), "w_start", "w_end")
    keyed = episodes.withColumn("_k", F.monotonically_increasing_id())
    feeder = F.regexp_extract("_g", r"^pdu-(\d+)", 1).try_cast("int")
    own = lambda a, b: overlaps(a, b, [host], ("episode_start", "episode_end"), ("w_start", "w_end"))
    by_host = with_wildcard(keyed, wide.withColumnRenamed("_g", host), host, own).select(host, "episode_start", "episode_end")
    racks = wide.where(feeder.isNotNull()).select(feeder.alias(rack), "w_start", "w_end")
    by_rack = overlaps(keyed, racks, [rack], ("episode_start", "episode_end"), ("w_start", "w_end")).select(host, "episode_start", "episode_end")
    hit = by_host.union(by_rack).distinct().withColumn("_hit", F.lit(True))
    return episodes.join(hit, [host, "episode_start", "episode_end"], "left").withColumn("label", F.coalesce("_hit", F.lit(False))).drop("_hit")


def pick_threshold(grid: DataFrame, aim: str, target: float = 0.0, floor: float = 0.0) -> DataFrame:
    """One row (t) of a threshold grid: the best F1 (``f1``), the best recall among precisions of ``target``
    (``precision``), or the best precision among recalls of ``target`` and precisions of ``floor``
    (``recall``); the lowest such threshold on ties. Empty if none qualifies."""
    if aim == "precision":
        grid, best = grid.where(F.col("precision") >= target), F.col("recall")
    elif aim == "recall":
        grid, best = grid.where((F.col("recall") >= target) & (F.col("precision") >= floor)), F.col("precision")
    else:
        best = F.col("f1")
    return grid.agg(F.min_by("t", F.struct(-F.coalesce(best, F.lit(0.0)), F.col("t"))).alias("t")).where("t is not null")


def plateau_threshold(grid: DataFrame, incumbent: float | None = None, tie: float = 1e-6) -> DataFrame:
    """One row (t): the incumbent if it is on the plateau of best F1, else the plateau's middle threshold."""
    best = grid.agg(F.max("f1").alias("_m"))
    flat = grid.join(F.broadcast(best), how="cross").where(F.col("f1") >= F.col("_m") - tie)
    held = F.max(F.when(F.abs(F.col("t") - F.lit(incumbent).cast("double")) < 1e-9, F.col("t")))
    ordered = F.array_sort(F.collect_list("t"))  # as many as the grid has
    return flat.agg(F.coalesce(held, F.element_at(ordered, (F.floor((F.count("*") - 1) / 2) + 1).cast("int"))).alias("t"))


def type_attribution(alerts: DataFrame, events: DataFrame, host: str, a_span: tuple[str, str], prob: str, kind: str, event: str = "gt_id", truth: str = "category") -> DataFrame:
    """Per event with an alert: its category, that of its most probable alert, and whether any alert's fits."""
    pairs = matched(alerts, events, host, a_span)
    out = pairs.groupBy(event, truth).agg(F.max_by(kind, F.struct(prob, kind)).alias("predicted"), F.bool_or(F.col(kind) == F.col(truth)).alias("lenient"))
    return out.withColumn("strict", F.col("predicted") == F.col(truth))


def permutation_importance(df: DataFrame, score, features: Sequence[str], label: str, key: str) -> dict[str, float]:
    """Loss of AUROC when a feature's values are dealt anew (by hash order of the key against key order)."""
    def area(x: DataFrame) -> float:
        return auroc(x.withColumn("_s", score), "_s", label).collect()[0][0] or 0.0

    base, out = area(df), {}
    for f in features:
        a = df.withColumn("_r", F.row_number().over(Window.partitionBy((F.col(key) % 64).alias("_b")).orderBy(key))).withColumn("_b", F.col(key) % 64)
        b = df.select((F.col(key) % 64).alias("_b"), F.row_number().over(Window.partitionBy((F.col(key) % 64)).orderBy(F.xxhash64(key))).alias("_r"), F.col(f).alias("_x"))
        out[f] = base - area(a.join(b, ["_b", "_r"]).withColumn(f, F.col("_x")))
    return out
