"""Sensor-level anomaly detectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.windows import ewma, expanding_median, in_runs, over, persistent, rolling, rolling_median, trailing, with_lead


def host_thresholds(df: DataFrame, host: str, columns: Sequence[str], fleet: float, clean: Column, factor: float = 1.10, q: float = 0.995) -> DataFrame:
    """Per host, the larger of the fleet limit and ``factor`` times its highest p99.5 over clean rows."""
    tops = df.where(clean).groupBy(host).agg(F.greatest(*[F.percentile(c, q) for c in columns], F.lit(float("-inf"))).alias("_p"))
    return tops.select(host, F.greatest(F.lit(float(fleet)), factor * F.col("_p")).alias("threshold"))


def above(columns: Sequence[str], limit: Column) -> Column:
    """Whether any column exceeds the limit; a missing value counts as 0."""
    return F.greatest(*[F.coalesce(F.col(c), F.lit(0.0)) for c in columns], F.lit(float("-inf"))) > limit


def drop_below_median(df: DataFrame, value: str, by, order, window: int, least: int, share: float, ceiling: float, name: str) -> DataFrame:
    """Adds ``name``: under ``share`` of the rolling median (itself over 100) and under ``ceiling``."""
    df, middle = rolling_median(df, F.col(value), by, order, window, least, "_middle"), F.col("_middle")
    hit = (F.col(value) < share * middle) & (middle > 100) & (F.col(value) < ceiling)
    return df.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_middle")


def idle_surge(df: DataFrame, value: str, idle: Column, by, order, window: int, least: int, rise: float, run: int, name: str) -> DataFrame:
    """Adds ``name``: idle rows whose value exceeds the rolling median of idle rows by ``rise`` for ``run`` rows."""
    df = rolling_median(df.withColumn("_idle", idle), F.when(F.col("_idle"), F.col(value)), by, order, window, least, "_middle")
    return in_runs(df, {name: (F.col("_idle") & (F.col(value) > F.col("_middle") + rise), run)}, by, order).drop("_idle", "_middle")


def flat_against_past(df: DataFrame, value: str, by, order, window: int, least: int, past: int, past_least: int, ratio: float, floor: float, run: int, name: str) -> DataFrame:
    """Adds ``name``: short deviation under ``ratio`` of a past one (``past`` rows that end ``past_least`` rows
    back) that exceeds ``floor``, for ``run`` rows."""
    now = rolling(F.col(value), trailing(by, order, window), least, "std")
    w = over(by, order).rowsBetween(-(past + past_least - 1), -past_least)
    before = F.when(F.count(value).over(w) >= past_least, F.stddev_samp(value).over(w))
    df = df.withColumn("_hit", F.coalesce((now < ratio * before) & (before > floor), F.lit(False)))
    return persistent(df, F.col("_hit"), by, order, run, name).drop("_hit")


def dropout(df: DataFrame, columns: Sequence[str], by, order, least: int, run: int, name: str) -> DataFrame:
    """Adds ``name``: at least ``least`` sensors have no value, for ``run`` rows."""
    gone = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    return persistent(df.withColumn("_hit", gone >= least), F.col("_hit"), by, order, run, name).drop("_hit")


def triggered(df: DataFrame, rules: Sequence[str]) -> DataFrame:
    """Adds flag_count, is_flagged and triggered_rules (names joined by ``|`` in rule order)."""
    count = sum((F.coalesce(F.col(r), F.lit(False)).cast("long") for r in rules), F.lit(0).cast("long"))
    names = F.concat_ws("|", *[F.when(F.coalesce(F.col(r), F.lit(False)), F.lit(r)) for r in rules])
    return df.withColumns({"flag_count": count, "is_flagged": count > 0, "triggered_rules": names})


def zscore_detector(df: DataFrame, columns: Sequence[str], host: str, order, train: Column, each: float = 4.0, top: float = 5.5, columns_least: int = 2, run: int = 5, centre: dict[str, Column] | None = None, rows_least: int = 30) -> DataFrame:
    """Adds max_z, n_high and is_flagged: several columns beyond ``each`` and one beyond ``top`` deviations of
    the host's training rows, for ``run`` rows. ``centre`` replaces the mean (EWMA detector)."""
    stats = df.where(train).groupBy(host).agg(*[x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"), F.count(c).alias(f"_n_{c}"))])
    out = df.join(stats, host, "left")
    zs = []
    for c in columns:
        middle = centre[c] if centre else F.col(f"_m_{c}")
        zs.append(F.coalesce(F.when((F.col(f"_n_{c}") >= rows_least) & (F.col(f"_s_{c}") >= 1e-6), F.abs(F.col(c) - middle) / F.col(f"_s_{c}")), F.lit(0.0)))
    out = out.withColumn("_z", F.array(*zs)).drop(*[f"{p}{c}" for c in columns for p in ("_m_", "_s_", "_n_")])
    out = out.withColumns({"max_z": F.array_max("_z"), "n_high": F.size(F.filter("_z", lambda z: z > each)).cast("long")}).drop("_z")
    return persistent(out, (F.col("n_high") >= columns_least) & (F.col("max_z") > top), [host], order, run, "is_flagged")


def ewma_detector(df: DataFrame, columns: Sequence[str], host: str, order, train: Column, span: int = 30, each: float = 3.0, top: float = 4.5, columns_least: int = 2, run: int = 5, rows_least: int = 30) -> DataFrame:
    """The same around each column's exponentially weighted mean."""
    for c in columns:
        df = ewma(df, c, [host], order, span, f"_e_{c}")
    out = zscore_detector(df, columns, host, order, train, each, top, columns_least, run, {c: F.col(f"_e_{c}") for c in columns}, rows_least)
    return out.drop(*[f"_e_{c}" for c in columns])


def outlet_thresholds(df: DataFrame, outlet: str, value: str, clean: Column, q: float = 0.95, least: int = 10) -> DataFrame:
    """Linear percentile per outlet over clean rows, for outlets with enough values."""
    return df.where(clean).groupBy(outlet).agg(F.percentile(value, q).alias("threshold"), F.count(value).alias("_n")).where(F.col("_n") >= least).drop("_n")


def rack_balance(pdu: DataFrame, hosts: DataFrame, keys: Sequence[str], outlets: DataFrame, low: float = 0.85, high: float = 1.50) -> DataFrame:
    """Rack power from outlets against the sum over hosts; the band narrows with a rack's share of the usual
    number of outlets. ``pdu`` and ``hosts`` have keys (rack first) and pdu_sum, host_sum; ``outlets`` rack and n."""
    rack = keys[0]
    usual = outlets.groupBy("n").agg(F.count("*").alias("_c")).agg(F.min_by("n", F.struct(-F.col("_c"), F.col("n"))).alias("_usual"))
    cover = outlets.join(F.broadcast(usual), how="cross").select(rack, F.least(F.col("n") / F.col("_usual"), F.lit(1.0)).alias("cover"))
    both = pdu.join(hosts, list(keys)).join(cover, rack)
    ratio = F.try_divide("pdu_sum", "host_sum")
    return both.withColumn("ratio", ratio).withColumn("is_flagged", F.coalesce((F.col("ratio") > high * F.col("cover")) | (F.col("ratio") < low * F.col("cover")), F.lit(False)))


def fleet_relative(scores: DataFrame, host: str, ts: str, score: str, hours: int = 1, least: int = 5, margin: float = 0.20) -> DataFrame:
    """Adds rel and is_anomaly_rel: score against the rolling median over ``hours`` of the fleet's medians, and where
    these are under ``least`` against the median of all of them so far.

    The fleet has one row per time, whatever the number of hosts. Its window rolls on over the whole series, in
    stretches that begin with the rows that the first windows reach back to."""
    fleet = scores.groupBy(ts).agg(F.percentile(score, 0.5).alias("_m"))
    seconds = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy("_part").orderBy("_s").rangeBetween(-(hours * 3_600_000_000 - 1), 0)
    fleet = expanding_median(fleet, "_m", ts, "_all")
    fleet = with_lead(fleet.withColumn("_s", seconds), "_s", hours * 3_600_000_000)
    level = F.coalesce(F.when(F.count("_m").over(w) >= least, F.percentile("_m", 0.5).over(w)), F.col("_all"))
    fleet = fleet.select(ts, level.alias("fleet_level"), "_own").where("_own").drop("_own")
    return scores.join(fleet, ts).withColumn("rel", F.col(score) - F.col("fleet_level")).withColumn("is_anomaly_rel", F.col("rel") > margin)


def top_features(df: DataFrame, columns: Sequence[str], stats: DataFrame, host: str, k: int = 3, cap: float = 50.0) -> DataFrame:
    """Adds top: the ``k`` features with the largest deviations from the host's statistics, ties by name."""
    per_host = stats.groupBy(host).agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "std")))).alias("_st"))
    out = df.join(per_host, host, "left")
    each = [F.struct((-F.least(F.abs(F.coalesce(F.col(c), F.lit(0.0)) - F.col("_st")[c]["mean"]) / F.greatest(F.col("_st")[c]["std"], F.lit(1e-3)), F.lit(cap))).alias("z"), F.lit(c).alias("name")) for c in columns]
    ranked = F.slice(F.array_sort(F.filter(F.array(*each), lambda x: x["z"].isNotNull())), 1, k)
    return out.withColumn("top", F.transform(ranked, lambda x: x["name"])).drop("_st")


def dynamic_limits(percentiles: DataFrame, platform: str, metric: str) -> DataFrame:
    """Limits per platform from percentiles: 1.05 times the highest p99, 0.9 times the lowest p001 (500 at
    least, and only if over 100) for fan speeds."""
    fan = F.col(metric).contains("rpm")
    out = percentiles.groupBy(platform, metric).agg(F.max("p99").alias("_h"), F.min("p001").alias("_l"))
    low = F.when(F.col("_l") > 100, F.greatest(0.9 * F.col("_l"), F.lit(500.0)))
    return out.select(platform, metric, F.when(~fan, 1.05 * F.col("_h")).alias("high"), F.when(fan, low).alias("low"))


def smooth_isolated(df: DataFrame, score: str, by, order, spike: float = 0.30, bad: float = 0.70) -> DataFrame:
    """Adds ``smooth`` (an isolated score over ``spike`` is the mean of its neighbours) and ``excluded`` (over
    ``bad``, or next to such a row)."""
    w = over(by, order)
    s, before, after = F.col(score), F.lag(score).over(w), F.lead(score).over(w)
    lone = (s > spike) & (F.coalesce(before, F.lit(0.0)) <= spike) & (F.coalesce(after, F.lit(0.0)) <= spike)
    mean = F.coalesce((before + after) / 2, before, after, s)
    df = df.withColumn("smooth", F.when(lone, mean).otherwise(s)).withColumn("_bad", F.coalesce(F.col("smooth") > bad, F.lit(False)).cast("int"))
    return df.withColumn("excluded", F.max("_bad").over(w.rowsBetween(-1, 1)) == 1).drop("_bad")


def spread_window_scores(windows: DataFrame, by, end: str, score: str, width: int) -> DataFrame:
    """Mean score of all windows that cover each row: by, row, score."""
    rows = windows.select(*by, F.explode(F.sequence(F.col(end) - (width - 1), F.col(end))).alias("row"), score)
    return rows.groupBy(*by, "row").agg(F.avg(score).alias(score))


def collapse_rule(df: DataFrame, host: str, z: str, base: float = 5.0, strict: float = 7.0, warn: float = 0.15, limit: float = 0.20) -> DataFrame:
    """Adds is_anomaly: over the threshold; the strict one where over ``warn`` of a host's rows would be
    flagged, and never where over ``limit`` would (a collapsed model)."""
    rate = F.avg((F.col(z) > base).cast("double")).over(Window.partitionBy(host))
    return df.withColumn("_rate", rate).withColumn("is_anomaly", F.coalesce(F.when(F.col("_rate") > limit, False).when(F.col("_rate") > warn, F.col(z) > strict).otherwise(F.col(z) > base), F.lit(False))).drop("_rate")
