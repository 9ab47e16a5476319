"""Per-host features over ordered rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.windows import least_periods, over, rolling, slope, trailing


def change_and_lags(df: DataFrame, value: str, by, order, lags: Sequence[int] = (1, 5, 15)) -> DataFrame:
    w = over(by, order)
    return df.withColumns({f"{value}_roc1": F.col(value) - F.lag(value).over(w), **{f"{value}_lag{k}": F.lag(value, k).over(w) for k in lags}})


def rolling_features(df: DataFrame, value: str, by, order, windows: Sequence[int] = (5, 15, 60), quantiles: Sequence[float] = (0.05, 0.25, 0.75, 0.95), q_windows: Sequence[int] = (15, 60)) -> DataFrame:
    """Rolling means and deviations, and quantiles, each with half a window of values at least."""
    out = {}
    for n in windows:
        w, least = trailing(by, order, n), least_periods(n)
        out[f"{value}_rmean{n}"] = rolling(F.col(value), w, least)
        out[f"{value}_rstd{n}"] = rolling(F.col(value), w, least, "std")
    for n in q_windows:
        for q in quantiles:
            out[f"{value}_rp{int(100 * q):02d}_{n}"] = rolling(F.col(value), trailing(by, order, n), least_periods(n), "quantile", q)
    return df.withColumns(out)


def by_regime(df: DataFrame, value: str, regime: str, by, order, window: int, op: str, name: str, q: float = 0.5) -> DataFrame:
    """A rolling feature within contiguous blocks of one regime; null inside maintenance (regime -1)."""
    w = over(by, order)
    df = df.withColumn("_c", (~F.col(regime).eqNullSafe(F.lag(regime).over(w))).cast("long")).withColumn("_block", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rolled = rolling(F.col(value), trailing([*by, "_block"], order, window), least_periods(window), op, q)
    return df.withColumn(name, F.when(F.col(regime) >= 0, rolled)).drop("_c", "_block")


def drift(df: DataFrame, value: str, by, order, window: int, name: str) -> DataFrame:
    """Adds ``name``: rise over the window relative to its mean level."""
    df = slope(df, value, by, order, window, "_slope")
    level = F.avg(value).over(trailing(by, order, window))
    return df.withColumn(name, F.col("_slope") * window / F.nullif(F.abs(level), F.lit(0.0))).drop("_slope")


def cyclic_time(ts: Column) -> dict[str, Column]:
    hour = F.hour(ts) + F.minute(ts) / 60.0
    day = F.weekday(ts)
    turn = lambda x, n: x * (2 * 3.141592653589793 / n)
    return {"hour_sin": F.sin(turn(hour, 24)), "hour_cos": F.cos(turn(hour, 24)), "dow_sin": F.sin(turn(day, 7)), "dow_cos": F.cos(turn(day, 7))}


def norm_stats(df: DataFrame, columns: Sequence[str], host: str, clean: Column) -> DataFrame:
    """Mean, sample deviation and count of each feature per host over clean training rows."""
    long = df.where(clean).unpivot([host], list(columns), "feature", "x")
    return long.groupBy(host, "feature").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.count("x").alias("n"))


def normalise(df: DataFrame, stats: DataFrame, host: str, feature: str, limit: float = 10.0) -> DataFrame:
    """``{feature}_norm``: (x - mean) / std, a deviation under 1e-3 being 1, clipped."""
    one = stats.where(F.col("feature") == feature).select(host, "mean", "std")
    scale = F.when(F.col("std") >= 1e-3, F.col("std")).otherwise(1.0)
    z = (F.col(feature) - F.col("mean")) / scale
    return df.join(one, host, "left").withColumn(f"{feature}_norm", F.greatest(F.least(z, F.lit(limit)), F.lit(-limit))).drop("mean", "std")


def power_class(busy: Column, cpus: Column, gpu: Column) -> Column:
    """0 idle, 4 on a GPU host, else 1 to 3 by requested cpus, 2 without a request."""
    return F.when(~busy, 0).when(gpu, 4).when(cpus.isNull(), 2).when(cpus <= 16, 1).when(cpus <= 64, 2).otherwise(3)


def same_job_run(df: DataFrame, job: str, busy: Column, by, order, name: str) -> DataFrame:
    """Adds ``name``: rows the present job has run in a row, 1 at its first, 0 when idle or unknown."""
    w = over(by, order)
    df = df.withColumn("_on", busy & F.col(job).isNotNull())
    fresh = F.col("_on") & F.lag("_on").over(w) & (F.col(job) == F.lag(job).over(w))
    df = df.withColumn("_n", (~F.coalesce(fresh, F.lit(False))).cast("long")).withColumn("_r", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.row_number().over(Window.partitionBy(*by, "_r").orderBy(*order))
    return df.withColumn(name, F.when(F.col("_on"), at).otherwise(0).cast("long")).drop("_on", "_n", "_r")


def rack_features(outlets: DataFrame, keys: Sequence[str], outlet: str, value: str) -> DataFrame:
    """Outlet powers per rack and time: total, mean and root mean square over outlets."""
    each = outlets.groupBy(*keys, outlet).agg(F.sum(value).alias("_s"))
    return each.groupBy(*keys).agg(F.sum("_s").alias("rack_sum"), F.avg("_s").alias("rack_mean"), F.sqrt(F.avg(F.col("_s") * F.col("_s"))).alias("rack_rms"), F.count("*").alias("outlets"))


def attach(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join that keeps the number of rows: the right side has one row per key after ``dropDuplicates``."""
    return left.join(right.dropDuplicates(list(on)), list(on), "left")
