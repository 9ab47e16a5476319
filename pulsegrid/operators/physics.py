"""Physics residuals and constraints, and the context of an anomaly."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.windows import over, persistent


def ridge(df: DataFrame, features: Sequence[str], target: str, train: Column, alpha: float = 1.0) -> tuple[dict[str, float], float]:
    """Ridge regression on standardised features by its normal equations.

    One aggregation gives all moments, so rows are read once and a few numbers reach the driver. Returns
    coefficients in the features' own units and the intercept. Rows with a missing value take no part.
    """
    cols = [*features, target]
    kept = df.where(train & reduce(lambda a, c: a & F.col(c).isNotNull(), cols, F.lit(True)))
    moments = [F.count("*"), *[F.sum(c) for c in cols], *[F.sum(F.col(a) * F.col(b)) for i, a in enumerate(cols) for b in cols[i:]]]
    got = [float(x or 0) for x in kept.agg(*moments).collect()[0]]
    n, sums, rest, k = got[0], np.array(got[1 : 1 + len(cols)]), got[1 + len(cols) :], len(features)
    if n < 2:
        return dict.fromkeys(features, 0.0), 0.0
    cross = np.zeros((len(cols), len(cols)))
    it = iter(rest)
    for i in range(len(cols)):
        for j in range(i, len(cols)):
            cross[i, j] = cross[j, i] = next(it)
    mean = sums / n
    cov = cross - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov)[:k] / n, 0))
    scale[scale == 0] = 1
    a = cov[:k, :k] / np.outer(scale, scale) + alpha * np.eye(k)
    coef = np.linalg.solve(a, cov[:k, k] / scale) / scale
    return dict(zip(features, map(float, coef), strict=True)), float(mean[k] - coef @ mean[:k])


def residual(df: DataFrame, coef: dict[str, float], intercept: float, target: str, name: str) -> DataFrame:
    """Adds ``name``: target minus the model's value, missing features counting as 0."""
    fitted = reduce(lambda a, x: a + F.coalesce(F.col(x[0]), F.lit(0.0)) * x[1], coef.items(), F.lit(intercept))
    return df.withColumn(name, F.col(target) - fitted)


def host_bias(df: DataFrame, host: str, resid: str, train: Column, least: int = 50, floor: float = 0.1) -> DataFrame:
    """Adds ``{resid}_z``: residual less the host's mean, over its deviation (``floor`` at least); hosts with too
    few training rows use the fleet's deviation and no bias."""
    kept = df.where(train & F.col(resid).isNotNull())
    per = kept.groupBy(host).agg(F.avg(resid).alias("_b"), F.stddev_pop(resid).alias("_s"), F.count("*").alias("_n")).where(F.col("_n") >= least)
    fleet = kept.agg(F.stddev_pop(resid).alias("_f"))
    out = df.join(per, host, "left").join(F.broadcast(fleet), how="cross")
    z = (F.col(resid) - F.coalesce("_b", F.lit(0.0))) / F.greatest(F.coalesce("_s", "_f"), F.lit(floor))
    return out.withColumn(f"{resid}_z", z).drop("_b", "_s", "_n", "_f")


def slope_correction(df: DataFrame, host: str, x: str, resid: str, train: Column, least: int = 50) -> DataFrame:
    """Adds ``{resid}_adj``: residual less the host's own regression on ``x``, for hosts with enough rows."""
    fit = df.where(train & F.col(x).isNotNull() & F.col(resid).isNotNull()).groupBy(host).agg(F.regr_slope(resid, x).alias("_k"), F.regr_intercept(resid, x).alias("_c"), F.count("*").alias("_n")).where(F.col("_n") >= least)
    out = df.join(fit, host, "left")
    return out.withColumn(f"{resid}_adj", F.col(resid) - F.coalesce(F.col("_k") * F.col(x) + F.col("_c"), F.lit(0.0))).drop("_k", "_c", "_n")


def adaptive_z(df: DataFrame, resid: str, by, order, sigma: float, window: int, least: int, name: str) -> DataFrame:
    """Adds ``name``: residual over a rolling IQR / 1.349 that is kept within half and five times ``sigma``."""
    w = over(by, order).rowsBetween(-(window - 1), 0)
    iqr = (F.percentile(resid, 0.75).over(w) - F.percentile(resid, 0.25).over(w)) / 1.349
    scale = F.when(F.count(resid).over(w) >= least, F.greatest(F.least(iqr, F.lit(5 * sigma)), F.lit(0.5 * sigma))).otherwise(sigma)
    return df.withColumn(name, F.col(resid) / scale)


def transition_attenuation(rows: DataFrame, transitions: DataFrame, by: Sequence[str], ts: str, name: str = "job_transition_atten") -> DataFrame:
    """Adds ``name``: 1 - exp(-min(minutes to the nearest job start or end, 20) / 5); 1 without any."""
    from pulsegrid.operators.joins import asof, micros

    marks = transitions.select(*by, ts, F.col(ts).alias("_near"))
    out = asof(rows, marks, by, ts, ["_near"], None, "nearest")
    minutes = F.abs(micros(F.col(ts)) - micros(F.col("_near"))) / 6e7
    return out.withColumn(name, F.coalesce(1 - F.exp(-F.least(minutes, F.lit(20.0)) / 5), F.lit(1.0))).drop("_near")


def temp_fan(df: DataFrame, temp: str, fan: str, idle: Column, by, order, window: int = 5, rate: float = 0.15, slack: float = 0.9) -> DataFrame:
    """Adds const1: the temperature rises while an idle host's fan is under ``slack`` of its median."""
    w = over(by, order)
    middle = F.percentile(fan, 0.5).over(Window.partitionBy(*by))
    hit = (F.col(temp) - F.lag(temp, window).over(w) > rate * window) & (F.col(fan) < slack * middle) & idle
    return df.withColumn("const1", F.coalesce(hit, F.lit(False)))


def rack_thermal(rows: DataFrame, pdu: DataFrame, keys: Sequence[str], temp: str, idle: str, window: int = 3, rise: float = 1.5, share: float = 0.6, stable: float = 0.10) -> DataFrame:
    """Per rack and time, const2: most idle hosts warm up while the rack's power is stable. ``rows`` has the
    host rows with keys (rack, ts) and ``hostname``; ``pdu`` keys and pdu_sum."""
    w = Window.partitionBy("hostname").orderBy(keys[1])
    up = F.coalesce((F.col(temp) - F.lag(temp, window).over(w)) > rise, F.lit(False))
    per = rows.withColumn("_up", up).groupBy(*keys).agg(F.avg((F.col("_up") & F.col(idle)).cast("double")).alias("warm_share"))
    both = per.join(pdu, list(keys), "left")
    back = F.lag("pdu_sum", window).over(Window.partitionBy(keys[0]).orderBy(keys[1]))
    return both.withColumn("const2", F.coalesce((F.col("warm_share") >= share) & (F.abs(F.col("pdu_sum") - back) < stable * back), F.lit(False)))


def dynamics(df: DataFrame, power: str, temp: str, idle: Column, by, order, lag: int = 10, ramp: float = 0.2, least_w: float = 30.0, rise: float = 1.5, stable_w: float = 20.0, stable: int = 5) -> DataFrame:
    """Adds const3: power rose a lag ago but the temperature did not follow, or an idle host warms at stable power."""
    w = over(by, order)
    p1, p2, t1 = F.lag(power, lag).over(w), F.lag(power, 2 * lag).over(w), F.lag(temp, lag).over(w)
    unmoved = (p1 - p2 > ramp * p2) & (p1 - p2 > least_w) & (F.col(temp) - t1 < rise)
    steady = F.abs(F.col(power) - F.lag(power, stable).over(w)) < stable_w
    warming = idle & steady & (F.col(temp) - F.lag(temp, stable).over(w) > rise)
    return df.withColumn("const3", F.coalesce(unmoved, F.lit(False)) | F.coalesce(warming, F.lit(False)))


def crossplane(rack: DataFrame, by, order, pdu: str, hosts: str, lag: int = 3, rise: float = 0.15, least_w: float = 100.0, still: float = 0.03, gap_w: float = 50.0) -> DataFrame:
    """Adds const4: a feeder rises while the hosts' total does not."""
    w = over(by, order)
    dp, dh = F.col(pdu) - F.lag(pdu, lag).over(w), F.col(hosts) - F.lag(hosts, lag).over(w)
    hit = (dp > rise * F.lag(pdu, lag).over(w)) & (dp > least_w) & (F.abs(dh) < still * F.lag(hosts, lag).over(w)) & (dp - dh > gap_w)
    return rack.withColumn("const4", F.coalesce(hit, F.lit(False)))


def allocated_idle(df: DataFrame, power: str, cpu: str, active: Column, job: str, by, order, roll: int = 60, p: float = 0.85, c: float = 0.15, grace: int = 20, tail: int = 5, run: int = 30) -> DataFrame:
    """Adds const5: power and cpu far under their rolling maxima while a job is active, past its warm-up and
    not in its last rows, for ``run`` rows. Rows missing at the end count as inactive."""
    w = over(by, order)
    frame, least = w.rowsBetween(-(roll - 1), 0), min(max(10, roll // 3), roll)
    top = lambda x: F.when(F.count(x).over(frame) >= least, F.max(x).over(frame))
    df = df.withColumn("_rn", F.row_number().over(w)).withColumn("_act", F.coalesce(active, F.lit(False)))
    df = df.withColumn("_chg", ~F.col(job).eqNullSafe(F.lag(job).over(w)))
    since = F.col("_rn") - F.last(F.when(F.col("_chg"), F.col("_rn")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = w.rowsBetween(0, tail - 1)
    lasting = (F.min(F.col("_act").cast("int")).over(ahead) == 1) & (F.count(F.lit(1)).over(ahead) == tail)
    low = (F.col(power) < p * top(power)) & (F.col(cpu) < c * top(cpu))
    df = df.withColumn("_hit", F.coalesce(low & F.col("_act") & (since >= grace) & lasting, F.lit(False)))
    return persistent(df, F.col("_hit"), by, order, run, "const5").drop("_hit", "_rn", "_act", "_chg")


#: Labels of the five constraints in bit order. Fixed values.
CONSTRAINTS = ("TEMP_FAN", "RACK_THERMAL", "DYNAMICS", "CROSSPLANE", "ALLOC_IDLE")


def constraint_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds constraint_mask, n_constraints_violated and constraint_flags (labels joined by ``|``)."""
    on = [F.coalesce(F.col(c), F.lit(False)) for c in columns]
    mask = reduce(lambda a, x: a.bitwiseOR(F.when(x[1], 1 << x[0]).otherwise(0)), enumerate(on), F.lit(0))
    count = reduce(lambda a, x: a + x.cast("int"), on, F.lit(0))
    return df.withColumns({"constraint_mask": mask, "n_constraints_violated": count, "constraint_flags": F.concat_ws("|", *[F.when(x, CONSTRAINTS[i]) for i, x in enumerate(on)])})


def classify(power_z: Column, power_anomaly: Column, thermal_z: Column, thermal_anomaly: Column, flags: Column, jobs: Column, isolation: Column, cpu: Column, request: Column, actual: Column, expected: Column) -> Column:
    """Context of an anomaly; the first case that holds counts."""
    has = lambda label: F.coalesce(flags.contains(label), F.lit(False))
    true = lambda c: F.coalesce(c, F.lit(False))
    pa, ta, any_flag = true(power_anomaly), true(thermal_anomaly), true(flags != "")
    measured = true((jobs > 0) & (cpu >= 65))
    requested = true((jobs > 0) & (request >= 0.60) & cpu.isNotNull())
    works = measured | requested
    pz, tz = F.abs(F.coalesce(power_z, F.lit(0.0))), F.abs(F.coalesce(thermal_z, F.lit(0.0)))
    thermal_only = ta & ~pa
    return (
        F.when(true(jobs == 0) & (pa | ta | any_flag), "NO_JOBS")
        .when(has("CROSSPLANE"), "MEASUREMENT_DISCREPANCY")
        .when(true(isolation == "ISOLATED") & pa & ~works, "INFRA_FAULT")
        .when(true(isolation == "CLUSTER_WIDE") & works & (pz < 4), "JOB_EXPLAINED")
        .when(pa & true(actual > 1.40 * expected), "JOB_OVER_EXPECTATION")
        .when(thermal_only & has("TEMP_FAN"), "COOLING_FAULT")
        .when(thermal_only & works & (tz < 5), "JOB_EXPLAINED")
        .when(thermal_only & works, "AMBIGUOUS")
        .when(thermal_only, "COOLING_FAULT")
        .when(has("DYNAMICS") & ~ta, "SENSOR_DRIFT")
        .when(pa & works & (pz < 4), "JOB_EXPLAINED")
        .when(pa & works, "AMBIGUOUS")
        .when(pa & (cpu.isNull() | (cpu < 65)), "INFRA_FAULT")
        .when(pa, "AMBIGUOUS")
        .when(any_flag & has("TEMP_FAN"), "COOLING_FAULT")
        .otherwise("AMBIGUOUS")
    )
