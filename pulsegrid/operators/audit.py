"""Quality flags of readings. Bits: duplicates 1, spikes 2, flat lines 4, out of range 8. Fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.windows import over, so_far

DUP, SPIKE, FLATLINE, BAD_RANGE = 1, 2, 4, 8


def flag_duplicates(counted: DataFrame, n: str = "n_raw") -> DataFrame:
    """Adds ``dup``: the raw rows of a (minute, host) exceed four times their median, and two."""
    middle = counted.agg(F.percentile(n, 0.5).alias("_m"))
    return counted.join(F.broadcast(middle), how="cross").withColumn("dup", F.col(n) > F.greatest(4 * F.col("_m"), F.lit(2.0))).drop("_m")


def flag_spikes(df: DataFrame, value: str, by, order, points: int, z: float, least_delta: float = 0.0) -> DataFrame:
    """Adds ``spike``: against the mean and population deviation of the ``points`` values before the row.

    At the edge the first value stands for the missing ones before it. A deviation under 1e-6 flags nothing.
    A missing value makes the sums after it unknown, so rows from it on are never flagged.
    """
    w = over(by, order)
    frame = w.rowsBetween(-points, -1)
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    x = F.coalesce(F.col(value), F.lit(0.0))
    pad = points - F.count(F.lit(1)).over(frame)
    total = F.coalesce(F.sum(x).over(frame), F.lit(0.0)) + pad * first
    squares = F.coalesce(F.sum(x * x).over(frame), F.lit(0.0)) + pad * first * first
    mean = total / points
    deviation = F.sqrt(F.greatest(squares / points - mean * mean, F.lit(0.0)))
    known = F.max(F.col(value).isNull().cast("int")).over(so_far(by, order)) == 0
    gap = F.abs(F.col(value) - mean)
    return df.withColumn("spike", F.coalesce(known & (deviation >= 1e-6) & (gap / deviation > z) & (gap > least_delta), F.lit(False)))


def flag_flatlines(df: DataFrame, value: str, by, order, least: int) -> DataFrame:
    """Adds ``flatline``: the value is one of ``least`` or more equal ones in a row; a missing one ends a run."""
    w = over(by, order)
    same = F.coalesce(F.col(value).cast("float") == F.lag(value).over(w).cast("float"), F.lit(False))
    df = df.withColumn("_new", (~same).cast("long")).withColumn("_run", F.sum("_new").over(so_far(by, order)))
    length = F.count("*").over(Window.partitionBy(*by, "_run"))
    return df.withColumn("flatline", F.col(value).isNotNull() & (length >= least)).drop("_new", "_run")


def flag_range(df: DataFrame, value: str, limits: DataFrame, on) -> DataFrame:
    """Adds ``bad_range``: negative, over 1.05 times p999 or under 0.95 times p001 of ``limits``."""
    out = df.join(F.broadcast(limits), on, "left")
    bad = (F.col(value) < 0) | (F.col(value) > F.col("p999") * 1.05) | (F.col(value) < F.col("p001") * 0.95)
    return out.withColumn("bad_range", F.coalesce(bad & F.col("p999").isNotNull(), F.lit(False))).drop("p001", "p999")


def bitmask(**flags: Column) -> Column:
    """Flags as one small integer."""
    bits = {"dup": DUP, "spike": SPIKE, "flatline": FLATLINE, "bad_range": BAD_RANGE}
    total = F.lit(0)
    for name, c in flags.items():
        total = total.bitwiseOR(F.when(F.coalesce(c, F.lit(False)), bits[name]).otherwise(0))
    return total


def summary(df: DataFrame, by, flags: str = "flags") -> DataFrame:
    """Rows with each bit set, per group."""
    has = lambda bit: F.count_if(F.col(flags).bitwiseAND(bit) > 0)
    return df.groupBy(*by).agg(F.count("*").alias("n"), has(DUP).alias("n_dup"), has(SPIKE).alias("n_spike"), has(FLATLINE).alias("n_flatline"), has(BAD_RANGE).alias("n_bad_range"))


def selective_mask(df: DataFrame, flags: str, value: str, idle: Column, thermal: Column, train: Column) -> DataFrame:
    """An idle host may be flat, a busy one may spike unless it is a temperature; a bad value is dropped from
    training rows. ``audit_any``: whether any flag remains."""
    f = F.col(flags)
    f = F.when(idle, f.bitwiseAND(F.lit(~FLATLINE))).when(~thermal, f.bitwiseAND(F.lit(~SPIKE))).otherwise(f)
    bad = f.bitwiseAND(BAD_RANGE) > 0
    return df.withColumn(value, F.when(~(bad & train), F.col(value))).withColumn(flags, f).withColumn("audit_any", F.col(flags) > 0)


def silence(df: DataFrame, value: str, powered: Column, by, order, limit: int) -> DataFrame:
    """Adds ``streak`` (rows in a row without a reading, or 0) and ``silent`` (over ``limit`` while powered)."""
    from pulsegrid.functions.windows import with_runs

    out = with_runs(df, F.col(value).isNull(), by, order, "_q")
    return out.withColumn("streak", F.col("_q_pos")).withColumn("silent", (F.col("_q_pos") > limit) & powered).drop("_q_flag", "_q_id", "_q_len", "_q_pos")
