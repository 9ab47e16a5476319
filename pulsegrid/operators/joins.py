"""Temporal joins: as-of, point in interval, interval overlap, wildcard hosts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], ts: str, value: Sequence[str], tolerance_s: float | None = None, direction: str = "nearest", order: str | None = None) -> DataFrame:
    """Each left row with ``value`` of the right row of equal ``by`` that is nearest (or last before) in time.

    One union and one shuffle by ``by``: the last right row at or before and the first after come from
    window frames, so no pair is ever formed. Of two at equal distance the earlier wins, of equal times the
    row with the larger ``order``. Beyond the tolerance, or without a match, the values are null.
    """
    by, value = list(by), list(value)
    struct = F.struct(F.col(ts).alias("_ts"), *[F.col(v) for v in value])
    marks = right.where(F.col(ts).isNotNull()).select(*by, ts, struct.alias("_r"), F.lit(0).alias("_side"), (F.col(order) if order else F.lit(0)).cast("long").alias("_o"))
    rows = left.select(*by, ts, F.struct(*[F.col(c) for c in left.columns]).alias("_l"), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_o"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(ts, "_side", "_o")
    before = F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # The first at or after, as the last of a frame that grows backwards in time: a frame to the end would be gone through for each row.
    after = F.last("_r", ignorenulls=True).over(Window.partitionBy(*by).orderBy(F.desc(ts), "_side", "_o").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_b", before)
    if direction == "nearest":
        found = found.withColumn("_a", after)
    found = found.where("_side = 1")
    gap_b = micros(F.col(ts)) - micros(F.col("_b._ts"))
    if direction == "nearest":
        gap_a = micros(F.col("_a._ts")) - micros(F.col(ts))
        pick = F.when(F.col("_a").isNull() | (F.col("_b").isNotNull() & (gap_b <= gap_a)), F.col("_b")).otherwise(F.col("_a"))
        gap = F.when(F.col("_a").isNull() | (F.col("_b").isNotNull() & (gap_b <= gap_a)), gap_b).otherwise(gap_a)
    else:
        pick, gap = F.col("_b"), gap_b
    near = gap <= F.lit(int(tolerance_s * 1e6)) if tolerance_s is not None else pick.isNotNull()
    found = found.withColumn("_p", F.when(near, pick))
    return found.select("_l.*", *[F.col(f"_p.{v}").alias(v) for v in value])


def bucketed(df: DataFrame, start: Column, end: Column, seconds: int, name: str = "_bucket") -> DataFrame:
    """One row per time bucket that [start, end] touches."""
    a, b = F.floor(micros(start) / (seconds * 1_000_000)), F.floor(micros(end) / (seconds * 1_000_000))
    return df.where(start <= end).withColumn(name, F.explode(F.sequence(a, b)))


def point_in_interval(points: DataFrame, intervals: DataFrame, by: Sequence[str], ts: str, start: str, end: str, closed: bool = True, bucket_s: int = 3600) -> DataFrame:
    """Inner join of points with the intervals of equal ``by`` that hold them.

    Intervals are spread over time buckets and joined by equality on (by, bucket), so cost follows points and
    touched buckets rather than pairs per host. A point lies in one bucket, so no pair repeats.
    """
    spread = bucketed(intervals, F.col(start), F.col(end), bucket_s)
    placed = points.withColumn("_bucket", F.floor(micros(F.col(ts)) / (bucket_s * 1_000_000)))
    inside = (F.col(ts) >= F.col(start)) & ((F.col(ts) <= F.col(end)) if closed else (F.col(ts) < F.col(end)))
    return placed.join(spread, [*by, "_bucket"]).where(inside).drop("_bucket")


def overlaps(left: DataFrame, right: DataFrame, by: Sequence[str], l_span: tuple[str, str], r_span: tuple[str, str], bucket_s: int = 3600) -> DataFrame:
    """Inner join of intervals of equal ``by`` that share a moment (ends included).

    Both sides are spread over buckets; of the buckets that a pair shares, only the later start's counts.
    """
    (ls, le), (rs, re_) = l_span, r_span
    a = bucketed(left, F.col(ls), F.col(le), bucket_s)
    b = bucketed(right, F.col(rs), F.col(re_), bucket_s)
    at = F.floor(micros(F.greatest(F.col(ls), F.col(rs))) / (bucket_s * 1_000_000))
    return a.join(b, [*by, "_bucket"]).where((F.col(ls) <= F.col(re_)) & (F.col(le) >= F.col(rs)) & (F.col("_bucket") == at)).drop("_bucket")


def with_wildcard(left: DataFrame, events: DataFrame, host: str, join, any_host: str = "*") -> DataFrame:
    """Apply ``join(left, events)`` for events of the same host and for events of all hosts.

    Two joins and a union instead of one with OR, which would compare all pairs. For wildcard events every
    left row goes by the wildcard's name, so events are not multiplied by hosts.
    """
    own = join(left, events.where(F.col(host) != any_host))
    renamed = left.withColumn("_host", F.col(host)).withColumn(host, F.lit(any_host))
    everyone = join(renamed, events.where(F.col(host) == any_host)).withColumn(host, F.col("_host")).drop("_host")
    return own.unionByName(everyone)
