"""Long readings to wide host tables, job context per minute, splits and maintenance regimes."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_mean(readings: DataFrame, keys: Sequence[str], ts: str, value: str, unit: str = "minute") -> DataFrame:
    """Mean value and raw row count per key and time unit; missing values count as rows only."""
    at = F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz")
    return readings.groupBy(*keys, at.alias(ts)).agg(F.avg(value).alias(value), F.count("*").alias("n_raw"))


def long_to_wide(long: DataFrame, keys: Sequence[str], sensor: str, value: str, sensors: Sequence[str]) -> DataFrame:
    """One ``{sensor}_avg`` column per listed sensor. Naming them saves the pass that would find them."""
    wide = long.groupBy(*keys).pivot(sensor, list(sensors)).agg(F.avg(value))
    return wide.select(*keys, *[F.col(f"`{s}`").alias(f"{s}_avg") for s in sensors])


def wide_to_long(wide: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    return wide.unpivot(list(keys), list(columns), name, value)


def last_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``. The pick is an aggregate, so rows are reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, "_r.*")


def merge_outer(frames: Sequence[DataFrame], keys: Sequence[str], flag: str = "audit_any") -> DataFrame:
    """Full outer merge of many frames on their keys by one union and one aggregation; flags are OR-ed.

    Each frame has at most one row per key, so ``max`` picks its only value.
    """
    values = [c for f in frames for c in f.columns if c not in keys and c != flag]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in values], F.coalesce(F.bool_or(flag), F.lit(False)).alias(flag))


def split_of(ts: Column, train_end: str, val_end: str) -> Column:
    return F.when(ts <= F.lit(train_end).cast("timestamp_ntz"), "train").when(ts <= F.lit(val_end).cast("timestamp_ntz"), "val").otherwise("test")


Windows = Sequence[tuple[datetime, datetime]]


def regime_id(ts: Column, windows: Windows) -> Column:
    """-1 inside a maintenance window [start, end), else how many windows have ended."""
    inside = reduce(lambda a, w: a | ((ts >= F.lit(w[0]).cast("timestamp_ntz")) & (ts < F.lit(w[1]).cast("timestamp_ntz"))), windows, F.lit(False))
    ended = reduce(lambda a, w: a + F.when(ts >= F.lit(w[1]).cast("timestamp_ntz"), 1).otherwise(0), windows, F.lit(0))
    return F.when(inside, -1).otherwise(ended)


def in_maintenance(ts: Column, windows: Windows) -> Column:
    """Inside a window, ends included."""
    return reduce(lambda a, w: a | ts.between(F.lit(w[0]).cast("timestamp_ntz"), F.lit(w[1]).cast("timestamp_ntz")), windows, F.lit(False))


_UNITS = {"1 minute": "minute", "1 hour": "hour", "1 day": "day"}


def _expandable(start: str, end: str, limit_h: float) -> Column:
    hours = (F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))) / 3.6e9
    return (F.col(start) <= F.col(end)) & (hours <= limit_h)


def expand_jobs(jobs: DataFrame, start: str, end: str, step: str = "1 minute", limit_h: float = 100.0) -> DataFrame:
    """A row per step from start to end, both floored and included, for jobs no longer than the limit."""
    unit = _UNITS[step]
    a, b = F.date_trunc(unit, F.col(start)).cast("timestamp_ntz"), F.date_trunc(unit, F.col(end)).cast("timestamp_ntz")
    return jobs.where(_expandable(start, end, limit_h)).withColumn("ts", F.explode(F.sequence(a, b, F.expr(f"INTERVAL '{step.split()[0]}' {unit.upper()}"))))


def _contexts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The columns of a context from ``_a``, the jobs (j) and cpus (c) in their order."""
    total = F.aggregate("_a", F.lit(0.0), lambda acc, x: acc + x["c"])
    return df.select(
        *keys, F.col("_a.j").alias("jobs"), F.col("_a.c").alias("shares"), F.size("_a").cast("long").alias("active_job_count"),
        F.element_at("_a", 1)["j"].alias("primary_job_id"), F.element_at("_a", 1)["c"].alias("primary_job_share"), total.alias("total_job_share"), (F.size("_a") > 1).alias("is_multi_job"),
    )


def job_context(expanded: DataFrame, keys: Sequence[str], job: str, cpus: str) -> DataFrame:
    """Jobs active per key, in order of their ids: list, shares of cpus, count, first job, sole-job flag."""
    packed = F.array_sort(F.collect_set(F.struct(F.col(job).alias("j"), F.col(cpus).alias("c"))))
    return _contexts(expanded.groupBy(*keys).agg(packed.alias("_a")), keys)


#: Steps of a block, whose jobs are sorted once, and blocks that are dealt to a task together.
STEPS = 16
BLOCKS = 32


def job_contexts(jobs: DataFrame, keys: Sequence[str], job: str, cpus: str, start: str, end: str, step: str = "1 minute", limit_h: float = 100.0) -> DataFrame:
    """``job_context`` per key and step (``ts``) of ``expand_jobs``, expanded after the shuffle and not before.

    Jobs are dealt as intervals, by key and span of ``STEPS * BLOCKS`` steps, sorted once per block of ``STEPS``
    with the steps that they take as bits, and each step picks its own from its block. So what is shuffled
    and sorted follows jobs and touched blocks, and no task holds a key's whole series.
    """
    unit, epoch = _UNITS[step], F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")

    def number(ts: Column) -> Column:
        at = ts.cast("timestamp_ntz")
        days = F.datediff(at.cast("date"), F.lit("1970-01-01").cast("date"))
        return {"day": days, "hour": days * 24 + F.hour(at), "minute": (days * 24 + F.hour(at)) * 60 + F.minute(at)}[unit]

    def over(n: Column, width: int) -> Column:
        return F.floor(n / width).cast("int")

    def bit(n: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1), n)

    dealt = jobs.where(_expandable(start, end, limit_h)).select(*keys, F.col(job).alias("_j"), F.col(cpus).alias("_c"), number(F.col(start)).alias("_from"), number(F.col(end)).alias("_to"))
    dealt = dealt.withColumn("_span", F.explode(F.sequence(over(F.col("_from"), STEPS * BLOCKS), over(F.col("_to"), STEPS * BLOCKS)))).repartition(*keys, "_span")
    first = F.greatest(over(F.col("_from"), STEPS), F.col("_span") * BLOCKS)
    last = F.least(over(F.col("_to"), STEPS), F.col("_span") * BLOCKS + BLOCKS - 1)
    dealt = dealt.withColumn("_block", F.explode(F.sequence(first, last)))
    at = F.col("_block") * STEPS
    taken = bit(F.least(F.col("_to") - at, F.lit(STEPS - 1)) + 1) - bit(F.greatest(F.col("_from") - at, F.lit(0)))
    dealt = dealt.select(*keys, "_span", "_block", F.struct(F.col("_j").alias("j"), F.col("_c").alias("c"), taken.alias("m")).alias("_x"))
    blocks = dealt.groupBy(*keys, "_span", "_block").agg(F.sort_array(F.collect_list("_x")).alias("_all"), F.bit_or("_x.m").alias("_any"))

    def again(rows: str):
        """Whether an element has the job and cpus of the one before."""
        return lambda x, i: (i > 0) & x["j"].eqNullSafe(F.get(rows, i - 1)["j"]) & x["c"].eqNullSafe(F.get(rows, i - 1)["c"])

    blocks = blocks.withColumn("_twice", F.size(F.filter("_all", again("_all"))) > 0)
    steps = blocks.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1)))).where(F.getbit("_any", F.col("_s")) == 1)
    steps = steps.withColumn("_now", F.filter("_all", lambda x: F.getbit(x["m"], F.col("_s")) == 1))
    once = F.when(F.col("_twice"), F.filter("_now", lambda x, i: ~again("_now")(x, i))).otherwise(F.col("_now"))
    n = F.col("_block") * STEPS + F.col("_s")
    ts = epoch + F.make_dt_interval(**{{"day": "days", "hour": "hours", "minute": "mins"}[unit]: n})
    return _contexts(steps.select(*keys, ts.alias("ts"), once.alias("_a")), [*keys, "ts"])


def share_per_job(context: DataFrame, keys: Sequence[str], jobs: str = "jobs", shares: str = "shares") -> DataFrame:
    """Parallel lists of jobs and shares summed per job."""
    pairs = context.select(*keys, F.explode(F.arrays_zip(jobs, shares)).alias("_z"))
    return pairs.groupBy(*keys, F.col(f"_z.{jobs}").alias("job_id")).agg(F.sum(f"_z.{shares}").alias("share"))


def calendar(df: DataFrame, by: Sequence[str], ts: str, step: str) -> DataFrame:
    """Every step between each group's first and last time; join to resample with gaps."""
    ends = df.groupBy(*by).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    return ends.select(*by, F.explode(F.sequence("_a", "_b", F.expr(f"INTERVAL '{step.split()[0]}' {step.split()[1].upper()}"))).alias(ts))


def segments(df: DataFrame, by: Sequence[str], order: Sequence[str], state: Sequence[str], gap_s: float) -> DataFrame:
    """Adds ``seg_id``: a new segment begins where any state column changes or time jumps over ``gap_s``."""
    w = Window.partitionBy(*by).orderBy(*order)
    ts = order[0]
    jump = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))) > gap_s * 1e6
    moved = reduce(lambda a, c: a | ~F.col(c).eqNullSafe(F.lag(c).over(w)), state, F.coalesce(jump, F.lit(True)))
    df = df.withColumn("_b", moved.cast("long"))
    return df.withColumn("seg_id", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_b")
