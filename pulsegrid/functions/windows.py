"""Sequence functions over one host's rows: runs, rolling statistics, prefix-sum slopes, folds.

A missing value is NULL throughout. Windows take ``by`` (partition columns) and ``order`` (a total order).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

By = Sequence[str]


def over(by: By, order: By) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def trailing(by: By, order: By, rows: int) -> WindowSpec:
    """The current row and the ``rows - 1`` before it."""
    return over(by, order).rowsBetween(-(rows - 1), 0)


def so_far(by: By, order: By) -> WindowSpec:
    return over(by, order).rowsBetween(Window.unboundedPreceding, 0)


def with_lead(df: DataFrame, at: str, width: int, span: int = 30 * 86_400_000_000) -> DataFrame:
    """Adds ``_part``, the stretch of time of a row, and ``_own``: true for the row itself, false for its copy in the
    next stretch, which is made where a window of ``width`` reaches back to it. Windows over ``_part`` thus see all
    that they reach, and no task holds the whole time; keep the rows with ``_own``. ``at`` and widths are microseconds."""
    span = max(span, width)
    part = F.floor(F.col(at) / span)
    parts = F.when(F.col(at) >= (part + 1) * span - width, F.array(part, part + 1)).otherwise(F.array(part))
    return df.withColumn("_parts", parts).select("*", F.explode("_parts").alias("_part")).withColumn("_own", F.col("_part") == F.col("_parts")[0]).drop("_parts")


def not_nan(c: Column) -> Column:
    """NaN as NULL."""
    return F.when(~F.isnan(c), c)


def with_runs(df: DataFrame, flag: Column, by: By, order: By, name: str = "run") -> DataFrame:
    """Adds ``{name}_id`` (number of the run of equal flags), ``{name}_len`` (rows of the run) and
    ``{name}_pos`` (1, 2, … while the flag holds, 0 elsewhere). A null flag is false."""
    w = over(by, order)
    df = df.withColumn(f"{name}_flag", F.coalesce(flag, F.lit(False)))
    changed = F.coalesce(F.col(f"{name}_flag") != F.lag(f"{name}_flag").over(w), F.lit(True)).cast("long")
    df = df.withColumn("_changed", changed).withColumn(f"{name}_id", F.sum("_changed").over(so_far(by, order))).drop("_changed")
    whole = Window.partitionBy(*by, f"{name}_id")
    position = F.row_number().over(whole.orderBy(*order))
    return df.withColumn(f"{name}_len", F.count("*").over(whole)).withColumn(f"{name}_pos", F.when(F.col(f"{name}_flag"), position).otherwise(0).cast("long"))


def persistent(df: DataFrame, flag: Column, by: By, order: By, least: int, name: str) -> DataFrame:
    """Adds ``name``: whether the flag holds in a run of at least ``least`` rows."""
    df = with_runs(df, flag, by, order, "_p")
    return df.withColumn(name, F.col("_p_flag") & (F.col("_p_len") >= least)).drop("_p_flag", "_p_id", "_p_len", "_p_pos")


def in_runs(df: DataFrame, flags: dict[str, tuple[Column, int]], by: By, order: By) -> DataFrame:
    """Adds each name: whether its flag holds in a run of at least so many rows. Two short frames over one order
    serve all flags: a row is in such a run if one of the next rows ends that many true ones. A null flag is false."""
    df = df.withColumns({name: F.coalesce(flag, F.lit(False)) for name, (flag, _) in flags.items()})
    df = df.withColumns({f"_t_{name}": F.sum(F.col(name).cast("int")).over(trailing(by, order, least)) == least for name, (_, least) in flags.items()})
    held = {name: F.col(name) & F.max(f"_t_{name}").over(over(by, order).rowsBetween(0, least - 1)) for name, (_, least) in flags.items()}
    return df.withColumns(held).drop(*[f"_t_{name}" for name in flags])


#: Rows of the longest frame whose median is taken by sorting the frame at each row.
SHORT_FRAME = 240


def rolling_median(df: DataFrame, value: Column, by: By, order: By, window: int, least: int, name: str) -> DataFrame:
    """Adds ``name``: median of the last ``window`` rows, null under ``least`` values. Frames too long to be sorted at
    each row are gone through once per group by a skip list, in Arrow batches of whole groups."""
    if window <= SHORT_FRAME:
        return df.withColumn(name, rolling(value, trailing(by, order, window), least, "quantile"))
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql.types import DoubleType, StructField, StructType

    keys = list(order)
    df = df.withColumn("_value", value.cast("double"))
    out = StructType([*df.drop("_value").schema.fields, StructField(name, DoubleType())])

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [(k, "ascending") for k in keys]))
        middle = rows["_value"].to_pandas().rolling(window, min_periods=least).median()
        return rows.drop_columns(["_value"]).append_column(name, pa.array(middle, from_pandas=True))

    return df.groupBy(*by).applyInArrow(run, out)


def expanding_median(df: DataFrame, value: str, order: str, name: str) -> DataFrame:
    """Adds ``name`` to one series (a row per time): the median of all values so far, by two heaps in one pass."""
    import heapq

    import pyarrow as pa
    from pyspark.sql.types import DoubleType, StructField, StructType

    out = StructType([*df.schema.fields, StructField(name, DoubleType())])

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(order)
        low: list[float] = []
        high: list[float] = []
        found: list[float | None] = []
        for x in rows[value].to_pylist():
            if x is not None:
                heapq.heappush(high, -heapq.heappushpop(low, -x))
                if len(high) > len(low):
                    heapq.heappush(low, -heapq.heappop(high))
            found.append(None if not low else -low[0] if len(low) > len(high) else (high[0] - low[0]) / 2)
        return rows.append_column(name, pa.array(found, pa.float64()))

    return df.groupBy().applyInArrow(run, out)


def rolling(c: Column, w: WindowSpec, least: int, op: str = "mean", q: float = 0.5) -> Column:
    """Rolling mean, std (sample), quantile (linear), max or min; null under ``least`` non-null values."""
    value = {"mean": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min, "sum": F.sum}[op](c) if op != "quantile" else F.percentile(c, q)
    return F.when(F.count(c).over(w) >= least, value.over(w))


def least_periods(window: int) -> int:
    """Values a rolling feature needs: half its window, one at least."""
    return max(1, window // 2)


def slope(df: DataFrame, value: str, by: By, order: By, window: int, name: str) -> DataFrame:
    """Adds ``name``: least-squares slope of the last ``window`` rows, from two prefix sums.

    Null values weigh 0; a window with over a fifth of them, or that is not full, has none. Row numbers are
    taken within the window, so nothing grows with the length of the series but the sums themselves.
    """
    w, n = so_far(by, order), window
    df = df.withColumn("_i", F.row_number().over(over(by, order)).cast("double"))
    x = F.coalesce(F.col(value), F.lit(0.0))
    df = df.withColumn("_s", F.sum(x).over(w)).withColumn("_t", F.sum(x * F.col("_i")).over(w)).withColumn("_m", F.sum(F.col(value).isNull().cast("int")).over(w))
    back = lambda c: F.coalesce(F.lag(c, n).over(over(by, order)), F.lit(0.0))
    s, t = F.col("_s") - back("_s"), F.col("_t") - back("_t")
    m = F.col("_m") - F.coalesce(F.lag("_m", n).over(over(by, order)), F.lit(0))
    base = F.col("_i") - (n - 1)  # row number of the window's first row
    centred = t - (base + (n - 1) / 2.0) * s
    spread = n * (n * n - 1) / 12.0
    return df.withColumn(name, F.when((F.col("_i") >= n) & (m <= 0.2 * n), centred / spread)).drop("_i", "_s", "_t", "_m")


def ewma(df: DataFrame, value: str, by: By, order: By, span: int, name: str) -> DataFrame:
    """Adds ``name``: exponentially weighted mean with adjusted weights; nulls decay the weights and are skipped.

    A host's ordered rows are cut into blocks so long that what lies before the last whole block weighs less
    than a double resolves (e to the -45); each block runs on from the one before it, whose rows it gets as a
    lead. Inside, the mean is a ratio of two running sums with growing weights. So no task holds a host's
    rows at once. Over a gap longer than that the mean stays what it was.
    """
    decay = -math.log1p(-2.0 / (span + 1))
    size = math.ceil(45.0 / decay)
    df = df.withColumn("_rn", F.row_number().over(over(by, order)) - 1)
    block = F.floor(F.col("_rn") / size)
    spread = df.withColumn("_block", F.explode(F.array(block, block + 1)))
    weight = F.exp((F.col("_rn") - F.col("_block") * size) * decay)  # of rows -size to size - 1 around the block's start
    w = so_far([*by, "_block"], order)
    x = F.col(value).cast("double")
    mean = F.sum(F.coalesce(x * weight, F.lit(0.0))).over(w) / F.nullif(F.sum(F.when(x.isNotNull(), weight).otherwise(0.0)).over(w), F.lit(0.0))
    own = spread.withColumn("_mean", mean).where(F.col("_rn") >= F.col("_block") * size)
    return own.withColumn(name, F.coalesce("_mean", F.last("_mean", ignorenulls=True).over(so_far(by, order)))).drop("_rn", "_block", "_mean")


def robust_z(df: DataFrame, value: str, train: Column, name: str, least: int = 30) -> DataFrame:
    """Adds ``name``: (x - median) / (1.4826 MAD) with both from training rows of the whole fleet.

    A MAD of 0 gives way to the sample standard deviation, and that, if 0 or null, to 1. A missing x is at
    the median (0). Under ``least`` training rows all are 0. One row of statistics is broadcast.
    """
    kept = df.where(train & F.col(value).isNotNull())
    centre = kept.agg(F.percentile(value, 0.5).alias("_med"), F.count("*").alias("_n"), F.stddev_samp(value).alias("_sd"))
    spread = kept.join(F.broadcast(centre.select("_med")), how="cross").agg(F.percentile(F.abs(F.col(value) - F.col("_med")), 0.5).alias("_mad"))
    stats = centre.join(F.broadcast(spread), how="cross")
    scale = F.when(F.col("_mad") > 0, 1.4826 * F.col("_mad")).when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)
    z = F.when(F.col("_n") < least, 0.0).otherwise(F.coalesce((F.col(value) - F.col("_med")) / scale, F.lit(0.0)))
    return df.join(F.broadcast(stats), how="cross").withColumn(name, z).drop("_med", "_n", "_sd", "_mad")


def mode_of(df: DataFrame, by: By, value: str, name: str) -> DataFrame:
    """Most frequent non-null value per group, the least on ties."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(name))
