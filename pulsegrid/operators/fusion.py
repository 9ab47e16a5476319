"""Detector scores fused into one table, votes, episodes and tiers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.windows import in_runs, over


def key_union(sources: Sequence[DataFrame], keys: Sequence[str], first: Sequence[str], largest: Sequence[str]) -> DataFrame:
    """Distinct keys of all sources; ``first`` columns from the first source that has a value, ``largest`` by max."""
    tagged = [s.select(*keys, *first, *largest, F.lit(i).alias("_src")) for i, s in enumerate(sources)]
    stacked = reduce(lambda a, b: a.unionByName(b), tagged)
    pick = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_src"))).alias(c) for c in first]
    return stacked.groupBy(*keys).agg(*pick, *[F.max(c).alias(c) for c in largest])


def phase_score(columns: Sequence[str], limit: float = 5.0) -> Column:
    """Mean of robust z columns, each clipped; missing ones are 0."""
    return sum((F.greatest(F.least(F.coalesce(F.col(c), F.lit(0.0)), F.lit(limit)), F.lit(-limit)) for c in columns), F.lit(0.0)) / len(columns)


def physics_score(z: str, n: str, context: Column) -> Column:
    """Evidence ((min(z, 3) / 3 + min(n / 5, 1)) / 2) weighed by context; z under 0 is 0."""
    a = F.greatest(F.least(F.coalesce(F.col(z), F.lit(0.0)), F.lit(3.0)), F.lit(0.0)) / 3
    b = F.least(F.coalesce(F.col(n), F.lit(0)) / 5, F.lit(1.0))
    return (a + b) / 2 * F.coalesce(context, F.lit(0.5))


def vote_bins(df: DataFrame, host: str, ts: str, families: dict[str, float], minutes: int = 5) -> DataFrame:
    """Adds ``vote_{family}`` (any in the host's time bin), n_votes and weighted_votes."""
    width = minutes * 60_000_000
    df = df.withColumn("_bin", F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / width))
    w = Window.partitionBy(host, "_bin")
    df = df.withColumns({f"vote_{f}": F.coalesce(F.bool_or(f).over(w), F.lit(False)) for f in families})
    count = sum((F.col(f"vote_{f}").cast("long") for f in families), F.lit(0).cast("long"))
    weight = sum((F.col(f"vote_{f}").cast("double") * v for f, v in families.items()), F.lit(0.0))
    return df.withColumns({"n_votes": count, "weighted_votes": weight}).drop("_bin")


def candidate_episodes(df: DataFrame, by: Sequence[str], order: Sequence[str], active: Column, peaks: Sequence[str], least: int = 2, gap: int = 10, agree: dict[str, float] | None = None) -> DataFrame:
    """Runs of at least ``least`` active rows, merged when they begin ``gap`` rows or fewer after the last one's end.

    Gaps count rows, not time. Returns by, start, end, active rows, duration in whole minutes (both ends
    counted), the largest of each peak column over all rows from start to end, those of gaps included, and,
    given ``agree`` (levels of peak columns), how many of these are reached. Three frames over one order; no join.
    """
    ts = order[0]
    rows = in_runs(df, {"_live": (active, least)}, by, order).withColumn("_rn", F.row_number().over(over(by, order)))
    here = F.when(F.col("_live"), F.col("_rn"))
    before = F.last(here, ignorenulls=True).over(over(by, order).rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(here, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_before", before).withColumn("_after", after)
    inside = F.coalesce(F.col("_after") - F.col("_before") <= gap, F.lit(False))
    fresh = F.col("_live") & F.coalesce(F.col("_rn") - F.lag("_before").over(over(by, order)) > gap, F.lit(True))
    rows = rows.withColumn("_in", inside).withColumn("ep", F.sum(fresh.cast("long")).over(over(by, order).rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.where("_in").groupBy(*by, "ep").agg(F.min(ts).alias("episode_start"), F.max(ts).alias("episode_end"), F.sum(F.col("_live").cast("long")).alias("n_active"), *[F.max(p).alias(f"peak_{p}") for p in peaks])
    minutes = F.floor((F.unix_micros(F.col("episode_end").cast("timestamp")) - F.unix_micros(F.col("episode_start").cast("timestamp"))) / 60_000_000) + 1
    out = out.withColumn("duration_min", minutes.cast("long"))
    if agree:
        out = out.withColumn("n_agree", sum((F.coalesce(F.col(f"peak_{p}") >= level, F.lit(False)).cast("long") for p, level in agree.items()), F.lit(0).cast("long")))
    return out.drop("ep")


def sessions(rows: DataFrame, by: Sequence[str], ts: str, gap_min: int = 60) -> DataFrame:
    """Episodes of rows no more than the gap apart: start, end, rows. An equal gap stays together."""
    out = rows.groupBy(*by, F.session_window(F.col(ts).cast("timestamp"), f"{gap_min} minutes")).agg(F.min(ts).alias("episode_start"), F.max(ts).alias("episode_end"), F.count("*").alias("n_rows"))
    return out.drop("session_window")


def episode_features(episodes: DataFrame, rows: DataFrame, by: Sequence[str], ts: str, means: Sequence[str], tops: Sequence[str], anys: Sequence[str], bucket_s: int = 86400) -> DataFrame:
    """Means, maxima, whether any, and the value of largest magnitude of the rows within each episode."""
    from pulsegrid.operators.joins import point_in_interval

    inside = point_in_interval(rows, episodes, by, ts, "episode_start", "episode_end", True, bucket_s)
    keys = [*by, "episode_start", "episode_end"]
    return inside.groupBy(*keys).agg(
        *[F.avg(c).alias(f"{c}_mean") for c in means], *[F.max(c).alias(f"{c}_max") for c in tops],
        *[F.max_by(c, F.struct(F.abs(F.col(c)), F.col(c))).alias(f"{c}_absmax") for c in tops], *[F.coalesce(F.bool_or(c), F.lit(False)).alias(f"{c}_any") for c in anys],
    )


def tier(prob: Column, candidate: float, confirmed: float, critical: float) -> Column:
    return F.when(prob >= critical, "CRITICAL").when(prob >= confirmed, "CONFIRMED").when(prob >= candidate, "CANDIDATE").otherwise("NONE")


def ensembles(df: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """Adds any, all and two-of-three of three flags."""
    x, y, z = (F.coalesce(F.col(k), F.lit(False)) for k in (a, b, c))
    return df.withColumns({"any_of": x | y | z, "all_of": x & y & z, "two_of_three": (x.cast("int") + y.cast("int") + z.cast("int")) >= 2})


def sustained(df: DataFrame, flag: Column, score: str, by, order, rows: int = 3, floor: float = 0.8) -> DataFrame:
    """``score`` raised to ``floor`` where the flag has held for ``rows`` rows in a row up to this one."""
    w = over(by, order).rowsBetween(-(rows - 1), 0)
    held = (F.min(F.coalesce(flag, F.lit(False)).cast("int")).over(w) == 1) & (F.count(F.lit(1)).over(w) == rows)
    return df.withColumn(score, F.when(held, F.greatest(F.col(score), F.lit(floor))).otherwise(F.col(score)))


def rule_summary(episodes: DataFrame, rows: DataFrame, by: Sequence[str], ts: str, flags: Sequence[str], texts: Sequence[str], bucket_s: int = 86400) -> DataFrame:
    """Per episode: whether each flag held, and the most frequent value of each text (the least on ties)."""
    from pulsegrid.functions.windows import mode_of
    from pulsegrid.operators.joins import point_in_interval

    keys = [*by, "episode_start", "episode_end"]
    inside = point_in_interval(rows, episodes.select(*keys), by, ts, "episode_start", "episode_end", True, bucket_s)
    out = inside.groupBy(*keys).agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in flags], F.count("*").alias("n_rows"))
    for c in texts:
        out = out.join(mode_of(inside, keys, c, c), keys, "left")
    return out
