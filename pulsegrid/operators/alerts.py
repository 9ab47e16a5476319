"""Operator alerts: category, evidence and text of an episode, as columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import duration_text


#: Categories that follow from an anomaly's context. Fixed values.
CONTEXT_CATEGORY = {"COOLING_FAULT": "cooling_failure", "MEASUREMENT_DISCREPANCY": "measurement_glitch", "INFRA_FAULT": "hardware"}


def category(fired: Sequence[tuple[str, Column, Column]], context: Column, peer_z: Column, dropped: Column) -> Column:
    """Dropout first, else the category of the rule that fired first (before all others where the time is unknown;
    table order on ties), else by context, else peer divergence with a z over 2, else unknown. ``fired``: category,
    whether it fired, when."""
    on = [F.when(F.coalesce(hit, F.lit(False)), F.struct(at.isNotNull().alias("known"), at.alias("t"), F.lit(i).alias("i"), F.lit(name).alias("c"))) for i, (name, hit, at) in enumerate(fired)]
    by_context = F.coalesce(*[F.when(F.upper(context) == c, F.lit(k)) for c, k in CONTEXT_CATEGORY.items()])
    return F.when(F.coalesce(dropped, F.lit(False)), "sensor_dropout").otherwise(F.coalesce(F.array_min(F.array(*on))["c"], by_context, F.when(peer_z > 2, "peer_node_divergence"), F.lit("unknown")))


def minutes_since_similar(alerts: DataFrame, by: Sequence[str], start: str, order: Sequence[str], name: str = "prev_similar_min") -> DataFrame:
    """Adds ``name``: minutes since the previous alert of the same host and category; null for the first."""
    before = F.lag(start).over(Window.partitionBy(*by).orderBy(start, *order))
    return alerts.withColumn(name, (F.unix_micros(F.col(start).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 6e7)


#: What each phase's score is divided by, and its name. Fixed values.
PHASE_SCALES = {"sensor": 4.0, "job": 3.0, "physics": 3.0}


def caught_by(scores: dict[str, Column], strong_physics: Column, tie: float = 0.90, least: float = 0.25) -> Column:
    """Phases that are saturated (4 or more), near the leader (and not weak), or physically strong; best first."""
    norm = {p: F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)) / PHASE_SCALES[p] for p, c in scores.items()}
    leader = F.greatest(*norm.values())
    picks = []
    for p, n in norm.items():
        keep = (scores[p] >= 4) | ((n >= tie * leader) & (n >= least))
        if p == "physics":
            keep = keep | F.coalesce(strong_physics, F.lit(False))
        picks.append(F.when(F.coalesce(keep, F.lit(False)), F.struct((-n).alias("o"), F.lit(p).alias("p"))))
    return F.array_join(F.transform(F.array_sort(F.filter(F.array(*picks), lambda x: x.isNotNull())), lambda x: x["p"]), "|")


def evidence(labels: dict[str, Column]) -> Column:
    """Labels of the conditions that hold, joined by ``; ``."""
    return F.concat_ws("; ", *[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in labels.items()])


def jobs_clause(jobs: Column, shown: int = 3) -> Column:
    n = F.size(jobs)
    names = F.array_join(F.slice(F.transform(jobs, lambda j: j.cast("string")), 1, shown), ", ")
    return F.when(jobs.isNull() | (n == 0), "No job was running.").when(n <= shown, F.concat(F.lit("Jobs: "), names, F.lit("."))).otherwise(F.concat(F.lit("Jobs: "), names, F.lit(" and "), (n - shown).cast("string"), F.lit(" more.")))


def message(host: Column, tier: Column, kind: Column, minutes: Column, why: Column) -> Column:
    """One sentence for the operator."""
    return F.concat_ws(" ", F.concat(F.lit("["), tier, F.lit("]")), host, F.concat(kind, F.lit(" anomaly for")), F.concat(duration_text(minutes), F.when(why != "", F.concat(F.lit(": "), why)).otherwise(F.lit("")), F.lit(".")))


def report(alert: dict[str, Column]) -> Column:
    """Markdown section of a card: a line per field that has a value."""
    lines = [F.when(c.isNotNull(), F.concat(F.lit(f"- **{k}**: "), c.cast("string"))) for k, c in alert.items()]
    return F.concat_ws("\n", *lines)


def alert_card(df: DataFrame, host: str, start: str, end: str, category_col: str, tier_col: str, why: str) -> DataFrame:
    """Adds minutes, message and card."""
    minutes = (F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))) / 6e7
    df = df.withColumn("minutes", minutes)
    df = df.withColumn("message", message(F.col(host), F.col(tier_col), F.col(category_col), F.col("minutes"), F.col(why)))
    fields = {"Host": F.col(host), "From": F.date_format(start, "yyyy-MM-dd HH:mm 'UTC'"), "Category": F.col(category_col), "Severity": F.col(tier_col), "Evidence": F.when(F.col(why) != "", F.col(why))}
    return df.withColumn("card", report(fields))


def peak_and_baseline(df: DataFrame, keys: Sequence[str], columns: Sequence[str], phase: str) -> DataFrame:
    """Per key: the column with the highest peak during the episode, that peak, and its median before (three
    values at least). ``phase`` is ``pre`` or ``epi`` in each row."""
    long = df.unpivot([*keys, phase], list(columns), "channel", "x")
    each = long.groupBy(*keys, "channel").agg(F.max(F.when(F.col(phase) == "epi", F.col("x"))).alias("peak"), F.percentile(F.when(F.col(phase) == "pre", F.col("x")), 0.5).alias("_m"), F.count(F.when(F.col(phase) == "pre", F.col("x"))).alias("_n"))
    each = each.withColumn("baseline", F.when(F.col("_n") >= 3, F.col("_m"))).where("peak is not null")
    best = each.groupBy(*keys).agg(F.max_by(F.struct("channel", "peak", "baseline"), F.struct("peak", "channel")).alias("_b"))
    return best.select(*keys, "_b.*")


def any_of(columns: Sequence[str]) -> Column:
    return reduce(lambda a, c: a | F.coalesce(F.col(c), F.lit(False)), columns, F.lit(False))
