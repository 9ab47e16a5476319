"""Sentences of an alert as column expressions. Each takes columns and gives text, or null where it has
nothing to say; ``paragraph`` joins what is left."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import duration_text


def paragraph(*clauses: Column) -> Column:
    """Clauses joined by spaces, without the null and empty ones."""
    return F.array_join(F.filter(F.array(*clauses), lambda c: c.isNotNull() & (c != "")), " ")


def sentence_case(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1_000_000))


def minute(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm UTC``."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit(" UTC"))


def target(host: Column, rack: Column) -> Column:
    return F.concat(F.lit("Host "), host, F.when(rack.isNotNull(), F.concat(F.lit(" in rack "), rack.cast("string"))).otherwise(F.lit("")))


def severity(tier: Column) -> Column:
    """How soon a tier wants attention."""
    return F.when(tier == "CRITICAL", "Act within 15 minutes.").when(tier == "CONFIRMED", "Act within two hours.").when(tier == "CANDIDATE", "Review during the shift.")


def families(n: Column) -> Column:
    return F.when(n >= 1, F.format_string("%d sensor famil%s silent.", n.cast("int"), F.when(n == 1, "y is").otherwise("ies are")))


def controller(n: Column, host: Column) -> Column:
    """With most families silent the management controller is the likelier cause than the sensors."""
    return F.when(n >= 4, F.concat(F.lit("Check the management controller of "), host, F.lit("."))).when(n >= 2, F.concat(F.lit("Check the sensor links of "), host, F.lit(".")))


def jobs(ids: Column, shown: int = 4) -> Column:
    names = F.array_join(F.transform(F.slice(ids, 1, shown), lambda j: j.cast("string")), ", ")
    more = F.when(F.size(ids) > shown, F.concat(F.lit(" and "), (F.size(ids) - shown).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return F.when(F.size(ids) > 0, F.concat(F.lit("Running jobs: "), names, more, F.lit(".")))


def cooldown(minutes_since: Column) -> Column:
    return F.when(minutes_since.isNotNull(), F.concat(F.lit("A similar alert came "), duration_text(minutes_since), F.lit(" before.")))


def lead_time(alert: Column, event: Column) -> Column:
    m = (F.unix_micros(event.cast("timestamp")) - F.unix_micros(alert.cast("timestamp"))) / 6e7
    return F.when(m >= 0, F.concat(duration_text(m), F.lit(" before the incident"))).otherwise(F.concat(duration_text(-m), F.lit(" after its start")))


def sensor(label: str, peak: Column, baseline: Column, unit: str, decimals: int = 1) -> Column:
    """A sensor's peak against its level before the episode."""
    at = F.format_string(f"%s peaked at %.{decimals}f %s", F.lit(label), peak.cast("double"), F.lit(unit))
    return F.when(peak.isNotNull(), F.concat(at, F.when(baseline.isNotNull(), F.format_string(f" (%.{decimals}f before)", baseline.cast("double"))).otherwise(F.lit("")), F.lit(".")))


def deviation(peak: Column, baseline: Column) -> Column:
    """Relative deviation, null without a baseline of some size."""
    return F.when(F.abs(baseline) > 1e-9, F.abs(peak - baseline) / F.abs(baseline))


def physics(power_z: Column, thermal_z: Column, violated: Column) -> Column:
    top = F.greatest(F.abs(power_z), F.abs(thermal_z))
    word = F.when(top >= 8, "severe").when(top >= 5, "anomalous").when(top >= 3, "raised")
    which = F.when(F.abs(F.coalesce(thermal_z, F.lit(0.0))) > F.abs(F.coalesce(power_z, F.lit(0.0))), "thermal").otherwise("power")
    return paragraph(F.when(word.isNotNull(), F.concat(sentence_case(which), F.lit(" residual is "), word, F.lit("."))), F.when(violated > 0, F.format_string("%d constraints are violated.", violated.cast("int"))))


def peers(z: Column, n: Column) -> Column:
    return F.when(F.abs(z) > 2, F.format_string("The host departs from %d peers of its job by %.1f deviations.", n.cast("int"), z.cast("double")))


def contributions(names: Sequence[str], values: Sequence[Column], k: int = 3) -> Column:
    """The ``k`` features that move the score most."""
    each = F.array(*[F.struct((-F.abs(F.coalesce(v, F.lit(0.0)))).alias("o"), F.lit(n).alias("n")) for n, v in zip(names, values, strict=True)])
    top = F.slice(F.array_sort(F.filter(each, lambda x: x["o"] < 0)), 1, k)
    return F.when(F.size(top) > 0, F.concat(F.lit("Main drivers: "), F.array_join(F.transform(top, lambda x: x["n"]), ", "), F.lit(".")))


def evidence(lines: Sequence[Column], most: int = 6) -> Column:
    """Distinct lines, ``most`` at most."""
    return F.slice(F.array_distinct(F.filter(F.array(*lines), lambda x: x.isNotNull() & (x != ""))), 1, most)


def culprits(df: DataFrame, key: Sequence[str], rule: str, channel: str, fired: str, grace_min: int = 5) -> DataFrame:
    """Per key, the channels of the rules that fired first or within the grace after, in name order."""
    first = df.groupBy(*key).agg(F.min(fired).alias("_first"))
    near = df.join(first, list(key)).where(F.col(fired) <= F.col("_first") + F.expr(f"INTERVAL '{grace_min}' MINUTE"))
    return near.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set(channel)), ", ").alias("channels"), F.array_join(F.array_sort(F.collect_set(rule)), "|").alias("rules"))


def faulty_channels(df: DataFrame, key: Sequence[str], columns: Sequence[str], phase: str) -> DataFrame:
    """Per key and channel, whether it went flat (deviation under 1e-6 after over 1e-3) or dropped out (over
    half of its values missing) in the ``epi`` rows as against the ``pre`` rows."""
    long = df.unpivot([*key, phase], list(columns), "channel", "x")
    epi, pre = F.col(phase) == "epi", F.col(phase) == "pre"
    each = long.groupBy(*key, "channel").agg(
        F.stddev_pop(F.when(epi, F.col("x"))).alias("_se"), F.stddev_pop(F.when(pre, F.col("x"))).alias("_sp"), F.avg(F.when(epi, F.col("x").isNull().cast("double"))).alias("_gone")
    )
    return each.select(*key, "channel", F.coalesce((F.col("_se") < 1e-6) & (F.col("_sp") > 1e-3), F.lit(False)).alias("flatline"), F.coalesce(F.col("_gone") > 0.5, F.lit(False)).alias("dropout"))
