"""Synthetic faults: a column is changed for one host within [start, end). A fault is a column expression, so
any number of them is one projection over the table."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mask(host: str, start: str, end: str, host_col: str = "hostname", ts: str = "ts") -> Column:
    at = F.col(ts)
    return (F.col(host_col) == host) & (at >= F.lit(start).cast("timestamp_ntz")) & (at < F.lit(end).cast("timestamp_ntz"))


def minutes_in(start: str, ts: str = "ts") -> Column:
    return (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lit(start).cast("timestamp_ntz").cast("timestamp"))) / 6e7


def stuck(df: DataFrame, column: str, where: Column, lookback: Column, value: float | None = None) -> DataFrame:
    """Held at a constant, or at the median of the ``lookback`` rows; without any the column stays as it is."""
    if value is not None:
        return df.withColumn(column, F.when(where, F.lit(value)).otherwise(F.col(column)))
    level = df.where(lookback).agg(F.percentile(column, 0.5).alias("_level"))
    out = df.join(F.broadcast(level), how="cross")
    return out.withColumn(column, F.when(where, F.coalesce("_level", F.col(column))).otherwise(F.col(column))).drop("_level")


#: Parts of column names by which a fault finds its sensors. Fixed values.
INLET = ("inlettemp", "inlet_temp", "inlettemperature", "systeminlettemp")
FAN = ("fanspeed", "fan_speed", "fanrpm", "fan_rpm", "tachometerreading", "rpmreading", "fan.embedded")
POWER = ("systeminputpower", "system_input_power", "powerconsumption", "power_consumption", "inputpower")
PDU = ("pdu_power", "pdupower", "rack_power", "rackpower", "pdu__pdu", "pdu_avg")

#: The twelve faults: hours they last and parameters, unless a spec says otherwise. Fixed values.
DEFAULTS = {
    "memory_leak": (12.0, {"target_delta_pct": 80.0}),
    "cpu_exhaustion": (3.0, {"target_cpu_pct": 99.0, "target_cpu_power_w": 500.0}),
    "fan_rpm_drop": (1.0, {"rpm_factor": 0.2, "rpm_floor": 0.0, "temp_bump_c": 0.0, "ramp_min": 15.0}),
    "sensor_dropout": (2.0, {"target_keywords": ["systeminputpower", "inlet", "rpmreading"]}),
    "gpu_thermal_runaway": (1.0, {"peak_delta_c": 15.0, "ramp_min": 15.0, "target_gpus": []}),
    "sensor_stuck_at_value": (2.0, {"target_keywords": [], "stuck_value": None, "lookback_hr": 24.0}),
    "gradual_thermal_drift": (48.0, {"drift_rate_c_per_hr": 0.05}),
    "cooling_failure": (1.0, {"delta_c": 5.0, "ramp_min": 30.0}),
    "peer_node_divergence": (2.0, {"power_factor": 1.4}),
    "idle_power_fault": (4.0, {"power_delta_w": 150.0}),
    "job_excess_power": (2.0, {"power_factor": 1.3}),
    "measurement_glitch": (0.25, {"pdu_factor": 1.25}),
}


def _floor(c: Column, least: float) -> Column:
    """Not under ``least``; a missing value stays missing."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(float(least))))


def _raise(c: Column, level: float) -> Column:
    """Not under ``level``, which a missing value becomes."""
    return F.greatest(F.coalesce(c, F.lit(float(level))), F.lit(float(level)))


def _changes(kind: str, p: dict, t: Column, total: float) -> list[tuple[tuple[str, ...], object]]:
    """Name parts of the columns that a fault changes, and how; t: minutes since its start, total: minutes it lasts."""
    ramp_to = lambda rise: rise * F.least(t / max(p["ramp_min"], 1e-6), F.lit(1.0))
    if kind == "memory_leak":
        share = t / total
        return [(("memoryusage",), lambda x: F.when(x.isNotNull(), F.least(F.greatest(x + share * p["target_delta_pct"], F.lit(0.0)), F.lit(100.0)))), (("freememory",), lambda x: _floor(x * (1 - share * p["target_delta_pct"] / 100), 0.0))]
    if kind == "cpu_exhaustion":
        return [(("cpuusage",), lambda x: F.least(_raise(x, p["target_cpu_pct"]), F.lit(100.0))), (("cpupower",), lambda x: _raise(x, p["target_cpu_power_w"]))]
    if kind == "fan_rpm_drop":
        warmer = [(INLET, lambda x: x + ramp_to(p["temp_bump_c"]))] if p["temp_bump_c"] > 0 else []
        return [(FAN, lambda x: _floor(x * p["rpm_factor"], p["rpm_floor"])), *warmer]
    if kind == "sensor_dropout":
        return [(tuple(k.lower() for k in p["target_keywords"]), lambda x: F.lit(None).cast("double"))]
    if kind == "gpu_thermal_runaway":
        return [(("gputemp",), lambda x: x + ramp_to(p["peak_delta_c"]))]
    if kind == "gradual_thermal_drift":
        return [(INLET, lambda x: x + t / 60 * p["drift_rate_c_per_hr"])]
    if kind == "cooling_failure":
        return [(INLET, lambda x: x + ramp_to(p["delta_c"]))]
    if kind in ("peer_node_divergence", "job_excess_power"):
        return [(POWER, lambda x: x * p["power_factor"])]
    if kind == "idle_power_fault":
        return [(POWER, lambda x: x + p["power_delta_w"])]
    if kind == "measurement_glitch":
        return [(PDU, lambda x: x * p["pdu_factor"])]
    raise ValueError(f"no such fault: {kind}")


def _fits(kind: str, p: dict, column: str, parts: tuple[str, ...]) -> bool:
    name = column.lower()
    if kind in ("sensor_dropout", "sensor_stuck_at_value") and not column.endswith("_avg"):
        return False
    if kind == "cpu_exhaustion" and "gpu" in name:
        return False
    if kind == "gpu_thermal_runaway" and p["target_gpus"] and not any(g.lower() in name for g in p["target_gpus"]):
        return False
    return any(k in name for k in parts)


def inject(df: DataFrame, specs: list[dict], host_col: str = "hostname", ts: str = "ts") -> tuple[DataFrame, list[dict]]:
    """Apply specs in turn; returns the table and the ground-truth manifest.

    A spec has type, hostname, start and, where they differ from ``DEFAULTS``, duration_hr or end and the
    fault's parameters. Columns are found by their names; ``column`` names the one to change instead. A fault
    that finds no column raises ValueError.
    """
    events = []
    for i, spec in enumerate(specs):
        kind = spec["type"]
        if kind not in DEFAULTS:
            raise ValueError(f"no such fault: {kind}")
        hours, given = DEFAULTS[kind]
        p = {k: spec.get(k, v) for k, v in given.items()}
        start = datetime.fromisoformat(spec["start"])
        end = datetime.fromisoformat(spec["end"]) if "end" in spec else start + timedelta(hours=float(spec.get("duration_hr", hours)))
        a, b = start.isoformat(" "), end.isoformat(" ")
        where = mask(spec["hostname"], a, b, host_col, ts)
        if kind == "sensor_stuck_at_value":
            parts = tuple(k.lower() for k in p["target_keywords"])
            touched = [spec["column"]] if "column" in spec else [c for c in df.columns if _fits(kind, p, c, parts)]
            before = mask(spec["hostname"], (start - timedelta(hours=float(p["lookback_hr"]))).isoformat(" "), a, host_col, ts)
            for c in touched:
                df = stuck(df, c, where, before, p["stuck_value"])
        else:
            changes = _changes(kind, p, minutes_in(a, ts), (end - start).total_seconds() / 60)
            pick = {spec["column"]: changes[0][1]} if "column" in spec else {c: f for parts, f in reversed(changes) for c in df.columns if _fits(kind, p, c, parts)}
            touched = [c for c in df.columns if c in pick]
            df = df.withColumns({c: F.when(where, pick[c](F.col(c))).otherwise(F.col(c)) for c in touched})
        if not touched:
            raise ValueError(f"no column for {kind} on {spec['hostname']}")
        events.append({"event_id": f"inj-{i}", "category": kind, "severity": 3, "hostname": spec["hostname"], "event_start": a, "event_end": b, "columns": touched, "params": p})
    return df, events


def overlap_by_class(specs: DataFrame, segments: DataFrame, host: str, kind: str) -> DataFrame:
    """Seconds of each injection window that fall on segments of each class."""
    from pulsegrid.operators.joins import overlaps

    pairs = overlaps(specs, segments, [host], ("start", "end"), ("seg_start", "seg_end"), 86400)
    both = F.unix_micros(F.least("end", "seg_end").cast("timestamp")) - F.unix_micros(F.greatest("start", "seg_start").cast("timestamp"))
    return pairs.groupBy("spec_id", kind).agg((F.sum(both) / 1e6).alias("seconds"))
