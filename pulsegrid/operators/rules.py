"""The threshold detector: thirteen rules over one host's sensors, as flags of one table.

Sensors are found by parts of their column names, once, on the driver. Percentiles of clean training rows
raise fleet limits per host in one aggregation; all rules then share one partitioning by host.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.windows import in_runs, over, rolling, rolling_median, trailing

#: Rules in the order in which their names are listed. Fixed values.
RULES = (
    "HIGH_SYSTEM_POWER", "HIGH_CPU_TEMP", "HIGH_INLET_TEMP", "FAN_FAIL", "GPU_POWER_IDLE", "HIGH_CPU_COMPONENT_POWER", "HIGH_FAN_POWER",
    "FAN_RPM_PCT_DROP", "IDLE_POWER_SURGE", "HIGH_GPU_TEMP", "FLATLINE", "DROPOUT", "COLD_INLET_DROP",
)

#: Rules that count only in runs of ``persist`` rows. Fixed values.
PERSISTENT = ("HIGH_SYSTEM_POWER", "HIGH_CPU_TEMP", "HIGH_INLET_TEMP", "HIGH_GPU_TEMP", "HIGH_CPU_COMPONENT_POWER", "HIGH_FAN_POWER")

#: Limits, frames (rows) and runs (rows), all of which a caller may change. Fixed values.
SETTINGS = {
    "system_power": 1800.0, "gpu_system_power": 4500.0, "cpu_temp": 85.0, "inlet_temp": 35.0, "cpu_component_power": 800.0, "fan_power": 230.0, "gpu_temp": 85.0,
    "fan_rpm_low": 1500.0, "fan_temp": 70.0, "gpu_power": 380.0, "gpu_util_low": 10.0, "fan_share": 0.50, "fan_cap": 4000.0, "idle_rise": 80.0, "idle_cpu": 5.0,
    "gpu_rate": 1.0, "gpu_rate_rows": 10, "cold_inlet": 15.0, "host_factor": 1.10, "host_q": 0.995, "flat_ratio": 0.03,
    "median_rows": 10080, "fan_least": 60, "idle_least": 120, "flat_rows": 15, "flat_least": 10, "flat_past": 360, "flat_past_least": 60, "flat_lag": 60,
    "persist": 5, "idle_run": 30, "flat_run": 10, "drop_run": 5, "drop_families": 2, "cold_run": 10,
}

#: Sensors that may be flat, with the deviation that they normally exceed, and the value from which flatness counts. Fixed values.
FLAT_FLOOR = {
    "rackinlettemperature1": 0.25, "maximumrackinlettemperature": 0.25, "returntemperature": 0.4, "supplytemperature": 0.4, "systeminputpower": 15.0,
    "systempowerconsumption": 15.0, "totalcpupower": 10.0, "cpupower": 10.0, "cpuusage": 5.0,
}
FLAT_FROM = {"cpuusage": 95.0}

#: Families of sensors that drop out together. Fixed values.
FAMILIES = (
    ("systeminputpower", "systempowerconsumption"), ("rackinlettemperature1", "maximumrackinlettemperature"), ("rpmreading",), ("cpupower", "totalcpupower"),
    ("powerconsumption",), ("compositetemperature",),
)


def sensors(columns: Sequence[str]) -> dict[str, list[str]]:
    """Columns (``…_avg``) of each role, by parts of their names."""
    named = [c for c in columns if c.endswith("_avg")]
    any_of = lambda *parts: [c for c in named if any(p in c.lower() for p in parts)]
    all_of = lambda *parts: [c for c in named if all(p in c.lower() for p in parts)]
    temps = any_of("temperaturereading")
    without = lambda cols, *parts: [c for c in cols if not any(p in c.lower() for p in parts)]
    return {
        "power": any_of("systeminputpower", "systempowerconsumption"),
        "cpu_temp": all_of("temperaturereading", "cpu") or without(temps, "inlet", "exhaust"),
        "inlet": all_of("temperaturereading", "inlet") or all_of("inlet", "temp"),
        "temp": temps,
        "rpm": any_of("rpmreading", "fanspeed", "fanrpm"),
        "cpu_power": any_of("totalcpupower", "cpupower"),
        "fan_power": any_of("totalfanpower"),
        "gpu_power": any_of("powerconsumption"),
        "gpu_util": any_of("gpuusage"),
        "cpu_util": any_of("cpuusage"),
        "gpu_temp": all_of("temperaturereading", "gpu") or without(temps, "inlet", "exhaust", "cpu", "dimm", "storage"),
    }


def _pick(columns: Sequence[str], op) -> Column:
    """Greatest or least of columns, missing values aside."""
    return op(*[F.col(c) for c in columns]) if len(columns) > 1 else F.col(columns[0])


def _or(parts: Sequence[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.coalesce(p, F.lit(False))
    return out


def threshold_rules(df: DataFrame, host: str, order: Sequence[str], running: Column, gpu: Column, clean: Column, settings: dict | None = None) -> DataFrame:
    """Adds ``rule_{name}`` for each rule, flag_count, is_flagged and triggered_rules (names joined by ``|``).

    ``running``: a job runs on the row's host; ``gpu``: the host has GPUs; ``clean``: training rows without
    incidents, whose percentiles raise limits. Missing values count as 0 against upper limits. A rule whose
    sensors are absent never fires. ``order`` is a total order of a host's rows.
    """
    s, by, of = SETTINGS | (settings or {}), [host], sensors(df.columns)
    given = list(df.columns)
    limited = {"power": None, "cpu_temp": "cpu_temp", "inlet": "inlet_temp", "cpu_power": "cpu_component_power", "fan_power": "fan_power", "gpu_temp": "gpu_temp"}
    tops = [F.greatest(*[F.percentile(c, s["host_q"]) for c in of[k]], F.lit(0.0)).alias(f"_top_{k}") for k in limited if of[k]]
    if tops:
        df = df.join(df.where(clean).groupBy(host).agg(*tops), host, "left")
    df = df.withColumns({"_run": F.coalesce(running, F.lit(False)), "_gpu": F.coalesce(gpu, F.lit(False))})

    def limit(kind: str) -> Column:
        fleet = F.lit(float(s[limited[kind]])) if limited[kind] else F.when(F.col("_gpu"), F.lit(float(s["gpu_system_power"]))).otherwise(F.lit(float(s["system_power"])))
        return F.greatest(fleet, F.col(f"_top_{kind}") * s["host_factor"])

    above = lambda kind: _or([F.coalesce(F.col(c), F.lit(0.0)) > limit(kind) for c in of[kind]])
    w = over(by, order)
    flags = {r: F.lit(False) for r in RULES}
    for rule, kind in (("HIGH_SYSTEM_POWER", "power"), ("HIGH_CPU_TEMP", "cpu_temp"), ("HIGH_INLET_TEMP", "inlet"), ("HIGH_CPU_COMPONENT_POWER", "cpu_power"), ("HIGH_FAN_POWER", "fan_power")):
        flags[rule] = above(kind)
    steps = int(s["gpu_rate_rows"])
    flags["HIGH_GPU_TEMP"] = F.col("_gpu") & (above("gpu_temp") | _or([F.col(c) - F.lag(c, steps).over(w) >= s["gpu_rate"] * steps for c in of["gpu_temp"]]))
    if of["rpm"]:
        df = df.withColumn("_rpm", _pick(of["rpm"], F.least))
        flags["FAN_FAIL"] = (F.col("_rpm") < s["fan_rpm_low"]) & _or([F.col(c) > s["fan_temp"] for c in of["temp"]])
        df = rolling_median(df, F.col("_rpm"), by, order, s["median_rows"], s["fan_least"], "_rpm_median")
        flags["FAN_RPM_PCT_DROP"] = (F.col("_rpm_median") > 100) & (F.col("_rpm") < s["fan_share"] * F.col("_rpm_median")) & (F.col("_rpm") < s["fan_cap"])
    if of["gpu_power"] and of["gpu_util"]:
        zero = lambda kind: F.coalesce(_pick(of[kind], F.greatest), F.lit(0.0))
        flags["GPU_POWER_IDLE"] = F.col("_gpu") & F.col("_run") & (zero("gpu_power") > s["gpu_power"]) & (zero("gpu_util") < s["gpu_util_low"])
    runs = {r: (flags[r], s["persist"]) for r in PERSISTENT}
    if of["power"]:
        calm = F.coalesce(_pick(of["cpu_util"], F.greatest), F.lit(0.0)) < s["idle_cpu"] if of["cpu_util"] else F.lit(True)
        df = df.withColumns({"_power": _pick(of["power"], F.greatest), "_idle": ~F.col("_run") & calm})
        df = rolling_median(df, F.when(F.col("_idle"), F.col("_power")), by, order, s["median_rows"], s["idle_least"], "_idle_median")
        runs["IDLE_POWER_SURGE"] = (F.col("_idle") & (F.col("_power") > F.col("_idle_median") + s["idle_rise"]), s["idle_run"])
    flat = []
    past = over(by, order).rowsBetween(-(s["flat_past"] + s["flat_lag"] - 1), -s["flat_lag"])
    for part, floor in FLAT_FLOOR.items():
        for c in (c for c in given if c.endswith("_avg") and part in c.lower()):
            before = F.when(F.count(c).over(past) >= s["flat_past_least"], F.stddev_samp(c).over(past))
            still = (rolling(F.col(c), trailing(by, order, s["flat_rows"]), s["flat_least"], "std") < s["flat_ratio"] * before) & F.col(c).isNotNull() & (before > floor)
            still = still & (F.col(c) >= FLAT_FROM[part]) if part in FLAT_FROM else still
            name = f"_flat_{len(flat)}"
            flat.append(name)
            runs[name] = (still, s["flat_run"])
    families = [[c for c in given if c.endswith("_avg") and any(p in c.lower() for p in parts)] for parts in FAMILIES]
    gone = sum((F.when(F.coalesce(*[F.col(c) for c in family]).isNull(), 1).otherwise(0) for family in families if family), F.lit(0))
    runs["DROPOUT"] = (gone >= s["drop_families"], s["drop_run"])
    cold = [f"_cold_{i}" for i in range(len(of["inlet"]))]
    runs |= {name: ((F.col(c) > 0) & (F.col(c) < s["cold_inlet"]) & F.col("_run"), s["cold_run"]) for name, c in zip(cold, of["inlet"], strict=True)}

    df = in_runs(df, {f"_in_{name}": x for name, x in runs.items()}, by, order)
    held = lambda name: F.col(f"_in_{name}")
    final = {r: F.coalesce(held(r) if r in runs else flags[r], F.lit(False)) for r in RULES}
    final["FLATLINE"], final["COLD_INLET_DROP"] = _or([held(n) for n in flat]), _or([held(n) for n in cold])
    df = df.select(*given, *[final[r].alias(f"rule_{r}") for r in RULES])
    count = sum((F.col(f"rule_{r}").cast("long") for r in RULES), F.lit(0).cast("long"))
    names = F.concat_ws("|", *[F.when(F.col(f"rule_{r}"), F.lit(r)) for r in RULES])
    return df.withColumns({"flag_count": count, "is_flagged": count > 0, "triggered_rules": names})
