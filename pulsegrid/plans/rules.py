"""The threshold detector over the supplied readings, and SQL for each rule, written from the rules' definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import rules
from pulsegrid.plans.base import BY, ORDER, T, TRAIN_END, W, query
from pulsegrid.sources.adapters import telemetry

#: Limits, frames and runs that suit the supplied readings: some hundred rows a host, values from 0 to some hundreds.
SETTINGS = {
    "system_power": 900.0, "gpu_system_power": 1100.0, "cpu_temp": 30.0, "inlet_temp": 18.0, "cpu_component_power": 500.0, "fan_power": 120.0, "gpu_temp": 30.0,
    "fan_rpm_low": 900.0, "fan_temp": 8.0, "gpu_power": 200.0, "gpu_util_low": 20.0, "fan_cap": 2500.0, "idle_rise": 5.0, "gpu_rate_rows": 3, "gpu_rate": 5.0, "cold_inlet": 15.0, "host_q": 0.5,
    "host_factor": 0.9, "flat_ratio": 0.6, "median_rows": 20, "fan_least": 6, "idle_least": 3, "flat_rows": 4, "flat_least": 3, "flat_past": 12, "flat_past_least": 4, "flat_lag": 4,
    "persist": 2, "idle_run": 1, "flat_run": 2, "drop_run": 1, "cold_run": 2,
}

#: Sensors made from the readings: name, expression in SQL.
_SENSORS = {
    "systeminputpower_avg": "value * 30",
    "cpu_temperaturereading_avg": "value",
    "inlet_temperaturereading_avg": "CASE WHEN event_id % 19 <> 0 THEN value / 2 END",
    "gpu_temperaturereading_avg": "value * 0.9",
    "rackinlettemperature1_avg": "value / 3",
    "rpmreading_avg": "value * 60 + event_id % 300",
    "totalcpupower_avg": "value * 15",
    "totalfanpower_avg": "value * 4",
    "gpu_powerconsumption_avg": "value * 9",
    "gpuusage_avg": "CAST(event_id % 40 AS DOUBLE)",
    "cpuusage_avg": "CAST(event_id % 9 AS DOUBLE) + CASE WHEN event_id % 4 = 0 THEN 95 ELSE 0 END",
}

_RAW = f"{T}, x AS (SELECT event_id, hostname, ts, event_id % 3 <> 0 AS busy, rack_id < 5 AS gpu, {', '.join(f'{sql} AS {name}' for name, sql in _SENSORS.items())} FROM t)"


def _frame(spark, d):
    df = telemetry(spark, d).selectExpr("event_id", "hostname", "ts", "event_id % 3 <> 0 AS busy", "rack_id < 5 AS gpu", *[f"{sql} AS {name}" for name, sql in _SENSORS.items()])
    return df


def _flagged(spark, d):
    clean = F.col("ts") <= F.lit(TRAIN_END).cast("timestamp_ntz")
    return rules.threshold_rules(_frame(spark, d), BY[0], ORDER, F.col("busy"), F.col("gpu"), clean, SETTINGS)


def _sql() -> str:
    s = rules.SETTINGS | SETTINGS
    limits = {"power": ("systeminputpower_avg", None), "cpu": ("cpu_temperaturereading_avg", "cpu_temp"), "inlet": ("inlet_temperaturereading_avg", "inlet_temp"), "comp": ("totalcpupower_avg", "cpu_component_power"), "fan": ("totalfanpower_avg", "fan_power"), "gput": ("gpu_temperaturereading_avg", "gpu_temp")}
    tops = ", ".join(f"quantile_cont({c}, {s['host_q']}) * {s['host_factor']} AS top_{k}" for k, (c, _) in limits.items())
    high = {}
    for k, (c, fleet) in limits.items():
        base = f"CASE WHEN gpu THEN {s['gpu_system_power']} ELSE {s['system_power']} END" if fleet is None else str(s[fleet])
        high[k] = f"COALESCE({c}, 0) > greatest({base}, COALESCE(top_{k}, 0))"
    med = lambda c, least: f"CASE WHEN COUNT({c}) OVER m >= {least} THEN quantile_cont({c}, 0.5) OVER m END"
    std = lambda c, w, least: f"CASE WHEN COUNT({c}) OVER {w} >= {least} THEN stddev_samp({c}) OVER {w} END"
    still = {"f1": ("rackinlettemperature1_avg", 0.25, None), "f2": ("systeminputpower_avg", 15.0, None), "f3": ("totalcpupower_avg", 10.0, None), "f4": ("cpuusage_avg", 5.0, 95.0)}
    flats = {k: f"({std(c, 'a', s['flat_least'])}) < {s['flat_ratio']} * ({std(c, 'p', s['flat_past_least'])}) AND {c} IS NOT NULL AND ({std(c, 'p', s['flat_past_least'])}) > {floor}" + (f" AND {c} >= {low}" if low else "") for k, (c, floor, low) in still.items()}
    gone = " + ".join(f"({c} IS NULL)::INT" for c in ("systeminputpower_avg", "rackinlettemperature1_avg", "rpmreading_avg", "totalcpupower_avg", "gpu_powerconsumption_avg"))
    raw = {
        "HIGH_SYSTEM_POWER": high["power"], "HIGH_CPU_TEMP": high["cpu"], "HIGH_INLET_TEMP": high["inlet"], "HIGH_CPU_COMPONENT_POWER": high["comp"], "HIGH_FAN_POWER": high["fan"],
        "HIGH_GPU_TEMP": f"gpu AND ({high['gput']} OR COALESCE(gpu_temperaturereading_avg - lag(gpu_temperaturereading_avg, {s['gpu_rate_rows']}) OVER o >= {s['gpu_rate'] * s['gpu_rate_rows']}, FALSE))",
        "FAN_FAIL": f"rpmreading_avg < {s['fan_rpm_low']} AND (COALESCE(cpu_temperaturereading_avg, 0) > {s['fan_temp']} OR COALESCE(inlet_temperaturereading_avg, 0) > {s['fan_temp']} OR COALESCE(gpu_temperaturereading_avg, 0) > {s['fan_temp']})",
        "GPU_POWER_IDLE": f"gpu AND busy AND COALESCE(gpu_powerconsumption_avg, 0) > {s['gpu_power']} AND COALESCE(gpuusage_avg, 0) < {s['gpu_util_low']}",
        "FAN_RPM_PCT_DROP": f"med_rpm > 100 AND rpmreading_avg < {s['fan_share']} * med_rpm AND rpmreading_avg < {s['fan_cap']}",
        "IDLE_POWER_SURGE": f"idle AND systeminputpower_avg > med_idle + {s['idle_rise']}",
        "DROPOUT": f"{gone} >= {s['drop_families']}",
        "COLD_INLET_DROP": f"inlet_temperaturereading_avg > 0 AND inlet_temperaturereading_avg < {s['cold_inlet']} AND busy",
    }
    run = dict.fromkeys(rules.PERSISTENT, s["persist"]) | {"IDLE_POWER_SURGE": s["idle_run"], "DROPOUT": s["drop_run"], "COLD_INLET_DROP": s["cold_run"]} | dict.fromkeys(still, s["flat_run"])
    flags = raw | flats
    windows = f"WINDOW o AS ({W}), m AS ({W} ROWS {s['median_rows'] - 1} PRECEDING), a AS ({W} ROWS {s['flat_rows'] - 1} PRECEDING), p AS ({W} ROWS BETWEEN {s['flat_past'] + s['flat_lag'] - 1} PRECEDING AND {s['flat_lag']} PRECEDING)"
    idle = f"NOT busy AND COALESCE(cpuusage_avg, 0) < {s['idle_cpu']}"
    parts = [
        f"top AS (SELECT hostname, {tops} FROM x WHERE ts <= TIMESTAMP '{TRAIN_END}' GROUP BY hostname)",
        f"y AS (SELECT x.*, {idle} AS idle, CASE WHEN {idle} THEN systeminputpower_avg END AS calm, top.* EXCLUDE (hostname) FROM x LEFT JOIN top USING (hostname))",
        f"z AS (SELECT *, {med('rpmreading_avg', s['fan_least'])} AS med_rpm, {med('calm', s['idle_least'])} AS med_idle FROM y {windows})",
        f"f AS (SELECT event_id, hostname, ts, {', '.join(f'COALESCE({sql}, FALSE) AS {name}' for name, sql in flags.items())} FROM z {windows})",
        f"c AS (SELECT *, {', '.join(f'CASE WHEN {n} = lag({n}) OVER o THEN 0 ELSE 1 END AS c_{n}' for n in run)} FROM f WINDOW o AS ({W}))",
        f"g AS (SELECT *, {', '.join(f'SUM(c_{n}) OVER (o ROWS UNBOUNDED PRECEDING) AS g_{n}' for n in run)} FROM c WINDOW o AS ({W}))",
        f"h AS (SELECT event_id, {', '.join(n if n not in run else f'{n} AND COUNT(*) OVER (PARTITION BY hostname, g_{n}) >= {run[n]} AS {n}' for n in flags)} FROM g)",
        f"k AS (SELECT event_id, {', '.join(f'{n} AS rule_{n}' for n in raw)}, {' OR '.join(still)} AS rule_FLATLINE FROM h)",
    ]
    return f"WITH {_RAW}, " + ", ".join(parts)


_SQL = _sql()
_COUNT = " + ".join(f"rule_{n}::BIGINT" for n in rules.RULES)
_NAMES = ", ".join(f"CASE WHEN rule_{n} THEN '{n}' END" for n in rules.RULES)


@query(f"{_SQL} SELECT event_id, {_COUNT} AS flag_count, {_COUNT} > 0 AS is_flagged, concat_ws('|', {_NAMES}) AS triggered_rules FROM k")
def threshold_rules(spark, d):
    return _flagged(spark, d).select("event_id", "flag_count", "is_flagged", "triggered_rules")


def _single(rule: str) -> None:
    def one(spark, d):
        return _flagged(spark, d).select("event_id", f"rule_{rule}")

    query(f"{_SQL} SELECT event_id, rule_{rule} FROM k", f"rule_{rule.lower()}_assembled")(one)


for _rule in ("FAN_FAIL", "GPU_POWER_IDLE", "HIGH_GPU_TEMP", "COLD_INLET_DROP", "HIGH_SYSTEM_POWER", "HIGH_CPU_TEMP", "HIGH_INLET_TEMP", "HIGH_CPU_COMPONENT_POWER", "HIGH_FAN_POWER"):
    _single(_rule)
