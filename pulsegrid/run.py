"""Run named stages over telemetry folders: ``python -m pulsegrid.run --input DIR --output DIR [--only a,b | --from a]``.

Each stage reads what earlier ones wrote, writes its own folder and is skipped where that exists unless
``--force``. Input: Parquet of readings (timestamp, hostname, sensor, value) and, optionally, of jobs
(job_id, hostname, start_time, end_time, cpus) and incidents (event_id, hostname, category, event_start,
event_end).
"""

from __future__ import annotations

import argparse
import time
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.windows import robust_z
from pulsegrid.operators import audit, detectors, evaluation, features, fusion, master
from pulsegrid.session import session


@dataclass
class Config:
    """Settings of a run; defaults are the detectors' published ones."""

    train_end: str = "2026-02-28 23:59:59"
    val_end: str = "2026-03-08 23:59:59"
    maintenance: list[tuple[datetime, datetime]] = field(default_factory=list)
    spike_z: float = 6.0
    spike_points: int = 30
    flat_rows: int = 30
    sensors: list[str] = field(default_factory=list)


def _audit(spark: SparkSession, c: Config, at) -> DataFrame:
    rows = master.bucket_mean(spark.read.parquet(at("input/readings")).withColumnRenamed("timestamp", "ts"), ["hostname", "sensor"], "ts", "value")
    rows = audit.flag_duplicates(rows)
    rows = audit.flag_spikes(rows, "value", ["hostname", "sensor"], ["ts"], c.spike_points, c.spike_z)
    rows = audit.flag_flatlines(rows, "value", ["hostname", "sensor"], ["ts"], c.flat_rows)
    return rows.withColumn("flags", audit.bitmask(dup=F.col("dup"), spike=F.col("spike"), flatline=F.col("flatline"))).drop("dup", "spike", "flatline")


def _master(spark: SparkSession, c: Config, at) -> DataFrame:
    long = spark.read.parquet(at("audit"))
    wide = master.long_to_wide(long, ["hostname", "ts"], "sensor", "value", c.sensors)
    flags = long.groupBy("hostname", "ts").agg(F.bool_or(F.col("flags") > 0).alias("audit_any"))
    out = wide.join(flags, ["hostname", "ts"])
    return out.withColumns({"split": master.split_of(F.col("ts"), c.train_end, c.val_end), "regime_id": master.regime_id(F.col("ts"), c.maintenance)})


def _features(spark: SparkSession, c: Config, at) -> DataFrame:
    out = spark.read.parquet(at("master"))
    columns = [f"{s}_avg" for s in c.sensors]
    for name in columns:
        out = features.rolling_features(out, name, ["hostname"], ["ts"], (5, 15, 60), (), ())
    clean = (F.col("split") == "train") & ~F.col("audit_any") & (F.col("regime_id") >= 0)
    stats = features.norm_stats(out, columns, "hostname", clean)
    for name in columns:
        out = features.normalise(out, stats, "hostname", name)
    return out


def _detect(spark: SparkSession, c: Config, at) -> DataFrame:
    columns = [f"{s}_avg" for s in c.sensors]
    df = spark.read.parquet(at("features"))
    out = detectors.zscore_detector(df, columns, "hostname", ["ts"], F.col("split") != "test")
    return robust_z(out, "max_z", F.col("split") == "train", "phase1")


def _episodes(spark: SparkSession, c: Config, at) -> DataFrame:
    return fusion.candidate_episodes(spark.read.parquet(at("detect")), ["hostname"], ["ts"], F.col("phase1") >= 0.7, ["phase1"])


def _evaluate(spark: SparkSession, c: Config, at) -> DataFrame:
    e = spark.read.parquet(at("episodes")).withColumn("alert_id", F.xxhash64("hostname", "episode_start"))
    return evaluation.event_metrics(e, spark.read.parquet(at("input/incidents")), "alert_id", "event_id", "hostname", ("episode_start", "episode_end"))


STAGES = {"audit": _audit, "master": _master, "features": _features, "detect": _detect, "episodes": _episodes, "evaluate": _evaluate}


def select(only: str | None = None, start: str | None = None) -> list[str]:
    names = list(STAGES)
    if only:
        return [n for n in names if n in only.split(",")]
    return names[names.index(start) :] if start else names


def run(spark: SparkSession, config: Config, source: str, target: str, stages: list[str], force: bool = False) -> dict[str, float]:
    """Run stages in order; returns seconds by stage. A stage that exists is left alone unless forced."""
    at = lambda name: f"{source}/{name.removeprefix('input/')}" if name.startswith("input/") else f"{target}/{name}"
    took = {}
    for name in stages:
        began = time.monotonic()
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at(name)}/_SUCCESS")
        if force or not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            STAGES[name](spark, config, at).write.mode("overwrite").parquet(at(name))
        took[name] = round(time.monotonic() - began, 3)
    return took


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--sensors", required=True, help="comma-separated sensor names")
    p.add_argument("--train-end", default=Config.train_end)
    p.add_argument("--val-end", default=Config.val_end)
    p.add_argument("--only")
    p.add_argument("--from", dest="start", choices=list(STAGES))
    p.add_argument("--force", action="store_true")
    a = p.parse_args(argv)
    config = Config(train_end=a.train_end, val_end=a.val_end, sensors=a.sensors.split(","))
    for name, seconds in run(session(), config, a.input, a.output, select(a.only, a.start), a.force).items():
        print(f"{name}: {seconds} s")


if __name__ == "__main__":
    main()
