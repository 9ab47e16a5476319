"""Views of the supplied star schema as machine telemetry, jobs and topology."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor readings (event_id, ts, hostname, rack_id, sensor, value): each user is a host, each event type
    a sensor, and every 17th reading is missing."""
    host = F.concat(F.lit("rpc-"), (F.col("user_id") % 10).cast("string"), F.lit("-"), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", host.alias("hostname"), (F.col("user_id") % 10).cast("int").alias("rack_id"), F.col("event_type").alias("sensor"),
        F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("value"),
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each host's readings per hour and sensor: hostname, rack_id, ts (hour), sensor, value."""
    return telemetry(spark, sf_dir).groupBy("hostname", "rack_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "sensor").agg(F.avg("value").alias("value"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job intervals per host: lines are tasks (job_id, task, hostname, start_time, end_time, cpus, req)."""
    days = F.col("l_quantity").cast("int")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("task"), F.col("l_suppkey").alias("host_id"), F.col("l_shipdate").alias("start_time"),
        (F.col("l_shipdate") + F.make_dt_interval(days)).alias("end_time"), (F.col("l_partkey") % 128 + 1).cast("double").alias("cpus"), F.col("l_extendedprice").alias("power"),
    )


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each job: failed, completed or pending."""
    state = F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "O", "COMPLETED").otherwise("PENDING")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), state.alias("job_state"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground-truth incidents: each ``error`` event starts one of an hour; every 50th concerns all hosts."""
    host = F.concat(F.lit("rpc-"), (F.col("user_id") % 10).cast("string"), F.lit("-"), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").where("event_type = 'error'").select(
        F.col("event_id").alias("gt_id"), F.when(F.col("event_id") % 50 == 0, F.lit("*")).otherwise(host).alias("hostname"),
        F.element_at(F.array(*[F.lit(c) for c in ("thermal", "power", "hardware", "software", "network")]), (F.col("event_id") % 5 + 1).cast("int")).alias("category"),
        F.col("ts").alias("event_start"), (F.col("ts") + F.expr("INTERVAL '1' HOUR")).alias("event_end"),
    )
