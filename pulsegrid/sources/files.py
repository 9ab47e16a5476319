"""Readers and writers of raw exports, reports and labelled events."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pulsegrid.functions import scalars


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header; rows that do not fit the schema are dropped. Folders are read recursively."""
    reader = spark.read.option("header", True).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True)
    return lower_names((reader.schema(schema) if schema is not None else reader).csv(path))


def csv_to_parquet(spark: SparkSession, source: str, target: str, ts: list[str] = (), bytes_: list[str] = (), values: list[str] = ("value",)) -> int:
    """Convert raw CSV: numbers by safe cast, epoch seconds or text times to UTC, byte arrays to text. Returns rows."""
    df = read_csv(spark, source)
    for c in [x for x in values if x in df.columns]:
        df = df.withColumn(c, scalars.to_float(F.col(c)))
    for c in ts:
        number = scalars.to_int(F.col(c))
        df = df.withColumn(c, F.coalesce(F.timestamp_seconds(number), F.try_to_timestamp(F.col(c))).cast("timestamp"))
    for c in bytes_:
        df = df.withColumn(c, scalars.decode_bytes(F.col(c)))
    df.write.mode("overwrite").option("compression", "snappy").parquet(target)
    return spark.read.parquet(target).count()


def read_tables(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """Union of Parquet folders with differing columns; absent or empty ones are left out, others that cannot be read raise.
    None if none is there."""
    frames = []
    for path in paths:
        try:
            frames.append(spark.read.parquet(path))
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def read_tickets(spark: SparkSession, path: str) -> DataFrame:
    """Tickets to events, one row per host of the ``hosts`` list."""
    t = read_csv(spark, path)
    start, end = F.try_to_timestamp("start_time"), F.try_to_timestamp("end_time")
    rows = t.withColumn("hostname", F.explode(F.filter(F.transform(F.split("hostnames", r"\|"), lambda h: F.trim(h)), lambda h: h != "")))
    minutes = F.greatest((F.unix_micros(end) - F.unix_micros(start)) / 6e7, F.lit(0.0))
    return rows.select("hostname", scalars.category(F.col("category")).alias("category"), scalars.severity(F.col("severity").cast("string")).alias("severity"), start.alias("event_start"), end.alias("event_end"), minutes.alias("duration_min"), "description")


def read_node_failures(spark: SparkSession, path: str, timezone: str = "America/Chicago", default_min: float = 60.0) -> DataFrame:
    """Node failures to events. Times without an offset are the facility's."""
    t = read_csv(spark, path)
    local = F.to_utc_timestamp(F.try_to_timestamp("timestamp"), timezone)
    at = F.when(F.col("timestamp").rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp("timestamp")).otherwise(local)
    minutes = F.coalesce(scalars.to_float(F.col("duration_min")), F.lit(default_min))
    return t.select(F.col("hostname"), scalars.category(F.col("failure_type")).alias("category"), F.lit(3).alias("severity"), at.alias("event_start"), F.timestamp_micros((F.unix_micros(at) + minutes * 6e7).cast("long")).alias("event_end"), minutes.alias("duration_min"))


def read_job_failures(spark: SparkSession, path: str) -> DataFrame:
    """Failed jobs to events; severity 3, 2 or 1 by exit code (1, 2, 126 and 127 are the user's)."""
    t = read_csv(spark, path)
    code, node = scalars.to_int(F.split("exit_code", ":")[0]), F.lower(F.coalesce("failure_reason", F.lit(""))).contains("node_fail")
    kept = t.where((F.coalesce(code, F.lit(0)) != 0) | node)
    level = F.when(node, 3).when(code.isin(1, 2, 126, 127), 1).otherwise(2)
    return kept.select(F.col("node").alias("hostname"), scalars.to_int(F.col("job_id")).alias("job_id"), level.alias("severity"), F.try_to_timestamp("start_time").alias("event_start"), F.try_to_timestamp("end_time").alias("event_end"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Injected faults as events of severity 3."""
    rows = spark.read.option("multiLine", True).json(path)
    return rows.withColumns({"event_start": F.try_to_timestamp("event_start"), "event_end": F.try_to_timestamp("event_end")})


def write_report(df: DataFrame, folder: str) -> None:
    """A small table as one CSV and one JSON file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/csv")
    df.coalesce(1).write.mode("overwrite").json(f"{folder}/json")


def write_partitioned(df: DataFrame, path: str, host: str = "hostname", by: str = "component") -> None:
    """Host rows together, folders by component: later reads prune by both."""
    df.repartition(host).sortWithinPartitions(host, "ts").write.mode("overwrite").partitionBy(by).parquet(path)
