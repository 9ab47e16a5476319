"""The same aggregates over streams. Sources are directories of Parquet files; any streaming DataFrame works."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WATERMARK = "5 minutes"


def source(spark: SparkSession, path: str) -> DataFrame:
    """A directory of Parquet files as a stream with the schema its files have now."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def tumbling(rows: DataFrame, ts: str, keys: list[str], value: str, width: str = "1 hour", late: str = WATERMARK) -> DataFrame:
    """Mean and count per key and window."""
    at = rows.withColumn(ts, F.col(ts).cast("timestamp"))
    if at.isStreaming:
        at = at.withWatermark(ts, late)
    out = at.groupBy(F.window(ts, width), *keys).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), *keys, "mean", "n")


def sessions(rows: DataFrame, ts: str, keys: list[str], gap: str = "60 minutes", late: str = WATERMARK) -> DataFrame:
    at = rows.withColumn(ts, F.col(ts).cast("timestamp"))
    if at.isStreaming:
        at = at.withWatermark(ts, late)
    out = at.groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").cast("timestamp_ntz").alias("session_start"), *keys, "n")


def running_profile(rows: DataFrame, ts: str, key: str, value: str, late: str = WATERMARK) -> DataFrame:
    """Expanding count, mean, deviation and maximum per key, updated with each batch; state is five numbers."""

    def update(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, s, q, top = state.get if state.exists else (0, 0.0, 0.0, float("-inf"))
        for part in parts:
            x = part[value].dropna()
            n, s, q = n + len(x), s + float(x.sum()), q + float((x * x).sum())
            top = max(top, float(x.max())) if len(x) else top
        state.update((n, s, q, top))
        std = ((q - s * s / n) / (n - 1)) ** 0.5 if n > 1 and q > s * s / n else (0.0 if n > 1 else None)
        yield pd.DataFrame({key: [k[0]], "run_n": [n], "run_mean": [s / n if n else None], "run_std": [std], "run_max": [top if n else None]})

    kind = rows.schema[key].dataType.simpleString()
    out = f"{key} {kind}, run_n long, run_mean double, run_std double, run_max double"
    return rows.groupBy(key).applyInPandasWithState(update, out, "n long, s double, q double, top double", "update", "NoTimeout")


def drain(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there now and stop."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def drain_batches(stream: DataFrame, sink, checkpoint: str, mode: str = "update") -> None:
    """The same with a function of (DataFrame, batch id) as the sink."""
    stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
