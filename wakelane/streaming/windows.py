"""Windowed features over a stream of recordings (C4, C18) with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_features(rows: DataFrame, key: str, ts: str, x: str, window: str, late: str) -> DataFrame:
    """Mean, deviation, extremes and count per key and tumbling window; rows later than `late` are dropped by the watermark."""
    grouped = rows.withWatermark(ts, late).groupBy(F.window(ts, window), key)
    return grouped.agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std_dev"), F.min(x).alias("min"), F.max(x).alias("max"), F.count("*").alias("n")).select(key, F.col("window.start").alias("start"), "mean", "std_dev", "min", "max", "n")


def run_to_memory(features: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    """Starts the query into Spark's memory sink, for tests and trials."""
    return features.writeStream.outputMode(mode).format("memory").queryName(name).start()
