"""File streams of metric parts with the same roll-ups as the batch tables (an addition of this library)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_parts(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Parquet parts of a folder as they arrive."""
    return spark.readStream.schema(schema).parquet(folder)


def windowed_ranks(parts: DataFrame, time: str, late: str, width: str, key: str, value: str) -> DataFrame:
    """Count, mean and extremes of a value by key and time window; rows later than the watermark are left out."""
    g = parts.withWatermark(time, late).groupBy(F.window(time, width), key)
    return g.agg(F.count(value).alias("n"), F.avg(value).alias("mean_value"), F.min(value).alias("least"), F.max(value).alias("most")).select(F.col("window.start").alias("start"), key, "n", "mean_value", "least", "most")


def append_once(parts: DataFrame, out: str, checkpoint: str):
    """Writes what has arrived as Parquet, each row once, and stops."""
    return parts.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
