"""A notification log for Structured Streaming: append-only Parquet, read as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "sequence long, channel string, payload string, sent_at timestamp"


def append(spark: SparkSession, path: str, items: list[tuple[int, str, str]]) -> None:
    """Append (sequence, channel, payload) rows to the log."""
    spark.createDataFrame(items, "sequence long, channel string, payload string").withColumn("sent_at", F.current_timestamp()).write.mode("append").parquet(path)


def stream(spark: SparkSession, path: str, channel: str | None = None) -> DataFrame:
    """The log as a stream, of one channel or all."""
    rows = spark.readStream.schema(LOG).parquet(path)
    return rows if channel is None else rows.filter(F.col("channel") == channel)


def counts(rows: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Items a channel and time window; state older than ``late`` is let go."""
    return rows.withWatermark("sent_at", late).groupBy(F.window("sent_at", window), "channel").agg(F.count("*").alias("n"))
