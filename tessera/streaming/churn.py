"""Counts and sums of events by windows of time, on tables and on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(events: DataFrame, size: str, late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) of each window; on a stream, windows close once the watermark, by which events may
    be late, has passed them."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    by = rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def watch(spark: SparkSession, source: str, target: str, checkpoint: str, size: str = "1 day") -> StreamingQuery:
    """Follows a folder of Parquet events and appends closed windows to another."""
    events = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    return windowed(events, size).writeStream.outputMode("append").option("checkpointLocation", checkpoint).format("parquet").option("path", target).trigger(availableNow=True).start()
