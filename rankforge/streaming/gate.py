"""Streaming extension: the label-only gate over an event stream.

An addition to the audit, which itself has no streams.  Events are counted in
tumbling windows with a watermark, so late data beyond it are dropped and state
stays bounded; the closed windows are appended to a table, over which the gate's
cumulative counts are a batch query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def window_counts(events: DataFrame, delay: str = "1 hour", length: str = "1 day") -> DataFrame:
    """start, event_type, n, users of every tumbling window; works on streams and on tables."""
    grouped = events.withWatermark("ts", delay).groupBy(F.window("ts", length).alias("w"), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("user_id").alias("users")).select(F.col("w.start").alias("start"), "event_type", "n", "users")


def session_counts(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """user_id, start, end, n of every session."""
    grouped = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_once(spark: SparkSession, source: str, target: str, checkpoint: str, delay: str = "1 hour", length: str = "1 day") -> None:
    """Process all files there are below `source` and append the closed windows to `target`."""
    schema = spark.read.parquet(source).schema
    events = spark.readStream.schema(schema).parquet(source).withColumn("ts", F.col("ts").cast("timestamp"))
    out = window_counts(events, delay, length).writeStream.outputMode("append").format("parquet")
    out.option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def first_passing(counts: DataFrame, needed: int, event_type: str = "purchase") -> DataFrame:
    """start, total, passes: cumulative counts per window; the first window that passes is the gate's date."""
    per = counts.where(F.col("event_type") == event_type).groupBy("start").agg(F.sum("n").alias("n"))
    upto = Window.orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("total", F.sum("n").over(upto)).select("start", "total", (F.col("total") >= needed).alias("passes"))
