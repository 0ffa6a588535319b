"""Streaming extension: cell density over report time. The batch operators have no streaming counterpart to match."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events_stream(spark: SparkSession, path: str) -> DataFrame:
    """A folder of event files that grows."""
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(path)


def density_stream(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows (start, event_type, n) once the watermark has passed the window; repeated ids count once."""
    e = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    g = e.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n")


def density_batch(events: DataFrame, width: str = "1 day") -> DataFrame:
    """The same over a finished table."""
    g = events.dropDuplicates(["event_id"]).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n")
