"""Structured Streaming over an event table: an extension, with no counterpart among the query features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_a_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def windowed(events: DataFrame, time: str, keys: list[str], length: str = "1 hour", slide: str | None = None, late: str = "10 minutes", measure: str | None = None) -> DataFrame:
    """Counts (and sums of `measure`) by key and time window; rows later than `late` are dropped by the watermark. Works on batches too."""
    given = events.withWatermark(time, late) if events.isStreaming else events
    window = F.window(time, length, slide) if slide else F.window(time, length)
    measures = [F.count(F.lit(1)).alias("n")] + ([F.sum(measure).alias("total")] if measure else [])
    return given.groupBy(window.alias("w"), *keys).agg(*measures).select(F.col("w.start").alias("window_start"), *keys, *[F.col(c) for c in ["n"] + (["total"] if measure else [])])


def sessions(events: DataFrame, time: str, keys: list[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    given = events.withWatermark(time, late) if events.isStreaming else events
    return given.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")
