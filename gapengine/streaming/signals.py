"""Streaming extensions: deduplication and counts of signals as they arrive, with watermarks. The batch operators don't need them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapengine.operators.ingest import dedup_key


def deduplicated(stream: DataFrame, late: str = "10 minutes", time: str = "timestamp", text: str = "text", rating: str = "rating") -> DataFrame:
    """The first signal of each text and rating within the watermark; state is dropped after it."""
    return stream.withColumn("dedup_key", dedup_key(F.col(text), F.col(rating))).withWatermark(time, late).dropDuplicatesWithinWatermark(["dedup_key"]).drop("dedup_key")


def counted(stream: DataFrame, by: str, window: str = "1 hour", late: str = "10 minutes", time: str = "timestamp") -> DataFrame:
    """(window_start, by, n, mean_rating) of tumbling windows; late rows are dropped by the watermark."""
    out = stream.withWatermark(time, late).groupBy(F.window(time, window), by).agg(F.count("*").alias("n"), F.avg("rating").alias("mean_rating"))
    return out.select(F.col("window.start").alias("window_start"), by, "n", "mean_rating")
