"""Streams over events: attempts in sliding windows, and first uses of single-use tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attempt_windows(events: DataFrame, key: str = "user_id", time: str = "ts", length: str = "15 minutes", slide: str = "1 minute", late: str = "1 day") -> DataFrame:
    """Attempts of a key in each window; state older than `late` goes."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return rows.groupBy(F.window(time, length, slide), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def first_uses(events: DataFrame, token: str, time: str = "ts", late: str = "1 day") -> DataFrame:
    """The first event of each token within the watermark."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([token])
