"""The same figures over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "60 seconds") -> DataFrame:
    """Events of a user in each window; state older than `late` goes."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "user_id").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "user_id", "n")
