"""Operating figures from an event log: counters, health, cache hits and call rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds that a cached answer lives, seconds and calls of the rate limit. Fixed values.
TTL_SECONDS, RATE_SECONDS, RATE_CALLS = 3600, 60, 50


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def counters(events: DataFrame) -> DataFrame:
    """Hits, misses, calls and their milliseconds for each user."""
    kind = lambda *k: F.col("event_type").isin(*k)
    return events.groupBy("user_id").agg(
        F.count_if(kind("view")).alias("memory_hits"),
        F.count_if(kind("click")).alias("pg_hits"),
        F.count_if(kind("error")).alias("pg_misses"),
        F.count_if(kind("purchase", "signup")).alias("api_calls"),
        F.round(F.sum(F.when(kind("click", "error"), F.col("value")).otherwise(0.0)), 4).alias("pg_time_ms"),
        F.round(F.sum(F.when(kind("purchase", "signup"), F.col("value")).otherwise(0.0)), 4).alias("api_time_ms"),
    )


def health(events: DataFrame) -> DataFrame:
    """A day is healthy without errors, unhealthy with nothing else, degraded between."""
    bad = F.col("event_type") == "error"
    return events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.when(~F.bool_or(bad), "healthy").when(F.bool_and(bad), "unhealthy").otherwise("degraded").alias("status"))


def cache_hits(events: DataFrame, seconds: int = TTL_SECONDS) -> DataFrame:
    """Whether a user's same event came within `seconds` before: what a cache of that life would have answered."""
    key = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return events.withColumn("hit", F.coalesce(_micros("ts") - F.lag(_micros("ts")).over(key) <= seconds * 1_000_000, F.lit(False))).select("event_id", "hit")


def rates(events: DataFrame, seconds: int = RATE_SECONDS, calls: int = RATE_CALLS) -> DataFrame:
    """A user's calls in the `seconds` up to each one, and whether they are within the limit."""
    span = Window.partitionBy("user_id").orderBy(_micros("ts")).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("in_window", F.count("*").over(span)).select("event_id", "in_window", (F.col("in_window") <= calls).alias("allowed"))
