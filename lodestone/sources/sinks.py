"""Writing: a checked replacement of the catalog, rows with the time they were cached, responses as documents and telemetry."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.index import build
from lodestone.operators.releases import upsert
from lodestone.sources.scratch import Scratch

NEEDED = {"id", "title", "artist"}


def _swap(spark, beside: str, path: str) -> None:
    """Puts beside in path's place; what was there is put back if that fails."""
    jvm = spark._jvm
    target, made = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(beside)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    before = jvm.org.apache.hadoop.fs.Path(f"{beside}.before")
    there = fs.exists(target)
    if there and not fs.rename(target, before):
        raise OSError(f"{path} cannot be moved away; the new catalog is in {beside}")
    if not fs.rename(made, target):
        if there and not fs.rename(before, target):
            raise OSError(f"the old catalog is in {before}, the new one in {beside}")
        raise OSError(f"{path} could not be replaced; the new catalog is in {beside}")
    fs.delete(before, True)


def replace_catalog(new: DataFrame, path: str, indexed: bool = False) -> DataFrame:
    """Writes new beside path, counts it, and then puts it in path's place: (status, row_count, finished).

    If indexed, path holds the folders catalog and index, which are replaced together.
    """
    if missing := NEEDED - set(new.columns):
        raise ValueError(f"a catalog needs the columns {sorted(missing)}")
    spark = new.sparkSession
    beside = f"{path}.{uuid.uuid4().hex}"
    rows = f"{beside}/catalog" if indexed else beside
    new.write.parquet(rows)
    n = spark.read.parquet(rows).count()
    if indexed:
        build(spark.read.parquet(rows), f"{beside}/index")
    _swap(spark, beside, path)
    return spark.range(1).select(F.lit("ok").alias("status"), F.lit(n).alias("row_count"), F.current_timestamp().alias("finished"))


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def create_bucketed(rows: DataFrame, path: str, keys: list[str], buckets: int = 64) -> None:
    """Writes rows to a new table whose folders are the buckets of their keys."""
    spread = rows.withColumn("_bucket", bucket_of(keys, buckets))
    spread.repartition("_bucket").sortWithinPartitions("_bucket", *keys).write.partitionBy("_bucket").parquet(path)


def merge_bucketed(new: DataFrame, path: str, keys: list[str], buckets: int = 64) -> DataFrame:
    """Upserts new by its keys into a table of `create_bucketed`: (buckets, rows) written anew; folders without a new key stay as they are.

    The merged buckets are written beside the table first, so that they are
    whole before any is replaced, and a run that failed can be repeated.
    """
    spark = new.sparkSession
    scratch = Scratch(spark, "merge")
    fresh = scratch.put(new.withColumn("_bucket", bucket_of(keys, buckets)))
    # no more than `buckets` numbers
    touched = sorted(r[0] for r in fresh.select("_bucket").distinct().collect())
    old = spark.read.schema(fresh.schema).parquet(path).where(F.col("_bucket").isin(touched))
    merged = scratch.put(upsert(old.select(*fresh.columns), fresh, keys).repartition("_bucket").sortWithinPartitions("_bucket", *keys))
    n = merged.count()
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)
    scratch.drop()
    return spark.createDataFrame([(len(touched), n)], "buckets int, rows long")


def upsert_cached(old: DataFrame, new: DataFrame, keys: list[str], source: str = "api_fetch", now: Column | None = None) -> DataFrame:
    """Rows (keys, source, cached_at): those of new are cached now, whether or not old has them."""
    fresh = new.select(*keys).distinct().select(*keys, F.lit(source).alias("source"), (F.current_timestamp() if now is None else now).alias("cached_at"))
    return upsert(old, fresh, keys)


def responses(rows: DataFrame) -> DataFrame:
    """One row a request from `lookup`'s rows: req_id and response, the JSON document of its results in order and what holds for all of them."""
    item = F.struct("rank", "id", "title", "artist", "confidence", F.struct("release_id", "album", F.col("release_artist").alias("artist"), "artwork_url").alias("artwork"))
    # five results at most
    results = F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), item)))
    whole = ["search_type", "song_not_found", "found_on_compilation", "context", "corrected_artist"]
    one = rows.groupBy("req_id").agg(results.alias("results"), *[F.any_value(c).alias(c) for c in whole])
    return one.select("req_id", F.to_json(F.struct("results", F.size("results").alias("total"), *whole), {"ignoreNullFields": "false"}).alias("response"))


def telemetry(events: DataFrame) -> DataFrame:
    """What one batch reports of itself, from rows (step, ms): calls, milliseconds and share of the whole for each step, and all steps as `total`."""
    steps = events.groupBy("step").agg(F.count("*").alias("calls"), F.round(F.sum("ms"), 4).alias("ms"))
    whole = events.agg(F.lit("total").alias("step"), F.count("*").alias("calls"), F.round(F.sum("ms"), 4).alias("ms"))
    return steps.unionByName(whole.where("calls > 0"))
