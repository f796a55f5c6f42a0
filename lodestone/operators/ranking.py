"""Ordered results as rows with a rank: keep-first, top-k and first-non-empty cascades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key with their rank; Spark cuts groups before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def keep_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_k(rows, keys, order, 1).drop("rank")


def first_hit(key: str, tiers: list[DataFrame]) -> DataFrame:
    """Rows of the first tier that has any for the key, with the tier's number."""
    every = reduce(DataFrame.unionByName, [t.withColumn("tier", F.lit(i)) for i, t in enumerate(tiers, 1)])
    return every.withColumn("best", F.min("tier").over(Window.partitionBy(key))).where("tier = best").drop("best")
