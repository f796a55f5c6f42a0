"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="lodestone-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


class Steps:
    """What the steps of a run wrote: a row (step, rows, ms) for each table, counted by Spark while it is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.written = spark, []

    def frame(self) -> DataFrame:
        return self.spark.createDataFrame(self.written, "step string, rows long, ms double")


class Scratch:
    """Writes frames as tables and reads them back: what several steps read is computed once, and lost executors cost nothing done before.

    With steps, a table that is put by name is a step of theirs. The tables that
    a result reads stay until whoever asked for it deletes `base`, or the shared folder.
    """

    def __init__(self, spark: SparkSession, name: str, steps: Steps | None = None):
        self.spark, self.base, self.n, self.steps = spark, f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}", 0, steps

    def put(self, df: DataFrame, step: str | None = None) -> DataFrame:
        path, self.n = f"{self.base}/{self.n}", self.n + 1
        if self.steps is None or step is None:
            df.write.parquet(path)
        else:
            seen, began = Observation(), time.perf_counter()
            df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
            self.steps.written.append((step, seen.get["rows"], 1000 * (time.perf_counter() - began)))
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Deletes all tables put so far; no frame that reads them can be used afterwards."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
