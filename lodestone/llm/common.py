"""What the corpus operators share: the shared folder, Arrow tasks and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separators of words in every contract.
SPACES = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"


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


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors.

    `put` writes a frame and reads it back; `drop` deletes tables that no later
    step reads. The table behind a returned result stays.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{len(self.paths)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self._keep = [*getattr(self, "_keep", []), out]
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark._jvm
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(self.paths[id(df)])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]], schema: str, rows: int = 1 << 20) -> DataFrame:
    """mapInArrow whose function gets set up once a task and sees `rows` rows at most at a time; it yields dicts of columns."""
    kinds = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                for out in each(batch.slice(at, rows)):
                    yield record_batch(out, kinds)

    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def record_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    made = [x if isinstance(x := columns[f.name], pa.Array) and x.type == f.type else pa.array(x, type=f.type) for f in schema]
    return pa.RecordBatch.from_arrays(made, schema=schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Null texts count as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of no more bytes of text than that, or of one row: what a task holds as Python strings does not grow with the batch."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is a node of the same component, one for each.

    Every node hooks to its least neighbour, and that one's; what is left of the
    edges between hooked nodes goes on to the next round, so each round has
    fewer, and the rounds' labels are put together from the last to the first.
    Hooking is a min that Spark combines before the shuffle; the joins are plain
    and thus split by AQE where a node is a hub. Only a count goes to the driver.
    """
    rounds, old = [], []
    left = scratch.put(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while True:
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("to")).union(left.select("b", "a"))
        hooked = scratch.put(ends.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("root")))
        jumped = hooked.join(hooked.select(F.col("node").alias("root"), F.col("root").alias("next")), "root").select("node", F.col("next").alias("root"))
        labels = scratch.put(jumped)
        rounds.append(labels)
        moved = left.join(labels.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(labels.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        after = scratch.put(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        old += [left, hooked]
        left = after
        if not left.limit(1).count():
            break
    out = rounds[-1]
    for labels in rounds[-2::-1]:
        final = labels.join(out.select(F.col("node").alias("root"), F.col("root").alias("last")), "root", "left")
        out = scratch.put(final.select("node", F.coalesce("last", "root").alias("root")))
    scratch.drop(*old)
    return out
