"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target number of words; a document's expected copies are its
source's target over the source's size. Whole parts are kept and the fractions
rounded together: two documents of a source pair up, words move at random from
one to the other until one of them has a whole number of copies, and the other
goes on to the next pair. A move keeps the sum of words, so a source's words
miss its target by less than one document; the odds keep each document's
expectation.

Documents are dealt by a hash of their id, never by source, so a source with a
third of all rows is spread over all tasks. A chunk leaves one unsettled
document a source; those of `fan_in` chunks meet at the next level, and so on
up a tree of logarithmic height. About `RESERVE` documents a source stay out of
the pairs: at the end, from the longest down, the words still owed move on to
each of them in turn and its copies are drawn, so what is left over in the end
is about a short document's length. Randomness comes from hashes of ids and
the seed: reruns agree.

Edge cases: null text has no words; a null source is a source, last in order;
documents without words settle by their own hash; repeated rows are mixed each;
rows of the same id and size are told apart by a hash of all their columns, so
that the order they arrive in plays no part; all copies of one row are in one
chunk, which is one task's and goes through them one by one; a text of any length is one number
here, its words; an empty table gives an empty table; other columns pass
through whatever their names, but for those of the results, which take their
place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from lodestone.llm.common import Scratch, record_batch

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: Documents in a chunk, on average, and chunks that meet at each level of the tree.
CHUNK_ROWS, FAN_IN = 2000, 16
#: Documents of a source kept for the end, on average, and one in so many at most.
RESERVE, RESERVE_SHARE = 256, 4


def word_count() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size and target: weights share out the words, none above `most` times its size.

    Sources fill in the order of size over weight: those whose fair level is
    above their limit stop at it, which is a prefix of that order, and the rest
    share what remains. One row a source takes part, whatever the documents.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    n = len(weights)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % n + 1).cast("int"))
    every = Window.partitionBy()
    ahead = Window.orderBy("fills", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        totals.withColumn("weight", weight)
        .withColumn("limit", most * F.col("source_size"))
        .withColumn("fills", F.col("limit") / F.col("weight"))
        .withColumn("all", share * F.sum("source_size").over(every))
        .withColumn("level", (F.col("all") - F.coalesce(F.sum("limit").over(ahead), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(ahead), F.lit(0.0))))
        .withColumn("full", F.col("level") >= F.col("fills"))
    )
    rest = F.col("all") - F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0.0)).over(every)
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0.0)).over(every)
    return filled.withColumn("target", F.when(F.col("full"), F.col("limit")).otherwise(F.col("weight") * rest / open_weight)).select("source", "source_size", "target", "full", "n_docs")


def _uniform(*parts) -> float:
    return xxhash.xxh3_64_intdigest(repr(parts).encode()) / 2.0**64


def _pivot(a: tuple, b: tuple, u: float) -> tuple[float, float]:
    """New fractions of a and b, each (fraction, size): one is 0 or 1, the words of both stay the same."""
    (p, s), (q, t) = a, b
    to_a, to_b = min((1 - p) * s, q * t), min(p * s, (1 - q) * t)
    if u * (to_a + to_b) < to_b:
        return (1.0, q - to_a / t) if to_a == (1 - p) * s else (p + to_a / s, 0.0)
    return (0.0, q + to_b / t) if to_b == p * s else (p - to_b / s, 1.0)


def _close(row: pa.RecordBatch, kinds: pa.Schema, fraction: float, settled: bool) -> pa.RecordBatch:
    columns = {f.name: row.column(f.name) for f in kinds}
    columns["copies"] = [columns["base"].to_pylist()[0] + round(fraction)] if settled else [None]
    return record_batch(columns | {"fraction": [fraction]}, kinds)


def _settle(rows: DataFrame, seed: int, level: int) -> DataFrame:
    """One level of the tree: of each (chunk, source), pairs settle one of two until one document is left open."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = rows.schema
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the open document: its row once its batch is gone; fraction, size, id
        group, held, carry = None, None, (0.0, 0, None)
        for batch in batches:
            keys = list(zip(batch.column("chunk").to_pylist(), batch.column("source").to_pylist(), strict=True))
            sizes, fractions, base, ids = (batch.column(c).to_pylist() for c in ("size", "fraction", "base", "doc_id"))
            copies: list[int | None] = [None] * batch.num_rows
            at = -1  # the open document's place in this batch; -1: in an earlier one
            for i, key in enumerate(keys):
                if key != group:
                    if group is not None:
                        yield _close(batch.slice(at, 1) if at >= 0 else held, kinds, carry[0], False)
                    group, at, carry = key, i, (fractions[i], sizes[i], ids[i])
                    continue
                p, s, doc = carry
                p, q = _pivot((p, s), (fractions[i], sizes[i]), _uniform(seed, level, doc, ids[i]))
                if 1e-12 < q < 1 - 1e-12:
                    if at >= 0:
                        copies[at] = base[at] + round(p)
                    else:
                        yield _close(held, kinds, p, True)
                    at, carry = i, (q, sizes[i], ids[i])
                else:
                    copies[i] = base[i] + round(q)
                    carry = (p, s, doc)
            if done := [i for i, c in enumerate(copies) if c is not None]:
                columns = {f.name: batch.column(f.name) for f in kinds} | {"copies": copies}
                yield record_batch(columns, kinds).take(pa.array(done))
            if at >= 0:  # a copy, so that the batch can go
                held = batch.take(pa.array([at]))
        if group is not None:
            yield _close(held, kinds, carry[0], False)

    return rows.repartition("chunk").sortWithinPartitions("chunk", F.col("source").asc_nulls_last(), "doc_id", "size", "tie").mapInArrow(run, schema)


def _finish(rows: DataFrame, seed: int) -> DataFrame:
    """What is open of each source, from the longest document down: owed words move on to it, then its copies are drawn."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = rows.schema
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, owed = (), 0.0
        for batch in batches:
            copies = []
            for source, size, p, base, doc in zip(*(batch.column(c).to_pylist() for c in ("source", "size", "fraction", "base", "doc_id")), strict=True):
                if group != (source,):
                    group, owed = (source,), 0.0
                owed += p * size
                take = _uniform(seed, "end", doc, size) < owed / size
                owed -= take * size
                copies.append(base + take)
            yield record_batch({f.name: batch.column(f.name) for f in kinds} | {"copies": copies}, kinds)

    return rows.repartition("source").sortWithinPartitions(F.col("source").asc_nulls_last(), F.col("size").desc(), "doc_id", "tie").mapInArrow(run, schema)


#: What `mix` adds to a document.
RESULTS = ("size", "source_size", "target", "copies")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 42, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN, size: Column | None = None) -> DataFrame:
    """docs' columns with size, source_size, target and copies: how often each document is taken.

    docs has doc_id and source, and text unless `size` says how long a document is.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    # the caller's columns go by numbers meanwhile, so that no name of theirs meets one of the work
    names = [c for c in docs.columns if c not in RESULTS]
    size = word_count() if size is None else size
    held = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
    tie = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
    sized = docs.select(*held, "doc_id", "source", size.cast("long").alias("size"), tie.alias("tie"))
    targets = scratch.put(source_targets(sized, weights, share, most))
    n_docs = targets.agg(F.sum("n_docs")).head()[0] or 0
    chunks = max(1, -(-n_docs // chunk_rows))

    joined = sized.join(targets.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    expected = F.when(F.col("full"), F.lit(most)).when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    share_out = lambda tag: F.xxhash64("doc_id", "source", "size", F.lit(f"{tag}{seed}"))
    alone = F.pmod(share_out("alone"), F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.col("fraction")
    start = spark_schema(
        joined.withColumn("fraction", expected)
        .withColumn("base", F.floor("fraction").cast("long"))
        .withColumn("fraction", F.col("fraction") - F.col("base"))
        .withColumn("chunk", F.when(F.pmod(share_out("reserve"), F.greatest(F.lit(RESERVE_SHARE), F.floor(F.col("n_docs") / RESERVE))) > 0, F.pmod(share_out("chunk"), F.lit(chunks))))
        # without words or a fraction there is nothing to trade
        .withColumn("copies", F.when((F.col("size") == 0) | (F.col("fraction") == 0), F.col("base") + alone.cast("long")))
        .drop("full", "n_docs")
    )
    settled = [start.where("copies IS NOT NULL")]
    rows, level = start.where("copies IS NULL AND chunk IS NOT NULL"), 0
    while True:
        out = scratch.put(_settle(rows, seed, level))
        settled.append(out.where("copies IS NOT NULL"))
        rows = out.where("copies IS NULL")
        if chunks == 1:
            break
        rows = rows.withColumn("chunk", F.floor(F.col("chunk") / fan_in).cast("long"))
        chunks, level = -(-chunks // fan_in), level + 1
    settled.append(scratch.put(_finish(rows.unionByName(start.where("copies IS NULL AND chunk IS NULL")), seed)))
    result = settled[0]
    for more in settled[1:]:
        result = result.unionByName(more)
    return result.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], *RESULTS)


def spark_schema(df: DataFrame) -> DataFrame:
    """The same frame, the columns of the work nullable and of fixed types."""
    fixed = {"size": LongType(), "source_size": LongType(), "target": DoubleType(), "fraction": DoubleType(), "base": LongType(), "chunk": LongType(), "copies": LongType()}
    schema = StructType([StructField(f.name, fixed.get(f.name, f.dataType), True) for f in df.schema])
    return df.to(schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    scratch = Scratch(spark, "mix-sizes")
    sized = scratch.put(docs.select("doc_id", "source", word_count().alias("size")))
    mixed = mix(sized, size=F.col("size"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
