"""Merges that write touched buckets alone, and steps that tell of themselves."""

import hashlib

from pyspark.sql import functions as F

from lodestone.sources import sinks
from lodestone.sources.scratch import Scratch, Steps


def files(path):
    return {str(p.relative_to(path)): hashlib.md5(p.read_bytes()).hexdigest() for p in path.rglob("*.parquet")}


def rows(spark, path):
    return sorted(map(tuple, spark.read.parquet(str(path)).select("id", "k", "v").collect()), key=str)


def test_merge_leaves_other_buckets(spark, tmp_path):
    path, schema = tmp_path / "table", "id long, k string, v string"
    old = [(i, "a", f"old{i}") for i in range(200)] + [(None, None, "none")]
    sinks.create_bucketed(spark.createDataFrame(old, schema), str(path), ["id", "k"], 32)
    before = files(path)
    assert len(before) > 20 and rows(spark, path) == sorted(old, key=str)
    new = [(3, "a", "new3"), (500, "b", "new500"), (3, "c", "other key")]
    told = sinks.merge_bucketed(spark.createDataFrame(new, schema), str(path), ["id", "k"], 32).head()
    after = files(path)
    touched = {p.split("/")[0] for p in before.keys() ^ after.keys()}
    assert 1 <= told["buckets"] <= 3 and len(touched) <= 3
    assert {p: h for p, h in before.items() if p.split("/")[0] not in touched} == {p: h for p, h in after.items() if p.split("/")[0] not in touched}
    want = [r for r in old if r[:2] != (3, "a")] + new
    assert rows(spark, path) == sorted(want, key=str)
    # nothing new leaves all as it is, and a repeated run changes no row
    assert tuple(sinks.merge_bucketed(spark.createDataFrame([], schema), str(path), ["id", "k"], 32).head()) == (0, 0) and files(path) == after
    sinks.merge_bucketed(spark.createDataFrame(new, schema), str(path), ["id", "k"], 32)
    assert rows(spark, path) == sorted(want, key=str)


def test_steps_count_what_they_write(spark):
    steps = Steps(spark)
    scratch = Scratch(spark, "t", steps)
    a = scratch.put(spark.range(17), "first")
    b = scratch.put(a.where("id > 100"), "second")
    scratch.put(a, "first")
    scratch.put(a)
    found = steps.frame().groupBy("step").agg(F.count("*").alias("calls"), F.sum("rows").alias("rows"), F.min("ms").alias("ms"))
    assert {r["step"]: (r["calls"], r["rows"]) for r in found.collect()} == {"first": (2, 34), "second": (1, 0)} and found.where("ms <= 0").count() == 0
    assert b.count() == 0
    told = {r["step"]: r["calls"] for r in sinks.telemetry(steps.frame()).collect()}
    assert told == {"first": 2, "second": 1, "total": 3}
    scratch.drop()
