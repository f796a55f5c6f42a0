"""Recall and the share of rows that queries meet, on vectors in groups and on random ones; repeated ids and several lengths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import nearest
from lodestone.llm.common import Scratch

SCHEMA = "vec_id long, embedding array<double>, row string, slice int"


def frame_of(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v], "mine", 1) for i, v in rows], SCHEMA)


def in_groups(n):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((60, 32))
    return centres[rng.integers(0, 60, n)] + 0.15 * rng.standard_normal((n, 32))


def recall(got, x, queries, k=10):
    hits = 0
    for q in queries:
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        found = [r for r in got if r["query_id"] == q]
        assert sorted(r["rank"] for r in found) == list(range(1, k + 1)) and all(r["score"] == d[r["vec_id"]] for r in found)
        hits += len({r["vec_id"] for r in found} & set(np.lexsort((np.arange(len(x)), d))[:k].tolist()))
    return hits / (k * len(queries))


def test_vectors_in_groups(spark):
    x = in_groups(3000)
    frame = frame_of(spark, enumerate(x))
    queries = range(0, 3000, 100)
    assert recall(nearest.nearest(frame, "vec_id % 100 = 0").collect(), x, queries) >= 0.9
    tables = nearest.fit(x[:1000], len(x))
    scratch = Scratch(spark, "test")
    vectors = scratch.put(nearest.usable(frame, "vec_id", "embedding"))
    met = nearest.candidates(vectors, vectors.where("vec_id % 100 = 0"), tables, scratch)
    on = ["tab", "cell", "slice", "block"]
    pairs = met.where("query").select(*on, F.col("vec_id").alias("q")).join(met.where("NOT query").select(*on, "vec_id"), on).select("q", "vec_id").distinct().count()
    assert tables.tables >= nearest.LEAST_TABLES
    assert pairs < 0.25 * len(x) * len(queries)


def test_random_vectors(spark):
    x = np.random.default_rng(8).standard_normal((2000, 64))
    assert recall(nearest.nearest(frame_of(spark, enumerate(x)), "vec_id % 100 = 0").collect(), x, range(0, 2000, 100)) >= 0.9


def test_repeated_ids_and_lengths(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [5.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.5]), (2, [2.0, 0.0]), (100, [1.0, 1.0, 1.0]), (3, [1.0, 1.0, 2.0]), (200, [7.0])]
    got = nearest.nearest(frame_of(spark, rows), "vec_id % 100 = 0", k=2).collect()
    as_rows = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got)
    # three rows ask as 0, each with its own two; 200 has no row of its length beside it
    assert as_rows == [(0, 1, 0, 0.0), (0, 1, 0, 0.0), (0, 1, 2, 3.0), (0, 2, 0, 4.0), (0, 2, 1, 0.0), (0, 2, 1, 0.0), (100, 1, 3, 1.0)]


@pytest.mark.parametrize("probes", [1, 8])
def test_probes_come_in_order_of_success(probes):
    f = np.array([0.1, 0.5, 0.95])
    score = lambda move: sum(f[i] ** 2 if step < 0 else (1 - f[i]) ** 2 for i, step in move)
    order = nearest.probe_order(f, probes)
    assert order[0] == [] and [score(m) for m in order] == sorted(score(m) for m in order)


def test_rows_without_an_id_take_no_part(spark):
    rows = [(i, [float(i), 1.0]) for i in range(30)]
    found = lambda some: sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest.nearest(frame_of(spark, some), F.col("vec_id") % 10 == 0, k=3).collect())
    plain = found(rows)
    assert len(plain) == 9 and found([*rows, (None, [0.5, 1.0]), (None, [10.0, 1.0])]) == plain


def test_vectors_of_several_sizes(spark):
    """Norms of which some are a hundred times as large as others: the neighbours of all are found, not only those of the densest."""
    rng = np.random.default_rng(3)
    x = np.exp(rng.standard_normal(2000))[:, None] * rng.standard_normal((2000, 32))
    got = nearest.nearest(frame_of(spark, enumerate(x)), "vec_id % 100 = 0").collect()
    assert recall(got, x, range(0, 2000, 100)) >= 0.9


def test_levels():
    assert nearest.levels(np.array([0.0, 0.0])) == []
    assert np.allclose(np.array(nearest.levels(np.array([0.0, 1.0, 1.9, 100.0, 150.0]))) / nearest.BEYOND, [1.9, 150.0])
    assert len(nearest.levels(10.0 ** np.arange(20))) == nearest.LEVELS
