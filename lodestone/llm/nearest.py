"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector by `m` projections on normal directions, cut into
cells of width `w`. A query visits its own cell and perturbed ones in the
order of estimated success: the squared distance to the walls it crosses.
Candidates of all tables are compared by their exact distance in double
precision and merged.

Rows may lie close together in one place and far apart in another, so one width
does not do for all. How far away a k-th neighbour is, is measured on a bounded
sample of queries (ASKED), each against all rows, and these distances fall into
levels, each no wider than SPREAD. A level's numbers of tables (LEAST_TABLES to
MOST_TABLES), projections and probes and its width are fitted on a bounded
sample (SAMPLE vectors): the cheapest setting that captures TARGET of the pairs
at the level's greatest distance. A query starts at the narrowest level. The k-th
distance that it finds there is no less than the true one: where it is within the
level's reach, all its neighbours are, and it is done; else it goes on to the next
level, and beyond the last meets all rows. Every row is indexed at every level
that a query gets to. On vectors that lie in groups a query meets few of all rows; among random ones in many dimensions
the tenth neighbour is nearly as far as any row, cells come out wide and
queries meet most rows. The README has recall and share for both.

A cell is dealt over tasks in slices of about CELL_ROWS rows, each against
blocks of about CELL_QUERIES queries, so that no task holds more than one of
each; what leaves a task is the best k of each query. Queries that found fewer
than k meet all rows in blocks of BLOCK queries, as do those beyond the last level, so none comes back short.

Edge cases: vectors that are null, empty, zero, or that hold null or non-finite
numbers take no part, nor do rows without a vec_id, which no result could name;
vectors of several lengths are searched length by length, as there is no distance
between them; rows that share a vec_id are rows of
their own, each a candidate, and each a query if its vec_id is one; ties go to
the smaller vec_id; an empty table gives an empty table; other columns are not
read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, arrow_schema, map_rows, record_batch

K = 10
#: Vectors that the fit looks at, pairs of them that stand for neighbours, and the share to be captured.
SAMPLE, PAIRS, TARGET = 2048, 150, 0.96
#: Queries whose true k-th distances are measured, the greatest over the least of a level, how far beyond them it reaches, and the levels at most.
ASKED, SPREAD, BEYOND, LEVELS = 128, 2.0, 1.05, 6
LEAST_TABLES, MOST_TABLES = 4, 24
CELL_ROWS, CELL_QUERIES, BLOCK = 2048, 1024, 2048
#: Queries whose best a task keeps before it lets them go.
HELD = 20_000


def usable(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """row, a number of its own, vec_id and vec, an array of doubles, of the vectors that take part."""
    v = F.transform(vector_column, lambda x: x.cast("double"))
    some = rows.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("vec")).where("vec_id IS NOT NULL AND size(vec) > 0")
    good = some.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0))
    return good.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vec")


def probe_order(fractions: np.ndarray, n: int) -> list[list[tuple[int, int]]]:
    """The first n sets of (projection, -1 or 1) by summed squared distance to the walls, the empty one first."""
    steps = sorted([(f * f, i, -1) for i, f in enumerate(fractions.tolist())] + [((1 - f) ** 2, i, 1) for i, f in enumerate(fractions.tolist())])
    out: list[list[tuple[int, int]]] = [[]]
    heap = [(steps[0][0], (0,))]
    while heap and len(out) < n:
        score, chosen = heapq.heappop(heap)
        moved = [steps[c][1] for c in chosen]
        if len(set(moved)) == len(moved):
            out.append([steps[c][1:] for c in chosen])
        last = chosen[-1]
        if last + 1 < len(steps):
            heapq.heappush(heap, (score - steps[last][0] + steps[last + 1][0], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (score + steps[last + 1][0], (*chosen, last + 1)))
    return out


class Tables:
    def __init__(self, dims: int, tables: int, m: int, width: float, probes: int, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.tables, self.m, self.width, self.probes = tables, m, width, probes
        self.directions = rng.standard_normal((tables, dims, m))
        self.shifts = rng.uniform(0, width, (tables, m))
        # cells are named by a hash of their m numbers
        self.mix = rng.integers(1, 1 << 62, m, dtype=np.int64) | 1

    def places(self, x: np.ndarray, table: int) -> np.ndarray:
        return (x @ self.directions[table] + self.shifts[table]) / self.width

    def cells(self, numbers: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (numbers.astype(np.int64) * self.mix).sum(axis=-1)

    def visited(self, place: np.ndarray) -> np.ndarray:
        """Names of the cells that a query visits in a table, the likeliest first."""
        own = np.floor(place)
        moves = probe_order(place - own, self.probes)
        numbers = np.repeat(own[None], len(moves), axis=0)
        for i, move in enumerate(moves):
            for j, step in move:
                numbers[i, j] += step
        return np.unique(self.cells(numbers))


def levels(apart: np.ndarray, spread: float = SPREAD, most: int = LEVELS) -> list[float]:
    """How far each level reaches, so that k-th distances within `spread` of each other share one; copies go with the nearest."""
    kth = np.sort(apart[apart > 0])
    out: list[float] = []
    while len(kth):
        # the last level takes what is left
        within = kth if len(out) == most - 1 else kth[kth <= spread * kth[0]]
        out.append(BEYOND * float(within[-1]))
        kth = kth[len(within) :]
    return out


def fit(sample: np.ndarray, n: int, k: int = K, reach: float | None = None) -> Tables:
    """The setting of least work that captures TARGET of the pairs `reach` apart, by default as far as k-th neighbours among n rows of one density."""
    dims, rng = sample.shape[1], np.random.default_rng(7)
    square = (sample**2).sum(axis=1)
    a, b = np.triu_indices(len(sample), 1)
    apart = np.sqrt(np.maximum(0, (square[:, None] + square[None] - 2 * sample @ sample.T)[a, b]))
    if not len(apart):
        return Tables(dims, 1, 1, 1.0, 1)
    far = rng.integers(0, len(apart), PAIRS)
    if reach is None:
        reach = float(np.quantile(apart, min(1.0, k / n))) or float(np.median(apart)) or 1.0
        near = np.argsort(np.abs(apart - reach), kind="stable")[:PAIRS]
    else:
        # the directions being normal, only the distance of a pair counts: partners are put that far from some of the sample
        some, way = rng.integers(0, len(sample), PAIRS), rng.standard_normal((PAIRS, dims))
        partners = sample[some] + reach * way / np.sqrt((way**2).sum(axis=1, keepdims=True))
        a, b = np.append(a, some), np.append(b, len(sample) + np.arange(PAIRS))
        near, sample = len(apart) + np.arange(PAIRS), np.concatenate([sample, partners])
    asking = np.unique(a[np.concatenate([near, far])]).tolist()
    best = None
    for m in (2, 3, 4, 6, 8, 12, 16, 24):
        for factor in (0.5, 1.0, 2.0, 4.0):
            for probes in (1, 8, 32, 100):
                t = Tables(dims, 1, m, factor * reach, probes)
                ys = t.places(sample, 0)
                cells = t.cells(np.floor(ys))
                seen = {i: set(t.visited(ys[i]).tolist()) for i in asking}
                hit = [np.mean([cells[j] in seen[i] for i, j in zip(a[at].tolist(), b[at].tolist())]) for at in (near, far)]
                if hit[0] <= 0.1:
                    continue
                tables = max(LEAST_TABLES, int(np.ceil(np.log(1 - TARGET) / np.log(1 - hit[0]))) if hit[0] < 1 else 1)
                # comparisons, and rows that are filed, each worth some of them
                work = tables * (hit[1] * n * n / 100 + 50 * (n + n / 100 * probes))
                if tables <= MOST_TABLES and (best is None or work < best[0]):
                    best = (work, (dims, tables, m, factor * reach, probes))
    return Tables(*best[1]) if best else Tables(dims, LEAST_TABLES, 1, 8 * reach, 3)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _file(rows: DataFrame, tables: Tables, query: bool) -> DataFrame:
    """A row for each table and cell: the vector's own, or those that a query visits."""
    shared = rows.sparkSession.sparkContext.broadcast(tables)
    schema = "tab int, cell long, query boolean, row long, vec_id long, vec array<double>"

    def make():
        t = shared.value

        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            if not batch.num_rows:
                return
            x = _matrix(batch.column("vec"))
            for tab in range(t.tables):
                ys = t.places(x, tab)
                if query:
                    cells = [t.visited(y) for y in ys]
                    of = np.repeat(np.arange(len(x)), [len(c) for c in cells])
                    cells = np.concatenate(cells)
                else:
                    of, cells = np.arange(len(x)), t.cells(np.floor(ys))
                for at in range(0, len(of), 10_000):
                    some = of[at : at + 10_000]
                    yield {"tab": np.full(len(some), tab), "cell": cells[at : at + 10_000], "query": np.full(len(some), query)} | {c: batch.column(c).take(pa.array(some)) for c in ("row", "vec_id", "vec")}

        return each

    return map_rows(rows, make, schema)


class Best:
    """The k nearest of each query so far: a query is its (row, vec_id)."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def offer(self, query: tuple[int, int], vector: np.ndarray, rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        d = np.sqrt(((x - vector) ** 2).sum(axis=1))
        d[rows == query[0]] = np.inf
        if len(d) > self.k:
            some = np.flatnonzero(d <= np.partition(d, self.k)[self.k])
            rows, ids, d = rows[some], ids[some], d[some]
        if query in self.held:
            rows, ids, d = (np.concatenate(both) for both in zip(self.held[query], (rows, ids, d), strict=True))
            _, first = np.unique(rows, return_index=True)
            rows, ids, d = rows[first], ids[first], d[first]
        keep = np.lexsort((rows, ids, d))[: self.k]
        keep = keep[d[keep] < np.inf]
        self.held[query] = (rows[keep], ids[keep], d[keep])

    def let_go(self) -> dict:
        n = [len(x[0]) for x in self.held.values()]
        asked = np.repeat(np.array(list(self.held), np.int64), n, axis=0)
        found = [np.concatenate([x[i] for x in self.held.values()]) for i in range(3)]
        self.held = {}
        return dict(zip(("query_row", "query_id", "row", "vec_id", "score"), (asked[:, 0], asked[:, 1], *found), strict=True))


_FOUND = "query_row long, query_id long, row long, vec_id long, score double"
_PART = ("tab", "cell", "slice", "block")


def _compare(filed: DataFrame, k: int) -> DataFrame:
    """Candidates of the cells: rows come by cell, slice and block, queries first."""
    kinds = arrow_schema(filed.sparkSession, _FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, part, queries = Best(k), None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            x, is_query = _matrix(batch.column("vec")), batch.column("query").to_numpy(zero_copy_only=False)
            rows, ids = (batch.column(c).to_numpy() for c in ("row", "vec_id"))
            keys = np.column_stack([batch.column(c).to_numpy() for c in _PART])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(ids)]
            for i, j in zip(cuts, cuts[1:]):
                if tuple(keys[i]) != part:
                    part, queries = tuple(keys[i]), []
                n = i + int(is_query[i:j].sum())
                queries += [((int(rows[r]), int(ids[r])), x[r].copy()) for r in range(i, n)]
                for q, v in queries if n < j else ():
                    best.offer(q, v, rows[n:j], ids[n:j], x[n:j])
                if len(best.held) > HELD:
                    yield record_batch(best.let_go(), kinds)
        if best.held:
            yield record_batch(best.let_go(), kinds)

    return filed.repartition(*_PART).sortWithinPartitions(*_PART, F.desc("query")).mapInArrow(run, _FOUND)


def _exhaust(rows: DataFrame, queries: list, k: int) -> DataFrame:
    """A block of queries against all rows, the best of each task."""
    shared = rows.sparkSession.sparkContext.broadcast([((q["row"], q["vec_id"]), np.array(q["vec"])) for q in queries])
    kinds = arrow_schema(rows.sparkSession, _FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in batches:
            if batch.num_rows:
                x, numbers, ids = _matrix(batch.column("vec")), batch.column("row").to_numpy(), batch.column("vec_id").to_numpy()
                for q, v in shared.value:
                    best.offer(q, v, numbers, ids, x)
        if best.held:
            yield record_batch(best.let_go(), kinds)

    return rows.mapInArrow(run, _FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_row", "query_id", "row", "vec_id").agg(F.min("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy("score", "vec_id", "row")))
    return ranked.where(F.col("rank") <= k)


def candidates(vectors: DataFrame, asking: DataFrame, tables: Tables, scratch: Scratch, cell_rows: int = CELL_ROWS, cell_queries: int = CELL_QUERIES) -> DataFrame:
    """Rows and queries of the cells that hold both, dealt to slices and blocks: what `_compare` brings together."""
    index, asked = scratch.put(_file(vectors, tables, False)), scratch.put(_file(asking, tables, True))
    counts = [f.groupBy("tab", "cell").agg(F.ceil(F.count("*") / size).cast("int").alias(name)) for f, size, name in ((index, cell_rows, "slices"), (asked, cell_queries, "blocks"))]
    cells = scratch.put(counts[0].join(counts[1], ["tab", "cell"]))
    own = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = index.join(cells, ["tab", "cell"]).withColumn("slice", own("slices")).withColumn("block", every("blocks"))
    sent = asked.join(cells, ["tab", "cell"]).withColumn("block", own("blocks")).withColumn("slice", every("slices"))
    return dealt.unionByName(sent).drop("slices", "blocks")


def _kth_distances(vectors: DataFrame, queries, n: int, k: int) -> np.ndarray:
    """The true k-th distance of at most ASKED queries, in one pass over all rows."""
    some = vectors.where(queries).orderBy(F.xxhash64("row"), "row").limit(ASKED).collect()
    last = _top(_exhaust(vectors, some, k), k).where(F.col("rank") == min(k, n - 1))
    return np.array([r["score"] for r in last.select("score").collect()])


def _blocks_of(short: DataFrame, n: int, vectors: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """Queries against all rows, about BLOCK of them at a time."""
    blocks, more = -(-n // BLOCK), None
    for i in range(blocks):
        some = short.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == i).collect()
        part = scratch.put(_exhaust(vectors, some, k))
        more = part if more is None else more.union(part)
    return _top(more, k)


def _of_one_length(vectors: DataFrame, queries, k: int, tables: Tables | None, scratch: Scratch, **sizes: int) -> DataFrame:
    n, left = vectors.count(), vectors.where(queries)
    want = min(k, n - 1)
    if tables is None:
        sample = np.array([r["vec"] for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(SAMPLE).collect()])
        reaches = levels(_kth_distances(vectors, queries, n, k)) or [None]
        settings = [(fit(sample, n, k, reach), reach) for reach in reaches]
    else:
        settings = [(tables, None)]
    found = None
    for setting, reach in settings:
        best = scratch.put(_top(scratch.put(_compare(candidates(vectors, left, setting, scratch, **sizes), k)), k))
        # a query is done with k rows, all of them within reach
        far = F.lit(True) if reach is None else F.max("score") <= reach
        done = scratch.put(best.groupBy("query_row").agg(F.count("*").alias("got"), far.alias("near")).where((F.col("got") >= want) & F.col("near")).select("query_row"))
        kept = best.join(done, "query_row", "left_semi")
        found = kept if found is None else found.unionByName(kept)
        left = scratch.put(left.join(done, F.col("row") == F.col("query_row"), "left_anti"))
        n_left = left.count() if want > 0 else 0
        if not n_left:
            return found
    # whoever is left meets everything
    return found.unionByName(_blocks_of(left, n_left, vectors, k, scratch))


def nearest(rows: DataFrame, queries, id_column: str = "vec_id", vector_column: str = "embedding", k: int = K, tables: Tables | None = None, **sizes: int) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k nearest found; queries: a condition on vec_id that says which rows ask."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "nearest")
    vectors = scratch.put(usable(rows, id_column, vector_column))
    found = spark.createDataFrame([], f"{_FOUND}, rank int")
    # a row for each length that vectors have
    for r in vectors.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("rows")).where("rows > 1").orderBy("n").collect():
        found = found.unionByName(_of_one_length(vectors.where(F.size("vec") == r["n"]), queries, k, tables, scratch, **sizes))
    return found.select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 100 = 0")
