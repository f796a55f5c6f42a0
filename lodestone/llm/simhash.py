"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints at most `radius` bits apart are linked. The 64 bits are grouped
into partitions, correlated bits together, and partition i gets a threshold
t_i with sum(t_i) = radius - partitions + 1: two linked fingerprints then agree
within t_i bits in at least one partition, whatever the grouping. A dynamic
program picks the number of partitions and unequal thresholds of least
estimated work; the estimate comes from a bounded sample of fingerprints and
has no effect on what is found. Each fingerprint is filed under its own bits of
every partition and under all bits within the threshold; what shares a bucket
is verified on all 64 bits.

Copies collapse first: buckets hold distinct fingerprints. A bucket of more
than `bucket_rows` is filed anew under its bits and a quarter of those left,
for which the pigeonhole argument holds again, and so on: after some rounds the
bits left bound its size. A task yields the edges of a spanning forest
of its buckets, never all pairs; components come from min labels along those edges.

Edge cases: null or empty text, and text without words, has fingerprint zero
and links like any other; a null doc_id is only ever a component's id if all
ids in it are null; a very long text is hashed whole, its bits counted in
slices; repeated rows give a row each, and equal fingerprints meet as one; an
empty table gives an empty table; other columns are not read, and pass through
`keep_one` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import ngram_join
from lodestone.llm.common import Scratch, arrow_schema, connected_components, map_rows, record_batch

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: For removing near-duplicates: words of a shingle, and the Jaccard similarity, in hundredths, that links.
DEDUP_WORDS, DEDUP_PERCENT = 5, 80
#: Most fingerprints that the estimate looks at.
SAMPLE = 2048
#: Fingerprints in a bucket that one task compares with each other.
BUCKET_ROWS = 4096
#: Work of filing a row (microseconds), in comparisons of two fingerprints (nanoseconds).
ROW_WORK = 2000.0
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, words: int = SHINGLE, distinct: bool = False) -> int:
    """Bit i is set if it is in over half of the shingles' hashes; distinct: repeats count once."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not parts:
        return 0
    shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)))) if len(parts) >= words else [b" ".join(parts)]
    if distinct:
        shingles = sorted(set(shingles))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    # counts in slices, so that a very long text needs no more memory than a short one
    ones = sum(np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for i in range(0, len(hashes), 4096))
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, prints: dict[str, tuple[int, bool]], extra: list[str] = ()) -> DataFrame:
    """doc_id, the extra whole-number columns and a signed 64-bit column for each of prints: (words, distinct) of its shingles."""

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            all_texts = batch.column("text").to_pylist()
            yield {c: batch.column(c) for c in ("doc_id", *extra)} | {c: np.array([fingerprint(t, *how) for t in all_texts], dtype=np.uint64).view(np.int64) for c, how in prints.items()}

        return each

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *extra, "text")
    return map_rows(kept, make, ", ".join(f"{c} long" for c in ("doc_id", *extra, *prints)))


def group_bits(sample: np.ndarray, n: int) -> list[list[int]]:
    """n groups of nearly equal size; each grows by the bits most correlated with it."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    spread = bits.std(axis=0)
    centred = (bits - bits.mean(axis=0)) / np.where(spread > 0, spread, 1)
    related = np.abs(centred.T @ centred) / max(1, len(bits))
    left, groups = list(range(BITS)), []
    for k in range(n):
        group = [left.pop(0)]
        while len(group) < BITS // n + (k < BITS % n):
            group.append(left.pop(int(np.argmax(related[np.ix_(group, left)].sum(axis=0)))))
        groups.append(group)
    return groups


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def choose_partitions(sample: np.ndarray, n: int, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed, of least estimated work for n fingerprints."""
    best = None
    a, b = np.triu_indices(min(len(sample), SAMPLE), 1)
    for parts in range(1, radius + 3):
        groups, budget = group_bits(sample, parts), radius - parts + 1
        costs = []
        for bits in groups:
            apart = np.bitwise_count((sample[a] ^ sample[b]) & np.uint64(mask_of(bits)))
            cost = {-1: 0.0}
            for t in range(0, radius + 1):
                probes = sum(comb(len(bits), i) for i in range(t + 1))
                share = max((apart <= t).mean() if len(a) else 0.0, probes / 2.0 ** len(bits))
                cost[t] = n * (probes + 1) * ROW_WORK + n * n / 2 * share
            costs.append(cost)
        # least work over partitions so far, by what is spent of the budget; -1 leaves a partition out
        table = {0: (0.0, ())}
        for cost in costs:
            step: dict[int, tuple] = {}
            for spent, (work, chosen) in table.items():
                for t, more in cost.items():
                    if (key := spent + t) not in step or work + more < step[key][0]:
                        step[key] = (work + more, (*chosen, t))
            table = step
        if budget in table and (best is None or table[budget][0] < best[0]):
            best = (table[budget][0], [(g, t) for g, t in zip(groups, table[budget][1], strict=True) if t >= 0])
    return best[1]


def _flips(bits: list[int], t: int) -> list[int]:
    from itertools import combinations

    return [mask_of(c) for i in range(1, t + 1) for c in combinations(bits, i)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Forest:
    """Edges that connect what linked pairs connect, over all buckets of a task."""

    def __init__(self, radius: int, confirm: int):
        self.radius, self.confirm, self.parent, self.edges = radius, confirm, {}, []

    def find(self, i: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(i, i)) != i:
            parent[i] = i = parent.setdefault(up, up)
        return i

    def add(self, rows: np.ndarray) -> None:
        """rows: (mask, key, own, id, fp, second) of a bucket; one of a pair is filed by its own bits."""
        ids, prints = rows[:, 3].tolist(), np.ascontiguousarray(rows[:, 4:].T).view(np.uint64)
        for i in np.flatnonzero(rows[:, 2]).tolist():
            near = np.flatnonzero(np.bitwise_count(prints[0] ^ prints[0, i]) <= self.radius)
            if len(near) > 1 and self.confirm < BITS:
                near = near[np.bitwise_count(prints[1, near] ^ prints[1, i]) <= self.confirm]
            if len(near) > 1:
                for j in near.tolist():
                    if ids[i] != ids[j] and (a := self.find(ids[i])) != (b := self.find(ids[j])):
                        self.parent[a] = b
                        self.edges.append((ids[i], ids[j]))
        if len(self.parent) > 1_000_000:
            self.parent = {}  # forgets what is connected, which only repeats edges


def _bucket_edges(filed: DataFrame, radius: int, confirm: int) -> DataFrame:
    """Edges (a, b) of every bucket; rows come sorted, so that a task holds one bucket at a time."""
    kinds = arrow_schema(filed.sparkSession, "a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, forest = None, Forest(radius, confirm)
        for batch in batches:
            now = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("mask", "key", "own", "id", "fp", "second")])
            if rest is not None:
                now = np.concatenate([rest, now])
            cuts = np.flatnonzero((now[1:, :2] != now[:-1, :2]).any(axis=1)) + 1
            last = cuts[-1] if len(cuts) else 0
            yield from emit(forest, now[:last], cuts[:-1])
            rest = now[last:]
        if rest is not None:
            yield from emit(forest, rest, np.array([], dtype=np.int64))

    def emit(forest: Forest, rows: np.ndarray, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        bounds = [0, *cuts.tolist(), len(rows)]
        for i, j in zip(bounds, bounds[1:]):
            if j - i > 1:
                forest.add(rows[i:j])
        if forest.edges:
            a, b = zip(*forest.edges)
            forest.edges = []
            yield record_batch({"a": a, "b": b}, kinds)

    return filed.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(run, "a long, b long")


def _file_anew(filed: DataFrame, radius: int) -> DataFrame:
    """Each row under its key and one of radius + 1 groups of the bits left."""
    schema = "id long, fp long, second long, mask long, key long, own boolean"
    kinds = arrow_schema(filed.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, mask, key = (batch.column(c).to_numpy().view(np.uint64) for c in ("fp", "mask", "key"))
            for m in np.unique(mask):
                at = np.flatnonzero(mask == m)
                left = [b for b in range(BITS) if not int(m) >> b & 1]
                for k in range(radius + 1):
                    more = np.uint64(mask_of(left[k :: radius + 1]))
                    yield record_batch({c: batch.column(c).take(pa.array(at)) for c in ("id", "fp", "second", "own")} | {"mask": np.full(len(at), m | more).view(np.int64), "key": (key[at] | fp[at] & more).view(np.int64)}, kinds)

    return filed.select("id", "fp", "second", "mask", "key", "own").mapInArrow(run, schema)


def links(nodes: DataFrame, scratch: Scratch, radius: int = RADIUS, confirm: int = BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (a, b) between ids that connect all nodes (id, fp, second) within the radius on fp and within confirm on second."""
    sample = np.array([r["fp"] for r in nodes.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], dtype=np.int64).view(np.uint64)
    if not len(sample):
        return scratch.put(nodes.select(F.col("id").alias("a"), F.col("id").alias("b")).where("false"))
    plan = choose_partitions(sample, nodes.count(), radius)
    keys = []
    for bits, t in plan:
        mask = _signed(mask_of(bits))
        own = F.col("fp").bitwiseAND(F.lit(mask))
        keys.append(F.struct(F.lit(mask).alias("mask"), own.alias("key"), F.lit(True).alias("own")))
        keys += [F.struct(F.lit(mask).alias("mask"), own.bitwiseXOR(F.lit(_signed(x))).alias("key"), F.lit(False).alias("own")) for x in _flips(bits, t)]
    filed = scratch.put(nodes.select("id", "fp", "second", F.explode(F.array(*keys)).alias("x")).select("id", "fp", "second", "x.*"))
    edges = None
    while True:
        crowded = filed.groupBy("mask", "key").agg(F.count("*").alias("n")).where((F.col("n") > bucket_rows) & (F.bit_count("mask") < BITS - bucket_rows.bit_length() + 1)).select("mask", "key")
        crowded = scratch.put(crowded)
        more = crowded.limit(1).count()
        plain = filed.join(crowded, ["mask", "key"], "left_anti") if more else filed
        found = scratch.put(_bucket_edges(plain, radius, confirm))
        edges = found if edges is None else edges.union(found)
        if not more:
            scratch.drop(filed, crowded)
            return edges
        again = scratch.put(_file_anew(filed.join(crowded, ["mask", "key"], "left_semi"), radius))
        scratch.drop(filed, crowded)
        filed = again


def components(printed: DataFrame, scratch: Scratch, least, radius: int = RADIUS, confirm: int = BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """printed's rows (id, fp, second and others) with component_id, the least value of the aggregate `least` among all that links reach."""
    nodes = scratch.put(printed.groupBy("id", "fp", "second").agg(least.alias("least")))
    roots = connected_components(links(nodes.select("id", "fp", "second"), scratch, radius, confirm, bucket_rows), scratch)
    rooted = scratch.put(nodes.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root"), "least"))
    lowest = scratch.put(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    classes = scratch.put(rooted.select("id", "root").join(lowest, "root").select("id", "component_id"))
    return printed.join(classes, "id")


def near_duplicates(docs: DataFrame, words: int = SHINGLE, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, fingerprint in hexadecimal and component_id of each document."""
    scratch = Scratch(docs.sparkSession, "simhash")
    printed = scratch.put(fingerprints(docs, {"fp": (words, False)}).select("doc_id", F.col("fp").alias("id"), "fp", F.col("fp").alias("second")))
    found = components(printed, scratch, F.min("doc_id"), radius, bucket_rows=bucket_rows)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def nominated(docs: DataFrame, sets: DataFrame, words: int, scratch: Scratch, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) that connect the sets (doc_id, id) of docs (doc_id, text) whose fingerprints of distinct shingles are within the radius; equal fingerprints meet as one, each with the least of its sets."""
    printed = scratch.put(fingerprints(docs, {"fp": (words, True)}).distinct().join(sets, "doc_id").select("id", "fp").distinct())
    firsts = scratch.put(printed.groupBy("fp").agg(F.min("id").alias("id")))
    near = links(firsts.select("id", "fp", F.col("fp").alias("second")), scratch, radius)
    same = printed.join(firsts.withColumnRenamed("id", "first"), "fp").select(F.col("first").alias("a"), F.col("id").alias("b"))
    return near.union(same).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def keep_one(docs: DataFrame, words: int = DEDUP_WORDS, percent: int = DEDUP_PERCENT, block_rows: int = ngram_join.BLOCK_ROWS) -> DataFrame:
    """docs without near-duplicates: of each component the row of least doc_id stays, null last; of rows that are the same, one.

    Links are pairs whose sets of five-word shingles have a Jaccard similarity
    of 0.8 or more, all of them; texts without words are one component. Pairs of
    fingerprints of those shingles within the radius come first, each checked
    exactly; what their links leave apart goes through `ngram_join`, for two texts of
    0.8 often have fingerprints farther apart than any radius that keeps buckets small.
    """
    scratch = Scratch(docs.sparkSession, "dedup")
    # a row's key has no null, so that plain joins find it
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    row = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
    texts = docs.select(row.alias("doc_id"), "text")
    found, rooted = ngram_join.components(texts, scratch, words, percent, block_rows=block_rows, nominate=lambda sets: nominated(texts, sets, words, scratch))
    root = found.join(rooted.select("id", "root"), "id", "left").select(F.col("doc_id").alias("row_hash"), "root")
    rows = scratch.put(docs.select(id_.alias("doc_id"), row.alias("row_hash")).distinct().join(root.distinct(), "row_hash"))
    kept = scratch.put(rows.groupBy("root").agg(F.min(F.struct("doc_id", "row_hash")).alias("kept")).select(F.col("kept.doc_id").alias("kept_id"), F.col("kept.row_hash").alias("kept_hash")))
    # the caller's columns go by numbers meanwhile, so that no name of theirs meets one of the work
    keyed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], id_.alias("kept_id"), row.alias("kept_hash"))
    stays = keyed.join(kept, ["kept_id", "kept_hash"], "left_semi").dropDuplicates(["kept_id", "kept_hash"])
    return stays.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
