"""Join of documents by the Jaccard similarity of their word n-grams, as a blocked sparse product.

Documents by n-grams is a sparse 0/1 matrix, kept once for equal rows; its
product with its own transpose has the overlaps of all pairs. A pair of n and m
n-grams links only if it overlaps in at least 85/185 (n + m), which bounds the
product in three ways: sizes must be within 0.85 of each other; of either set, in
one order of all n-grams, the first n - ceil(0.85 n) + 1 must share a column;
and at most 15/185 (n + m) n-grams may be of one side alone. Any order will do,
and rare n-grams come first: a table of SLOTS counts over all n-grams, of one
fixed size, says which are frequent, so that passages that many documents
share come last.

Columns of such prefixes that two or more sets have are the product's blocks;
columns that the same sets have, as a pair of copies has many, are one block.
A set's parity sketch turns one bit over for each n-gram, and so two sketches
never differ in more bits than the sets have n-grams of one side alone: pairs
with more than the bound are discarded, and no link is. A block yields a spanning
forest of the pairs left, whose overlaps are then accumulated exactly, row by
row, over the n-grams of a batch. Blocks with a pair of the forest that failed
and whose sets are not all connected are gone through again, across what is not
connected yet: all pairs left by the bounds are accumulated too or, where a set
has more than OPEN of them, the block's sets in question are multiplied out with
their whole rows in one place, which yields links alone. Blocks of more than
BLOCK_ROWS sets are dealt in slices, each with the block's first set, and in the
second round in pairs of slices.

Edge cases: null text, empty text and text without words have no n-grams, link
with nothing and are their own component; fewer words than n are one n-gram;
a null doc_id is a component's id only if all ids in it are null; repeated rows
give a row each and meet as one set; a very long text is one row, hashed whole;
an empty table gives an empty table; other columns are not read. N-grams are
told apart by 64 bits, which matters only between two sets that are compared,
and equal sets by 128; a set's id has 64 of them, and if two sets had one id, all
would be hashed anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, arrow_schema, connected_components, map_rows, record_batch

WORDS, PERCENT, SEED = 4, 85, 42
#: Entries of the table of counts; rows of a block or slice in the first and in the second product.
SLOTS, BLOCK_ROWS, WHOLE_ROWS = 1 << 18, 4096, 1024
#: Pairs of a set in a block of the second round that are looked at one by one.
OPEN = 4
#: Bits of the table that says which documents' n-grams are wanted again.
WANTED = 1 << 22
#: Bits of a sketch: a power of two, BITS_EACH for each n-gram and no fewer or more than these.
LEAST_BITS, MOST_BITS, BITS_EACH = 256, 1 << 16, 2
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_MIX = np.random.default_rng(SEED).integers(0, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def n_grams(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of so many words in lower case; of all words if they are fewer."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not parts:
        return np.empty(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    each = np.fromiter((digest(p, SEED) for p in parts), np.uint64, len(parts))
    n = min(words, len(parts))
    mixed = np.full(len(parts) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        mixed = (mixed ^ each[i : len(each) - n + 1 + i]) * _MIX[i]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def may_link(n: int, m: np.ndarray, apart: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether sets of n and m with at least so many n-grams of one side alone may link."""
    # with overlap o and d of one side alone: 100 o >= p (o + d), and 2 o + d = n + m
    return (100 + percent) * apart <= (100 - percent) * (n + m)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def sketch(grams: np.ndarray) -> bytes:
    """One bit turned over for each n-gram."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * len(grams) - 1).bit_length()))
    odd = np.bincount(((grams >> np.uint64(20)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(odd: bytes, size: int) -> np.ndarray:
    """The sketch as one of fewer bits: places that are the same in it meet."""
    rows = np.frombuffer(odd, np.uint64).reshape(-1, size // 8)
    return np.bitwise_xor.reduce(rows, axis=0)


def set_id(grams: np.ndarray, seed: int) -> int:
    """What a set goes by; `checked` tells two sets of one id apart."""
    return xxhash.xxh64_intdigest(grams.tobytes(), seed)


def hashed(docs: DataFrame, words: int, slots: int, seed: int) -> DataFrame:
    """doc_id, n, id and check of each document, null without n-grams; a task's counts of slots follow as rows (slot, c)."""
    schema = "doc_id long, n long, id long, check long, slot int, c long"
    kinds = arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(slots, dtype=np.int64)
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                sets = [n_grams(t, words) for t in batch.column("text").to_pylist()]
                empty = np.array([not len(s) for s in sets])
                counts += np.bincount((np.concatenate(sets) % np.uint64(slots)).astype(np.int64), minlength=slots)
                as_longs = lambda seed: pa.array(np.array([set_id(s, seed) for s in sets], dtype=np.uint64).view(np.int64), mask=empty)  # noqa: B023, E731
                none = [None] * len(sets)
                yield record_batch({"doc_id": batch.column("doc_id"), "n": [len(s) for s in sets], "id": as_longs(seed), "check": as_longs(~seed & 0xFFFFFFFF), "slot": none, "c": none}, kinds)
        at = np.flatnonzero(counts)
        if len(at):
            none = pa.nulls(len(at), pa.int64())
            yield record_batch({c: none for c in ("doc_id", "n", "id", "check")} | {"slot": at.astype(np.int32), "c": counts[at]}, kinds)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def matrix(docs: DataFrame, wanted: DataFrame, words: int, seed: int) -> DataFrame:
    """(id, n, grams): the rows of the wanted (doc_id) documents, some twice, and of some others.

    A table of WANTED bits, one size whatever the input, says which documents
    need not be looked at, so that no text is shuffled.
    """
    slot = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(WANTED)), F.lit(0)).cast("int").alias("bit")
    bits = np.zeros(WANTED, dtype=bool)
    bits[wanted.select(slot).distinct().toArrow().column("bit").to_numpy()] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def make():
        here = np.unpackbits(shared.value).astype(bool)

        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            some = here[batch.column("bit").to_numpy()]
            sets = [g for t in batch.column("text").filter(pa.array(some)).to_pylist() if len(g := n_grams(t, words))]
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            grams = np.concatenate([*sets, np.empty(0, dtype=np.uint64)]).view(np.int64)
            yield {"id": np.array([set_id(s, seed) for s in sets], dtype=np.uint64).view(np.int64), "n": [len(s) for s in sets], "grams": pa.ListArray.from_arrays(pa.array(offsets), pa.array(grams))}

        return each

    return map_rows(docs.select(slot, "text"), make, "id long, n long, grams array<long>", rows=1024)


def rows_of(batch: pa.RecordBatch, column: str = "grams") -> tuple[np.ndarray, np.ndarray]:
    """The column's arrays in one, and where each begins."""
    lists = batch.column(column)
    offsets = lists.offsets.to_numpy()
    return lists.values.to_numpy().view(np.uint64), offsets


def slot_counts(rows: DataFrame, slots: int) -> np.ndarray:
    """How many n-grams of documents fall in each slot, from the tasks' counts (slot, c); slots numbers, whatever the input."""
    found = rows.where("slot IS NOT NULL").groupBy("slot").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(slots, dtype=np.int64)
    out[found.column("slot").to_numpy()] = found.column("c").to_numpy()
    return out


def prefixes(docs: DataFrame, words: int, counts: np.ndarray, percent: int, seed: int) -> DataFrame:
    """(key, id) of each n-gram of a document's prefix, rare slots first, then by hash; and (id, n, odd) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def make():
        order = shared.value

        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            keys, ids, odd, sizes = [np.empty(0, dtype=np.uint64)], [], [], []
            for text in batch.column("text").to_pylist():
                grams = n_grams(text, words)
                if len(grams):
                    first = np.lexsort((grams, order[(grams % np.uint64(len(order))).astype(np.int64)]))
                    keys.append(grams[first[: prefix_length(len(grams), percent)]])
                    ids.append(set_id(grams, seed))
                    odd.append(sketch(grams))
                    sizes.append(len(grams))
            ids = np.array(ids, dtype=np.uint64).view(np.int64)
            all_keys = np.concatenate(keys).view(np.int64)
            none = pa.nulls(len(all_keys))
            yield {"key": all_keys, "id": np.repeat(ids, list(map(len, keys[1:]))), "n": none.cast(pa.int64()), "odd": none.cast(pa.binary())}
            yield {"key": pa.nulls(len(ids), pa.int64()), "id": ids, "n": sizes, "odd": odd}

        return each

    return map_rows(docs.select("text"), make, "key long, id long, n long, odd binary", rows=1024)


class Block:
    """Sets of a block by size and sketch, and by their n-grams where these are given."""

    def __init__(self, rows: pa.Table, percent: int):
        self.ids, self.percent = rows.column("id").to_pylist(), percent
        self.n = rows.column("n").to_numpy()
        odd = rows.column("odd").to_pylist()
        # sketches are compared at the size of the shorter: a fold for each size there is
        lengths = sorted({len(x) for x in odd})
        self.length = np.array([len(x) for x in odd])
        self.odd = {}
        for size in lengths:
            at = np.flatnonzero(self.length >= size)
            self.odd[size] = np.full(len(odd), -1), np.array([folded(odd[i], size) for i in at.tolist()])
            self.odd[size][0][at] = np.arange(len(at))
        self.grams = rows.column("grams").combine_chunks() if "grams" in rows.column_names else None

    def close(self, i: int, at: np.ndarray) -> np.ndarray:
        """Those of the rows `at` that sizes and sketches do not discard against row i."""
        n = self.n[i]
        at = at[may_link(n, self.n[at], np.abs(self.n[at] - n), self.percent)]
        out = []
        for size in sorted({*np.minimum(self.length[at], self.length[i]).tolist()}):
            here = at[np.minimum(self.length[at], self.length[i]) == size]
            place, odd = self.odd[size]
            differ = np.bitwise_count(odd[place[here]] ^ odd[place[i]]).sum(axis=1, dtype=np.int64)
            out.append(here[may_link(n, self.n[here], differ, self.percent)])
        return np.sort(np.concatenate(out)) if out else at

    def forest(self) -> Iterator[tuple[int, int]]:
        """A spanning forest of the pairs that are close; the first row is the first tree's root."""
        left = np.arange(len(self.ids))
        while len(left):
            queue, left = [int(left[0])], left[1:]
            while queue and len(left):
                i = queue.pop()
                near = self.close(i, left)
                if len(near):
                    yield from ((self.ids[i], self.ids[j]) for j in near.tolist())
                    queue += near.tolist()
                    left = np.setdiff1d(left, near, assume_unique=True)

    def open_pairs(self, labels: np.ndarray, slices: np.ndarray, most: int) -> tuple[list[tuple[int, int]], list[int]]:
        """Close pairs with different labels, of two slices those across them; if a row has more than `most`, the rows of any such pair instead."""
        across = len(np.unique(slices)) > 1
        found, heavy, concerned = [], False, np.zeros(len(self.ids), dtype=bool)
        for i in range(len(self.ids)):
            later = np.arange(i + 1, len(self.ids))
            later = self.close(i, later[(labels[later] != labels[i]) & ((slices[later] != slices[i]) | (not across))])
            if len(later):
                concerned[i] = concerned[later] = True
                heavy = heavy or len(later) > most
                if not heavy:
                    found += [(self.ids[i], self.ids[j]) for j in later.tolist()]
        return ([], [self.ids[i] for i in np.flatnonzero(concerned).tolist()]) if heavy else (found, [])

    def links(self, labels: list[int], slices: np.ndarray) -> Iterator[tuple[int, int]]:
        """Links that connect what the labels do not; of two slices, those across them."""
        up = {x: x for x in labels}

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        across = len(np.unique(slices)) > 1
        values, offsets = self.grams.values.to_numpy().view(np.uint64), self.grams.offsets.to_numpy()
        roots = np.array([root(x) for x in labels])
        for i in range(len(self.ids)):
            later = np.arange(i + 1, len(self.ids))
            later = later[(roots[later] != roots[i]) & ((slices[later] != slices[i]) | (not across))]
            later = self.close(i, later)
            if len(later):
                both = overlaps(values, offsets, i, later)
                for j in later[linked(self.n[i], self.n[later], both, self.percent)].tolist():
                    if (a := root(labels[i])) != (b := root(labels[j])):
                        up[a] = b
                        roots[roots == a] = b
                        yield self.ids[i], self.ids[j]


def linked(n: int | np.ndarray, m: np.ndarray, overlap: np.ndarray, percent: int) -> np.ndarray:
    return 100 * overlap >= percent * (n + m - overlap)


def overlaps(values: np.ndarray, offsets: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """Row i of the product: n-grams that each of the other rows shares with it. Rows are sorted."""
    row = values[offsets[i] : offsets[i + 1]]
    sizes = offsets[others + 1] - offsets[others]
    heads = np.cumsum(sizes) - sizes
    entries = values[np.arange(int(sizes.sum())) + np.repeat(offsets[others] - heads, sizes)]
    at = np.minimum(np.searchsorted(row, entries), len(row) - 1)
    return np.add.reduceat((row[at] == entries).astype(np.int64), heads)


def by_block(dealt: DataFrame, how: str, percent: int) -> DataFrame:
    """(a, b, key, part) of every part of a block (key, part, first, id, n, odd): pairs a < b of its forest, of what is `open`, or linked by `whole` rows; a row to multiply out is a, with key and part."""
    schema = "a long, b long, key long, part long"
    kinds = arrow_schema(dealt.sparkSession, schema)

    def found(rows: pa.Table) -> list[tuple]:
        block, heavy = Block(rows, percent), []
        if how == "forest":
            pairs = block.forest()
        else:
            labels, slices = rows.column("label").to_numpy(), rows.column("slice").to_numpy()
            if how == "whole":
                pairs = block.links(labels.tolist(), slices)
            else:
                pairs, heavy = block.open_pairs(labels, slices, OPEN)
        key, part = rows.column("key")[0].as_py(), rows.column("part")[0].as_py()
        return [*{(min(p), max(p), None, None) for p in pairs}, *((i, None, key, part) for i in heavy)]

    def emit(rows: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables(rows).combine_chunks()
        if table.num_rows > 1 and (out := found(table)):
            yield record_batch(dict(zip(("a", "b", "key", "part"), zip(*out))), kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            key = np.column_stack([now.column(c).to_numpy() for c in ("key", "part")])
            bounds = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for i, j in zip(bounds, bounds[1:]):
                if i < j:
                    if held and tuple(key[i]) != last:
                        yield from emit(held)
                        held = []
                    held.append(now.slice(i, j - i))
                    last = tuple(key[i])
        if held:
            yield from emit(held)

    return dealt.repartition("key", "part").sortWithinPartitions("key", "part", "first", "id").mapInArrow(run, schema).distinct()


def ends(pairs: DataFrame) -> DataFrame:
    """The distinct ids of pairs (a, b)."""
    return pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()


def unconnected(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """pairs (a, b) without those whose ends have one root of roots (node, root)."""
    of = lambda c, out: roots.select(F.col("node").alias(c), F.col("root").alias(out))
    both = pairs.join(of("a", "x"), "a", "left").join(of("b", "y"), "b", "left")
    return both.where("x IS NULL OR y IS NULL OR x <> y").select("a", "b")


def exact(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) with linked, from the overlaps of their rows."""
    rows = sets.select("id", "grams").join(ends(pairs), "id", "left_semi").dropDuplicates(["id"])
    both = pairs.join(rows.select(F.col("id").alias("a"), F.col("grams").alias("s")), "a").join(rows.select(F.col("id").alias("b"), F.col("grams").alias("t")), "b")

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            found = []
            left, at = rows_of(batch, "s")
            right, to = rows_of(batch, "t")
            for i in range(batch.num_rows):
                row, other = left[at[i] : at[i + 1]], right[to[i] : to[i + 1]]
                k = np.minimum(np.searchsorted(row, other), len(row) - 1)
                found.append(bool(linked(len(row), len(other), int((row[k] == other).sum()), percent)))
            yield {"a": batch.column("a"), "b": batch.column("b"), "linked": found}

        return each

    return map_rows(both.select("a", "b", "s", "t"), make, "a long, b long, linked boolean", rows=256)


def labels(docs: DataFrame, least: DataFrame, counts: np.ndarray, scratch: Scratch, words: int, percent: int, seed: int, block_rows: int, whole_rows: int, known: DataFrame | None = None) -> DataFrame:
    """(node, root) of the sets of docs that links connect with others. least: (id, doc_id) of each set; counts: of n-grams by slot; known: links (a, b) that need no check."""
    filed = scratch.put(prefixes(docs, words, counts, percent, seed))
    sketches = scratch.put(filed.where("key IS NULL").select("id", "n", "odd").dropDuplicates(["id"]))
    # most n-grams are in one document alone; equal documents have them more than once
    often = filed.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key")
    met = scratch.put(filed.where("key IS NOT NULL").select("key", "id").join(often, "key").distinct())
    columns = met.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("pivot"), *[F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"h{i}") for i in range(2)]).where("size > 1")
    # columns of the same sets, by 128 bits and their number, are one block
    blocks = columns.groupBy("size", "pivot", "h0", "h1").agg(F.min("key").alias("key")).select("key", "size", "pivot")
    shared = scratch.put(met.join(blocks, "key").select("key", "id", "size", "pivot"))
    scratch.drop(filed, met)
    # every slice also has the block's first set
    slices = F.ceil(F.col("size") / block_rows).cast("int")
    part = F.when(F.col("id") == F.col("pivot"), F.sequence(F.lit(0), slices - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), slices).cast("int")))
    dealt = shared.select("key", "id", (F.col("id") != F.col("pivot")).alias("first"), F.explode(part).alias("part")).join(sketches, "id")
    pairs = scratch.put(by_block(dealt, "forest", percent).select("a", "b"))
    if known is not None:
        pairs = scratch.put(unconnected(pairs, connected_components(known, scratch)))
    sets = scratch.put(matrix(docs, least.join(ends(pairs), "id"), words, seed))
    judged = scratch.put(exact(pairs, sets, percent))
    links, refused = judged.where("linked").select("a", "b"), judged.where("NOT linked").select("a", "b")
    if known is not None:
        links = links.union(known)
    crowded = shared.where(F.col("size") > block_rows).select("key").distinct()
    roots = connected_components(links, scratch)
    if refused.limit(1).count() or crowded.limit(1).count():
        # blocks with both sets of a refused pair, or in slices, that have more than one component
        here = shared.select("key", F.col("id").alias("a")).join(refused, "a").select("key", "a", "b")
        doubtful = here.join(shared.select("key", F.col("id").alias("b")), ["key", "b"]).select("key").union(crowded).distinct()
        named = roots.withColumnRenamed("node", "id")
        label = F.coalesce("root", "id").alias("label")
        open_rows = scratch.put(shared.join(doubtful, "key").join(named, "id", "left").select("key", "id", "size", label))
        mixed = open_rows.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
        slices = F.ceil(F.col("size") / whole_rows).cast("int")
        mine = scratch.put(open_rows.join(mixed, "key").withColumn("slices", slices).withColumn("slice", F.pmod(F.xxhash64("id"), slices).cast("int")))
        # a slice goes with itself and with every other
        parts = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda t: F.least(t, "slice").cast("long") * F.col("slices") + F.greatest(t, "slice"))
        rows = mine.select("key", "id", "label", "slice", F.lit(False).alias("first"), F.explode(parts).alias("part")).join(sketches, "id")
        found = scratch.put(by_block(rows, "open", percent))
        left = found.where("b IS NOT NULL").select("a", "b").join(refused, ["a", "b"], "left_anti")
        heavy = found.where("b IS NULL").select("key", "part", F.col("a").alias("id"))
        left, asked = scratch.put(left), heavy.select("id").distinct()
        again = scratch.put(matrix(docs, least.join(ends(left).union(asked).distinct(), "id"), words, seed))
        more = scratch.put(exact(left, again, percent)).where("linked").select("a", "b")
        if heavy.limit(1).count():
            grams = again.select("id", "grams").join(asked, "id", "left_semi").dropDuplicates(["id"])
            more = more.union(scratch.put(by_block(rows.join(heavy, ["key", "part", "id"]).join(grams, "id"), "whole", percent).select("a", "b")))
        roots = connected_components(links.union(more), scratch)
    return roots


def components(
    docs: DataFrame, scratch: Scratch, words: int, percent: int, slots: int = SLOTS, block_rows: int = BLOCK_ROWS, whole_rows: int = WHOLE_ROWS, nominate: Callable[[DataFrame], DataFrame] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, id) of docs (doc_id, text), and (id, root) of each set that documents have.

    nominate gives pairs (a, b) of sets from rows (doc_id, id): they are checked
    first, and the product is left with what their links do not connect.
    """
    seed = SEED
    while True:
        counted = scratch.put(hashed(docs, words, slots, seed))
        rows = counted.where("slot IS NULL").select("doc_id", "n", "id", "check")
        # two sets of one id, told by 64 bits more, ask for another seed
        if not rows.where("id IS NOT NULL").groupBy("id").agg(F.min("check").alias("x"), F.max("check").alias("y")).where("x <> y").limit(1).count():
            break
        seed += 1
    least = scratch.put(rows.where("id IS NOT NULL").groupBy("id").agg(F.min("doc_id").alias("doc_id")))
    known = None
    if nominate is not None:
        near = scratch.put(nominate(rows.where("id IS NOT NULL").select("doc_id", "id").distinct()))
        sets = scratch.put(matrix(docs, least.join(ends(near), "id"), words, seed))
        known = scratch.put(exact(near, sets, percent)).where("linked").select("a", "b")
        scratch.drop(near, sets)
    roots = labels(docs, least, slot_counts(counted, slots), scratch, words, percent, seed, block_rows, whole_rows, known)
    rooted = least.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", "doc_id", F.coalesce("root", "id").alias("root"))
    return rows.drop("check"), rooted


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, slots: int = SLOTS, block_rows: int = BLOCK_ROWS, whole_rows: int = WHOLE_ROWS) -> DataFrame:
    """doc_id, n_shingles and component_id of each document."""
    scratch = Scratch(docs.sparkSession, "ngram_join")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, rooted = components(docs, scratch, words, percent, slots, block_rows, whole_rows)
    rooted = scratch.put(rooted)
    lowest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = scratch.put(rooted.select("id", "root").join(lowest, "root").select("id", "component_id"))
    found = rows.join(classes, "id", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
