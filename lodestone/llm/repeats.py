"""Exact removal of repeated byte strings by longest-previous-factor arrays.

A position starts a repeat if its next `length` bytes also start elsewhere,
that is if its longest previous or next factor is that long. Suffixes are
compared in buckets: of every `length` bytes the 32-byte gram of least hash is
an anchor, so two equal strings have the same anchor at the same place, and
meet in the bucket of its hash. Only anchors are counted over all text, about
one in 85 bytes; contexts (all strings that hold the anchor) that are the same
are repeats as they stand, and of each kind of context one goes on.

Where a bucket has several kinds, the suffixes of its contexts are put in
order by their bytes, eight more at a time for those that still tie, which
also gives how much neighbours share. From each suffix the previous and next
smaller positions in that order (smaller in the text, that is earlier) lead to
its longest previous factor, the greater of what it shares with the two; the
same over greater positions gives the longest next factor.

A bucket of more than `hot` kinds is never one task's: its contexts are
compared by what all strings of a range of offsets share, in counts that Spark
combines before the shuffle; ranges with several kinds are cut in four until
they are decided or share a range with no more than `hot` kinds, which are put
in order like any bucket. Contexts are told apart by 128 bits, of the anchor
and of all the context; within a bucket bytes are compared.

By default the first copy, by doc_id and position, stays; with keep_first off
all copies go.

Edge cases: null text is empty; texts below `length` bytes have no repeats but
with others; a very long text is hashed BLOCK bytes at a time, so that a task
holds little beside the text itself; rows that share a doc_id are documents of
their own, told apart by text, and rows that are the same are copies of each
other, of which the first stays whole; a null doc_id comes first in order; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, arrow_schema, map_rows, record_batch

#: Kinds of context in a bucket that one task puts in order, and documents that it unpacks, at a time.
HOT, ROWS = 1024, 1000
#: Bytes of a text that are hashed at a time; below 2^28.
BLOCK = 1 << 20

LENGTH, GRAM = 200, 32


def _table(seed: int = 7) -> np.ndarray:
    """One odd 64-bit number for each byte value, from a hash of the value."""
    return np.array([xxhash.xxh3_64_intdigest(bytes([b]), seed) | 1 for b in range(256)], dtype=np.uint64)


_BYTES = _table()
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = [np.ones(1, dtype=np.uint64)] * 2


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64; the tables grow to a block's length."""
    if len(_POWERS[0]) < n:
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, b, np.uint64)])) for b in (_BASE, _INVERSE)]
    return [p[:n] for p in _POWERS]


def gram_hashes(data: bytes, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the bytes at each position, `gram` long, from one running sum."""
    n = len(data)
    up, down = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[np.frombuffer(data, np.uint8)] * up, out=total[1:])
    h = (total[gram:] - total[:-gram]) * down[: n - gram + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchor_positions(h: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the least hash of some `width` neighbours in a row, the first of equals."""
    n, spots = len(h), 1 + (len(h) - 1) // width
    keys = np.full(spots * width, np.iinfo(np.uint64).max, np.uint64)
    keys[:n] = (h >> np.uint64(28) << np.uint64(28)) | np.arange(n, dtype=np.uint64)
    blocks = keys.reshape(spots, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: n - width + 1], ahead[width - 1 : n])
    chosen = least[np.flatnonzero(np.diff(least, prepend=least[:1] ^ np.uint64(1)))] & np.uint64((1 << 28) - 1)
    return chosen.astype(np.int64)


def anchors_of(data: bytes, length: int, gram: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a text's anchors and the hashes of their grams; blocks overlap by a string, so that where they are cut plays no part."""
    places, hashes, last = [], [], -1
    for start in range(0, len(data) - length + 1, block):
        h = gram_hashes(data[start : start + block + length - 1], gram)
        at = anchor_positions(h, length - gram + 1)
        new = at[at + start > last]
        if len(new):
            last = int(new[-1]) + start
            places.append(new + start)
            hashes.append(h[new])
    return np.concatenate(places), np.concatenate(hashes)


def _documents(docs: DataFrame) -> DataFrame:
    """A key without nulls beside each text: id and a hash of id and text."""
    text = F.coalesce("text", F.lit(""))
    id_ = F.col("doc_id").cast("long")
    return docs.select(id_.alias("doc_id"), F.coalesce(id_, F.lit(-(1 << 63))).alias("key"), F.xxhash64(id_, text).alias("row"), text.cast("binary").alias("text"))


def anchors(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """key, row and position of each anchor with hashes of its gram and of its context.

    left: how far before the anchor its strings may start. A string that holds
    the same gram twice belongs to the first, so that none meets itself.
    """
    reach = length - gram

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            out: dict[str, list] = {c: [] for c in ("key", "row", "pos", "left", "gram", "context")}
            for key, row, text in zip(batch.column("key").to_numpy(), batch.column("row").to_numpy(), batch.column("text"), strict=True):
                data = text.as_py()
                if len(data) < length:
                    continue
                at, h = anchors_of(data, length, gram)
                out["key"].append(np.full(len(at), key))
                out["row"].append(np.full(len(at), row))
                out["pos"].append(at.astype(np.int32))
                out["gram"].append(h.view(np.int64))
                left, seen, places = [], {}, at.tolist()
                for x, g in zip(places, h.tolist()):
                    left.append(min(x, reach, x - seen.get(g, -length) - 1))
                    seen[g] = x
                out["left"].append(np.array(left, dtype=np.int32))
                out["context"].append(np.array([xxhash.xxh3_64_intdigest(data[x - n : x + length], n) for x, n in zip(places, left)], dtype=np.uint64).view(np.int64))
            if out["pos"]:
                yield {c: np.concatenate(x) for c, x in out.items()}

        return each

    return map_rows(docs.select("key", "row", "text"), make, "key long, row long, pos int, left int, gram long, context long", ROWS)


def _squeezed(docs: DataFrame) -> DataFrame:
    """Texts compressed for the way through shuffles."""

    def make():
        pack = zstandard.ZstdCompressor(level=1).compress

        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            yield {c: batch.column(c) for c in ("doc_id", "key", "row")} | {"packed": [pack(t.as_py()) for t in batch.column("text")]}

        return each

    return map_rows(docs, make, "doc_id long, key long, row long, packed binary", ROWS)


_CONTEXT = "gram long, key long, row long, pos int, left int, text binary"


def _contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes that strings with the anchor can reach, for each wanted (gram, key, row, pos, left)."""

    def make():
        unpack = zstandard.ZstdDecompressor().decompress

        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            out: dict[str, list] = {c: [] for c in ("gram", "key", "row", "pos", "left", "text")}
            for key, row, packed, places in zip(*(batch.column(c).to_pylist() for c in ("key", "row", "packed", "places")), strict=True):
                data = unpack(packed)
                for p in places:
                    for c, v in zip(out, (p["gram"], key, row, p["pos"], p["left"], data[p["pos"] - p["left"] : p["pos"] + length]), strict=True):
                        out[c].append(v)
            yield out

        return each

    places = wanted.groupBy("key", "row").agg(F.collect_list(F.struct("pos", "left", "gram")).alias("places"))
    return map_rows(_squeezed(docs).join(places, ["key", "row"]).select("key", "row", "packed", "places"), make, _CONTEXT, ROWS)


#: The least numbers of one byte, of two and so on.
_BYTE_SIZES = np.array([1 << 8 * i for i in range(8)], dtype=np.uint64)


def suffix_order(data: np.ndarray, starts: np.ndarray, bucket: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes by bucket and first `length` bytes, equal ones as given, and how many bytes each shares with the one before, -1 across buckets.

    data goes on for seven bytes at least beyond the last suffix's.
    """
    order = np.argsort(bucket, kind="stable")
    ends = bucket[order][1:] != bucket[order][:-1]
    shared = np.full(len(order), length, np.int16)
    shared[:1] = -1
    shared[1:][ends] = -1
    eight = np.arange(8)
    for depth in range(0, length, 8):
        # places whose suffix still ties with a neighbour's
        tied = shared == length
        tied[:-1] |= tied[1:].copy()
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(shared[at] < length)
        wide = min(8, length - depth)
        keys = data[(starts[order[at]] + depth)[:, None] + eight[:wide]]
        if wide < 8:
            keys = np.concatenate([keys, np.zeros((len(at), 8 - wide), np.uint8)], axis=1)
        keys = np.ascontiguousarray(keys).view(">u8").ravel().astype(np.uint64)
        moved = np.lexsort((keys, group))
        order[at] = order[at[moved]]
        keys = keys[moved]
        apart = keys[1:] ^ keys[:-1]
        new = np.flatnonzero((group[1:] == group[:-1]) & (apart != 0))
        # bytes before the first that differs; a number's size says which one
        shared[at[new + 1]] = depth + 8 - np.searchsorted(_BYTE_SIZES, apart[new], "right")
    return order, shared


def longest_factors(order: np.ndarray, shared: np.ndarray, length: int, later: bool = False) -> np.ndarray:
    """Each suffix's longest previous factor, or next one if later, where it has the whole length; 0 elsewhere.

    order: positions in suffix order. On either side a suffix looks for the
    nearest position smaller than its own; positions passed over are greater,
    so a step may take all that the one passed over has taken. What is shared
    on the way is the least of the neighbours', and a look ends where that
    falls below the length.
    """
    position = -order if later else order
    best = np.zeros(len(order), np.int16)
    for forward in (False, True):
        p = position[::-1] if forward else position
        s = np.concatenate([shared[1:], [-1]])[::-1] if forward else shared
        at = np.arange(len(p)) - 1
        least = s.astype(np.int16).copy()
        open_ = np.flatnonzero(least >= length)
        while len(open_):
            open_ = open_[p[at[open_]] > p[open_]]
            over = at[open_]
            least[open_] = np.minimum(least[open_], least[over])
            at[open_] = at[over]
            open_ = open_[(least[open_] >= length) & (at[open_] >= 0)]
        found = np.where((least >= length) & (at >= 0), least, 0)
        best = np.maximum(best, found[::-1] if forward else found)
    out = np.zeros(len(order), np.int16)
    out[order] = best
    return out


def _ordered(contexts: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Repeats (key, row, start, end) found in buckets; rows come sorted, whole buckets are taken some thousand contexts at a time."""
    kinds = arrow_schema(contexts.sparkSession, "key long, row long, start int, end int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for big in batches:
            for at in range(0, big.num_rows, HOT):
                batch = big.slice(at, HOT)
                grams = batch.column("gram").to_numpy()
                last = int(np.searchsorted(grams, grams[-1]))  # where the bucket that may go on starts
                if last or (rest and rest[-1].column("gram")[0].as_py() != grams[0]):
                    yield from emit([*rest, batch.slice(0, last)])
                    rest = []
                rest.append(batch.slice(last))
        if rest:
            yield from emit(rest)

    def emit(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).combine_chunks()
        if t.num_rows < 2:
            return
        c = {f: t.column(f).to_numpy() for f in ("gram", "key", "row", "pos", "left")}
        all_texts = t.column("text").to_pylist()
        sizes = np.array([len(x) for x in all_texts])
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join([*all_texts, bytes(8)]), np.uint8)
        # windows of a context that hold its anchor
        n = np.maximum(0, np.minimum(c["left"], sizes - length) + 1)
        of = np.repeat(np.arange(len(n)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        # contexts come by gram, key, row and pos, so that a suffix's number is its position in the text
        order, shared = suffix_order(data, starts[of] + place, c["gram"][of], length)
        longest = longest_factors(order, shared, length)
        if not keep_first:
            longest = np.maximum(longest, longest_factors(order, shared, length, later=True))
        hit = np.flatnonzero(longest)
        if not len(hit):
            return
        cut = np.flatnonzero((np.diff(hit) != 1) | (np.diff(of[hit]) != 0)) + 1
        begin, end = hit[np.concatenate([[0], cut])], hit[np.concatenate([cut - 1, [len(hit) - 1]])]
        base = c["pos"][of[begin]] - c["left"][of[begin]]
        yield record_batch({"key": c["key"][of[begin]], "row": c["row"][of[begin]], "start": base + place[begin], "end": base + place[end] + length}, kinds)

    return contexts.repartition("gram").sortWithinPartitions("gram", "key", "row", "pos").mapInArrow(run, "key long, row long, start int, end int")


def _split(contexts: DataFrame, scratch: Scratch, length: int, gram: int, keep_first: bool, hot: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Repeats of contexts in hot buckets, by ranges of the offsets from a string's start to its anchor, and contexts to be put in order.

    Contexts that share what all strings of a range hold are a bucket of their
    own; one of no more than `hot` kinds goes back to the ordered way, cut to
    the range, and only the others are split further.
    """
    found, few, width = [], [], length - gram + 1
    rows = contexts.withColumn("lo", F.lit(0))
    names = "lo int, shared long, whole long"
    schema = f"{_CONTEXT}, {names}"

    def name(now: DataFrame, width: int) -> DataFrame:
        kinds = arrow_schema(now.sparkSession, schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            digest = xxhash.xxh3_64_intdigest
            for batch in batches:
                kept, shared, whole = [], [], []
                for i, (left, text, lo) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("left", "text", "lo")), strict=True)):
                    hi, right = min(lo + width, length - gram + 1) - 1, len(text) - left
                    if left < lo or right < length - hi:
                        continue  # no string of this range fits
                    kept.append(i)
                    shared.append(digest(text[left - lo : left + length - hi], lo))
                    whole.append(digest(text[left - hi : left + length - lo], lo) if left >= hi and right >= length - lo else None)
                part = batch.take(pa.array(kept, pa.int64()))
                as_long = lambda x: x if x is None or x < 1 << 63 else x - (1 << 64)
                yield record_batch({c: part.column(c) for c in batch.schema.names} | {"shared": list(map(as_long, shared)), "whole": list(map(as_long, whole))}, kinds)

        return now.select("gram", "key", "row", "pos", "left", "text", "lo").mapInArrow(run, schema)

    while True:
        named = scratch.put(name(rows, width))
        order = F.col("key").cast("decimal(38,0)") * (1 << 31) + F.col("pos")
        on, each = ["gram", "lo", "shared"], ["gram", "lo", "shared", "whole"]
        counted = scratch.put(named.groupBy(*each).agg(F.count("*").alias("n"), F.min(order).alias("first")))
        several = scratch.put(counted.groupBy(*on).agg(F.sum("n").alias("all"), F.count("*").alias("n_kinds"), F.count_if(F.col("whole").isNull()).alias("n_open"), F.sum(F.when(F.col("whole").isNull(), F.col("n")).otherwise(1)).alias("going")).where(F.col("all") > 1))
        judged = counted.join(several, on).withColumnRenamed("whole", "whole_")
        same = F.col("whole").eqNullSafe(F.col("whole_"))
        met = scratch.put(named.join(judged.select(*on, "whole_", "n", "first", "n_kinds", "n_open", "going"), on).where(same).withColumn("is_first", F.expr("cast(key as decimal(38,0)) * 2147483648 + pos = first")))
        hi = F.least(F.col("lo") + F.lit(width), F.lit(length - gram + 1)) - 1
        closed = F.col("whole").isNotNull()
        gone = met.where(closed & (F.col("n") > 1) & (~F.col("is_first") if keep_first else F.lit(True)))
        base = F.col("pos") - hi
        found.append(scratch.put(gone.select("key", "row", base.alias("start"), (F.col("pos") - F.col("lo") + length).alias("end"))))
        if width == 1:
            return found, few
        # one of each kind goes on where there are others, and what the range's end cuts off
        on_ = met.where(~closed | (F.col("is_first") & ((F.col("n_kinds") > 1) | (F.col("n_open") > 0))))
        before, after = F.least("left", hi), F.least(F.length("text") - F.col("left"), F.lit(length) - F.col("lo"))
        cut = F.col("text").substr(F.col("left") - before + 1, before + after)
        few.append(scratch.put(on_.where(F.col("going") <= hot).select(F.xxhash64(*on).alias("gram"), "key", "row", "pos", before.alias("left"), cut.alias("text"))))
        on_ = on_.where(F.col("going") > hot)
        if not on_.limit(1).count():
            return found, few
        quarter = -(-width // 4)
        rows = on_.select("gram", "key", "row", "pos", "left", "text", F.explode(F.sequence(F.col("lo"), hi, F.lit(quarter))).alias("lo"))
        width = quarter


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_first: bool = True, hot: int = HOT, scratch: Scratch | None = None) -> DataFrame:
    """(key, row, start, end): spans to remove, which may overlap and run past the text."""
    scratch = scratch or Scratch(docs.sparkSession, "repeats")
    known = _documents(docs)
    spots = scratch.put(anchors(known, length, gram))
    # of each kind of context: how many, and the first by key and position
    order = F.col("key").cast("decimal(38,0)") * (1 << 31) + F.col("pos")
    grouped = spots.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(order).alias("first"), F.min_by("row", order).alias("row"), F.max("left").alias("left"))
    pos = F.pmod(F.col("first"), F.lit(1 << 31).cast("decimal(38,0)"))
    grouped = scratch.put(grouped.select("gram", "context", "n", ((F.col("first") - pos) / (1 << 31)).cast("decimal(38,0)").cast("long").alias("key"), "row", pos.cast("int").alias("pos"), "left"))
    buckets = scratch.put(grouped.groupBy("gram").agg(F.count("*").alias("n_kinds")).where("n_kinds > 1"))
    whole = spots.drop("left").join(grouped.where("n > 1").select("gram", "context", F.col("key").alias("k"), F.col("row").alias("r"), F.col("pos").alias("p"), "left"), ["gram", "context"])
    if keep_first:
        whole = whole.where("NOT (key = k AND row = r AND pos = p)")
    spans = [scratch.put(whole.select("key", "row", (F.col("pos") - F.col("left")).alias("start"), (F.col("pos") + length).alias("end")))]
    scratch.drop(spots)

    wanted = scratch.put(grouped.join(buckets, "gram").select("gram", "key", "row", "pos", "left"))
    contexts = _contexts(known, wanted, length)
    crowded = scratch.put(buckets.where(F.col("n_kinds") > hot).select("gram"))
    if crowded.limit(1).count():
        contexts = scratch.put(contexts)
        gone, few = _split(contexts.join(crowded, "gram", "left_semi"), scratch, length, gram, keep_first, hot)
        spans += gone
        contexts = contexts.join(crowded, "gram", "left_anti")
        for more in few:
            contexts = contexts.unionByName(more)
    spans.append(scratch.put(_ordered(contexts, length, keep_first)))
    out = spans[0]
    for more in spans[1:]:
        out = out.union(more)
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_first: bool = True, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, spans removed (array of start and end, in bytes) and kept, the bytes that remain."""
    scratch = Scratch(docs.sparkSession, "repeats")
    spans = repeated_spans(docs, length, gram, keep_first, hot, scratch).groupBy("key", "row").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))

    def make():
        unpack = zstandard.ZstdDecompressor().decompress

        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            out: dict[str, list] = {c: [] for c in ("doc_id", "n_bytes", "spans", "kept")}
            for doc, packed, starts, ends, copy in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "packed", "starts", "ends", "copy")), strict=True):
                data = unpack(packed)
                if copy > 1 and len(data) >= length:
                    starts, ends = [0], [len(data)]
                runs: list[list[int]] = []
                for a, b in sorted(zip(starts or (), ends or (), strict=True)):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], min(b, len(data)))
                    else:
                        runs.append([a, min(b, len(data))])
                bounds = [0, *(x for run in runs for x in run), len(data)]
                for c, v in zip(out, (doc, len(data), [{"start": a, "end": b} for a, b in runs], b"".join(data[a:b] for a, b in zip(bounds[::2], bounds[1::2]))), strict=True):
                    out[c].append(v)
            yield out

        return each

    joined = _squeezed(_documents(docs)).join(spans, ["key", "row"], "left")
    # of rows that are the same the spans say where the first of them repeats others
    copy = F.row_number().over(Window.partitionBy("key", "row").orderBy(F.lit(0))) if keep_first else F.lit(1)
    joined = joined.select("doc_id", "packed", "starts", "ends", copy.alias("copy"))
    return map_rows(joined, make, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary", ROWS)


def query(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_first=False)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
