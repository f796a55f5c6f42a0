"""Audit of how the sources of a language differ in their use of terms.

Tokenizer: a table of 256 entries, looked up over the concatenated UTF-8 of a
block of texts, says which bytes belong to terms; edges of that and of the texts
are the terms' boundaries. Slices are grouped by their xxhash, and every slice is
compared, byte by byte, with the one that stands for its group, so that terms
whose hashes collide stay apart. A task sums what its blocks have, in a
table of bounded size, before anything is shuffled.

Divergences: the kept terms of a language are dealt in shards by term, and each
shard is a CSR matrix of sources by terms. For one source its row is laid out
over the shard's columns, and one pass over the matrix's entries with
`np.add.reduceat` sums its terms against every other source; terms that neither
has are counted and added at the end. Sources beyond BLOCK a language are dealt
in blocks, two to a task. All arithmetic is of whole numbers.

Edge cases: null text, language or source is ''; a text without terms still
gives its group; a language without kept terms has pairs of value 0 and no terms; a
repeated row counts each time; ties go to the item that is least by bytes; an
empty table gives an empty table; other columns are not read, whatever their
names. Memory of a task is that of a block or of the longest text, and of one
shard. Counts may reach 2**52.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, arrow_schema, record_batch

#: Documents of a language that a kept term is in, and ranks of terms that are given.
LEAST_DOCS, TOP = 10, 10
SCALE = 1_000_000_000
#: Bytes of text looked at together; entries a task sums; entries of a shard; sources in a block.
BLOCK_BYTES, TABLE_ROWS, SHARD_ROWS, BLOCK = 8 << 20, 1_000_000, 1 << 18, 256
#: A task's occurrences and texts of a term are one number, texts from this bit on.
TEXTS_AT = 40
_BYTES = np.arange(256)
IS_UPPER = (_BYTES >= 0x41) & (_BYTES <= 0x5A)
IS_TERM = IS_UPPER | (_BYTES >= 0x61) & (_BYTES <= 0x7A) | (_BYTES >= 0x80)
LOWER = np.where(IS_UPPER, _BYTES + 32, _BYTES).astype(np.uint8)


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each term in the bytes; text i is data[offsets[i]:offsets[i + 1]], and no term crosses its ends."""
    inside = IS_TERM[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    at = offsets[:-1][full]
    first[at] = inside[at]
    at = offsets[1:][full] - 1
    last[at] = inside[at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, side="right") - 1


def group_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest: Callable = xxhash.xxh64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """The group of each slice and the slice that stands for each group; slices of a group are the same bytes."""
    view = memoryview(np.ascontiguousarray(data))
    hashes = np.fromiter(map(digest, map(view.__getitem__, map(slice, starts.tolist(), ends.tolist()))), np.uint64, len(starts))
    _, stands, group = np.unique(hashes, return_index=True, return_inverse=True)
    size = ends - starts
    odd = size != size[stands[group]]
    # byte by byte, so many slices at a time that indexes stay small
    done = np.concatenate([[0], np.cumsum(size)])
    for k in range(0, int(done[-1]), 1 << 20):
        i, j = np.searchsorted(done, [k, k + (1 << 20)])
        i, j = int(i), int(min(j, len(size)))
        part = np.flatnonzero(~odd[i:j]) + i
        if not len(part):
            continue
        n = size[part]
        heads = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(heads, n)
        differ = data[step + np.repeat(starts[part], n)] != data[step + np.repeat(starts[stands[group[part]]], n)]
        odd[part] = np.logical_or.reduceat(differ, heads)
    new: dict[bytes, int] = {}
    more = []
    for i in np.flatnonzero(odd).tolist():
        term = bytes(view[starts[i] : ends[i]])
        if term not in new:
            new[term] = len(stands) + len(new)
            more.append(i)
        group[i] = new[term]
    return group, np.concatenate([stands, np.array(more, dtype=stands.dtype)])


def count_terms(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, str], list[bytes], list[int], list[int]]]:
    """For each group of each block: (lang, source), terms, their occurrences and the number of texts they are in."""
    text = batch.column("text").fill_null("").cast(pa.large_string())
    groups = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()))
    names = list(dict.fromkeys(groups))
    number = {g: i for i, g in enumerate(names)}
    of_row = np.array([number[g] for g in groups], dtype=np.int64)
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(text):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, side="right")) - 1)
        cuts = offsets[row : end + 1] - offsets[row]
        block = LOWER[data[offsets[row] : offsets[end]]]
        starts, ends, at = boundaries(block, cuts)
        if len(starts):
            term, stands = group_slices(block, starts, ends)
            n = len(stands)
            in_text, times = np.unique(at * n + term, return_counts=True)
            pairs, back = np.unique(of_row[row:end][in_text // n] * n + in_text % n, return_inverse=True)
            docs = np.bincount(back)
            counts = np.bincount(back, times).astype(np.int64)
            view = memoryview(block)
            a, b = starts[stands].tolist(), ends[stands].tolist()
            cut = np.flatnonzero(np.diff(pairs // n)) + 1
            for p, c, d in zip(np.split(pairs, cut), np.split(counts, cut), np.split(docs, cut)):
                yield names[int(p[0] // n)], [bytes(view[a[t] : b[t]]) for t in (p % n).tolist()], c.tolist(), d.tolist()
        row = end


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences and texts, summed by task; each group also has a row of the term ''."""
    schema = "lang string, source string, term string, n long, d long"
    kinds = arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[tuple[str, str], dict[bytes, int]] = {}
        held = 0
        for batch in batches:
            for g in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()):
                table.setdefault(g, {b"": 0})
            for group, terms, ns, ds in count_terms(batch):
                own = table[group]
                held -= len(own)
                get = own.get
                for t, n, d in zip(terms, ns, ds):
                    own[t] = get(t, 0) + n + (d << TEXTS_AT)
                held += len(own)
                if held > TABLE_ROWS:
                    yield from flush(table)
                    table, held = {g: {b"": 0} for g in table}, 0
        yield from flush(table)

    def flush(table: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), own in table.items():
            both = np.fromiter(own.values(), np.int64, len(own))
            same = lambda x: pa.DictionaryArray.from_arrays(np.zeros(len(own), np.int32), pa.array([x], pa.string())).cast(pa.string())  # noqa: B023, E731
            yield record_batch({"lang": same(lang), "source": same(source), "term": pa.array(own, pa.binary()).cast(pa.string()), "n": both & (1 << TEXTS_AT) - 1, "d": both >> TEXTS_AT}, kinds)

    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return named.mapInArrow(run, schema)


def share(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * count / total), in steps of a thousand so that nothing overflows."""
    out, rest = np.zeros_like(count), count
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class Shard:
    """Counts of a shard's terms in sources, as CSR: source i has the columns indices[indptr[i]:indptr[i + 1]]."""

    def __init__(self, indptr: np.ndarray, indices: np.ndarray, counts: np.ndarray, columns: int, totals: np.ndarray):
        self.indptr, self.indices, self.columns = indptr, indices, columns
        self.sizes = np.diff(indptr)
        self.full = np.flatnonzero(self.sizes)
        # shares of the entries, and what a term has in a source without it
        self.p = share(counts + 2, np.repeat(totals, self.sizes))
        self.zero = share(np.full(len(totals), 2), np.maximum(totals, 1))
        self.zeros = np.repeat(self.zero, self.sizes)

    def by_row(self, values: np.ndarray) -> np.ndarray:
        """Sums of the entries' values in each row."""
        out = np.zeros(len(self.sizes), dtype=np.int64)
        if len(self.full):
            out[self.full] = np.add.reduceat(values, self.indptr[self.full])
        return out

    def against(self, g: int) -> tuple[np.ndarray, np.ndarray]:
        """For source g and every source: the sum of divergences over terms that one of the two has, and how many these are."""
        own = slice(self.indptr[g], self.indptr[g + 1])
        x = np.full(self.columns, self.zero[g])
        x[self.indices[own]] = self.p[own]
        has = np.zeros(self.columns, dtype=bool)
        has[self.indices[own]] = True
        at = x[self.indices]
        both = has[self.indices]
        # terms of the other source, then those of g that it lacks
        value = self.by_row(apart(at, self.p) - np.where(both, apart(at, self.zeros), 0))
        shares, times = np.unique(self.p[own], return_counts=True)
        zero, back = np.unique(self.zero, return_inverse=True)
        value += np.array([int((apart(shares, z) * times).sum()) for z in zero], dtype=np.int64)[back]
        return value, self.sizes[g] + self.sizes - self.by_row(both.astype(np.int64))


def _top(term: list, p: np.ndarray, q: np.ndarray, k: int) -> list[int]:
    """The entries with p > q of the k largest divergences, ties by bytes."""
    at = np.flatnonzero(p > q)
    if len(at) > k:
        value = apart(p[at], q[at])
        at = at[value >= np.partition(value, -k)[-k]]
    value = apart(p[at], q[at])
    return [int(at[i]) for i in sorted(range(len(at)), key=lambda i: (-value[i], term[at[i]]))[:k]]


def shard_rows(rows: pa.Table, k: int = TOP) -> dict[str, list]:
    """Divergences of one shard's two blocks, from its sources (no term; total, whole) and its entries (term, n, m), sorted by source and term."""
    head = rows.filter(pa.compute.is_null(rows.column("term")))
    rest = rows.filter(pa.compute.is_valid(rows.column("term")))
    sources, block = head.column("source").to_pylist(), head.column("block").to_numpy()
    number = {s: i for i, s in enumerate(sources)}
    # a term's bytes, for order
    term = rest.column("term").cast(pa.binary()).dictionary_encode().combine_chunks()
    term = term if isinstance(term, pa.DictionaryArray) else pa.DictionaryArray.from_arrays(pa.array([], pa.int32()), pa.array([], pa.binary()))
    names = term.dictionary.to_pylist()
    indices = term.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.array([number[s] for s in rest.column("source").to_pylist()], dtype=np.int64)
    order = np.argsort(of, kind="stable")
    indptr = np.searchsorted(of[order], np.arange(len(sources) + 1))
    indices, counts, m = indices[order], rest.column("n").to_numpy()[order], rest.column("m").to_numpy()[order]
    totals, whole = head.column("total").to_numpy(), head.column("whole").to_numpy()
    shard = Shard(indptr, indices, counts, len(names), totals)
    one = rows.column("one")[0].as_py()
    two = rows.column("two")[0].as_py()
    out: dict[str, list] = {c: [] for c in ("source", "part", "item", "value", "seen", "each")}
    for g in np.flatnonzero(block == one).tolist():
        value, seen = shard.against(g)
        each = apart(np.full(len(sources), shard.zero[g]), shard.zero)
        for h in np.flatnonzero(block == two).tolist():
            if g != h:
                # a pair within a block is met from both sides, one across blocks from this side alone
                for a, b in ((g, h),) if one == two else ((g, h), (h, g)):
                    for c, x in zip(out, (sources[a], "pair", sources[b], int(value[h]), int(seen[h]), int(each[h]))):
                        out[c].append(x)
    if one == two:
        for g in range(len(sources)):
            own = slice(indptr[g], indptr[g + 1])
            if own.start < own.stop:
                p, q = shard.p[own], share(m[own] + 2, whole[g])
                terms = [names[t] for t in indices[own].tolist()]
                for i in _top(terms, p, q, k):
                    for c, x in zip(out, (sources[g], "term", terms[i].decode(), int(apart(p[i : i + 1], q[i : i + 1])[0]), 0, 0)):
                        out[c].append(x)
    return out


def shards(dealt: DataFrame, k: int) -> DataFrame:
    """shard_rows of every (lang, shard, one, two); rows come sorted, so that a task holds one shard at a time."""
    schema = "lang string, source string, part string, item string, value long, seen long, each long"
    kinds = arrow_schema(dealt.sparkSession, schema)
    keys = ["lang", "shard", "one", "two"]

    def emit(rows: pa.Table) -> pa.RecordBatch:
        out = shard_rows(rows, k)
        return record_batch({"lang": [rows.column("lang")[0].as_py()] * len(out["part"]), **out}, kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            key = list(zip(*(now.column(c).to_pylist() for c in keys)))
            at = 0
            for i in [*(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]:
                if held and key[at] != last:
                    yield emit(pa.concat_tables(held).combine_chunks())
                    held = []
                held.append(now.slice(at, i - at))
                last, at = key[at], i
        if held:
            yield emit(pa.concat_tables(held).combine_chunks())

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, shard_rows: int = SHARD_ROWS, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): divergence of each source from each other of its language, and its most overused terms."""
    scratch = Scratch(docs.sparkSession, "divergence")
    counts = scratch.put(counted(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d")))
    has_term = F.col("term") != ""
    kept = counts.where(has_term).groupBy("lang", "term").agg(F.sum("n").alias("m"), F.sum("d").alias("d")).where(F.col("d") >= least_docs).select("lang", "term", "m")
    kept = scratch.put(kept)
    entries = scratch.put(counts.where(has_term).select("lang", "source", "term", "n").join(kept, ["lang", "term"]))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("m").alias("whole"))
    langs = langs.join(entries.groupBy("lang").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards")), "lang")
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where(~has_term).select("lang", "source")
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").join(blocks, "lang").na.fill({"total": 0, "v": 0, "whole": 0, "shards": 1})
    # both with twice the number of kept terms, as shares need them
    groups = groups.select("lang", "source", (F.col("total") + 2 * F.col("v")).alias("total"), (F.col("whole") + 2 * F.col("v")).alias("whole"), "v", "shards", "blocks", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block"))
    groups = scratch.put(groups)
    # a block goes with itself and with every other, the lesser first
    others = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.named_struct(F.lit("one"), F.least(b, "block"), F.lit("two"), F.greatest(b, "block"))))
    none = F.lit(None)
    heads = groups.select("lang", "source", "block", "total", "whole", others.alias("x"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    heads = heads.select("lang", "shard", "x.one", "x.two", "block", "source", none.cast("string").alias("term"), none.cast("long").alias("n"), none.cast("long").alias("m"), "total", "whole")
    of_lang = groups.groupBy("lang").agg(F.first("shards").alias("shards"), F.first("blocks").alias("blocks"))
    body = entries.join(of_lang, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    body = body.select("lang", "source", "term", "n", "m", "block", others.alias("x"), F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"))
    body = body.select("lang", "shard", "x.one", "x.two", "block", "source", "term", "n", "m", none.cast("long").alias("total"), none.cast("long").alias("whole"))
    found = scratch.put(shards(heads.unionByName(body), top))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.first("each").alias("each"))
    # terms that neither source has
    pairs = pairs.join(groups.groupBy("lang").agg(F.first("v").alias("v")), "lang").select("lang", "source", "part", "item", (F.col("value") + (F.col("v") - F.col("seen")) * F.col("each")).alias("value"))
    best = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = found.where("part = 'term'").select("lang", "source", "part", "item", "value").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    out = scratch.put(pairs.withColumn("rank", F.row_number().over(best)).unionByName(ranked))
    scratch.drop(counts, kept, entries, groups, found)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
tokens AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
vocabulary AS (SELECT lang, term, count(*) AS m FROM tokens GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(m) AS whole FROM vocabulary GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM tokens t JOIN vocabulary USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
shares AS (
  SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n,
         1 + (1000000000 * (coalesce(c.n, 0) + 2)::HUGEINT) // (coalesce(t.total, 0) + 2 * l.v)::HUGEINT AS p,
         1 + (1000000000 * (v.m + 2)::HUGEINT) // (l.whole + 2 * l.v)::HUGEINT AS q
  FROM groups g JOIN vocabulary v USING (lang) JOIN langs l USING (lang)
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM rows)
WHERE part = 'pair' OR rank <= 10
"""
