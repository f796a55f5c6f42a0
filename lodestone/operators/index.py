"""A kept full-text index of a catalog: written once, extended by new rows, searched by rounds that end early.

Texts (title, artist) are numbered by `first`, the least id of their rows, and
dealt in ranges of it: the first ranges hold few texts and each further one
GROWTH times as many, so that there are some ten of them for a million texts. In
a range, blocks of about BLOCK texts. A row of `postings` is a token in a block:
(bucket, token, range, block, least, greatest, n, ids and the token's places in
title and artist), so no row grows with the catalog, however frequent the
token. Rows are in folders by the token's bucket and sorted by range and token:
a search reads the buckets of its tokens, and of their files the range's part.

A search goes through the ranges in order, for all queries at once, and a query
that has its k hits drops out: a word that every row holds costs one row of the
first range. Within a round posting rows are combined as sets, in arrays of one
block, so that ids are not exploded before they are hits.

A query string is words and quoted phrases, all of which must be there, with
AND, OR, NOT, NEAR(...), brackets, column: and {columns}:, ^ for the start of a
column and * for the rest of a word. A malformed string finds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import tokens
from lodestone.operators.catalog import BOTH, FUZZY_ROWS, is_plain, texts_of
from lodestone.operators.ranking import top_k

#: Folders of tokens; texts of the first range, times that the next one is as large, and texts of a block.
BUCKETS, FIRST, GROWTH, BLOCK = 16, 64, 4, 4096


SCHEMAS = {
    "texts": "id long, first long, title string, artist string",
    "ranges": "range int, low long, high long, blocks int, texts long",
    "postings": "token string, range int, block int, least long, greatest long, n int, ids array<long>, title array<array<int>>, artist array<array<int>>, bucket int",
}


class Index(NamedTuple):
    """Where an index is. Its tables are read anew at each use, so that it can be extended and replaced."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}")

    def match(self, queries: DataFrame, k: int, scratch) -> DataFrame:
        return match(queries, self, k, scratch)


def bucket_of(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def _places(found: Column, token: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda i: (F.size(found) > 0) & (F.get(found, i) == token)).cast("array<int>")


def _postings(texts: DataFrame, ranges: list[tuple]) -> DataFrame:
    """Posting rows of texts (first, title, artist) in ranges (range, low, high, blocks); a text belongs to the last that starts at or before it."""
    number = F.lit(ranges[0][0])
    low, high, blocks = (F.lit(ranges[0][i]) for i in (1, 2, 3))
    for r in ranges[1:]:
        there = F.col("first") >= r[1]
        number = F.when(there, r[0]).otherwise(number)
        low, high, blocks = (F.when(there, r[i]).otherwise(x) for i, x in ((1, low), (2, high), (3, blocks)))
    part = F.floor((F.col("first") - low) / F.greatest(high - low + 1, F.lit(1)) * blocks)
    rows = texts.select("first", number.alias("range"), F.greatest(F.lit(0), F.least(part, blocks - 1)).cast("int").alias("block"), *[tokens(F.col(c)).alias(c) for c in BOTH])
    one = rows.select("first", "range", "block", *BOTH, F.explode(F.array_distinct(F.concat(*BOTH))).alias("token"))
    entry = F.struct(F.col("first").alias("id"), *[_places(F.col(c), F.col("token")).alias(c) for c in BOTH])
    kept = one.groupBy("token", "range", "block").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return kept.select(bucket_of(F.col("token")).alias("bucket"), "token", "range", "block", F.element_at("e", 1)["id"].alias("least"), F.element_at("e", -1)["id"].alias("greatest"), F.size("e").alias("n"), F.col("e.id").alias("ids"), *[F.col(f"e.{c}").alias(c) for c in BOTH])


def _write(index: Index, new: DataFrame, ranges: list[tuple], mode: str) -> None:
    spark = index.spark
    spark.createDataFrame(ranges, SCHEMAS["ranges"]).coalesce(1).write.mode(mode).parquet(f"{index.path}/ranges")
    rows = _postings(new, ranges)
    rows.repartition("bucket").sortWithinPartitions("bucket", "range", "token").write.mode(mode).partitionBy("bucket").parquet(f"{index.path}/postings")


def _ranges(texts: DataFrame, start: int) -> list[tuple]:
    """(range, low, high, blocks, texts) of some ten ranges that texts (first) fall in, numbered from start."""
    n, low, high = texts.agg(F.count("*"), F.min("first"), F.max("first")).head()
    if not n:
        return []
    sizes, left = [], n
    while left > 0:
        sizes.append(min(left, FIRST * GROWTH ** len(sizes)))
        left -= sizes[-1]
    done = [sum(sizes[:i]) / n for i in range(1, len(sizes))]
    cuts = texts.agg(F.percentile_approx("first", [float(x) for x in done], 100_000)).head()[0] if done else []
    lows = sorted({low, *(c + 1 for c in cuts if c < high)})
    return [(start + i, a, b, max(1, -(-size // BLOCK)), size) for i, (a, b, size) in enumerate(zip(lows, [*(x - 1 for x in lows[1:]), high], sizes))]


def build(catalog: DataFrame, path: str, k: int = FUZZY_ROWS) -> Index:
    """Writes the index of a catalog (id, title, artist) to path, which must be new: its texts with the k least ids of each, and its postings."""
    index = Index(catalog.sparkSession, path)
    catalog = catalog.select(F.col("id").cast("long").alias("id"), *BOTH)
    texts_of(catalog, k).repartitionByRange("first").sortWithinPartitions("first", "id").write.parquet(f"{path}/texts")
    texts = index.table("texts").where("id = first").select("first", *BOTH)
    ranges = _ranges(texts, 0)
    _write(index, texts, ranges or [(0, 0, 0, 1, 0)], "errorifexists")
    return index


def extend(index: Index, rows: DataFrame) -> Index:
    """Adds catalog rows whose ids are above all that the index has; postings are written for texts that it does not have yet."""
    old, new = index.table("texts"), rows.select(F.col("id").cast("long").alias("id"), *BOTH)
    most = old.agg(F.max("id")).head()[0]
    least = new.agg(F.min("id")).head()[0]
    if least is None:
        return index
    if most is not None and least <= most:
        raise ValueError(f"ids up to {most} are in the index; rows from {least} on need it built anew")
    known = old.where("id = first").select(*[F.col(c).alias(f"old_{c}") for c in BOTH], F.col("first").alias("old_first"))
    same = [F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in BOTH]
    placed = texts_of(new, FUZZY_ROWS).join(known, same, "left").select("id", F.coalesce("old_first", "first").alias("first"), *BOTH)
    last = index.table("ranges").agg(F.max("range")).head()[0]
    fresh = placed.where("id = first").select("first", *BOTH)
    if ranges := _ranges(fresh, last + 1):
        _write(index, fresh, ranges, "append")
    placed.write.mode("append").parquet(f"{index.path}/texts")
    return index


def _blocks(index: Index, asked: DataFrame) -> DataFrame:
    """The postings in the buckets of the tokens asked: no more than BUCKETS numbers come to the driver."""
    buckets = sorted(r[0] for r in asked.select(bucket_of(F.col("token"))).distinct().collect())
    return index.table("postings").where(F.col("bucket").isin(buckets))


def _rounds(index: Index) -> Iterator[list[int]]:
    """Numbers of ranges, few texts first."""
    for r in sorted(r[0] for r in index.table("ranges").select("range").distinct().collect()):
        yield [r]


def _ids(index: Index, hits: DataFrame, k: int) -> DataFrame:
    """(query, id, rank) of the k least ids of hits (query, first)."""
    few = top_k(hits, ["query"], [F.col("first")], k).drop("rank")
    return top_k(few.join(index.table("texts").select("first", "id"), "first").select("query", "id"), ["query"], [F.col("id")], k)


def _in_rounds(index: Index, queries: DataFrame, k: int, scratch, one_round) -> DataFrame:
    """Hits (query, first) of one_round(queries left, ranges), round by round; who has k drops out."""
    left, found = queries, None
    for ranges in _rounds(index):
        now = scratch.put(one_round(left, ranges))
        found = now if found is None else found.unionByName(now)
        full = found.groupBy("query").agg(F.count("*").alias("have")).where(F.col("have") >= k).select("query")
        left = scratch.put(queries.join(full, "query", "left_anti"))
        if not left.limit(1).count():
            break
    return found if found is not None else queries.select("query", F.lit(0).cast("long").alias("first")).where("false")


def _narrow(postings: DataFrame, ranges: list[int], columns: tuple[str, ...] = BOTH) -> DataFrame:
    """(token, range, block, n, ids) of the ranges: ids with the token in one of the columns."""
    rows = postings.where(F.col("range").isin(ranges))
    if columns == BOTH:
        return rows.select("token", "range", "block", "ids")
    held = F.filter("ids", lambda x, i: F.size(F.get(F.col(columns[0]), i)) > 0)
    return rows.select("token", "range", "block", held.alias("ids")).where(F.size("ids") > 0)


def full_text(queries: DataFrame, index: Index, k: int, scratch, columns: tuple[str, ...] = BOTH) -> DataFrame:
    """(query, id, rank): rows with all tokens of the query, as `catalog.full_text` has them, through the index."""
    plain = queries.where(is_plain(F.col("query"))).select("query").distinct().select("query", F.array_distinct(tokens(F.col("query"))).alias("asked")).where(F.size("asked") > 0)
    asked = scratch.put(plain.select("query", F.size("asked").alias("need"), F.explode("asked").alias("token")))
    postings = _blocks(index, asked)

    def one_round(left: DataFrame, ranges: list[int]) -> DataFrame:
        met = asked.join(left, "query", "left_semi").join(_narrow(postings, ranges, columns), "token")
        # a block in which a token is missing has no hit
        sets = met.groupBy("query", "need", "range", "block").agg(F.collect_list("ids").alias("sets")).where(F.size("sets") == F.col("need"))
        both = F.aggregate(F.slice("sets", 2, 1 << 20), F.get("sets", F.lit(0)), lambda a, b: F.array_intersect(a, b))
        return sets.select("query", F.explode(F.slice(F.array_sort(both), 1, k)).alias("first"))

    return _ids(index, _in_rounds(index, asked.select("query").distinct(), k, scratch, one_round), k)


_LEX = re.compile(r'\s*(?:(?P<quoted>"(?:[^"]|"")*")|(?P<word>[A-Za-z0-9_\x1a\u0080-\U0010ffff]+)|(?P<sign>[():{}^*+,-]))')
#: Operators of a program, least first in how tightly they bind; what stands side by side binds tightest.
OPERATORS = ("OR", "AND", "NOT", "BESIDE")


class Malformed(ValueError):
    pass


class Query:
    """A query string as leaves and a program over their numbers, operators after what they work on.

    A leaf is (columns, initial, near, phrases); a phrase is (texts, prefix).
    """

    def __init__(self, text: str):
        self.items, self.at, self.leaves = [], 0, []
        at, text = 0, text.rstrip()
        while at < len(text):
            if not (m := _LEX.match(text, at)):
                raise Malformed(text)
            at = m.end()
            self.items.append((m.lastgroup, m[m.lastgroup]))
        self.program = self.level(0, BOTH)
        if self.at < len(self.items):
            raise Malformed(text)

    def sees(self, *values: str, ahead: int = 0) -> bool:
        i = self.at + ahead
        return i < len(self.items) and self.items[i][0] != "quoted" and self.items[i][1] in values

    def take(self, *values: str) -> str:
        if self.at == len(self.items) or values and not self.sees(*values):
            raise Malformed
        self.at += 1
        return self.items[self.at - 1][1]

    def level(self, i: int, columns: tuple[str, ...]) -> list[str]:
        """What stands between operators of this binding; BESIDE is not written."""
        if i == len(OPERATORS):
            return self.term(columns)
        out = self.level(i + 1, columns)
        while self.sees(OPERATORS[i]) if i < 3 else self.at < len(self.items) and not self.sees(*OPERATORS[:3], ")"):
            if i < 3:
                self.take()
            out = [*out, *self.level(i + 1, columns), OPERATORS[i]]
        return out

    def term(self, columns: tuple[str, ...]) -> list[str]:
        wanted = self.columns()
        columns = columns if wanted is None else tuple(c for c in columns if c in wanted)
        if self.sees("("):
            self.take("(")
            out = self.level(0, columns)
            self.take(")")
            return out
        initial = self.sees("^")
        if initial:
            self.take("^")
        near = 10
        if not initial and self.sees("NEAR") and self.sees("(", ahead=1):
            self.take(), self.take()
            phrases = [self.phrase()]
            while not self.sees(")", ","):
                phrases.append(self.phrase())
            if self.sees(","):
                self.take(",")
                if not (n := self.take()).isdecimal() or not n.isascii():
                    raise Malformed
                near = int(n)
            self.take(")")
        else:
            phrases = [self.phrase()]
        self.leaves.append((list(columns), initial, near, phrases))
        return [str(len(self.leaves) - 1)]

    def columns(self) -> set[str] | None:
        """The columns named before a colon, or all but those after a minus sign."""
        start, none = self.at, self.sees("-")
        if none:
            self.take("-")
        if self.sees("{"):
            self.take("{")
            names = set()
            while not self.sees("}"):
                names.add(self.name())
            self.take("}")
            self.take(":")
        elif self.at + 1 < len(self.items) and self.sees(":", ahead=1):
            names = {self.name()}
            self.take(":")
        elif none:
            raise Malformed
        else:
            self.at = start
            return None
        names = {n.lower() for n in names}
        if not names <= set(BOTH):
            raise Malformed
        return set(BOTH) - names if none else names

    def name(self) -> str:
        return self.string()

    def string(self) -> str:
        kind, value = self.items[self.at] if self.at < len(self.items) else ("", "")
        if kind not in ("quoted", "word") or kind == "word" and value in OPERATORS[:3]:
            raise Malformed
        self.at += 1
        return value[1:-1].replace('""', '"') if kind == "quoted" else value

    def phrase(self) -> tuple[list[str], bool]:
        texts = [self.string()]
        while self.sees("+"):
            self.take("+")
            texts.append(self.string())
        star = self.sees("*")
        if star:
            self.take("*")
        return texts, star


def parsed(queries: DataFrame) -> DataFrame:
    """(query, program, leaves) of the well-formed distinct queries."""
    schema = "query string, program array<string>, leaves array<struct<columns: array<string>, initial: boolean, near: int, phrases: array<struct<texts: array<string>, prefix: boolean>>>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("query").to_pylist():
                try:
                    q = Query(text)
                except (Malformed, RecursionError):
                    continue
                leaves = [{"columns": c, "initial": i, "near": min(n, 1 << 30), "phrases": [{"texts": t, "prefix": p} for t, p in phrases]} for c, i, n, phrases in q.leaves]
                out.append({"query": text, "program": q.program, "leaves": leaves})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return queries.where("query IS NOT NULL").select("query").distinct().mapInArrow(run, schema)


def _tokenized(leaves: DataFrame) -> DataFrame:
    """leaves (leaf, ...) with `words`: each phrase's tokens and whether the last is a start; phrases without tokens go."""
    of_phrase = lambda p: F.struct(F.flatten(F.transform(p["texts"], tokens)).alias("words"), p["prefix"].alias("prefix"))
    return leaves.withColumn("phrases", F.filter(F.transform("leaf.phrases", of_phrase), lambda p: F.size(p["words"]) > 0))


def _leaf_hits(leaves: DataFrame, postings: DataFrame, ranges: list[int]) -> DataFrame:
    """(leaf, range, block, ids) of the distinct leaves (leaf, phrases), in the blocks that have any."""
    rows = postings.where(F.col("range").isin(ranges))
    each = leaves.select("leaf", F.size("phrases").alias("count"), F.posexplode("phrases").alias("phrase", "p"))
    each = each.select("leaf", "count", "phrase", F.size("p.words").alias("size"), "p.prefix", F.posexplode("p.words").alias("at", "word"))
    start = F.col("prefix") & (F.col("at") == F.col("size") - 1)
    by_word = each.where(~start).join(rows, F.col("word") == F.col("token"))
    # starts meet the distinct tokens of the ranges first
    known = rows.select("token").distinct()
    begun = each.where(start).select("word").distinct().withColumn("letter", F.substring("word", 1, 1)).join(known.withColumn("letter", F.substring("token", 1, 1)), "letter").where(F.col("token").startswith(F.col("word"))).select("word", "token")
    by_start = each.where(start).join(begun, "word").join(rows, "token")
    columns = ["leaf", "count", "phrase", "size", "at", "range", "block", "ids", *BOTH]
    met = by_word.select(*columns).unionByName(by_start.select(*columns))
    # one word anywhere in both columns needs no places
    easy = (F.col("count") == 1) & (F.col("size") == 1) & ~F.col("leaf.initial") & (F.size("leaf.columns") == len(BOTH))
    plain = met.where(easy).groupBy("leaf", "range", "block").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
    hard = met.where(~easy).select("leaf", "count", "phrase", "size", "at", "range", "block", F.explode(F.arrays_zip("ids", *BOTH)).alias("e"))
    held = F.explode(F.filter(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"e.{c}").alias("places")) for c in BOTH]), lambda x: F.array_contains(F.col("leaf.columns"), x["column"]) & (F.size(x["places"]) > 0)))
    spots = hard.select("leaf", "count", "phrase", "size", "at", "range", "block", F.col("e.ids").alias("id"), held.alias("h"))
    starts = spots.select("leaf", "count", "phrase", "size", "at", "range", "block", "id", "h.column", F.explode("h.places").alias("place")).withColumn("start", F.col("place") - F.col("at"))
    whole = starts.groupBy("leaf", "count", "phrase", "size", "range", "block", "id", "column", "start").agg(F.countDistinct("at").alias("words")).where("words = size AND (NOT leaf.initial OR start = 0)")
    of_text = whole.groupBy("leaf", "count", "range", "block", "id", "column").agg(F.collect_list(F.struct("phrase", "start", "size")).alias("found"))
    # some place that every phrase starts at or before, and ends no more than `near` tokens before
    fits = lambda m: F.forall(F.sequence(F.lit(0), F.col("count") - 1), lambda p: F.exists("found", lambda o: (o["phrase"] == p) & (o["start"] <= m["start"]) & (o["start"] + o["size"] + F.col("leaf.near") >= m["start"])))
    near = of_text.where((F.col("count") == 1) | F.exists("found", fits)).groupBy("leaf", "range", "block").agg(F.collect_set("id").alias("ids"))
    return plain.unionByName(near)


def _evaluated(program: Column, sets: Column) -> Column:
    """The ids that a program leaves of its leaves' sets, a map by number; null for nothing asked, which words beside it do not heed."""
    none = F.array().cast("array<array<bigint>>")
    empty = F.array().cast("array<bigint>")

    def step(stack: Column, op: Column) -> Column:
        b, a = F.get(stack, F.size(stack) - 1), F.get(stack, F.size(stack) - 2)
        rest = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 2, F.lit(0)))
        x, y = F.coalesce(a, empty), F.coalesce(b, empty)
        beside = F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.array_intersect(x, y))
        push = lambda v: F.concat(rest, F.array(v))
        return (
            F.when(op == "AND", push(F.array_intersect(x, y)))
            .when(op == "OR", push(F.array_union(x, y)))
            .when(op == "NOT", push(F.array_except(x, y)))
            .when(op == "BESIDE", push(beside))
            .otherwise(F.concat(stack, F.array(F.try_element_at(sets, op))))
        )

    return F.coalesce(F.get(F.aggregate(program, none, step), F.lit(0)), empty)


def match(queries: DataFrame, index: Index, k: int, scratch) -> DataFrame:
    """(query, id, rank): rows that query strings of the whole grammar match, by id."""
    trees = scratch.put(parsed(queries))
    numbered = trees.select("query", "program", F.posexplode("leaves").alias("number", "leaf"))
    numbered = scratch.put(numbered.withColumn("number", F.col("number").cast("string")))
    # a leaf that many queries have is looked up once
    leaves = scratch.put(_tokenized(numbered.select("leaf").distinct()))
    words = leaves.select(F.explode(F.flatten(F.transform("phrases", lambda p: F.filter(p["words"], lambda w, i: ~p["prefix"] | (i < F.size(p["words"]) - 1))))).alias("token")).distinct()
    some_start = leaves.where(F.exists("phrases", lambda p: p["prefix"])).limit(1).count()
    postings = index.table("postings") if some_start else _blocks(index, words)
    blank = leaves.select("leaf", (F.size("phrases") == 0).alias("blank"))

    def one_round(left: DataFrame, ranges: list[int]) -> DataFrame:
        asked = numbered.join(left, "query", "left_semi").join(blank, "leaf")
        hits = asked.join(_leaf_hits(leaves.where(F.size("phrases") > 0), postings, ranges), "leaf").select("query", "program", "number", "range", "block", "ids")
        # leaves without a hit in the block are empty sets, those without a token are null
        blanks = asked.groupBy("query").agg(F.collect_list(F.when(~F.col("blank"), F.col("number"))).alias("told"))
        sets = hits.groupBy("query", "program", "range", "block").agg(F.map_from_entries(F.collect_list(F.struct("number", "ids"))).alias("found")).join(blanks, "query")
        full = F.map_from_arrays("told", F.transform("told", lambda n: F.coalesce(F.try_element_at("found", n), F.array().cast("array<bigint>"))))
        got = sets.select("query", _evaluated(F.col("program"), full).alias("ids"))
        return got.select("query", F.explode(F.slice(F.array_sort("ids"), 1, k)).alias("first"))

    return _ids(index, _in_rounds(index, trees.select("query"), k, scratch, one_round), k)
