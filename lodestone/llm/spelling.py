"""Spelling variants: words one letter apart, found through their halves.

Words are maximal runs of Latin letters; a text's rare misreadings are made by
the rule of `read_run`. If two words differ by exactly one letter inserted,
deleted or replaced, one of the two halves of either is whole in the other: the
left half at its start or the right half at its end. Each shard builds an
Aho-Corasick automaton of the halves that are dealt to it by hash and scans the
words; a hit counts if its offset is that half's and the lengths allow one edit,
and what is left of both words is then compared. A word is sent to those
shards alone that can hold a half of a word near to it, four at most. Of a pair
found by both halves the right one's hit is left out, so that pairs are distinct.

A half that many words share keeps, in its shard, an index of what is left of
them with one letter out, so that the work of a scan goes with its hits. A half
of over SEGMENT_ROWS words is dealt in slices, to which its scans go in turn.

A word's form is its most frequent near word that is at least twice as frequent;
forms are followed to their end by doubling steps: counts double along the way,
so that there are at most six rounds.

Edge cases: null text has no words; a null doc_id reads as the empty text
in the rule; repeated rows count each time; very long texts are read whole, in
memory that grows with them; ties of forms go to the least word by code points;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, arrow_schema, record_batch, texts

#: Least length and occurrences of a word; every MISREAD-th hash loses a letter; times that a form is as frequent.
LEAST_LETTERS, LEAST_COUNT, MISREAD, TIMES = 5, 3, 97, 2
#: Words that a task sums; words whose halves a shard holds, on average; words of one half in a slice; words of a half that are looked through.
TABLE_ROWS, SHARD_WORDS, SEGMENT_ROWS, PLAIN = 1_000_000, 25_000, 50_000, 12
RUN = re.compile("[a-zÀ-ÿ]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def read_run(run: str, start: int) -> str:
    """The run, without one letter if MISREAD divides its hash; start is the crc32 of the document's part."""
    h = zlib.crc32(run.encode(), start)
    if h % MISREAD:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1 :]


def words_of(doc_id: int | None, text: str) -> Counter:
    """How often each word is in the text."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    lower = text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")
    out: Counter = Counter()
    for run, n in Counter(RUN.findall(lower)).items():
        out[read_run(run, start)] += n
    return out


def vocabulary(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough; a task sums its own before the shuffle."""
    schema = "word string, n long"
    kinds = arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[str, int] = {}
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                for word, n in words_of(doc_id, text).items():
                    if len(word) >= least_letters:
                        table[word] = table.get(word, 0) + n
                if len(table) > TABLE_ROWS:
                    yield record_batch({"word": list(table), "n": list(table.values())}, kinds)
                    table = {}
        yield record_batch({"word": list(table), "n": list(table.values())}, kinds)

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one letter inserted, deleted or replaced makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return i < len(a) and a[i + 1 :] == b[i + 1 :]
    return len(b) == len(a) + 1 and a[i:] == b[i + 1 :]


def shorter(x: str) -> set[str]:
    return {x[:i] + x[i + 1 :] for i in range(len(x))}


class Side:
    """What is left of the words that have a half on this side, and their counts."""

    __slots__ = ("rests", "index")

    def __init__(self):
        self.rests: list[tuple[str, int]] = []
        self.index: dict[str, list[int]] | None = None

    def near(self, rest: str) -> Iterator[tuple[str, int]]:
        if len(self.rests) <= PLAIN:
            yield from (r for r in self.rests if one_edit(r[0], rest))
            return
        if self.index is None:
            self.index = {}
            for i, (r, _) in enumerate(self.rests):
                for key in {r, *shorter(r)}:
                    self.index.setdefault(key, []).append(i)
        for i in {i for key in {rest, *shorter(rest)} for i in self.index.get(key, ())}:
            if one_edit(self.rests[i][0], rest):
                yield self.rests[i]


class Automaton:
    """A shard's halves, each with the words it is the left or right half of."""

    def __init__(self, halves: Iterator[tuple[str, bool, str, int]]):
        self.found = ahocorasick.Automaton()
        held: dict[str, tuple[int, Side, Side]] = {}
        for half, right, word, n in halves:
            if (entry := held.get(half)) is None:
                entry = held[half] = (len(half), Side(), Side())
            entry[1 + right].rests.append((word[: -len(half)] if right else word[len(half) :], n))
        for half, entry in held.items():
            self.found.add_word(half, entry)
        self.any = bool(held)
        if self.any:
            self.found.make_automaton()

    def scan(self, word: str) -> Iterator[tuple[str, int]]:
        """(near word, its count) of the shard's words."""
        if not self.any:
            return
        size = len(word)
        for end, (n, left, right) in self.found.iter(word):
            # a word of 2n or 2n + 1 letters has a left half of n, one of 2n - 1 or 2n a right half of n
            if end + 1 == n and left.rests and 2 * n - 1 <= size <= 2 * n + 2:
                head = word[:n]
                for rest, count in left.near(word[n:]):
                    yield head + rest, count
            if end + 1 == size and right.rests and 2 * n - 2 <= size <= 2 * n + 1:
                tail = word[size - n :]
                for rest, count in right.near(word[: size - n]):
                    # with its left half at the start the word was found there
                    if not word.startswith(rest):
                        yield rest + tail, count


def _half(word, size, right: bool):
    """The left half, of size // 2 letters, or the rest, of a word of that size."""
    n = F.floor(size / 2)
    return F.substring(word, F.length(word) - (size - n) + 1, size - n) if right else F.substring(word, F.lit(1), n)


def near_words(words: DataFrame, scratch: Scratch, shard_words: int = SHARD_WORDS, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(word, near, n): every ordered pair of words (word, n) one edit apart, n being near's."""
    count = words.count()
    shards = max(1, -(-count // shard_words))
    w, size = F.col("word"), F.length("word")
    owners = words.select("word", "n", F.explode(F.array(*[F.struct(F.lit(r).alias("right"), _half(w, size, r).alias("half")) for r in (False, True)])).alias("x")).select("word", "n", "x.*")
    # halves of words that are one letter shorter, as long or longer, at their place in this word
    spots = F.array_distinct(F.array(*[_half(w, size + d, r) for d in (-1, 0, 1) for r in (False, True)]))
    scans = words.select("word", F.explode(spots).alias("half"))
    crowded = scratch.put(owners.groupBy("half").agg(F.ceil(F.count("*") / segment_rows).cast("int").alias("slices")).where("slices > 1"))
    zero = F.lit(0)
    if crowded.limit(1).count():
        owners = owners.join(crowded, "half", "left").withColumn("slice", F.pmod(F.xxhash64("word"), F.coalesce("slices", F.lit(1))).cast("int")).drop("slices")
        scans = scans.join(crowded, "half", "left").select("word", "half", F.explode(F.sequence(zero, F.coalesce("slices", F.lit(1)) - 1)).alias("slice"))
    else:
        owners, scans = owners.withColumn("slice", zero), scans.withColumn("slice", zero)
    shard = F.pmod(F.xxhash64("half", "slice"), F.lit(shards)).alias("shard")
    owned = owners.select(shard, zero.alias("kind"), "half", "right", "word", "n")
    asked = scans.select(shard, "word").distinct().select("shard", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("half"), F.lit(None).cast("boolean").alias("right"), "word", F.lit(None).cast("long").alias("n"))
    schema = "word string, near string, n long"
    kinds = arrow_schema(words.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, halves, automaton = None, [], None
        for batch in batches:
            out: list[tuple[str, str, int]] = []
            for at, kind, half, right, word, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "kind", "half", "right", "word", "n"))):
                if at != shard:
                    shard, halves, automaton = at, [], None
                if not kind:
                    halves.append((half, right, word, n))
                    continue
                if automaton is None:
                    automaton, halves = Automaton(halves), []
                out += [(word, near, k) for near, k in automaton.scan(word)]
            if out:
                yield record_batch(dict(zip(("word", "near", "n"), zip(*out))), kinds)

    return owned.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(run, schema)


def variants(docs: DataFrame, shard_words: int = SHARD_WORDS, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.put(vocabulary(docs))
    pairs = near_words(words, scratch, shard_words, segment_rows)
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("best"))
    best = best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    is_form = F.col("near_n") >= TIMES * F.col("n")
    told = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"))
    told = scratch.put(told)
    steps = told.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    steps, old = scratch.put(steps), [words]
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = scratch.put(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        old.append(steps)
        steps = after.select("word", "root")
        if not after.where("moved").limit(1).count():
            break
        scratch.paths[id(steps)] = scratch.paths[id(after)]
    out = scratch.put(told.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
    scratch.drop(*old, told)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
