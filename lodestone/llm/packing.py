"""Best-fit packing of tokenised documents, after Martello-Toth dominance reduction.

Tokenising and cutting run over all rows in Arrow tasks. What packing needs of
a piece is its length alone, and there are at most `capacity` lengths, so the
plan is made from the count of each length: at most 4096 numbers, however many
documents there are. Reduction fixes pairs that dominate every other set with
the same long piece; best-fit decreasing places the rest. Both work on counts,
so the plan is a bounded list of runs (length, ranks, first sequence, pieces a
sequence, offset), which tasks use to look up each piece. Pieces of one length
get ranks from salted windows: a length held by a third of all pieces is dealt
over many tasks.

Edge cases: null text is empty and packs as its end id alone; a very long text
is tokenised whole, in memory that grows with it alone, and cut into pieces;
repeated rows are packed each; ties in length are broken by doc_id, piece and checksum; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, map_rows, slices, texts

CAPACITY, END_ID = 4096, 1
#: Pieces of one length and salt that one task ranks, on average over all lengths.
SALT_ROWS = 5000

_TOKENIZERS: dict[str, WordTokenizer] = {}


class WordTokenizer:
    """Ids of a text, as little-endian 32-bit bytes, from caches of words and of pre-tokens.

    The vocabulary splits at white space and then into runs of letters, single
    digits and runs of other characters, and each such pre-token's ids are its
    own. A text of printable Latin-1 is taken apart here, lower-cased, and only
    unseen pre-tokens are encoded, many in one call. Of other texts each word
    is looked up, or encoded, whole; a text with a special token's opening or
    with separators that only Python splits at is encoded whole.
    """

    #: Entries of each cache before it starts afresh.
    CACHE = 700_000
    ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
    NOT_PLAIN = re.compile(r"[^\t-\r\x20-\x7e\x85\xa0-\xac\xae-\xff]")
    SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        """One for each Python worker, which keeps its caches from task to task."""
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = cls(path)
        return _TOKENIZERS[path]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if any(x in text for x in self.ODD):
            return self.whole(text)
        if self.NOT_PLAIN.search(text):
            return self.joined(text.split(), self.words, self.learn_words)
        return self.joined(self.SPLIT.findall(text.lower()), self.parts, self.learn_parts)

    def joined(self, units: list[str], cache: dict[str, bytes], learn) -> bytes:
        found = list(map(cache.get, units))
        if None in found:
            new = list({w for w, x in zip(units, found, strict=True) if x is None})
            if len(cache) + len(new) > self.CACHE:
                cache.clear()
                new = list(set(units))
            for i in range(0, len(new), 512):
                learn(new[i : i + 512])
            found = map(cache.__getitem__, units)
        return b"".join(found)

    def learn_words(self, words: list[str]) -> None:
        self.words |= {w: self.whole(w) for w in words}

    def learn_parts(self, parts: list[str]) -> None:
        found = self.tokenizer.encode(" ".join(parts), add_special_tokens=False)
        of = np.array(found.word_ids)
        starts = (4 * np.flatnonzero(np.diff(of, prepend=-1))).tolist()
        if len(starts) != len(parts):
            self.parts |= {p: self.whole(p) for p in parts}
            return
        ids = np.array(found.ids, dtype="<u4").tobytes()
        self.parts |= {p: ids[i:j] for p, i, j in zip(parts, starts, [*starts[1:], len(ids)], strict=True)}


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each document's pieces of at most `capacity` ids."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def make():
        tokenizer = WordTokenizer.of(tokenizer_path)

        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc, text in ((d, t) for part in slices(batch) for d, t in zip(part.column("doc_id").to_pylist(), texts(part), strict=True)):
                ids = tokenizer.encode(text) + end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    some = ids[at : at + 4 * capacity]
                    for k, v in zip(out, (doc, i, at // 4, len(some) // 4, zlib.crc32(some)), strict=True):
                        out[k].append(v)
            yield out

        return each

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Where the pieces of each length go: runs of ranks, as columns of whole numbers."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left, self.capacity = {k: v for k, v in counts.items() if v > 0}, capacity
        self.ranks, self.sequences, self.runs = dict.fromkeys(self.left, 0), 0, []
        self.sizes = sorted(self.left)
        self.reduce()
        self.fixed = self.sequences
        self.best_fit()

    def take(self, size: int, n: int, sequence: int, per: int, offset: int) -> None:
        """The next n pieces of a size go to sequences from `sequence` on, `per` to each, from `offset` on."""
        rank = self.ranks[size]
        self.runs.append((size, rank, n, sequence, per, offset))
        self.ranks[size] = rank + n
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def partner(self, size: int) -> int | None:
        """The largest size that fits beside one piece of `size`."""
        i = bisect_left(self.sizes, self.capacity - size + 1) - 1
        if i >= 0 and self.sizes[i] == size and self.left[size] < 2:
            i -= 1
        return self.sizes[i] if i >= 0 else None

    def smallest(self, n: int, but: int) -> list[int]:
        """The n smallest pieces other than one of size `but`."""
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(n - len(out), self.left[s] - (s == but))
            if len(out) >= n:
                break
        return out

    def best_pair(self, room: int, but: int) -> int:
        """The largest sum of two pieces, other than one of size `but`, that is no more than room."""
        best, lo, hi = 0, 0, bisect_left(self.sizes, room + 1) - 1
        free = lambda s: self.left[s] - (s == but)
        while lo <= hi:
            a, b = self.sizes[lo], self.sizes[hi]
            if not free(a) or (lo == hi and free(a) < 2):
                lo += 1
            elif not free(b) or a + b > room:
                hi -= 1
            else:
                best, lo = max(best, a + b), lo + 1
        return best

    def reduce(self) -> None:
        """Martello-Toth: from the longest piece down, fix it alone or with one partner where that set dominates.

        A set with the piece dominates all others if nothing else fits beside
        it, if the partner fills the sequence, if no two pieces fit, or if no
        three do and no two that do are together longer than the partner.
        """
        for size in self.sizes[::-1]:
            while size in self.left:
                room, partner = self.capacity - size, self.partner(size)
                if partner is None:
                    n = self.left[size]
                    if 2 * size <= self.capacity:
                        n = 1
                    self.take(size, n, self.sequences, 1, 0)
                    self.sequences += n
                    continue
                if partner != room:
                    least = self.smallest(3, size)
                    pairs = len(least) >= 2 and sum(least[:2]) <= room
                    triples = len(least) == 3 and sum(least) <= room
                    if triples or pairs and self.best_pair(room, size) > partner:
                        break
                if partner == size:
                    n = self.left[size] // 2
                    self.take(size, 2 * n, self.sequences, 2, 0)
                else:
                    n = min(self.left[size], self.left[partner])
                    self.take(size, n, self.sequences, 1, 0)
                    self.take(partner, n, self.sequences, 1, size)
                self.sequences += n

    def best_fit(self) -> None:
        """Best-fit decreasing over counts: sequences with the same room are kept as ranges and filled together."""
        rooms: list[int] = []
        ranges: dict[int, list[tuple[int, int]]] = {}

        def keep(room: int, first: int, n: int) -> None:
            if room and n:
                if room not in ranges:
                    ranges[room] = []
                    insort(rooms, room)
                ranges[room].append((first, n))

        def fill(size: int, room: int, first: int, n: int) -> None:
            """As many pieces as there are into n sequences, each filled before the next."""
            per, offset = room // size, self.capacity - room
            whole = min(n, self.left[size] // per)
            if whole:
                self.take(size, whole * per, first, per, offset)
                keep(room - per * size, first, whole)
            if whole < n and (rest := self.left.get(size, 0)):
                self.take(size, rest, first + whole, rest, offset)
                keep(room - rest * size, first + whole, 1)
                whole += 1
            keep(room, first + whole, n - whole)

        for size in self.sizes[::-1]:
            while size in self.left and (i := bisect_left(rooms, size)) < len(rooms):
                room = rooms.pop(i)
                for first, n in ranges.pop(room):
                    if size in self.left:
                        fill(size, room, first, n)
                    else:
                        keep(room, first, n)
            if size in self.left:
                n = -(-self.left[size] // (self.capacity // size))
                first, self.sequences = self.sequences, self.sequences + n
                fill(size, self.capacity, first, n)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, salt_rows: int = SALT_ROWS) -> DataFrame:
    """Each piece with its sequence_id and its offset there."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    pieces = scratch.put(tokenized_pieces(docs, tokenizer_path, capacity, end_id))
    # at most `capacity` rows come to the driver
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = np.array(sorted(Plan(counts, capacity).runs), dtype=np.int64).reshape(-1, 6)
    known = spark.sparkContext.broadcast(runs)
    salts = max(1, -(-sum(counts.values()) // salt_rows))

    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = (
        salted.groupBy("length", "salt")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    )
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("own", F.row_number().over(own)).join(before, ["length", "salt"]).withColumn("rank", F.col("own") - 1 + F.col("before"))

    def make():
        size, rank, n, sequence, per, offset = known.value.T

        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            length, place = (batch.column(c).to_numpy() for c in ("length", "rank"))
            # the run is the last of the length that starts at the rank or before
            i = np.searchsorted(size * (1 << 40) + rank, length * (1 << 40) + place, "right") - 1
            k = place - rank[i]
            out = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield out | {"sequence_id": sequence[i] + k // per[i], "offset": offset[i] + (k % per[i]) * length}

        return each

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return map_rows(ranked.select(*columns, "rank"), make, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
