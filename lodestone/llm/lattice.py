"""LM scoring by subword lattices: a text's probability, summed over all ways to cut its words into pieces.

The pieces come from an existing vocabulary, whose scores give the order of
their first weights; how often its own tokenizer uses each piece, over all
training words and their counts, turns them into the probabilities of a unigram
vocabulary. A word's probability is the marginal over its lattice, by forward
recursion in log space, and a text's the product over its words and one end.

Words are counted over all training documents, combined in tasks and before
the shuffle, and each distinct word's lattice is summed once. Counts and sums
go to the texts in two ways. The HEAD words of most training tokens are
broadcast, which bounds that side by its number of rows; the words below, each
rare, are joined through a shuffle, with one row for each document and word.
The results are exact either way.

Edge cases: null text has no words but still an end; a null doc_id is never
held out; a text of any length is counted word by word, and a word's lattice
takes time and memory in proportion to its length; rows that share a doc_id are
scored each, and all of them are training rows or none; repeated rows are counted and scored each; without training documents
all counts are zero and the model keeps its first weights; an empty table gives
an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, map_rows

#: Words whose counts are broadcast at most.
HEAD = 250_000
#: Weight of the vocabulary's own order against the counts, in tokens.
PRIOR = 1000.0
HELD_OUT = (7, 2)
#: Words that the tokenizer cuts at a time.
ROWS = 20_000
SPACE = "▁"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
LOG10 = math.log(10)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(HELD_OUT[0])) == HELD_OUT[1], F.lit(False))


def read_vocabulary(model) -> tuple[dict[str, int], list[int], np.ndarray]:
    """Pieces by text, the ids of the 256 single bytes, and first weights that fall with a piece's place in the scores' order."""
    n = model.get_piece_size()
    pieces, single, weights = {}, [0] * 256, np.zeros(n + 1)
    order = np.argsort(np.argsort([-model.get_score(i) for i in range(n)], kind="stable"), kind="stable")
    for i in range(n):
        if model.is_byte(i):
            single[int(model.id_to_piece(i)[1:-1], 16)] = i
            weights[i] = 1.0 / (n + 256)
        elif not (model.is_control(i) or model.is_unknown(i)):
            pieces[model.id_to_piece(i)] = i
            weights[i] = 1.0 / (order[i] + 10)
    weights[n] = 0.1  # the end of a text
    return pieces, single, weights / weights.sum()


def load_model(source: str | bytes):
    """A vocabulary's tokenizer from its file or from the file's bytes."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(**{"model_file" if isinstance(source, str) else "model_proto": source})


class Lattice:
    """Log probabilities of words, given those of the pieces."""

    def __init__(self, pieces: dict[str, int], single: list[int], p: np.ndarray):
        self.pieces, self.single = pieces, single
        self.log = np.log(np.maximum(p, 1e-300)).tolist()
        # the log of each piece; none for what only starts one
        self.steps: dict[str, float | None] = {}
        for w, i in pieces.items():
            for k in range(1, len(w)):
                self.steps.setdefault(w[:k], None)
            self.steps[w] = self.log[i]

    def arcs(self, s: str) -> list[list[tuple[int, float]]]:
        """For each place the starts of the pieces that end there, with their logs; a character that is no piece falls to its bytes."""
        get, n = self.steps.get, len(s)
        out: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for i in range(n):
            for j in range(i + 1, n + 1):
                x = get(s[i:j], 0.0)
                if x == 0.0:  # no piece goes on like this
                    break
                if x is not None:
                    out[j - 1].append((i, x))
            if get(s[i]) is None:
                out[i].append((i, sum(self.log[self.single[b]] for b in s[i].encode("utf-8", "surrogatepass"))))
        return out

    @staticmethod
    def forward(arcs: list[list[tuple[int, float]]]) -> list[float]:
        """log of the summed probability of all paths to each place."""
        a, exp, log = [0.0], math.exp, math.log
        for here in arcs:
            terms = [a[i] + x for i, x in here]
            top = max(terms)
            a.append(top if len(terms) == 1 else top + log(sum([exp(t - top) for t in terms])))
        return a

    def word(self, word: bytes) -> float:
        return self.forward(self.arcs(SPACE + word.decode("utf-8", "replace")))[-1]


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over docs."""

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            found: Counter[bytes] = Counter()
            for t in batch.column("text").to_pylist():
                found.update(words_of(t or ""))
            yield {"word": list(found), "c": list(found.values())}

        return each

    return map_rows(docs.select("text"), make, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def fit_pieces(counts: DataFrame, ends: int, model, first: np.ndarray) -> np.ndarray:
    """Probabilities of all pieces and the end, from the tokenizer's cuts of all training words and PRIOR first weights."""
    shared = counts.sparkSession.sparkContext.broadcast(model.serialized_model_proto())

    def make():
        cut = load_model(shared.value)

        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            words, c = batch.column("word").to_pylist(), batch.column("c").to_numpy()
            found = cut.encode([w.decode("utf-8", "replace") for w in words], num_threads=1)
            of = np.repeat(c, [len(x) for x in found])
            used = np.bincount(np.fromiter(chain.from_iterable(found), np.int64, len(of)), of) if len(of) else np.zeros(0)
            at = np.flatnonzero(used)
            yield {"piece": at, "n": used[at]}

        return each

    # a row for each piece of the vocabulary at most; whole numbers, so that their order plays no part
    used = map_rows(counts, make, "piece int, n double", ROWS).groupBy("piece").agg(F.sum("n").alias("n")).collect()
    p = PRIOR * first
    for r in used:
        if first[r["piece"]]:
            p[r["piece"]] += r["n"]
    p[-1] += ends
    return p / p.sum()


def weigh(counts: DataFrame, model: tuple) -> DataFrame:
    """(word, c, log10): each word's probability over all its segmentations."""
    shared = counts.sparkSession.sparkContext.broadcast(model)

    def make():
        lattice = Lattice(*shared.value)

        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            yield {"word": batch.column("word"), "c": batch.column("c"), "log10": [lattice.word(w) / LOG10 for w in batch.column("word").to_pylist()]}

        return each

    return map_rows(counts.select("word", "c"), make, "word binary, c long, log10 double")


def head_limit(counts: DataFrame, head: int) -> int:
    """The least count that keeps the words with it or more within `head`."""
    # counts of counts by powers of 2^(1/4): some two hundred rows at most
    level = F.floor(4 * F.log2("c"))
    levels = sorted(((r["level"], r["n"], r["least"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect()), reverse=True)
    total, limit = 0, (levels[0][2] if levels else 1) * 2 + 1
    for _, n, least in levels:
        total += n
        if total > head:
            break
        limit = least
    return limit


def score(docs: DataFrame, vocabulary_path: str, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lattice")
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))
    training = some.where("NOT held_out")
    counts = scratch.put(count_words(training))
    ends = training.select("doc_id").count()
    words, distinct = counts.agg(F.sum("c"), F.count("*")).head()
    n, v = (words or 0) + ends, distinct + (ends > 0)
    share = math.log10(n + v + 1)

    cut = load_model(vocabulary_path)
    vocabulary = read_vocabulary(cut)
    p = fit_pieces(counts, ends, cut, vocabulary[2])
    # words of held-out texts alone have no count, but a lattice
    unseen = count_words(some.where("held_out")).join(counts, "word", "left_anti").select("word", F.lit(0).cast("long").alias("c"))
    weighed = scratch.put(weigh(counts, (*vocabulary[:2], p)).union(weigh(unseen, (*vocabulary[:2], p))))
    limit = head_limit(counts, head)
    # `head` rows at most, whatever the corpus
    top = weighed.where(F.col("c") >= limit).toArrow()
    known = dict(zip(top.column("word").to_pylist(), zip((math.log10(c + 1) for c in top.column("c").to_pylist()), top.column("log10").to_pylist(), strict=True), strict=True))
    shared = spark.sparkContext.broadcast(known)
    of_ends = math.log10(ends + 1), math.log10(p[-1])

    def make():
        get = shared.value.get

        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            out: dict[str, list] = {c: [] for c in ("doc_id", "held_out", "n_tokens", "known", "base", "score", "rare")}
            for doc, held, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held_out", "text")), strict=True):
                tokens = words_of(text or "")
                (base, total), n_known, rare = of_ends, int(ends > 0), []
                for w, k in Counter(tokens).items():
                    x = get(w)
                    if x is None:
                        rare.append({"word": w, "n": k})
                    else:
                        base += k * x[0]
                        total += k * x[1]
                        n_known += k
                for c, value in zip(out, (doc, held, len(tokens) + 1, n_known, base, total, rare), strict=True):
                    out[c].append(value)
            yield out

        return each

    schema = "doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare array<struct<word:binary,n:long>>"
    scored = scratch.put(map_rows(some, make, schema).withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.n")
    sums = rare.join(weighed.where(F.col("c") < limit), "word").groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"), F.sum(F.col("n") * F.col("log10")).alias("more_score"))
    return scored.drop("rare").join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * share).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary())
