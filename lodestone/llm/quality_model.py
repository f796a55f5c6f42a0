"""Quality classifier: perplexity under interpolated modified Kneser-Ney models of trusted text.

A model predicts the characters of a word, and its end, from the characters
before. Documents fall into two folds by their text, so that equal texts share
one, and each fold has a model of the other fold's trusted documents: whatever
is scored, trusted or not, is scored by a model that has not seen it. Models are
trained on all trusted documents: their n-grams are counted in each task, then
over all tasks, and every order gets continuation counts, discounts, context totals and
interpolated probabilities by joins that are sharded on the n-gram. A document's
perplexity is over the characters of all its words. What is judged is that
perplexity with PRIOR more characters at the mean of the document's language, so
that a handful of words says little, and a document is kept if it is no higher
than the QUANTILE of the same figure over all trusted documents of its language.
That is the rule at every size. A language without trusted documents is held
against the quantile over all languages together.

Models of up to BROADCAST_GRAMS n-grams together, counted first, go to the tasks
whole, as arrays; larger ones stay in their tables, which the n-grams of the
distinct words are joined with, and the words' sums with the documents. A task
works on so many characters of text at a time, however many rows it is given.
`training_ids` picks a sample of trusted documents for those who want models of
one; the classifier does not.

Edge cases: a text that is null or has no words has no perplexity and is not
kept; a text of any length is scored word by word; a null lang counts as a
language of its own; without trusted text every document with words is kept, and
a model without any, as of one trusted document in all, gives all texts the same
score; repeated rows are judged each, and a label holds for all rows of its
doc_id; a document right at the limit is kept; an empty table gives an empty
table; other columns pass through whatever their names, but for those of the
results, which take their place.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from lodestone.llm.common import Scratch, map_rows, record_batch, slices, texts
from lodestone.operators.ranking import top_k

ORDER = 5
#: Documents of a sample of trusted ones, by the hash of their id, and the folds that score each other.
SAMPLE, FOLDS = 4500, 2
#: Characters' worth of the language's mean that a document's score starts from.
PRIOR = 200
#: The quantile of trusted documents, in nats a character; scores are counted to so many digits.
QUANTILE, DIGITS = 0.995, 5
#: N-grams that the models may have together, with their histories, to be broadcast.
BROADCAST_GRAMS = 2_000_000
BEGIN, END = "\x02", "\x03"
#: More than any code point, and places that are scored at a time.
POINTS, PLACES = 0x110000, 1 << 18
#: Bits that say of an id whether it may be a trusted one.
BITS = 1 << 24


def count_grams(docs: DataFrame, order: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, gram, c): how often the n-grams of this order stand in the words of the texts, for each value of the whole-number columns by."""
    names = ", ".join(f"{c} int, " for c in by)

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            for part in slices(batch, most=4 << 20):
                words: dict[tuple, Counter[str]] = {}
                for *key, t in zip(*[part.column(c).to_pylist() for c in by], texts(part), strict=True):
                    words.setdefault(tuple(key), Counter()).update(t.split())
                for key, counted in words.items():
                    found: Counter[str] = Counter()
                    for w, n in counted.items():
                        s = BEGIN * (order - 1) + w + END
                        for i in range(len(s) - order + 1):
                            found[s[i : i + order]] += n
                    yield {c: [x] * len(found) for c, x in zip(by, key, strict=True)} | {"gram": list(found), "c": list(found.values())}

        return each

    return map_rows(docs.select(*by, "text"), make, f"{names}gram string, c long").groupBy(*by, "gram").agg(F.sum("c").alias("c"))


def _discounts(level: DataFrame) -> list[float]:
    """Chen and Goodman's three discounts; 0.5, 1 and 1.5 where counts of counts are missing."""
    row = level.agg(*[F.count_if(F.col("c") == i).alias(f"n{i}") for i in range(1, 5)]).head()
    n = [None, *row]
    if not all(n[1:]):
        return [0.5, 1.0, 1.5]
    y = n[1] / (n[1] + 2 * n[2])
    return [min(float(i), max(0.0, i - (i + 1) * y * n[i + 1] / n[i])) for i in (1, 2, 3)]


def train(trusted: DataFrame, scratch: Scratch, order: int = ORDER) -> DataFrame:
    """The model (gram, p, g) of the texts of trusted."""
    return estimate(scratch.put(count_grams(trusted, order)), scratch, order)


def estimate(level: DataFrame, scratch: Scratch, order: int = ORDER) -> DataFrame:
    """(gram, p, g) from counts (gram, c) of the highest order: the probability of the gram's last character after the others; g: the weight of lower orders after all of it."""
    levels = [level]
    for k in range(order - 1, 0, -1):
        shorter = F.substring("gram", 2, order)
        level = level.withColumn("gram", shorter).groupBy("gram").agg(F.when(F.col("gram").startswith(BEGIN), F.sum("c")).otherwise(F.count("*")).alias("c"))
        if k == 1:
            level = level.where(F.col("gram") != BEGIN)
        level = scratch.put(level)
        levels.append(level)
    symbols = levels[-1].count() + 1  # one for what was never seen
    lower, weights = None, []
    for k, level in zip(range(1, order + 1), levels[::-1]):
        d1, d2, d3 = _discounts(level)
        cut = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        counts = level.select("gram", F.substring("gram", 1, k - 1).alias("history"), F.col("c"), cut.alias("cut"))
        contexts = scratch.put(counts.groupBy("history").agg(F.sum("c").alias("total"), (F.sum(F.least(F.col("cut"), F.col("c").cast("double"))) / F.sum("c")).alias("g")))
        weights.append(contexts.select(F.col("history").alias("gram"), "g"))
        own = counts.join(contexts, "history").select("gram", (F.greatest(F.col("c") - F.col("cut"), F.lit(0.0)) / F.col("total")).alias("own"), "g")
        if lower is None:
            level_p = own.select("gram", (F.col("own") + F.col("g") / symbols).alias("p"))
        else:
            level_p = own.withColumn("shorter", F.substring("gram", 2, order)).join(lower.select(F.col("gram").alias("shorter"), F.col("p").alias("q")), "shorter").select("gram", (F.col("own") + F.col("g") * F.col("q")).alias("p"))
        level_p = scratch.put(level_p)
        lower = level_p
        weights[-1] = (weights[-1], level_p)
    table = None
    for g, p in weights:
        both = p.select("gram", "p", F.lit(None).cast("double").alias("g")).union(g.select("gram", F.lit(None).cast("double").alias("p"), "g"))
        table = both if table is None else table.union(both)
    return scratch.put(table.groupBy("gram").agg(F.max("p").alias("p"), F.max("g").alias("g")))


class Scorer:
    """Negative log probability and number of symbols of texts.

    N-grams are nodes of a tree, a sorted array of (parent, character) for each
    depth, so that a model takes some 25 bytes an n-gram, and the distinct words
    of some texts are looked up together: an n-gram of k characters that ends at
    a place is the child of the one of k - 1 that ends a place before.
    """

    def __init__(self, p: dict[str, float], g: dict[str, float], order: int):
        grams = list(p.keys() | g.keys())
        self._build(grams, np.array([p.get(x, math.nan) for x in grams]), np.array([g.get(x, math.nan) for x in grams]), order)

    @classmethod
    def of(cls, rows: pa.Table, order: int) -> Scorer:
        """From a model's rows (gram, p, g)."""
        made = cls.__new__(cls)
        logs = (np.log(rows.column(c).to_numpy()) for c in ("p", "g"))
        with np.errstate(divide="ignore"):
            # a share of nothing counts as none
            p, g = (np.where(np.isinf(x), math.nan, x) for x in logs)
        made._build(rows.column("gram").to_pylist(), p, g, order)
        return made

    def _build(self, grams: list[str], p: np.ndarray, g: np.ndarray, order: int) -> None:
        self.order, self.keys, self.p, self.g = order, [], [], []
        size = np.array([len(x) for x in grams], dtype=np.int64)
        codes = np.array(grams, dtype=f"U{order}").view(np.uint32).reshape(len(grams), order)
        node = np.zeros(len(grams), dtype=np.int64)
        for k in range(1, order + 1):
            at = np.flatnonzero(size >= k)
            keys, node[at] = np.unique(node[at] * POINTS + codes[at, k - 1], return_inverse=True)
            own = at[size[at] == k]
            of_node = np.full((2, len(keys)), math.nan)
            of_node[:, node[own]] = p[own], g[own]
            self.keys.append(keys)
            self.p.append(of_node[0])
            self.g.append(np.nan_to_num(of_node[1]))
        # logs; the empty history's weight times the uniform share is the floor
        self.floor = float(np.nan_to_num(g[size == 0]).sum()) - math.log(np.count_nonzero((size == 1) & ~np.isnan(p)) + 1)

    def _places(self, codes: np.ndarray) -> np.ndarray:
        """For each place but the first order - 1, the negative log probability of what stands there."""
        n = self.order - 1
        nodes = []
        for keys in self.keys:
            parent = np.concatenate([[-1], nodes[-1][:-1]]) if nodes else np.zeros(len(codes), dtype=np.int64)
            at = np.flatnonzero(parent >= 0)
            asked = parent[at] * POINTS + codes[at]
            node = np.full(len(codes), -1, dtype=np.int64)
            if len(keys):
                found = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                node[at] = np.where(keys[found] == asked, found, -1)
            nodes.append(node)
        total, left = np.zeros(len(codes) - n), np.arange(len(codes) - n)
        for k in range(n, -1, -1):
            node = nodes[k][left + n]
            p = np.where(node >= 0, self.p[k][node], math.nan) if len(self.p[k]) else np.full(len(node), math.nan)
            known = ~np.isnan(p)
            total[left[known]] -= p[known]
            left = left[~known]
            if k and len(self.g[k - 1]):
                node = nodes[k - 1][left + n - 1]
                total[left] -= np.where(node >= 0, self.g[k - 1][node], 0.0)
        total[left] -= self.floor
        return total

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        n = self.order - 1
        codes = np.frombuffer("".join(f"{BEGIN * n}{w}{END}" for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        symbols = np.array([len(w) + 1 for w in words], dtype=np.int64)
        word = np.repeat(np.arange(len(words)), symbols + n)
        # places that start a word are not scored
        first = np.repeat(np.cumsum(symbols + n) - symbols - n, symbols + n)
        total = np.zeros(len(words))
        for a in range(0, len(codes) - n, PLACES):
            places = np.arange(a + n, min(a + n + PLACES, len(codes)))
            scored = places - first[places] >= n
            total += np.bincount(word[places], np.where(scored, self._places(codes[a : places[-1] + 1]), 0.0), len(words))
        return total, symbols

    def texts(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """nll and symbols of each text."""
        number: dict[str, int] = defaultdict(count().__next__)
        ids, sizes = array("q"), []
        for t in some:
            found = t.split()
            ids.extend(map(number.__getitem__, found))
            sizes.append(len(found))
        of_text, ids = np.repeat(np.arange(len(some)), sizes), np.frombuffer(ids, dtype=np.int64)
        if not len(ids):
            return np.zeros(len(some)), np.zeros(len(some), dtype=np.int64)
        nll, symbols = self.words(list(number))
        return np.bincount(of_text, nll[ids], len(some)), np.bincount(of_text, symbols[ids], len(some)).astype(np.int64)


def _with(kept: list[StructField]) -> StructType:
    return StructType([*kept, StructField("nll", DoubleType()), StructField("symbols", LongType())])


def _lookup(docs: DataFrame, known: list[Broadcast], fold: str | None, text: str, kept: list[StructField]) -> DataFrame:
    """The columns kept of docs, nll and symbols, by the broadcast scorer of each row's fold, or by the only one."""
    schema = _with(kept)
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, 6 << 20):
                some = texts(part, text)
                folds = part.column(fold).to_numpy() if fold else np.zeros(len(some), dtype=np.int64)
                nll, symbols = np.zeros(len(some)), np.zeros(len(some), dtype=np.int64)
                for f in np.unique(folds).tolist():
                    at = np.flatnonzero(folds == f)
                    nll[at], symbols[at] = known[f].value.texts([some[i] for i in at.tolist()])
                yield record_batch({f.name: part.column(f.name) for f in kept} | {"nll": nll, "symbols": symbols}, kinds)

    return docs.mapInArrow(run, schema)


class Model:
    def __init__(self, counts: DataFrame, order: int = ORDER, broadcast_grams: int = BROADCAST_GRAMS):
        """counts: (gram, c) of the documents known to be good, as `count_grams` gives them."""
        self.spark, self.order = counts.sparkSession, order
        self.scratch = Scratch(self.spark, "quality")
        self.table = estimate(counts, self.scratch, order)
        self.known = None
        if self.table.count() <= broadcast_grams:
            self.known = self.spark.sparkContext.broadcast(Scorer.of(self.table.toArrow(), order))  # of a checked size

    def score(self, docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
        """docs, with or without the text, and nll, in nats, and symbols."""
        kept = [f for f in docs.schema if keep_text or f.name != text]
        return self._by_joins(docs, text, kept) if self.known is None else _lookup(docs, [self.known], None, text, kept)

    def _by_joins(self, docs: DataFrame, text: str, kept: list[StructField]) -> DataFrame:
        """The same sums from joins on n-grams and on words; each distinct word is scored once."""
        order = self.order
        rows = self.scratch.put(docs.withColumn("row", F.monotonically_increasing_id()))

        def per_document():
            def each(batch: pa.RecordBatch) -> Iterator[dict]:
                for row, t in zip(batch.column("row").to_pylist(), texts(batch), strict=True):
                    found = Counter(t.split())
                    yield {"row": [row] * len(found), "word": list(found), "n": list(found.values())}

            return each

        def lookups():
            def each(batch: pa.RecordBatch) -> Iterator[dict]:
                for w in batch.column("word").to_pylist():
                    s = BEGIN * (order - 1) + w + END
                    ways = [(i, k, s[i - k : i + 1], s[i - k : i]) for i in range(order - 1, len(s)) for k in range(order)]
                    yield {"word": [w] * len(ways)} | {c: [x[j] for x in ways] for j, c in enumerate(("i", "k", "gram", "history"))}

            return each

        words = self.scratch.put(map_rows(rows.select("row", F.col(text).alias("text")), per_document, "row long, word string, n long"))
        asked = map_rows(words.select("word").distinct(), lookups, "word string, i int, k int, gram string, history string")
        p = self.table.where("p IS NOT NULL").select("gram", F.log("p").alias("p"))
        g = self.table.where("g IS NOT NULL").select(F.col("gram").alias("history"), F.log("g").alias("g"))
        met = asked.join(p, "gram", "left").join(g, "history", "left")
        known = F.col("p").isNotNull()
        of_place = met.groupBy("word", "i").agg(
            F.max(F.when(known, F.col("k"))).alias("longest"), F.max_by("p", F.when(known, F.col("k"))).alias("p"), F.collect_list(F.struct("k", F.coalesce("g", F.lit(0.0)).alias("g"))).alias("back")
        )
        # the empty history's weight counts for what no order knows alone, beside the uniform share
        share = math.log(p.where(F.length("gram") == 1).count() + 1)
        backed = F.aggregate(F.filter("back", lambda b: b["k"] > F.coalesce("longest", F.lit(-1))), F.lit(0.0), lambda total, b: total + b["g"])
        of_word = self.scratch.put(of_place.select("word", (-backed - F.coalesce("p", F.lit(-share))).alias("nll")).groupBy("word").agg(F.sum("nll").alias("nll")))
        sums = words.join(of_word, "word").groupBy("row").agg(F.sum(F.col("n") * F.col("nll")).alias("nll"), F.sum(F.col("n") * (F.length("word") + 1)).cast("long").alias("symbols"))
        both = rows.join(sums, "row", "left")
        return both.select(*[f.name for f in kept], F.coalesce("nll", F.lit(0.0)).alias("nll"), F.coalesce("symbols", F.lit(0).cast("long")).alias("symbols"))


def fold_of(text: str):
    """A document's fold; equal texts share one."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(FOLDS)).cast("int")


def score_folds(models: list[Model], docs: DataFrame, fold: str, text: str, keep_text: bool) -> DataFrame:
    """docs without their fold, scored each by the model of its fold."""
    if any(m.known is None for m in models):
        parts = [m.score(docs.where(F.col(fold) == i).drop(fold), text, keep_text) for i, m in enumerate(models)]
        return reduce(DataFrame.unionByName, parts)
    kept = [f for f in docs.schema if (keep_text or f.name != text) and f.name != fold]
    return _lookup(docs, [m.known for m in models], fold, text, kept)


def limits(scored: DataFrame) -> DataFrame:
    """lang, mean and limit from rows (lang, nll, symbols); one more row, marked other, holds for all other languages."""
    mean = F.sum("nll") / F.sum("symbols")
    means = scored.groupBy("lang").agg(mean.alias("mean"))
    overall = scored.agg(mean.alias("mean"), F.count("*").alias("n")).where("n > 0").withColumn("lang", F.lit(None).cast("string"))

    def limit(rows: DataFrame, keys: list[str]) -> DataFrame:
        score = (F.col("nll") + PRIOR * F.col("mean")) / (F.col("symbols") + PRIOR)
        # equal scores are counted before the quantile, so that its memory does not grow with the rows; rounded up, none of them is above its own
        counted = rows.groupBy(*keys, "mean", F.ceil(score, F.lit(DIGITS)).cast("double").alias("score")).agg(F.count("*").alias("n"))
        return counted.groupBy(*keys, "mean").agg(F.percentile("score", F.lit(QUANTILE), F.col("n")).alias("limit"))

    own = limit(scored.join(means.withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l"))).drop("l"), ["lang"]).withColumn("other", F.lit(False))
    # one row beside all
    rest = limit(scored.drop("lang").crossJoin(F.broadcast(overall.drop("n"))), ["lang"]).withColumn("other", F.lit(True))
    return own.unionByName(rest)


def judge(scored: DataFrame, limits: DataFrame, lang: str = "lang") -> DataFrame:
    """Scored rows, without nll and symbols, with perplexity, score, limit and kept."""
    # a row for each language with a limit of its own, and one for all others
    own = F.broadcast(limits.where("NOT other").select(F.col("lang").alias("l_"), F.col("mean").alias("own_mean"), F.col("limit").alias("own_limit")))
    rest = limits.where("other").select("mean", "limit").head()
    joined = scored.join(own, F.col(lang).eqNullSafe(F.col("l_")), "left")
    mean = F.coalesce("own_mean", F.lit(float(rest["mean"]) if rest else 0.0))
    limit = F.coalesce("own_limit", F.lit(float(rest["limit"]) if rest else math.inf))
    words = F.col("symbols") > 0
    return (
        joined.withColumn("perplexity", F.when(words, F.exp(F.col("nll") / F.col("symbols"))))
        .withColumn("score", F.when(words, (F.col("nll") + PRIOR * mean) / (F.col("symbols") + PRIOR)))
        .withColumn("limit", limit)
        .withColumn("kept", words & (F.col("score") <= F.col("limit")))
        .drop("l_", "own_mean", "own_limit", "nll", "symbols")
    )


def training_ids(trusted: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id of `sample` of the trusted rows (doc_id, lang) at most, by hash: the same number for each language, or all there are."""
    open_ = trusted.select("doc_id", "lang").distinct()
    # how many languages have how many documents; more than `sample` of them need no quota above one
    sizes = [min(r["n"], sample) for r in open_.groupBy("lang").agg(F.count("*").alias("n")).orderBy("n").limit(sample).collect()]
    left, quota = sample, 1
    for k, n in enumerate(sizes):
        quota = max(1, left // (len(sizes) - k))
        if n >= quota:
            break
        left -= n
    some = top_k(open_, ["lang"], [F.xxhash64("doc_id"), F.col("doc_id")], quota)
    return some.orderBy("rank", F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id").distinct()


def of_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is one of ids (doc_id).

    A table of BITS bits, one size whatever the input, is broadcast first, so
    that few texts of others are shuffled for the exact join. That is an inner
    one: Spark moves a semi join below the table, and then shuffles all texts.
    """
    bit, of_bit = F.pmod(F.xxhash64("doc_id"), F.lit(BITS)), lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (c % 64).cast("int"))
    table = ids.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("bits_")).agg(F.bit_or(of_bit(F.col("bit"))).alias("set_"))
    near = docs.withColumn("bits_", F.shiftright(bit, 6)).join(F.broadcast(table), "bits_").where(F.col("set_").bitwiseAND(of_bit(bit)) != 0)
    return near.drop("bits_", "set_").join(ids.select("doc_id").distinct(), "doc_id")


#: What `judge_documents` adds to a document.
RESULTS = ("perplexity", "score", "limit", "kept")


def judge_documents(docs: DataFrame, labels: DataFrame, columns: list[str] | None = None, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """The columns of docs, all by default, with perplexity, score, limit and kept; trusted is what labels call good and not toxic."""
    columns = [c for c in columns or docs.columns if c not in RESULTS]
    # the caller's columns go by numbers meanwhile, so that no name of theirs meets one of the work
    named = {c: f"c{i}" for i, c in enumerate(dict.fromkeys([*columns, "doc_id", "lang", "text"]))}
    doc_id, lang, text = (named[c] for c in ("doc_id", "lang", "text"))
    held = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in named.items()])
    scratch = Scratch(docs.sparkSession, "judged")
    good = scratch.put(labels.where("quality = 1 AND toxic = 0").select("doc_id").distinct())
    training = of_ids(docs.select("doc_id", "text", fold_of("text").alias("fold")), good)
    counts = scratch.put(count_grams(training, ORDER, ("fold",)))
    models = [Model(counts.where(F.col("fold") != i).groupBy("gram").agg(F.sum("c").alias("c")), broadcast_grams=broadcast_grams // FOLDS) for i in range(FOLDS)]
    scored = scratch.put(score_folds(models, held.withColumn("fold", fold_of(text)), "fold", text, "text" in columns))
    trusted = scored.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), "nll", "symbols").where("symbols > 0").join(good, "doc_id", "left_semi")
    judged = judge(scored, scratch.put(limits(scratch.put(trusted.select("lang", "nll", "symbols")))), lang)
    return judged.select(*[F.col(named[c]).alias(c) for c in columns], *RESULTS)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return judge_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ["doc_id", "lang"]).select("doc_id", "lang", "perplexity", "limit", "kept")
