"""The classifier's perplexities and limits against a plain model in Python, by lookup and by joins, and names that clash."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import quality_model
from lodestone.llm.quality_model import BEGIN, END


def plain_model(texts, order):
    """Probability of a character after others, by the textbook."""
    counts = [None] * (order + 1)
    counts[order] = Counter(g for t in texts for w in t.split() for s in [BEGIN * (order - 1) + w + END] for g in (s[i : i + order] for i in range(len(s) - order + 1)))
    for k in range(order - 1, 0, -1):
        now = Counter()
        for g, c in counts[k + 1].items():
            # what starts a word has no characters before it to be counted
            now[g[1:]] += c if g[1:].startswith(BEGIN) else 1
        counts[k] = Counter({g: c for g, c in now.items() if not (k == 1 and g == BEGIN)})
    cuts, followers = [None] * (order + 1), [None] * (order + 1)
    for k in range(1, order + 1):
        n = Counter(counts[k].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        cuts[k] = [min(i, max(0.0, i - (i + 1) * y * n[i + 1] / n[i])) for i in (1, 2, 3)] if all(n[i] for i in (1, 2, 3, 4)) else [0.5, 1.0, 1.5]
        followers[k] = defaultdict(list)
        for g, c in counts[k].items():
            followers[k][g[:-1]].append(c)
    symbols = len(counts[1]) + 1

    def p(history, c, k):
        if k == 0:
            return 1 / symbols
        h = history[len(history) - k + 1 :]
        if not (all_ := followers[k].get(h)):
            return p(history, c, k - 1)
        cut = lambda n: cuts[k][min(n, 3) - 1]
        n = counts[k][h + c]
        left = sum(min(cut(x), x) for x in all_) / sum(all_)
        return max(n - cut(n), 0) / sum(all_) + left * p(history, c, k - 1) if n else left * p(history, c, k - 1)

    return lambda w: -sum(math.log(p(s[i - order + 1 : i], s[i], order)) for s in [BEGIN * (order - 1) + w + END] for i in range(order - 1, len(s)))


def rows_of(rng):
    say = lambda letters, n: " ".join("".join(rng.choices(letters, k=rng.randint(1, 5))) for _ in range(n))
    rows = [(i, say("abcdé", rng.randint(1, 40)), "x" if i % 3 else None) for i in range(120)]
    return [*rows, (200, say("zyx", 30), "x"), (201, None, "x"), (202, " \n", "y"), (203, say("abc", 30), "y"), (204, "a" * 3000, "x"), (205, "long " * 20_000, "x"), rows[5], rows[5]]


@pytest.mark.parametrize("bound", [10**6, 0])
def test_perplexity_and_limits(spark, bound):
    rows = rows_of(random.Random(4))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(110)] + [(110, 1, 1), (111, 0, 0)], "doc_id long, quality int, toxic int")
    trained = {r["doc_id"] for r in quality_model.training_ids(docs.where("doc_id < 110").select("doc_id", "lang")).collect()}
    assert trained == set(range(110))
    folds = [r["fold"] for r in docs.coalesce(1).select(quality_model.fold_of("text").alias("fold")).collect()]
    # a fold is scored by the model of the other's trusted documents
    nll = [plain_model([t for (d, t, _), f in zip(rows, folds) if d in trained and f != i], quality_model.ORDER) for i in range(2)]
    assert 40 <= sum(folds[:110]) <= 70
    sums = [(sum(map(nll[f], (t or "").split())), sum(len(w) + 1 for w in (t or "").split())) for (_, t, _), f in zip(rows, folds)]
    held = [(lang, *x) for (d, _, lang), x in zip(rows, sums) if d < 110]
    limit = {}
    for lang in ("x", None, "all"):
        some = [x[1:] for x in held if lang in ("all", x[0])]
        mean = sum(a for a, _ in some) / sum(n for _, n in some)
        limit[lang] = mean, np.quantile([(a + quality_model.PRIOR * mean) / (n + quality_model.PRIOR) for a, n in some], quality_model.QUANTILE)
    expected = Counter()
    for (d, _, lang), (a, n) in zip(rows, sums):
        mean, most = limit.get(lang, limit["all"])
        expected[d, n and round(math.exp(a / n), 6), n > 0 and (a + quality_model.PRIOR * mean) / (n + quality_model.PRIOR) <= most + 1e-5] += 1
    got = quality_model.judge_documents(docs, labels, broadcast_grams=bound).collect()
    assert Counter((r["doc_id"], r["perplexity"] and round(r["perplexity"], 6) or 0, r["kept"]) for r in got) == expected
    assert {r["lang"]: r["limit"] for r in got}["x"] == pytest.approx(limit["x"][1], abs=2e-5)
    assert {r["lang"]: r["limit"] for r in got}["y"] == pytest.approx(limit["all"][1], abs=2e-5)


@pytest.mark.parametrize("n", [30, 150, 5000])
def test_clean_documents_stay_at_every_size(spark, n):
    """Of trusted and of other clean documents next to none go, and junk goes, however few are trusted."""
    rng = random.Random(n)
    syllables = ["ba", "ne", "tion", "er", "li", "so"]
    say = lambda: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(100))
    rows = [(i, say(), "en") for i in range(n + n // 2)] + [(10**6 + i, " ".join("".join(rng.choices("qxzjkvw#", k=6)) for _ in range(100)), "en") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(n)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in quality_model.judge_documents(docs, labels, ["doc_id"]).where("kept").collect()}
    assert not any(i >= 10**6 for i in kept)
    assert n - sum(i < n for i in kept) <= 1 + 0.005 * n
    # of the others those beyond the highest of n like them: one in n + 1 on average
    assert n // 2 - sum(n <= i < 10**6 for i in kept) <= 4 + 0.01 * n


def test_names_that_clash(spark):
    rows = rows_of(random.Random(4))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(110)], "doc_id long, quality int, toxic int")
    more = docs.select("*", *[F.lit("mine").alias(c) for c in ("nll", "symbols", "kept", "score", "limit", "perplexity", "l_", "own_mean", "row", "c0", "word", "rank", "a.b")])
    plain, clashing = (quality_model.judge_documents(d, labels) for d in (docs, more))
    as_rows = lambda df: Counter((r["doc_id"], r["perplexity"], r["limit"], r["kept"]) for r in df.collect())
    assert as_rows(plain) == as_rows(clashing)
    assert {c for c in clashing.columns if c not in plain.columns} == {"nll", "symbols", "l_", "own_mean", "row", "c0", "word", "rank", "a.b"}
    assert clashing.select("nll", "c0", "`a.b`").distinct().collect() == [("mine",) * 3]


@pytest.mark.parametrize("bound", [10**6, 0])
def test_all_trusted_documents_count(spark, monkeypatch, bound):
    """A sample's size has no effect: counts are of every trusted document."""
    monkeypatch.setattr(quality_model, "SAMPLE", 10)
    monkeypatch.setattr(quality_model.training_ids, "__defaults__", (10,))
    rng = random.Random(6)
    rows = [(i, " ".join("".join(rng.choices("abcdé\U0001f600", k=rng.randint(1, 7))) for _ in range(rng.randint(1, 40))), "x") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    folds = [r["fold"] for r in docs.coalesce(1).select(quality_model.fold_of("text").alias("fold")).collect()]
    nll = [plain_model([t for (d, t, _), f in zip(rows, folds) if d < 100 and f != i], quality_model.ORDER) for i in range(2)]
    got = {r["doc_id"]: r["perplexity"] for r in quality_model.judge_documents(docs, labels, broadcast_grams=bound).collect()}
    for (d, t, _), f in zip(rows, folds):
        assert got[d] == pytest.approx(math.exp(sum(map(nll[f], t.split())) / sum(len(w) + 1 for w in t.split())), rel=1e-9)


def test_words_longer_than_what_is_scored_at_a_time(monkeypatch):
    p, g = {"a": -1.0, "b": -2.0, "ab": -0.5, "aab": -0.25, END: -3.0}, {"": -0.1, "a": -0.2, "ba": -0.4}
    scorer, some = quality_model.Scorer(p, g, 3), ["ab", "aabab?", "b" * 50 + "aab" * 7, "\x00a"]
    whole = scorer.words(some)[0].tolist()
    monkeypatch.setattr(quality_model, "PLACES", 5)
    assert scorer.words(some)[0].tolist() == pytest.approx(whole)
    # a by its own, b after it, and the end with the weight of a history that is known
    assert whole[0] == pytest.approx(1.0 + 0.5 + 3.0)
    assert scorer.texts(["", "ab ab", " "])[0].tolist() == pytest.approx([0, 2 * whole[0], 0])
