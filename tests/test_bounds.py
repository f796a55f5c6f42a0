"""Bounds that keep pairs from being scored: never below the score, and few pairs left."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import similarity
from lodestone.operators import catalog, releases
from lodestone.sources.scratch import Scratch


def test_bounds_are_no_less_than_scores(spark):
    rng = random.Random(4)
    words = ["the", "blue", "train", "tr", "é", "日本", "a", "aa", "under", "trains", "", "x y", "q\x1cz", "𝔏"]
    pairs = [tuple(rng.choice([" ", "  ", "\t"]).join(rng.choice(words) for _ in range(rng.randint(0, 5))) for _ in range(2)) for _ in range(3000)]
    pairs += [(a, a[::-1]) for a, _ in pairs[:200]] + [("", ""), ("a", "")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity.ratio_bound(*map(similarity.letters, (F.col("a"), F.col("b")))).alias("r"), similarity.set_ratio_bound(*map(similarity.letters, (F.col("a"), F.col("b")))).alias("s")).collect()
    assert all(r["r"] >= similarity.ratio(r["a"], r["b"]) - 1e-9 for r in rows)
    assert all(r["s"] >= similarity.set_ratio(r["a"], r["b"]) - 1e-9 for r in rows)
    # and of use: about as many are below a threshold as would be by the score
    low = [r for r in rows if similarity.set_ratio(r["a"], r["b"]) < 60]
    assert sum(r["s"] < 60 for r in low) > 0.5 * len(low)


def test_few_rows_are_scored(spark, monkeypatch):
    """Of the rows with a query's letters those that can reach the threshold go to Python, with the same results as all of them."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 9)))
    rows = [(i, f"con{word()} {word()}", f"con{word()}") for i in range(450)]
    asked = [(f"{t} {a}"[:-2] + "zz",) for _, t, a in rows[:40]]
    cat, queries = spark.createDataFrame(rows, "id long, title string, artist string"), spark.createDataFrame(asked, "query string")
    found = {tuple(r) for r in catalog.fuzzy(queries, cat, 5).collect()}
    monkeypatch.setattr(catalog, "set_ratio_bound", lambda a, b: F.lit(100.0))
    assert found == {tuple(r) for r in catalog.fuzzy(queries, cat, 5).collect()} and len(found) >= 40
    every = queries.crossJoin(cat.select(F.lower(F.concat_ws(" ", "artist", "title")).alias("text")))
    left = every.where(similarity.set_ratio_bound(similarity.letters(F.lower("query")), similarity.letters(F.col("text"))) >= catalog.FUZZY_SCORE - catalog.SLACK).count()
    assert left < 0.25 * every.count()


def brute(asked, known, k):
    def grams(x):
        w = [p for p in "".join(c if c.isalnum() else " " for c in x.lower()).split()]
        return {f"  {p} "[i : i + 3] for p in w for i in range(len(p) + 1)}

    out = set()
    for a in asked:
        some = []
        for t, first in known:
            x, y = grams(a), grams(t)
            sim = len(x & y) / len(x | y) if x | y else 0.0
            if sim >= releases.SIMILAR:
                some.append((-sim, first, t))
        out |= {(a, t, round(-s, 9)) for s, _, t in sorted(some)[:k]}
    return out


@pytest.mark.parametrize("shape", ["names", "words"])
def test_few_pairs_are_verified(spark, monkeypatch, shape):
    """Names that share a long prefix, and titles of frequent words: the same nearest texts as by all pairs, a small share of them verified."""
    rng = random.Random(6)
    if shape == "names":
        known = [(f"customer#{i:09d}", i) for i in range(1, 1500)]
        asked = [f"supplier#{i:09d}" for i in range(1, 120)]
    else:
        vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(300)]
        known = [(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 4))), i) for i in range(900)]
        asked = [t[: rng.randint(3, 30)] for t, _ in rng.sample(known, 80)]
    known = list({t: (t, i) for t, i in known}.values())
    counts, plain = [], releases.verified

    def counted(pairs, t):
        counts.append(pairs.count())
        return plain(pairs, t)

    monkeypatch.setattr(releases, "verified", counted)
    got = releases.nearest_texts(spark.createDataFrame([(a,) for a in asked], "asked string"), spark.createDataFrame(known, "known string, first long"), 10, Scratch(spark, "t"))
    assert {(r["asked"], r["known"], round(float(r["sim"]), 9)) for r in got.collect()} == brute(set(asked), known, 10)
    assert sum(counts) < (0.02 if shape == "names" else 0.03) * len(set(asked)) * len(known)


def test_names_that_differ_by_number_alone_meet_few(spark, monkeypatch):
    """Trigrams that no known text has use up most of a text's rarest ones, so that it is compared with hardly any but those of its own number."""
    known, asked = [(f"customer#{i:09d}", i) for i in range(3000)], [f"supplier#{i:09d}" for i in range(0, 3000, 30)]
    counts, plain = [], releases.meeting

    def counted(ours, theirs):
        counts.append(plain(ours, theirs).count())
        return plain(ours, theirs)

    monkeypatch.setattr(releases, "meeting", counted)
    got = releases.nearest_texts(spark.createDataFrame([(a,) for a in asked], "asked string"), spark.createDataFrame(known, "known string, first long"), 10, Scratch(spark, "t"))
    assert {(r["asked"], r["known"], round(float(r["sim"]), 9)) for r in got.collect()} == brute(set(asked), known, 10)
    assert sum(counts) < 0.02 * len(asked) * len(known), sum(counts)


def test_pairs_are_spread_over_tasks(spark, monkeypatch):
    """Few bytes of pairs are much work: what meets and what is verified is dealt over all tasks of a shuffle, not left to one for its size."""
    seen, meeting, verified = [], releases.meeting, releases.verified
    monkeypatch.setattr(releases, "meeting", lambda ours, theirs: seen.append(ours.rdd.getNumPartitions()) or meeting(ours, theirs))
    monkeypatch.setattr(releases, "verified", lambda pairs, t: seen.append(pairs.rdd.getNumPartitions()) or verified(pairs, t))
    known, asked = [(f"customer#{i:09d}", i) for i in range(300)], [(f"supplier#{i:09d}",) for i in range(20)]
    releases.nearest_texts(spark.createDataFrame(asked, "asked string"), spark.createDataFrame(known, "known string, first long"), 10, Scratch(spark, "t")).count()
    assert len(seen) == 4 and set(seen) == {int(spark.conf.get("spark.sql.shuffle.partitions"))}, seen


def test_names_of_many_numbers_meet_by_several_trigrams(spark, monkeypatch):
    """Where numbers share most of their trigrams, keys of several of them leave few pairs to meet, and the same nearest texts."""
    rng = random.Random(9)
    numbers = rng.sample(range(100000, 400000), 3000)
    known = [(f"customer#{i:09d}", i) for i in numbers] + [("ab", 1), ("a", 2), ("x y", 3), ("customer", 4), (" ".join(f"w{i}" for i in range(12)), 5)]
    asked = [f"supplier#{i:09d}" for i in numbers[:150]] + ["ab", "a", "x", "abc", "custom", " ".join(f"w{i}" for i in range(2, 14))]
    counts, widths, plain = [], set(), releases.meeting

    def counted(ours, theirs):
        counts.append(plain(ours, theirs).count())
        if "width" in ours.columns:
            widths.update(r["width"] for r in ours.select("width").distinct().collect())
        return plain(ours, theirs)

    monkeypatch.setattr(releases, "meeting", counted)
    monkeypatch.setattr(releases, "MEETINGS", 0, raising=False)
    monkeypatch.setattr(releases, "MEETINGS_EACH", 0, raising=False)
    got = releases.nearest_texts(spark.createDataFrame([(a,) for a in asked], "asked string"), spark.createDataFrame(known, "known string, first long"), 10, Scratch(spark, "t"))
    assert {(r["asked"], r["known"], round(float(r["sim"]), 9)) for r in got.collect()} == brute(set(asked), known, 10)
    assert sum(counts) < 0.0125 * len(asked) * len(known), counts
    assert len(widths) > 1, widths
