"""Mixing with columns of any name, and with rows that only their text tells apart."""

import random
from collections import Counter

from pyspark.sql import functions as F

from lodestone.llm import mixing

NAMES = ("size", "target", "source_size", "copies", "chunk", "fraction", "base", "tie", "weight", "limit", "level", "full", "n_docs", "source_", "c1")


def test_names_that_clash(spark):
    rows = [(i, " ".join("w" for _ in range(i % 9)), f"s{i % 3}") for i in range(60)] + [(0, "a b c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    more = docs.select("*", *[F.lit(999).alias(c) for c in NAMES])
    as_rows = lambda df: Counter((r["doc_id"], r["text"], r["size"], r["source_size"], r["target"], r["copies"]) for r in df.collect())
    mixed = mixing.mix(more)
    assert as_rows(mixed) == as_rows(mixing.mix(docs))
    assert {r["size"] for r in mixed.where("source IS NULL").collect()} == {3}
    assert [c for c in mixed.columns if c not in docs.columns] == [*NAMES[4:], *mixing.RESULTS]
    assert mixed.select("chunk", "c1").distinct().collect() == [(999, 999)]


def test_ties_do_not_depend_on_the_order_of_arrival(spark):
    rows = [(7, f"a b {i}", "s") for i in range(40)] + [(i, "a b c d e", "t") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = lambda df: Counter((r["doc_id"], r["text"], r["copies"]) for r in mixing.mix(df).collect())
    assert taken(docs) == taken(docs.orderBy(F.desc("text")).repartition(3))


def brute_targets(rows, weights=(5, 2, 1), share=1.5, most=2.0):
    """(size of a row, size and target of its source), by going round until no source is above its limit."""
    size = lambda t: len((t or "").split())
    of = Counter()
    for _, t, s in rows:
        of[s] += size(t)
    order = sorted((s for s in of if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in of)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(of.values())
    while open_:
        fair = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if fair[s] > most * of[s]}
        if not above:
            target |= fair
            break
        target |= {s: most * of[s] for s in above}
        left -= sum(most * of[s] for s in above)
        open_ -= above
    return Counter((d, size(t), of[s], round(target[s], 6)) for d, t, s in rows)


def test_sizes_and_targets_against_brute_force(spark):
    for seed in range(3):
        rng = random.Random(seed)
        sources = [None, "", "a", "B", "é", "𝔏", "￮", "z", "hot", "only empty"]
        rows = [(i, None if rng.random() < 0.1 else " ".join(["w"] * rng.randint(0, 40)), "hot" if rng.random() < 0.4 else rng.choice(sources[: 3 + 3 * seed])) for i in range(300)]
        rows += [(900, "", "only empty"), (901, None, "only empty"), rows[0], rows[0], (None, "x y z", "a")]
        mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
        expected = brute_targets([(d, (t or "").replace(" ", "_"), s) for d, t, s in rows])
        assert Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in mixed) == expected
        longest = max(r["size"] for r in mixed)
        for s in {r["source"] for r in mixed}:
            own = [r for r in mixed if r["source"] == s]
            assert abs(sum(r["size"] * r["copies"] for r in own) - own[0]["target"]) <= longest and all(r["copies"] <= 2 for r in own)
