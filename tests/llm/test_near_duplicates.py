"""Near-duplicates of the pipeline against brute-force similarity of five-word shingles."""

import random

import pytest

from lodestone.llm import ngram_join, simhash


def shingles(text, words):
    p = text.lower().split()
    return {" ".join(p[i : i + words]) for i in range(max(1, len(p) - words + 1))} if p else set()


def similarity(a, b):
    return len(a & b) / len(a | b)


def edited(rng, base, how, n):
    new = [f"n{rng.randrange(10**6)}" for _ in range(n)]
    if how == "tail":
        return base + new
    if how == "block":
        at = rng.randrange(len(base) - n)
        return base[:at] + new + base[at + n :]
    out = list(base)
    for at, w in zip(rng.sample(range(len(base)), max(1, n // 4)), new):
        out[at] = w
    return out


def corpus(seed=5, pairs=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    weights = [1 / (i + 2) for i in range(3000)]
    rows = []
    for how in ("tail", "block", "word"):
        for k in range(pairs):
            base = rng.choices(vocabulary, weights, k=200)
            rows += [" ".join(base), " ".join(edited(rng, base, how, 8 + k))]
    return rows


@pytest.mark.parametrize("block_rows", [ngram_join.BLOCK_ROWS, 2])
def test_links_as_brute_force(spark, block_rows):
    rows = corpus()
    sets = [shingles(t, 5) for t in rows]
    near = [similarity(sets[i], sets[i + 1]) for i in range(0, len(rows), 2)]
    assert min(sum(x >= 0.8 for x in near[i : i + 40]) for i in (0, 40, 80)) >= 10 and sum(x < 0.8 for x in near) > 10
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_one(docs, block_rows=block_rows).collect()}
    wrong = [x for i, x in enumerate(near) if (2 * i + 1 in kept) != (x < 0.8)]
    assert not wrong


@pytest.mark.parametrize("block_rows", [ngram_join.BLOCK_ROWS, 4])
def test_refused_forest_edges_are_tried_anew(spark, block_rows):
    """A chain of texts, each near the one before only, in the way of forests that skip links."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = [" ".join(words[i : i + 200]) for i in range(0, 100, 8)]
    sets = [shingles(t, 5) for t in rows]
    assert all(similarity(a, b) >= 0.8 for a, b in zip(sets, sets[1:])) and similarity(sets[0], sets[4]) < 0.8
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert [r["doc_id"] for r in simhash.keep_one(docs, block_rows=block_rows).collect()] == [0]


def test_large_group_that_is_not_near_enough(spark):
    """Texts each one word away from a text that is not there: near, and no two of them near enough, which their sketches tell."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for _ in range(700):
        now = list(base)
        now[rng.randrange(6, 54)] = f"n{rng.randrange(10**9)}"
        texts.append(" ".join(now))
    sets = [shingles(t, 5) for t in texts]
    import numpy as np
    import pyarrow as pa

    grams = [ngram_join.n_grams(t, 5) for t in texts]
    assert [len(g) for g in grams] == [len(x) for x in sets]
    bucket = ngram_join.Block(pa.table({"id": range(700), "n": [len(g) for g in grams], "odd": [ngram_join.sketch(g) for g in grams]}), 80)
    passed = wrong = 0
    for i in range(0, 700, 7):
        near = set(bucket.close(i, np.arange(700)).tolist())
        linked = {j for j in range(700) if similarity(sets[i], sets[j]) >= 0.8}
        assert linked <= near
        passed, wrong = passed + len(near), wrong + len(near - linked)
    # of all pairs looked at; what passes wrongly is as good as at the limit
    assert wrong <= 0.05 * 100 * 700
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    label = list(range(700))
    for i in range(700):
        for j in range(i):
            if label[i] != label[j] and similarity(sets[i], sets[j]) >= 0.8:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    assert kept == set(label)


def test_fingerprints_come_first(spark, monkeypatch):
    """Pairs within the radius are checked exactly, and those that link are not left for the product."""
    rng = random.Random(7)
    rows = []
    for _ in range(30):
        base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        rows += [" ".join(base), " ".join([*base, "end"])]
    rows += ["same print one", "same print two"]
    real = simhash.fingerprint
    checked, product = [], []
    nominated, unconnected = simhash.nominated, ngram_join.unconnected
    monkeypatch.setattr(simhash, "nominated", lambda *a, **k: checked.append(out := nominated(*a, **k)) or out)
    monkeypatch.setattr(ngram_join, "unconnected", lambda pairs, roots: product.append((pairs.count(), out := unconnected(pairs, roots), out.count())) or out)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in simhash.keep_one(docs).collect())
    assert kept == [*range(0, 60, 2), 60, 61]
    near = sum(bin(real(rows[i], 5, True) ^ real(rows[i + 1], 5, True)).count("1") <= simhash.RADIUS for i in range(0, 60, 2))
    assert near > 10 and checked[0].count() >= near
    (before, _, after), = product
    assert before == 30 and after == 30 - near
