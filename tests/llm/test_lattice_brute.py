"""Document scores against enumeration of all segmentations, with piece probabilities counted in one process."""

import collections
import math
import random
import zlib

import numpy as np
import pytest

from lodestone.llm import lattice


def rows_of(rng):
    word = lambda: "".join(rng.choice("aeinrsté中") for _ in range(rng.randint(1, 6)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 8)))) for i in range(40)]
    return [*rows, rows[3], (50, None), (51, ""), (52, "The THE the\x0bend x"), (None, "the \U0001f600 �")]


@pytest.mark.parametrize("head", [250_000, 2])
def test_scores_sum_all_segmentations(spark, head):
    rows = rows_of(random.Random(9))
    path = lattice.default_vocabulary()
    model = lattice.load_model(path)
    pieces, single, first = lattice.read_vocabulary(model)
    trains = lambda d: d is None or zlib.crc32(str(d).encode()) % 7 != 2
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    split = lambda t: [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in lower(t)).split(" ") if w]
    p = lattice.PRIOR * first
    for d, t in rows:
        if trains(d):
            p[-1] += 1
            for w in split(t):
                for i in model.encode(w):
                    p[i] += bool(first[i])
    p = p / p.sum()

    def every(s):
        if not s:
            return 1.0
        ways = sum(p[pieces[s[:k]]] * every(s[k:]) for k in range(1, len(s) + 1) if s[:k] in pieces)
        # a character that is no piece is spelled in bytes
        return ways if s[0] in pieces else ways + math.prod(p[single[b]] for b in s[0].encode()) * every(s[1:])

    chance = {w: every(lattice.SPACE + w) for _, t in rows for w in split(t)}
    expected = sorted((str(d), round(math.log10(p[-1]) + sum(math.log10(chance[w]) for w in split(t)), 6)) for d, t in rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lattice.score(docs, path, head).collect()
    assert sorted((str(r["doc_id"]), round(r["score"], 6)) for r in got) == expected


def test_very_long_word_and_repeats(spark):
    rows = [(1, "ab" * 20_000), (2, "x " * 50_000), (3, "q w"), (3, "q w"), (3, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["n_tokens"], r["held_out"]) for r in lattice.score(docs, lattice.default_vocabulary()).collect())
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    assert got == {(1, 2, held(1)): 1, (2, 50_001, held(2)): 1, (3, 3, held(3)): 2, (3, 2, held(3)): 1}
    assert np.isfinite([r["score"] for r in lattice.score(docs, lattice.default_vocabulary()).collect()]).all()
