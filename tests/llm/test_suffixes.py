"""Suffix order and factors against plain sorting, anchors over blocks, and repeats in hard texts."""

import random
from collections import Counter

import numpy as np
import pytest
from tests_brute import brute_repeats

from lodestone.llm import repeats


def pool(rng, n, kinds):
    """Texts of few letters, zero bytes among them, so that many suffixes tie for long."""
    return [bytes(rng.choice(b"\0\0ab\xff"[: rng.randint(1, kinds)]) for _ in range(n)) for _ in range(6)]


@pytest.mark.parametrize("length", [3, 8, 13, 40])
def test_suffix_order_and_factors(length):
    rng = random.Random(length)
    for kinds in (1, 2, 5):
        data = b"".join(pool(rng, 60, kinds))
        starts = np.arange(len(data) - length + 1)
        bucket = np.array([rng.randint(0, 2) for _ in starts])
        order, shared = repeats.suffix_order(np.frombuffer(data + bytes(8), np.uint8), starts, bucket, length)
        strings = [data[i : i + length] for i in starts]
        assert order.tolist() == sorted(range(len(starts)), key=lambda i: (bucket[i], strings[i], i))
        for i in range(1, len(order)):
            a, b = order[i - 1], order[i]
            same = next((k for k in range(length) if strings[a][k] != strings[b][k]), length)
            assert shared[i] == (same if bucket[a] == bucket[b] else -1)
        # any order of the ties will do
        for keys in (order, np.array(sorted(range(len(starts)), key=lambda i: (bucket[i], strings[i], rng.random())))):
            for later in (False, True):
                got = repeats.longest_factors(keys, shared, length, later)
                seen, expected = Counter(), {}
                for i in sorted(range(len(starts)), reverse=later):
                    expected[i] = length if seen[bucket[i], strings[i]] else 0
                    seen[bucket[i], strings[i]] += 1
                assert got.tolist() == [expected[i] for i in range(len(starts))]


def test_anchors_do_not_depend_on_blocks():
    rng = np.random.default_rng(3)
    for data in (rng.integers(0, 256, 5000, dtype=np.uint8).tobytes(), bytes(3000), b"ab" * 2000 + rng.bytes(1000)):
        whole = repeats.anchors_of(data, 200, 32)
        for block in (1, 170, 1000, 4801):
            for a, b in zip(whole, repeats.anchors_of(data, 200, 32, block)):
                assert a.tolist() == b.tolist()


@pytest.mark.parametrize("first", [False, True])
def test_identical_rows_and_long_texts(spark, first):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 5)))
    text = " ".join(word() for _ in range(80))
    long = " ".join(word() for _ in range(4000))
    rows = [(1, text), (1, text), (2, text), (2, text), (3, "short"), (3, "short"), (None, text + "!"), (4, long), (5, long[5000:9000] + text), (6, "\0" * 700), (6, "\0" * 650)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_bytes"], bytes(r["kept"])) for r in repeats.remove_repeats(frame, keep_first=first).collect())
    # rows of one id come in the order of a hash of their text
    either = [Counter(brute_repeats(some, 200, first)) for some in (rows, [*rows[:-2], rows[-1], rows[-2]])]
    assert got in either


def test_block_memory(spark):
    """A text of 24 MB takes little more than itself."""
    import resource
    import subprocess
    import sys

    code = "import resource, os; from lodestone.llm import repeats as r; d = os.urandom(24 << 20); a = resource.getrusage(0).ru_maxrss; r.anchors_of(d, 200, 32); print(resource.getrusage(0).ru_maxrss - a)"
    grown = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)
    assert grown < 300_000 and resource
