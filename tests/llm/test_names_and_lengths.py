"""Columns whose names clash with the work's, very long texts, and pieces against the tokenizer itself."""

import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import packing, quality_rules, repeats, secret_scan, simhash, url_filter

CLASHING = ("kept_id", "kept_hash", "row_hash", "c0", "id", "row", "key", "size", "length", "rank", "salt", "host", "block", "hit", "fp", "t", "w")


def docs_of(spark):
    rng = random.Random(21)
    prose = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6))) for _ in range(n))
    rows = [(i, prose(30 + i)) for i in range(12)] + [(20, "word " * 60_000), (21, "x" * 300_000), (22, None), (23, ""), (24, " \n")]
    rows += [rows[3], rows[3], (30, rows[4][1])]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_clashing_columns(spark):
    rows, docs = docs_of(spark)
    more = docs.select("*", *[F.lit("mine").alias(c) for c in CLASHING])
    for of in (simhash.keep_one, secret_scan.redact):
        out = of(more)
        assert out.columns == more.columns
        assert Counter(map(tuple, out.select("doc_id", "text").collect())) == Counter(map(tuple, of(docs).collect()))
        assert out.select("kept_id", "c0").distinct().collect() == [("mine", "mine")]
    for of in (repeats.remove_repeats, secret_scan.scan, simhash.near_duplicates, quality_rules.quality_rules, lambda d: packing.pack(d, packing.default_tokenizer())):
        order = lambda df: sorted(map(str, df.collect()))
        same = [c for c in of(docs).columns if c not in ("sequence_id", "offset")]
        assert order(of(more).select(*same)) == order(of(docs).select(*same))
    pages = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://a.b/"), "text").alias("url"))
    clashing = pages.select("*", *[F.lit("mine").alias(c) for c in (*CLASHING, "c", "path", "rule", "verdict", "spread", "w0")])
    assert Counter(map(tuple, url_filter.filter_urls(clashing, pages.limit(3)).collect())) == Counter(map(tuple, url_filter.filter_urls(pages, pages.limit(3)).collect()))


def test_urls_long_and_repeated(spark):
    urls = ["http://x.io/" + "a" * 200_000, "http://x.io/" + "a" * 200_000, "http://x.io/p//\n", "http://x.io/p", "http://x.io/p/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for limit in (url_filter.BROADCAST_BYTES, 0):
        got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages, pages.where("page_id IN (0, 3)"), broadcast_bytes=limit).collect()}
        # a line's end is part of a path
        assert got == {0: "block", 1: "block", 2: "allow", 3: "block", 4: "block"}


def test_pieces(spark):
    from tokenizers import Tokenizer

    rows, docs = docs_of(spark)
    whole = Tokenizer.from_file(packing.default_tokenizer())
    expected = Counter()
    for d, t in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        for i, at in enumerate(range(0, len(ids), 4096)):
            some = np.array(ids[at : at + 4096], "<u4")
            expected[d, i, at, len(some), zlib.crc32(some.tobytes())] += 1
    packed = packing.pack(docs, packing.default_tokenizer()).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == expected
    filled = Counter()
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled[r["sequence_id"]]
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 4096
