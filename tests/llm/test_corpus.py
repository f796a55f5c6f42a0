"""The corpus operators against brute force on small tables with nulls, empties, ties and repeats."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F
from tests_brute import brute_repeats

from lodestone.llm import lattice, mixing, nearest, packing, quality_model, quality_rules, repeats, secret_scan, simhash, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size_ string"


def base_rows():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(70)
    texts = [None, "", " \n\t", "one", prose(80), prose(300), prose(40) + " " + passage + " " + prose(30), passage + " " + prose(20), "x" * 900, "ab" * 300]
    texts += [prose(60)] * 3 + [prose(5000)]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 4 else None, len(t or ""), "extra") for i, t in enumerate(texts)]
    return [*rows, rows[4], (None, prose(30), "de", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(base_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("hot", [1024, 2])
@pytest.mark.parametrize("first", [False, True])
def test_repeats(spark, docs, hot, first):
    rows = base_rows()
    frame = spark.createDataFrame(rows, SCHEMA)
    got = repeats.remove_repeats(frame, length=40, gram=12, keep_first=first, hot=hot).collect()
    as_key = lambda x: (str(x[0]), x[1], bytes(x[2]))
    assert sorted(as_key((r["doc_id"], r["n_bytes"], r["kept"])) for r in got) == sorted(map(as_key, brute_repeats(rows, 40, first)))


def test_packing(docs, empty):
    rows = packing.pack(docs, packing.default_tokenizer(), capacity=64, salt_rows=3).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= math.ceil(sum(r["length"] for r in rows) / 64) + 1
    assert sum(r["doc_id"] == 4 and r["piece"] == 0 for r in rows) == 2
    assert packing.pack(empty, packing.default_tokenizer()).count() == 0


def test_token_ids():
    t = packing.WordTokenizer(packing.default_tokenizer())
    rng = random.Random(3)
    letters = "aBcdEé ÀÉß'sStTreVEdll0129²½ªº.,!?*$#|<>\t\n\x0b\x85\xa0\xad–“”ΣσςİıŁø中文й😀é\x1c~`^_-"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(800)] + ["don't <|endoftext|> x<|startoftext|>y", ""]
    assert [x for x in texts if t.encode(x) != t.whole(x)] == []


def test_dominance_reduction_keeps_the_best_number():
    def best(sizes, capacity):
        for n in range(1, len(sizes) + 1):
            bins = [0] * n

            def place(i):
                if i == len(sizes):
                    return True
                tried = set()
                for b in range(n):
                    if bins[b] + sizes[i] <= capacity and bins[b] not in tried:
                        tried.add(bins[b])
                        bins[b] += sizes[i]
                        if place(i + 1):
                            return True
                        bins[b] -= sizes[i]
                return False

            if place(0):
                return n

    rng = random.Random(2)
    for _ in range(150):
        sizes = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 8))), reverse=True)
        plan = packing.Plan(dict(collections.Counter(sizes)), 20)
        assert sum(n for _, _, n, *_ in plan.runs) == len(sizes)
        # best fit alone may take one more
        assert best(sizes, 20) <= plan.sequences <= best(sizes, 20) + 1


def components(prints, radius):
    parent = {i: i for i in range(len(prints))}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
            a, b = find(i), find(j)
            parent[a] = b
    out = collections.defaultdict(list)
    for i in parent:
        out[find(i)].append(prints[i][0])
    return {i: min((d for d in out[find(i)] if d is not None), default=None) for i in parent}


@pytest.mark.parametrize(("radius", "bucket"), [(3, 4096), (20, 2), (24, 4096)])
def test_simhash(docs, empty, radius, bucket):
    rows = base_rows()
    prints = [(r[0], simhash.fingerprint(r[1])) for r in rows]
    expected = collections.Counter((prints[i][0], f"{prints[i][1]:016x}", c) for i, c in components(prints, radius).items())
    got = simhash.near_duplicates(docs, radius=radius, bucket_rows=bucket)
    assert collections.Counter(map(tuple, got.collect())) == expected
    assert simhash.near_duplicates(empty).count() == 0


def test_fingerprint_is_zero_without_words():
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("A b") == simhash.fingerprint("a  B") != 0


def test_keep_one(spark, docs, empty):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(4) == 1 and 10 in ids and 11 not in ids and 12 not in ids and None in ids
    assert simhash.keep_one(empty).count() == 0


def test_mixing(spark, docs, empty):
    rows = [(i, f"s{i % 7 % 4}" if i % 11 else None, (i * 37) % 90) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, size long")
    mixed = mixing.mix(frame, chunk_rows=100, fan_in=4, size=F.col("size")).cache()
    got = mixed.collect()
    assert sorted(r["doc_id"] for r in got) == list(range(3000))
    total = collections.defaultdict(lambda: [0, 0, 0.0, 0])
    for r in got:
        assert 0 <= r["copies"] <= 2
        t = total[r["source"]]
        t[0] += r["size"]
        t[1] += r["size"] * r["copies"]
        t[2], t[3] = r["target"], r["source_size"]
    assert sum(t[2] for t in total.values()) == pytest.approx(1.5 * sum(t[0] for t in total.values()))
    for size, taken, target, known in total.values():
        assert known == size and target <= 2 * size + 1e-6 and abs(taken - target) <= 90
    again = {r["doc_id"]: r["copies"] for r in mixing.mix(frame.repartition(3), chunk_rows=100, fan_in=4, size=F.col("size")).collect()}
    assert again == {r["doc_id"]: r["copies"] for r in got}
    texts = mixing.mix(docs)
    assert texts.count() == docs.count() and {r["size"] for r in texts.where("text IS NULL").collect()} == {0}
    assert mixing.mix(empty).count() == 0


def test_rules_on_odd_texts(spark, empty):
    texts = [None, "", "a b c a b c", "\n".join(["same line", "same line", " ", "same line"]), " ".join(["the of and to in"] * 20), "#* $ word"]
    got = [tuple(r) for r in quality_rules.measures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()]
    assert got == [(0, 0, 0, 0, 0), (0, 0, 0, 0, 0), (6, 6, 0, 0, 6), (6, 24, 0, 2, 6), (100, 240, 0, 0, 100), (3, 7, 3, 0, 0)]
    assert quality_rules.quality_rules(empty).count() == 0


def test_urls(spark):
    urls = [None, "no scheme", "http://A.Example.NET/en/1?x#y", "https://x.net", "https://x.net/", "http://b.example.com/de/x", "http://org/fr/a", "http://spam.io/a/?b=2&a=1&utm_source=x", "http://www.spam.io/a?a=1&b=2", "http://spam.io/c", "http://x.xnet/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame([("https://spam.io/a?b=2&a=1",), (None,)], "url string")
    for limit in (url_filter.BROADCAST_BYTES, 0):
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, listed, broadcast_bytes=limit).collect()}
        assert got == {
            0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("a.example.net", "/en/1", "example.net/en/", "allow"), 3: ("x.net", "", None, "allow"), 4: ("x.net", "/", "net/", "block"),
            5: ("b.example.com", "/de/x", "example.com/de/", "block"), 6: ("org", "/fr/a", "org/fr/", "allow"), 7: ("spam.io", "/a/", None, "block"), 8: ("www.spam.io", "/a", None, "block"),
            9: ("spam.io", "/c", None, "allow"), 10: ("x.xnet", "/", None, "allow"),
        }
    assert url_filter.filter_urls(pages.limit(0), listed).count() == 0


def test_nearest(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 16))
    x[300:500] = x[0]  # a group of copies
    rows = [(i, [float(v) for v in np.float32(r)]) for i, r in enumerate(x)] + [(700, None), (800, [0.0] * 16), (900, [float("nan")] + [1.0] * 15), (1000, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest.nearest(frame, "vec_id % 100 = 0", cell_rows=50, cell_queries=2).collect()
    y = np.array([r[1] for r in rows[:600]])
    found = 0
    for q in range(0, 600, 100):
        d = np.sqrt(((y - y[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(600), d)).tolist() if i != q][:10]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in mine] == list(range(1, 11)) and all(d[v] == s for _, v, s in mine)
        found += len({v for _, v, _ in mine} & set(order))
    assert found >= 54 and {r["query_id"] for r in got} == set(range(0, 600, 100))
    few = nearest.nearest(frame.where("vec_id IN (0, 5, 7)"), "vec_id % 100 = 0").collect()
    assert sorted(r["vec_id"] for r in few) == [5, 7]
    assert nearest.nearest(frame.limit(0), "true").count() == 0


def test_narrow_tables_fall_back_to_all_rows(spark):
    import numpy as np

    x = np.random.default_rng(1).standard_normal((200, 8))
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest.nearest(frame, "vec_id % 100 = 0", tables=nearest.Tables(8, 1, 8, 0.1, 1)).collect()
    d = np.sqrt(((x - x[100]) ** 2).sum(axis=1))
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 100] == np.argsort(d)[1:11].tolist()


def test_kneser_ney_sums_to_one(spark):
    from lodestone.llm.common import Scratch

    words = ["aba", "abc", "cab", "bb", "a"] * 3 + ["abba"]
    table = quality_model.train(spark.createDataFrame([(0, " ".join(words), "en")], "doc_id long, text string, lang string"), Scratch(spark, "t"), 3).collect()
    p = {r["gram"]: math.log(r["p"]) for r in table if r["p"]}
    g = {r["gram"]: math.log(r["g"]) for r in table if r["g"]}
    scorer = quality_model.Scorer(p, g, 3)
    symbols = "abc" + quality_model.END
    for history in ("\x02\x02", "\x02a", "ab", "cc"):

        def probability(c, history=history):
            total = 0.0
            for k in (2, 1, 0):
                if (x := p.get(history[2 - k :] + c)) is not None:
                    return math.exp(total + x)
                total += g.get(history[2 - k :], 0.0) if k else 0.0
            return math.exp(total + scorer.floor)

        # all symbols and one for the unseen
        assert sum(map(probability, symbols)) + probability("?") == pytest.approx(1.0)


def test_classifier(spark, empty):
    rng = random.Random(8)
    good = lambda: " ".join("".join(rng.choice(["ba", "ne", "tion", "er", "li"]) for _ in range(rng.randint(1, 3))) for _ in range(120))
    rows = [(i, good(), "en", "s", 0, "") for i in range(260)] + [(900, "#### $$$ %%% !!! QQQQ ZZZZ " * 20, "en", "s", 0, ""), (901, None, "en", "s", 0, ""), (902, good(), None, "s", 0, "")]
    frame = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(240)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in quality_model.judge_documents(frame, labels).collect()}
    assert len(kept) == 263 and not kept[900] and not kept[901] and kept[902] and sum(kept[i] for i in range(260)) >= 255
    assert quality_model.judge_documents(frame, labels.limit(0)).where("kept").count() == 262
    assert quality_model.judge_documents(empty, labels).count() == 0


def test_secrets(spark, docs, empty):
    import base64

    der = bytes([0x30, 0x48, 0x02, 0x41, 0x00, 0xC1, *range(1, 64), 0x02, 0x03, 1, 0, 1])
    ssh = b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", bytes(range(32))))
    head = base64.urlsafe_b64encode(b'{"alg":"HS256","typ":"JWT"}').decode().rstrip("=")
    texts = [
        None, "", "Password: hunter22 é token='abc'", "AKIA" + "A" * 16 + " AKIASHORT", "deadbeef" * 3, "key " + base64.b64encode(der).decode(), "k " + base64.b64encode(ssh).decode(),
        f"x {head}.e30.c2ln", "ſecret=abcdefgh", der.hex(), base64.b64encode(der[:-1] + b"\x00\x00").decode(),
    ]
    got = [(r["n_assign"], r["n_access"], r["n_hex"], r["spans"]) for r in secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    kinds = [sorted({s.split(":")[0] for s in spans.split(",") if s}) for *_, spans in got]
    assert kinds == [[], [], ["assign"], ["access"], ["hex"], ["der"], ["ssh"], ["signed"], [], ["der", "hex"], []]
    assert got[2][3] == "assign:0:18" and got[0][:3] == (0, 0, 0)
    assert secret_scan.masked("a password=hunter22 b") == "a [secret] b"
    redacted = secret_scan.redact(docs)
    assert redacted.columns == docs.columns and redacted.count() == docs.count()
    assert secret_scan.scan(empty).count() == 0


def test_lattice_sums_all_segmentations():
    import numpy as np

    pieces = {"▁": 0, "▁a": 1, "a": 2, "b": 3, "ab": 4, "▁ab": 5, "ba": 6}
    p = np.array([0.1, 0.2, 0.1, 0.15, 0.05, 0.2, 0.1] + [0.0] * 256 + [0.1])
    lat = lattice.Lattice(pieces, list(range(7, 263)), p)

    def every(s):
        if not s:
            return 1.0
        return sum(p[i] * every(s[len(w) :]) for w, i in pieces.items() if s.startswith(w))

    for w in ("a", "ab", "abba", "babab"):
        assert lat.word(w.encode()) == pytest.approx(math.log(every("▁" + w)))


@pytest.mark.parametrize("head", [250_000, 3])
def test_scores(docs, empty, head):
    rows = base_rows()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c = collections.Counter(w for r in rows if not held(r[0]) for w in [*lattice.words_of(r[1] or ""), "END"])
    n, v = sum(c.values()), len(c)
    expected = sorted((str(r[0]), held(r[0]), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for r in rows for w in [[*lattice.words_of(r[1] or ""), "END"]])
    got = lattice.score(docs, lattice.default_vocabulary(), head).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == expected
    assert all(r["score"] < 0 for r in got)
    assert lattice.score(empty, lattice.default_vocabulary()).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    good = lambda: " ".join("".join(rng.choice(["ba", "ne", "tion", "er", "li"]) for _ in range(rng.randint(1, 3))) for _ in range(120))
    rows = [(i, good(), "en", f"s{i % 3}", 0) for i in range(200)]
    rows += [(500, rows[3][1], "en", "s0", 0), (501, "#### $$$ %%% !!!! QQQQ " * 30, "en", "s0", 0), (502, good() + " password=hunter2222", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs)
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in kept]
    assert 501 not in ids[0] and len(ids[0]) >= 198
    assert 500 not in ids[1] and 3 in ids[1] and ids[2] == ids[1]
    assert "hunter2222" not in "".join(r["text"] for r in kept[2].collect())
    assert kept[3].columns == corpus_pipeline.COLUMNS and kept[3].groupBy("doc_id").count().agg(F.max("count")).head()[0] <= 2
    assert kept[4].count() >= kept[3].count() and hashlib.sha256(b"").hexdigest()
