"""Divergences, spelling variants and the n-gram join against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import divergence, ngram_join, spelling

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, id long, set string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, 8, "y") for r in rows], SCHEMA)


def audit_rows():
    rng = random.Random(3)
    words = ["Zoë", "alpha", "BETA", "ünder", "日本", "gamma", "delta", "éé", "É", "x"]
    rows = []
    for i in range(160):
        lang, source = rng.choice(["en", "de", None]), rng.choice([None, "a", "b", "ä", "z"])
        text = rng.choice([" ", "1", "_", "\n", "\x00", "\x7f"]).join(rng.choice(words[: rng.randint(1, 10)]) for _ in range(rng.randint(0, 30)))
        rows.append((i, text, lang, source))
    rows += [(900, None, "en", "only"), (901, "", "fr", "a"), (902, "12 34", "fr", "b"), rows[5], (None, "alpha " * 3000, "en", "a")]
    return rows


def brute_audit(rows, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    upper = {c: c + 32 for c in range(65, 91)}
    groups, df, n = set(), collections.Counter(), collections.Counter()
    for _, text, lang, source in rows:
        key = (lang or "", source or "")
        groups.add(key)
        found = term.findall((text or "").translate(upper))
        df.update((key[0], t) for t in set(found))
        n.update((*key, t) for t in found)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), d in df.items() if x == lang and d >= least]
        mine = sorted(s for x, s in groups if x == lang)

        def shares(count):
            total = sum(count(t) for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (count(t) + 2) // total for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p = {s: shares(lambda t: n[lang, s, t]) for s in mine}  # noqa: B023
        q = shares(lambda t: sum(n[lang, s, t] for s in mine))  # noqa: B023
        for s in mine:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in mine if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if n[lang, s, t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 4, "block": 2}])
def test_audit(spark, sizes):
    rows = audit_rows()
    for least in (10, 1000):
        got = [tuple(r) for r in divergence.audit(frame(spark, rows), least_docs=least, top=3, **sizes).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_audit(rows, least, 3)


def test_audit_of_nothing(spark):
    assert divergence.audit(frame(spark, [])).count() == 0


def test_slices_with_equal_hashes_stay_apart():
    data = np.frombuffer(b"ab cd ab abc cd e", np.uint8)
    starts, ends, _ = divergence.boundaries(data, np.array([0, len(data)]))
    group, stands = divergence.group_slices(data, starts, ends, lambda x: 1)
    terms = [bytes(data[a:b]) for a, b in zip(starts, ends)]
    assert [bytes(data[starts[s] : ends[s]]) for s in stands[group]] == terms and len(stands) == len(set(terms))


def test_blocks_cut_at_texts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_BYTES", 5)
    batch = pa.RecordBatch.from_pydict({"text": ["ab", "", None, "Ab ab", "x" * 30, "ab"], "lang": ["l"] * 6, "source": ["s", "s", "s", "t", "t", "s"]})
    total = collections.Counter()
    for (_, source), terms, n, d in divergence.count_terms(batch.slice(0, 6)):
        for t, a, b in zip(terms, n, d):
            total[source, t, "n"] += a
            total[source, t, "d"] += b
    assert total == {("s", b"ab", "n"): 2, ("s", b"ab", "d"): 2, ("t", b"ab", "n"): 2, ("t", b"ab", "d"): 1, ("t", b"x" * 30, "n"): 1, ("t", b"x" * 30, "d"): 1}


def test_shares_are_exact():
    rng = np.random.default_rng(1)
    total = rng.integers(1, 1 << 52, 500)
    count = (total * rng.random(500)).astype(np.int64)
    assert divergence.share(count, total).tolist() == [1 + 10**9 * c // t for c, t in zip(count.tolist(), total.tolist())]
    assert divergence.share(np.array([7]), np.array([7])).tolist() == [1 + 10**9]


def spelling_rows():
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    words = []
    for w in base:
        words += [w] * rng.randint(1, 40)
        for _ in range(4):
            i = rng.randrange(len(w) + 1)
            words += [rng.choice([w[:i] + "a" + w[i:], w[:i] + w[i + 1 :], w[:i] + "ç" + w[i + 1 :]])] * rng.randint(1, 9)
    words += ["lantern"] * 60 + ["lantarn"] * 25 + ["lantarm"] * 9 + ["lbntarm"] * 4
    rng.shuffle(words)
    gap = lambda: rng.choice([" ", "-", "1", "\n", "ß" if rng.random() < 0.1 else "."])
    rows = [(i, "".join(w.upper().replace("É", "é").replace("Ç", "ç") + gap() if rng.random() < 0.3 else w + gap() for w in words[i * 20 : i * 20 + 20]), "en", "s") for i in range(-(-len(words) // 20))]
    return [*rows, rows[3], rows[3], (None, "quince quinces", None, None), (None, "quince Quince quinces quinces x", None, None), (77, None, None, None), (78, "", None, None), (79, "qu", None, None)]


def brute_spelling(rows):
    n = collections.Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, out = {}, set()
    for w in n:
        those = [v for v in n if near(w, v)]
        best = min(those, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
        out.add((w, form[w], len(those)))
    root = lambda w: root(form[w]) if form[w] else w
    return {(w, f, root(w), n[w], k, n[f] if f else None) for w, f, k in out}


@pytest.mark.parametrize("sizes", [{}, {"shard_words": 20, "segment_rows": 3}])
def test_spelling(spark, sizes, monkeypatch):
    rows = spelling_rows()
    got = [tuple(r) for r in spelling.variants(frame(spark, rows), **sizes).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = brute_spelling(rows)
    assert len(got) == len(set(got)) and set(got) == want
    assert any(root != form for _, form, root, *_ in want if form) and any("quin" in w for w, *_ in want)


def test_spelling_of_nothing(spark):
    assert spelling.variants(frame(spark, [])).count() == 0
    assert spelling.variants(frame(spark, [(1, None, None, None), (2, "ab ab ab", None, None)])).count() == 0


def test_halves_with_many_words():
    rng = random.Random(8)
    words = {"stem" + "".join(rng.choice("ab") for _ in range(rng.randint(3, 5))) for _ in range(60)}
    found = spelling.Automaton((w[: len(w) // 2] if not right else w[len(w) // 2 :], right, w, 1) for w in words for right in (False, True))
    for w in words:
        assert sorted(x for x, _ in found.scan(w)) == sorted(v for v in words if v != w and spelling.one_edit(v, w))


def join_rows():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    rows = []
    for size in (4, 5, 30, 60, 60, 61, 200, 900):
        text = [word() for _ in range(size)]
        for k in range(14):
            copy = list(text)
            # around the bound: a changed word changes four n-grams
            for _ in range(rng.randint(0, max(1, size // 40 + 1))):
                copy[rng.randrange(len(copy))] = word()
            copy = copy[: len(copy) - rng.randint(0, size // 12)]
            rows.append((len(rows) + 10, rng.choice([" ", "\n", "\t "]).join(x.upper() if rng.random() < 0.2 else x for x in copy), None, None))
    rng.shuffle(rows)
    passage = " ".join(word() for _ in range(40))
    rows += [(i, passage + " " + " ".join(word() for _ in range(rng.randint(0, 60))), None, None) for i in range(1000, 1025)]
    rows += [(5, "one two", None, None), (4, "One  TWO", None, None), (3, None, None, None), (2, "", None, None), (1, " \n", None, None), (None, None, None, None), (None, "lone text here now", None, None), rows[0], (None, rows[1][1], None, None)]
    rows += [(9000, " ".join(word() for _ in range(12000)), None, None)]
    return rows


def brute_join(rows, percent):
    def grams(text):
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        p = re.findall(r"[^\x20\x09-\x0D]+", lower)
        return {" ".join(p[i : i + 4]) for i in range(max(1, len(p) - 3))} if p else set()

    sets = [grams(t) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    members = collections.defaultdict(list)
    for i in range(len(rows)):
        members[root(i)].append(rows[i][0])
    return sorted(((rows[i][0], len(sets[i]), min((x for x in members[root(i)] if x is not None), default=None)) for i in range(len(rows))), key=str)


@pytest.mark.parametrize("sizes, most", [({}, 4), ({"slots": 1, "block_rows": 4, "whole_rows": 3}, 0), ({"slots": 1, "block_rows": 4, "whole_rows": 3}, 100), ({"percent": 60}, 1)])
def test_join(spark, sizes, most, monkeypatch):
    monkeypatch.setattr(ngram_join, "OPEN", most)
    rows = join_rows()
    got = sorted((tuple(r) for r in ngram_join.join(frame(spark, rows), **sizes).collect()), key=str)
    want = brute_join(rows, sizes.get("percent", 85))
    assert got == want
    assert 10 < len({c for _, _, c in want}) < len(rows) - 20


def test_join_of_nothing(spark):
    assert ngram_join.join(frame(spark, [])).count() == 0
    assert [tuple(r) for r in ngram_join.join(frame(spark, [(1, None, None, None)])).collect()] == [(1, 0, 1)]


def test_sketches_lose_no_link():
    rng = np.random.default_rng(4)
    for n in (3, 50, 700, 9000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for m in (1, 2, n // 10 + 1):
            b = np.unique(np.concatenate([a[m:], rng.integers(0, 1 << 63, m // 2, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            rows = pa.table({"id": [0, 1], "n": [len(a), len(b)], "odd": [ngram_join.sketch(a), ngram_join.sketch(b)]})
            if ngram_join.linked(len(a), len(b), both, 85):
                assert ngram_join.Block(rows, 85).close(0, np.array([1])).tolist() == [1]
