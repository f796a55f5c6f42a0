import pytest
from pyspark.sql import functions as F

from lodestone.functions import similarity, text


def column(spark, values, of):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(of(F.col("x"))).collect()]


def test_norm(spark):
    assert column(spark, ["Björk", "MOTÖRHEAD", "Jørgen Łódź ß", None, " a ", "ﬁn", "é"], text.norm) == ["bjork", "motorhead", "jørgen łodz ß", "", " a ", "fin", "e"]


def test_compilations(spark):
    assert column(spark, ["Various Artists", "Original SOUNDTRACK", "V/A", "Queen", "", None], text.is_compilation) == [True, True, True, False, False, False]


def test_ambiguous_parts(spark):
    got = column(spark, ["A - B - C", "hip-hop beats", "X- Y", "X -Y", "one. two", "- foo", None], text.ambiguous_parts)
    assert [g and tuple(g) for g in got] == [("A", "B - C"), None, ("X", "Y"), ("X", "Y"), ("one", "two"), None, None]


def test_titles_and_brackets(spark):
    assert [tuple(r) for r in column(spark, ["A - B - C", "plain"], text.artist_and_album)] == [("A", "B - C"), ("", "plain")]
    assert column(spark, ["Name (2)", " X "], text.without_suffix) == ["name", "x"]
    assert column(spark, ["Song (Some Remix) now", "none"], text.version_in) == ["some remix", ""]


@pytest.mark.parametrize(
    ("asked", "found", "score"),
    [(("a", "b"), ("A", "B "), 1.0), (("a", None), ("a", "x"), 0.4), (("ab", ""), ("a", "x"), 0.3), (("ab", "cd"), ("a", "c"), 0.8), (("x", "y"), ("a", "b"), 0.2), ((None, None), (None, None), 0.2)],
)
def test_confidence(spark, asked, found, score):
    row = spark.createDataFrame([(*asked, *found)], "a string, b string, c string, d string")
    assert row.select(text.confidence(*(F.col(c) for c in "abcd"))).head()[0] == pytest.approx(score)


def test_call_number(spark):
    rows = spark.createDataFrame([("Rock", "CD", "A", 1, 2), (None, None, None, None, None), (None, None, None, None, 3), ("Rock", None, "A", None, 1)], "g string, f string, l string, a int, r int")
    assert [r[0] for r in rows.select(text.call_number(*(F.col(c) for c in "gflar"))).collect()] == ["Rock CD A 1/2", "", None, "Rock A/1"]


def test_ratios():
    assert similarity.lcs("living color", "living colour") == 12
    assert similarity.lcs("", "a") == 0
    assert similarity.ratio("living color", "living colour") == pytest.approx(96.0)
    assert similarity.ratio("plug", "plugz") == pytest.approx(800 / 9)
    assert similarity.set_ratio("radioheed computer", "radiohead ok computer") == pytest.approx(87.1795, abs=1e-4)
    assert similarity.set_ratio("a b", "b a c") == 100.0
    assert similarity.set_ratio("", "a") == 0.0


def test_lcs_against_the_plain_table():
    import random

    random.seed(5)
    for _ in range(300):
        a, b = ("".join(random.choice("abc ") for _ in range(random.randint(0, 12))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            now = [0]
            for j, y in enumerate(b):
                now.append(row[j] + 1 if x == y else max(row[j + 1], now[j]))
            row = now
        assert similarity.lcs(a, b) == row[-1]


def test_trigrams(spark):
    assert sorted(column(spark, ["word"], similarity.trigrams)[0]) == ["  w", " wo", "ord", "rd ", "wor"]


def test_folding_of_all_characters(spark):
    import unicodedata

    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    blocks = ["".join(map(chr, codes[i : i + 100])) for i in range(0, len(codes), 100)]
    # one by one, as neighbours may change order
    one_by_one = ["\n".join(b) for b in blocks]
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    got = column(spark, one_by_one, text.strip_diacritics)
    assert [(a, b, c) for t, g in zip(one_by_one, got) for a, b, c in zip(t.split("\n"), map(plain, t.split("\n")), g.split("\n")) if b != c][:20] == []
    assert column(spark, ["\uff22\uff2a\uff2f\uff32\uff2b", "\ud55c"], text.norm) == ["bjork", unicodedata.normalize("NFKD", "\ud55c")]


def test_versions_keywords_and_keys(spark):
    row = spark.createDataFrame([("Blue Song", "play blue song (Long Mix) now", "The Big Band Four"), ("Other", "play blue song (long mix)", None)], "s string, r string, a string")
    assert [x[0] for x in row.select(text.song_with_version(F.col("s"), F.col("r"))).collect()] == ["Blue Song (long mix)", "Other"]
    assert [x[0] for x in row.select(text.keyword_query(F.coalesce("a", F.lit("")), F.col("s"))).collect()] == ["band four blue", "other"]
    keys = row.select(text.cache_key("f", a=F.col("a"), s=F.col("s")), text.cache_key("f", s=F.col("s"), a=F.col("a")), text.cache_key("g", a=F.col("a"), s=F.col("s"))).collect()
    assert all(a == b != c for a, b, c in keys) and keys[0][0] != keys[1][0]
    assert column(spark, ["http://x/1.jpg", "http://x/spacer.gif", "", None], text.image_or_null) == ["http://x/1.jpg", None, None, None]
    assert column(spark, ["7", None], lambda x: text.url_of("http://y?id=", x)) == ["http://y?id=7", None]


def test_white_space_of_all_scripts(spark):
    """Words end where str.split() ends them, and strip goes as far as str.strip()."""
    spaces = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2003\u200a\u2028\u2029\u202f\u205f\u3000"
    texts = [f"{c}one{c}{c}two three{c}" for c in spaces] + ["\u200bone\u200b", "a\ufeffb"]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", text.words(F.col("x")).alias("w"), text.strip(F.col("x")).alias("s"), text.marked_words(F.col("x")).alias("m"), text.artist_and_album(F.concat("x", F.lit(" - "), "x")).alias("a"))
    for r in rows.collect():
        assert r["w"] == r["x"].split() and r["s"] == r["x"].strip()
        assert r["a"].artist == r["x"].strip() == r["a"].album
        if "\u200b" not in r["x"] and "\ufeff" not in r["x"]:
            assert r["m"] == ["one", "two", "three"]


def test_normal_form_is_computed_once(spark, tmp_path):
    """A text is decomposed for its digest and its length together."""
    from lodestone.plans import scalar_queries

    spark.createDataFrame([(1, "Ä b"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = scalar_queries.norm_text(spark, str(tmp_path))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("decompose") == 1
    assert {(r["doc_id"], r["n"]) for r in found.collect()} == {(1, 3), (2, 0)}


def test_class_of_combining_marks(spark):
    import unicodedata

    from lodestone.functions import text

    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([("".join(chars[i : i + 4096]),) for i in range(0, len(chars), 4096)], "t string")
    left = {c for r in rows.selectExpr(f"regexp_replace(t, r'{text._MARKS}', '') AS t").collect() for c in r["t"]}
    assert set(chars) - left == {c for c in chars if unicodedata.combining(c)}
