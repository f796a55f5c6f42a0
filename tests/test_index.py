"""The kept index: the same rows as without it, pruned reads, rounds that end early, growth, replacement and query strings."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import catalog as search
from lodestone.operators import index
from lodestone.sources import sinks
from lodestone.sources.scratch import Scratch

SCHEMA = "id long, title string, artist string"
ROWS = [
    (1, "Blue Train", "John Coltrane"), (2, "Train in Vain", "The Clash"), (3, "A Love Supreme", "John Coltrane"), (4, "Mystery Train", "Elvis Presley"),
    (5, "Blue", "Joni Mitchell"), (6, "blue train", "john coltrane"), (7, "Blue Train", "John Coltrane"), (8, None, "Nobody"), (9, "", None),
    (10, "Señor Blues", "Horace Silver"), (11, "The the the", "The The"), (12, "Train Train Blue", "Train"), (13, "Love is a 𝔏osing game", "Amy 日本"), (14, "Or And Not", "Near"),
]


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    return index.build(spark.createDataFrame(ROWS, SCHEMA), str(tmp_path_factory.mktemp("index") / "one"))


def ids(spark, kept, *queries, k=20):
    found = kept.match(spark.createDataFrame([(q,) for q in queries], "query string"), k, Scratch(spark, "t")).orderBy("query", "rank").collect()
    out = {q: [] for q in queries}
    for r in found:
        out[r["query"]].append(r["id"])
    return out


MATCHES = {
    "blue train": [1, 6, 7, 12],
    "BLUE OR vain": [1, 2, 5, 6, 7, 12],
    "train NOT blue": [2, 4],
    "train NOT blue NOT vain": [4],
    "love OR train NOT blue": [2, 3, 4, 13],
    "(love OR train) NOT blue": [2, 3, 4, 13],
    "vain OR love AND supreme": [2, 3],
    "john supreme OR vain": [2, 3],
    '"blue train"': [1, 6, 7],
    '"train blue"': [12],
    "blue + train": [1, 6, 7],
    "train + tr*": [12],
    "^train": [2, 12],
    "^blue": [1, 5, 6, 7],
    "title : ^ train": [2, 12],
    "title:train artist:train": [12],
    "artist:train": [12],
    "- artist : the": [11],
    "{title artist}: the": [2, 11],
    "{ artist }: (john OR joni)": [1, 3, 5, 6, 7],
    "NEAR(mystery train)": [4],
    "NEAR(love supreme, 0)": [3],
    "NEAR(a supreme, 0)": [],
    "NEAR(a supreme, 1)": [3],
    'NEAR("is a" love game, 3)': [13],
    'NEAR("is a" love game, 2)': [],
    "NEAR(love is game, 0)": [],
    "NEAR": [14],
    "NEAR train": [],
    '"AND"': [14],
    "senor": [10],
    "blu*": [1, 5, 6, 7, 10, 12],
    '"blue tr" *': [1, 6, 7],
    'train ""': [1, 2, 4, 6, 7, 12],
    'train AND ""': [],
    'train NOT ""': [1, 2, 4, 6, 7, 12],
    '""': [],
    "日本": [13],
    "𝔏osing": [13],
    'artist:("coltrane" NOT blue)': [1, 3, 6, 7],
    'title:"say ""train"""': [],
    "unknown": [],
}
MALFORMED = ["", "  ", "AND", "a AND", "OR b", "NOT a", "(a", "a)", "()", '"a', "a & b", "R&B", "T-Rex", "a.b", "it's", "shelf:a", "{title:a", "{title shelf}: a", "a *b*", "NEAR(a", "NEAR(a, x)", "NEAR()", "^", "a +", "- a", "-a", ":a", "a, b", "a OR OR b", "^(a)"]


def test_query_strings(spark, kept):
    assert ids(spark, kept, *MATCHES) == MATCHES


def test_malformed(spark, kept):
    for q in MALFORMED:
        if q != "a *b*":
            with pytest.raises(index.Malformed):
                index.Query(q)
    assert index.parsed(spark.createDataFrame([(q,) for q in [*MALFORMED, None]], "query string")).count() == 1  # a *b* alone is well formed


def test_malformed_goes_on(spark, kept):
    asked = spark.createDataFrame([("Train & Vain",), ("blue train",), ("Mystery-Train",)], "query string")
    found = {(r["query"], r["id"], r["tier"]) for r in search.search(asked, kept.table("texts"), 5, kept).collect()}
    assert ("Train & Vain", 2, 2) in found and ("Mystery-Train", 4, 2) in found and ("blue train", 1, 1) in found


def test_same_as_without(spark, kept, tmp_path):
    catalog = spark.createDataFrame(ROWS, SCHEMA)
    asked = spark.createDataFrame([(q,) for q in ("blue", "train", "john blue", "the", "the the", "日本", "𝔏osing game", "zzz", "a & b", "", "AND", "senor")], "query string")
    rows = lambda df: {tuple(r) for r in df.select("query", "id", "rank").collect()}
    for k in (1, 3, 50):
        assert rows(index.full_text(asked, kept, k, Scratch(spark, "t"))) == rows(search.full_text(asked, catalog, k))
        assert rows(index.full_text(asked, kept, k, Scratch(spark, "t"), ("title",))) == rows(search.full_text(asked, catalog, k, ("title",)))


def test_extended(spark, tmp_path):
    part = lambda f: spark.createDataFrame([r for r in ROWS if f(r[0])], SCHEMA)
    grown = index.build(part(lambda i: i < 5), str(tmp_path / "grown"))
    before = sorted(p.name for p in (tmp_path / "grown" / "postings").rglob("*.parquet"))
    index.extend(grown, part(lambda i: 5 <= i < 9))
    index.extend(grown, part(lambda i: i >= 9))
    index.extend(grown, part(lambda i: i > 99))
    assert set(before) <= {p.name for p in (tmp_path / "grown" / "postings").rglob("*.parquet")}
    assert ids(spark, grown, *MATCHES) == MATCHES
    assert grown.table("ranges").agg(F.countDistinct("range") == F.count("*")).head()[0]
    with pytest.raises(ValueError, match="built anew"):
        index.extend(grown, part(lambda i: i == 3))


def test_empty_catalog(spark, tmp_path):
    empty = index.build(spark.createDataFrame([], SCHEMA), str(tmp_path / "empty"))
    assert ids(spark, empty, "a", "a OR b*") == {"a": [], "a OR b*": []}
    index.extend(empty, spark.createDataFrame(ROWS, SCHEMA))
    assert ids(spark, empty, "blue train") == {"blue train": [1, 6, 7, 12]}


def many(spark, n):
    return spark.range(n).select("id", F.concat(F.lit("common "), F.hex("id"), F.when(F.col("id") % 1000 == 7, " seldom").otherwise("")).alias("title"), F.lit("same").alias("artist"))


def test_frequent_words_end_early(spark, tmp_path, monkeypatch):
    """A word of every row costs one posting row of the first range, however many rows there are."""
    kept = index.build(many(spark, 6000), str(tmp_path / "many"))
    assert kept.table("ranges").count() > 3 and kept.table("postings").agg(F.max("n")).head()[0] <= 2 * index.BLOCK
    joined, plain = [], index._narrow

    def counted(postings, ranges, columns=index.BOTH):
        rows = plain(postings, ranges, columns)
        joined.append((ranges, rows.where("token IN ('common', 'same', 'seldom')").agg(F.count("*"), F.sum(F.size("ids"))).head()))
        return rows

    monkeypatch.setattr(index, "_narrow", counted)
    one = spark.createDataFrame([("common same",)], "query string")
    assert [r["id"] for r in index.full_text(one, kept, 5, Scratch(spark, "t")).orderBy("rank").collect()] == [0, 1, 2, 3, 4]
    assert [r for r, _ in joined] == [[0]] and joined[0][1][0] <= 3 and joined[0][1][1] <= 3 * 2 * index.FIRST
    joined.clear()
    both = spark.createDataFrame([("common",), ("common seldom",)], "query string")
    found = index.full_text(both, kept, 5, Scratch(spark, "t")).collect()
    assert sorted(r["id"] for r in found if r["query"] == "common seldom") == [7, 1007, 2007, 3007, 4007] and len(joined) > 2


def test_reads_are_pruned(spark, kept):
    asked = spark.createDataFrame([("mystery",)], "token string")
    bucket = asked.select(index.bucket_of(F.col("token"))).head()[0]
    rows = index._blocks(kept, asked)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull(bucket" in plan and f"= {bucket})" in plan
    assert {f"bucket={bucket}" in x for (x,) in rows.select(F.input_file_name()).distinct().collect()} == {True}
    ranged = rows.where(F.col("range").isin([0]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in ranged and "range" in ranged.split("PushedFilters")[1]


def test_replaced_together(spark, tmp_path):
    path = str(tmp_path / "live")
    for rows in (ROWS[:4], ROWS):
        out = sinks.replace_catalog(spark.createDataFrame(rows, SCHEMA), path, indexed=True).head()
        assert (out["status"], out["row_count"]) == ("ok", len(rows))
        assert spark.read.parquet(f"{path}/catalog").count() == len(rows)
    assert ids(spark, index.Index(spark, f"{path}/index"), "blue train") == {"blue train": [1, 6, 7, 12]}
    assert [p.name for p in tmp_path.iterdir()] == ["live"]
    with pytest.raises(ValueError):
        sinks.replace_catalog(spark.createDataFrame([(1,)], "id long"), path, indexed=True)
