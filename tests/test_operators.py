import pytest

from pyspark.sql import functions as F

from lodestone.operators import catalog, releases
from lodestone.sources import sinks
from lodestone.sources.scratch import Scratch
from lodestone.sources.sinks import replace_catalog
from lodestone.sources.views import Store

ROWS = [
    (1, "Night Songs", "Harbour"), (2, "The Long Game", "Harbour"), (3, "Colours", "Vivid Lights"), (4, "Vivid Lights", "Colours"),
    (5, "Chew", "Chew Toy"), (6, "Blue (One Hour)", "Björk Hald"), (7, "Rock Classics", "Various Artists"), (8, None, None),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id long, title string, artist string")


def asked(spark, *queries):
    return spark.createDataFrame([(q,) for q in queries], "query string")


def ids(df, query):
    return [r["id"] for r in df.where(df["query"] == query).orderBy("rank").collect()]


def test_search_cascade(spark, rows):
    found = catalog.search(asked(spark, "harbour game", "lights vivid", "bjork hald", "harbor longe game", "nothing here"), rows, 5).cache()
    assert ids(found, "harbour game") == [2]
    assert ids(found, "lights vivid") == [3, 4]
    assert ids(found, "bjork hald") == [6]
    assert ids(found, "harbor longe game") == [2]
    assert ids(found, "nothing here") == []
    assert {r["query"]: r["tier"] for r in found.collect()}["harbor longe game"] == 3


def test_words_in_either_column(spark, rows):
    assert ids(catalog.all_words(asked(spark, "night harb", "various classic"), rows, 5), "night harb") == [1]


def test_artist_correction(spark, rows):
    names = spark.createDataFrame([("Harbur",), ("Harbour",), ("Ha",), (None,)], "artist string")
    more = rows.union(spark.createDataFrame([(9, "x", "Plugz")], rows.schema))
    got = {r["artist"]: r["corrected"] for r in catalog.correct_artist(names.union(spark.createDataFrame([("Plug",)], names.schema)), more).collect()}
    assert got == {"Harbur": "Harbour"}


def test_batch_is_the_same_as_single(spark, rows):
    queries = ["harbour game", "lights vivid", "vivid"]
    batch = catalog.search(asked(spark, *queries), rows, 5)
    for q in queries:
        assert ids(batch, q) == ids(catalog.search(asked(spark, q), rows, 5), q)


@pytest.fixture(scope="module")
def store(spark):
    release = spark.createDataFrame([(1, "Night Songs", 2001, "u", 7, 1), (2, "Other", 2002, None, 8, 2), (3, "Third", 2003, "x/spacer.gif", None, 1)], "id long, title string, release_year int, artwork_url string, artist_id long, label_id long")
    artist = spark.createDataFrame([(1, "Harbour (2)", 0), (1, "Guest", 1), (2, "Various", 0), (3, "Harbour", 0)], "release_id long, artist_name string, extra int")
    track = spark.createDataFrame([(1, 1, "A1", "Tide", "3:00"), (1, 2, None, "Wave", None), (2, 1, "1", "Tide", None)], "release_id long, sequence int, position string, title string, duration string")
    names = spark.createDataFrame([(2, 1, "Someone")], "release_id long, track_sequence int, artist_name string")
    artist_image = spark.createDataFrame([(8, ["a8", "b8"]), (7, [])], "artist_id long, images array<string>")
    return Store(release, artist, track, names, artist_image, spark.createDataFrame([(1, ["l1"])], "label_id long, images array<string>"))


def test_validation(spark, store):
    questions = spark.createDataFrame([(1, "tide", "Harbour"), (2, "Tide", "Various"), (2, "tide", "someone else"), (9, "tide", "x"), (1, "none", "Harbour")], "release_id long, track string, artist string")
    got = {(r["release_id"], r["track"], r["artist"]): r["valid"] for r in releases.validate(questions, releases.documents(store)).collect()}
    assert got == {(1, "tide", "Harbour"): True, (2, "Tide", "Various"): False, (2, "tide", "someone else"): True, (9, "tide", "x"): None, (1, "none", "Harbour"): False}


def test_documents_and_images(spark, store):
    docs = {r["release_id"]: r for r in releases.documents(store, spark.createDataFrame([(1,), (3,), (4,)], "release_id long")).collect()}
    assert sorted(docs) == [1, 3] and [(t["position"], t["title"], t["artists"]) for t in docs[1]["tracklist"]] == [("A1", "Tide", []), ("", "Wave", [])] and docs[3]["tracklist"] == []
    assert {r["release_id"]: r["image"] for r in releases.fallback_images(store.release.selectExpr("id AS release_id"), store).collect()} == {1: "l1", 2: "a8", 3: "l1"}


def test_release_search(spark, store):
    want = spark.createDataFrame([(1, None, "night song"), (2, "harbour", None), (3, None, "zzz"), (4, "harbour", "third")], "req_id long, artist string, album string")
    got = [(r["req_id"], r["rank"], r["release_id"], r["artwork_url"]) for r in releases.search(want, store.release, store.artist).orderBy("req_id", "rank").collect()]
    assert got == [(1, 1, 1, "u"), (2, 1, 3, None), (2, 2, 1, "u"), (4, 1, 3, None), (4, 2, 1, "u")]
    guarded = releases.searchable(spark.createDataFrame([(1, "", "", "t"), (2, "a", "b", "t"), (3, "", None, "")], "req_id long, artist string, album string, track string"))
    assert sorted(map(tuple, guarded.collect())) == [(1, None, "t"), (2, "a", "b")]


def test_releases_of_a_track(spark, store):
    asked = spark.createDataFrame([("tide", None), ("Tide", "Harbour"), ("tide", "Someone"), ("", "x")], "track string, artist string")
    got = sorted((r["track"], str(r["artist"]), r["rank"], r["release_id"], r["is_compilation"]) for r in releases.by_track(asked, store).collect())
    assert got == [("Tide", "Harbour", 1, 1, False), ("tide", "None", 1, 1, False), ("tide", "None", 2, 2, True)]
    assert [(r["track"], r["release_id"]) for r in releases.releases_of_track(asked.where("artist IS NOT NULL"), store).collect()] == [("Tide", 1)]


@pytest.mark.parametrize("k", [1, 3, 50])
def test_nearest_texts(spark, k):
    import random

    rng = random.Random(k)
    words = lambda: " ".join(rng.choice(["harbour", "harbor", "night", "nights", "song", "songs", "x1", "x2"]) for _ in range(rng.randint(1, 3)))
    asked, known = {words() for _ in range(20)}, {words() for _ in range(60)}

    def grams(t):
        return {f"  {w} "[i : i + 3] for w in t.split() for i in range(len(w) + 1)}

    number = {t: i for i, t in enumerate(sorted(known))}
    expected = set()
    for a in asked:
        near = sorted(((-len(grams(a) & grams(b)) / len(grams(a) | grams(b)), number[b], b) for b in known))
        expected |= {(a, b, round(-s, 9)) for s, _, b in near[:k] if -s >= 0.3}
    found = releases.nearest_texts(spark.createDataFrame([(a,) for a in asked], "asked string"), spark.createDataFrame([(b, n) for b, n in number.items()], "known string, first long"), k, Scratch(spark, "test"))
    assert {(r["asked"], r["known"], round(r["sim"], 9)) for r in found.collect()} == expected


def test_remote_rows(spark):
    rows = spark.createDataFrame([(1, "Harbour - Night Songs", "t"), (2, "Harbour - night songs", "x/spacer.gif"), (3, "Only", ""), (None, "A - B", "t"), (5, "", "t"), (6, "Harbour - Tide", None)], "id long, title string, thumb string")
    assert sorted(map(tuple, releases.listed(rows).collect())) == [(1, "Harbour", "Night Songs", "t"), (2, "Harbour", "night songs", None), (3, "", "Only", None), (6, "Harbour", "Tide", None)]
    words = spark.createDataFrame([("harbour",), ("songs harbour",)], "query string")
    assert sorted((r["query"], r["id"], r["rank"]) for r in releases.keyword_search(words, rows, 5).collect()) == [("harbour", 1, 1), ("harbour", 6, 2), ("songs harbour", 1, 1)]
    tracks = spark.createDataFrame([(6, "Low Tide"), (1, "Wave")], "release_id long, title string")
    fields = spark.createDataFrame([(1, "harbour", None, None), (2, "harbour", None, "tide"), (3, None, None, None), (4, "x", "tide", None)], "req_id long, artist string, album string, track string")
    strict = releases.strict_search(fields, rows, tracks, 5)
    assert sorted((r["req_id"], r["id"], r["rank"]) for r in strict.collect()) == [(1, 1, 1), (1, 6, 2), (2, 6, 1)]
    second = spark.createDataFrame([(2, 1, "Harbour", "Night Songs", "t", 1), (2, 6, "Harbour", "TIDE", "t", 2), (4, 3, "", "Only", None, 1)], "req_id long, id long, artist string, album string, thumb string, rank int")
    assert sorted((r["req_id"], r["id"], r["rank"]) for r in releases.supplemented(strict, second, "req_id", 5, 2).collect()) == [(1, 1, 1), (1, 6, 2), (2, 1, 2), (2, 6, 1), (4, 3, 1)]


def test_upserts(spark, store):
    old = store.release.where("id < 3")
    new = spark.createDataFrame([(2, "New", 2003, None, 1, 1), (3, "Third", 2004, None, 1, 1)], old.schema)
    assert sorted((r["id"], r["title"]) for r in releases.upsert(old, new, ["id"]).collect()) == [(1, "Night Songs"), (2, "New"), (3, "Third")]
    assert sorted((r["id"], r["title"]) for r in releases.insert_absent(old, new, ["id"]).collect()) == [(1, "Night Songs"), (2, "Other"), (3, "Third")]
    assert sorted((r["id"], r["source"]) for r in sinks.upsert_cached(old.selectExpr("id", "'dump' AS source", "now() AS cached_at"), new, ["id"]).collect()) == [(1, "dump"), (2, "api_fetch"), (3, "api_fetch")]


def test_catalog_replacement(spark, rows, tmp_path):
    path = str(tmp_path / "catalog")
    for n in (8, 2):
        assert replace_catalog(rows.limit(n), path).head()["row_count"] == n
        assert spark.read.parquet(path).count() == n
    with pytest.raises(ValueError):
        replace_catalog(rows.drop("title"), path)
    (tmp_path / "file").write_text("x")
    with pytest.raises(Exception):
        replace_catalog(rows, str(tmp_path / "file" / "catalog"))
    assert spark.read.parquet(path).count() == 2


def test_full_text_forms(spark, rows):
    ask = lambda found, q: ids(found, q)
    found = catalog.phrase(asked(spark, "long game", "game long", "vivid lights", "the"), rows, 5).cache()
    assert [ask(found, q) for q in ("long game", "game long", "vivid lights", "the")] == [[2], [], [3, 4], [2]]
    assert ask(catalog.phrase(asked(spark, "vivid lights"), rows, 5, ("title",)), "vivid lights") == [4]
    first = catalog.phrase(asked(spark, "the long", "long"), rows, 5, ("title",), initial=True).cache()
    assert [ask(first, q) for q in ("the long", "long")] == [[2], []]
    close = catalog.near(asked(spark, "game the", "game x"), rows, 5, within=1).cache()
    assert [ask(close, q) for q in ("game the", "game x")] == [[2], []]
    assert ask(catalog.near(asked(spark, "game the"), rows, 5, within=0), "game the") == []
    starts = catalog.prefix(asked(spark, "h", "ha", "harbou", "viv", "q"), rows, 5).cache()
    assert [ask(starts, q) for q in ("h", "ha", "harbou", "viv", "q")] == [[1, 2, 6], [1, 2, 6], [1, 2], [3, 4], []]
    assert ask(catalog.any_token(asked(spark, "chew harbour"), rows, 5), "chew harbour") == [1, 2, 5]
    no = spark.createDataFrame([("harbour", "game"), ("vivid", None)], "query string, excluded string")
    left = catalog.without(no, rows, 5).cache()
    assert [ask(left, q) for q in ("harbour", "vivid")] == [[1], [3, 4]]


def test_least_ids_of_repeated_texts(spark):
    many = spark.createDataFrame([(i, "Same Title", "A") for i in range(50, 90)] + [(i, f"Same Other {i}", "B") for i in range(40)] + [(100, None, "Same")], "id long, title string, artist string")
    assert ids(catalog.full_text(asked(spark, "same"), many, 5), "same") == [0, 1, 2, 3, 4]
    assert ids(catalog.full_text(asked(spark, "same title"), many, 5), "same title") == [50, 51, 52, 53, 54]
    assert ids(catalog.all_words(asked(spark, "itle"), many, 3), "itle") == [50, 51, 52]


def test_albums_by_some_of_their_words(spark, rows):
    texts = ["Night Songs", "Night Songs night songs anniversary", "Songs colours anniversary edition"]
    found = catalog.album_fuzzy(asked(spark, *texts), rows, 5).cache()
    assert [ids(found, q) for q in texts] == [[1], [1], []]
    pairs = spark.createDataFrame([("the singers songsheet", "Singers' Songsheets"), ("night songs", "Night Other"), ("one two", None)], "a string, t string")
    assert [r[0] for r in pairs.select(catalog.accepts(F.col("a"), F.col("t"))).collect()] == [True, False, False]


def test_responses_and_telemetry(spark):
    import json

    cols = "req_id long, rank int, id long, title string, artist string, release_id long, album string, release_artist string, artwork_url string, confidence double, search_type string, song_not_found boolean, found_on_compilation boolean, context string, corrected_artist string"
    tail = ("direct", False, False, None, "Harbour")
    lines = [(1, 2, 5, "B", "Harbour", None, None, None, None, None, *tail), (1, 1, 9, "A", "Harbour", 3, "A", "Harbour", "u", 1.0, *tail), (2, None, None, None, None, None, None, None, None, None, "none", False, False, None, None)]
    got = {r["req_id"]: json.loads(r["response"]) for r in sinks.responses(spark.createDataFrame(lines, cols)).collect()}
    assert [x["id"] for x in got[1]["results"]] == [9, 5] and got[1]["total"] == 2 and got[1]["results"][0]["artwork"]["artwork_url"] == "u" and got[1]["corrected_artist"] == "Harbour"
    assert got[2]["results"] == [] and got[2]["total"] == 0 and got[2]["search_type"] == "none"
    steps = spark.createDataFrame([("a", 1.5), ("a", 2.0), ("b", None)], "step string, ms double")
    assert sorted(map(tuple, sinks.telemetry(steps).collect()), key=str) == [("a", 2, 3.5), ("b", 1, None), ("total", 3, 3.5)]
    assert sinks.telemetry(steps.limit(0)).count() == 0


def test_stream_counts(spark, tmp_path):
    from lodestone.streaming.rates import windowed_counts

    spark.sql("SELECT timestamp'2024-01-01 00:00:10' AS ts, 1L AS user_id UNION ALL SELECT timestamp'2024-01-01 00:00:40', 1L UNION ALL SELECT timestamp'2024-01-01 00:01:10', 1L").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, user_id long").parquet(str(tmp_path / "in"))
    q = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n"] for r in spark.table("counted").collect()) == [1, 2]


def test_strict_search_meets_rows_once_for_all_who_ask(spark, monkeypatch):
    """Requests for one artist of every row: the rows are ranked once for all of them, with the results of a plain search for each."""
    rows = [(i, f"Band {'One' if i % 2 else 'Two'} - {'Red' if i % 3 else 'Blue'} Album {i % 7}", None) for i in range(120)] + [(None, "Band One - No Number", None), (500, "No separator", None)]
    on_tracks = [(i, f"Song {i % 5}") for i in range(120) for _ in range(2)]
    asked = [(n, "band one", None, None) for n in range(150)]
    asked += [(200, None, "red", None), (201, "one", "blue album", None), (202, "two", None, "song 3"), (203, "band", "red 4", "SONG 1"), (204, None, None, "song 2"), (205, "nobody", "red", None), (206, "#", "red", None), (207, None, None, None)]
    seen, plain = [], releases.first_by_title

    def counted(ranked, keys, order, k):
        seen.append(ranked.count())
        return plain(ranked, keys, order, k)

    monkeypatch.setattr(releases, "first_by_title", counted)
    fields = spark.createDataFrame(asked, "req_id long, artist string, album string, track string")
    remote, tracks = spark.createDataFrame(rows, "id long, title string, thumb string"), spark.createDataFrame(on_tracks, "release_id long, title string")
    got = sorted((r["req_id"], r["rank"], r["id"]) for r in releases.strict_search(fields, remote, tracks, 3).collect())
    holds = lambda entry, text: text is None or (set(text.lower().split()) <= set(entry.lower().split()) and text != "#")
    want = []
    for req, artist, album, track in asked:
        if artist is None and album is None and track is None:
            continue
        once = {}
        for i, title, _ in rows:
            if i is None:
                continue
            theirs, name = title.split(" - ") if " - " in title else ("", title)
            if holds(theirs, artist) and holds(name, album) and (track is None or any(r == i and holds(t, track) for r, t in on_tracks)):
                once.setdefault(name.lower(), i)
        want += [(req, n, i) for n, i in enumerate(sorted(once.values())[:3], 1)]
    assert got == sorted(want) and len(got) > 450
    assert sum(seen) < 1000, seen
