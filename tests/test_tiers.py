"""What the store lacks comes from the remote search: releases by track, releases searched, and whole lookups."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import releases
from lodestone.plans.lookup import lookup
from lodestone.sources.json_rows import release_documents
from lodestone.sources.views import Store, Tiered

REMOTE = [
    (501, "Fern - Deep Wood", "http://i/501"), (502, "Fern - deep wood", None), (503, "Various Artists - Wood Songs", "spacer.gif"), (504, "Fern", None), (None, "Fern - No Number", None),
    (505, "Moss & Co - Lichen Deep", None), (506, "Fern - Bark", None), (507, "Harbour - Night Songs Live", None), (508, "", None), (509, None, None),
]
TRACKS = [(101, 1, "Tide"), (501, 1, "Canopy"), (503, 1, "Canopy Wood"), (506, 1, "Canopy")]


@pytest.fixture(scope="module")
def store(spark):
    plain = Store(
        spark.createDataFrame([(101, "Night Songs", 2000, "img101", 1, 1)], "id long, title string, release_year int, artwork_url string, artist_id long, label_id long"),
        spark.createDataFrame([(101, "Harbour", 0)], "release_id long, artist_name string, extra int"),
        spark.createDataFrame([(r, n, str(n), t, None) for r, n, t in TRACKS], "release_id long, sequence int, position string, title string, duration string"),
        spark.createDataFrame([], "release_id long, track_sequence int, artist_name string"),
        spark.createDataFrame([], "artist_id long, images array<string>"),
        spark.createDataFrame([], "label_id long, images array<string>"),
    )
    texts = [{"id": 501, "title": "Deep Wood", "artists": [{"id": 9, "name": "Fern"}], "tracklist": [{"title": "Canopy"}]}, {"id": 506, "title": "Bark", "artists": [{"id": 9, "name": "Someone"}], "tracklist": [{"title": "Canopy"}]}]
    docs, _ = release_documents(spark.createDataFrame([(d["id"], json.dumps(d)) for d in texts], "id long, value string"))
    return Tiered.of(plain, spark.createDataFrame(REMOTE, "id long, title string, thumb string"), docs)


def by_track(spark, store, *asked, k=20):
    rows = releases.by_track_tiers(spark.createDataFrame(asked, "track string, artist string"), store, k).orderBy("track", "artist", "rank").collect()
    return [(r["track"], r["artist"], r["release_id"], r["source"], r["is_compilation"]) for r in rows]


def test_by_track(spark, store):
    assert by_track(spark, store, ("Tide", "Harbour")) == [("Tide", "Harbour", 101, "store", False)]
    # strict by track and artist first, then by all words, each album once
    assert by_track(spark, store, ("Canopy", "Fern")) == [("Canopy", "Fern", 501, "remote", False), ("Canopy", "Fern", 506, "remote", False)]
    assert by_track(spark, store, ("Deep", "Fern")) == [("Deep", "Fern", 501, "remote", False)]
    assert by_track(spark, store, ("wood", None)) == [("wood", None, 503, "remote", True), ("wood", None, 501, "remote", False)]
    assert by_track(spark, store, ("wood", None), k=1) == [("wood", None, 503, "remote", True)]
    assert by_track(spark, store, ("&", "Moss"), ("nothing", "nobody"), ("", "Fern"), (None, "Fern")) == [("&", "Moss", 505, "remote", False)]
    assert by_track(spark, store, ("Canopy", "")) == [("Canopy", "", 501, "remote", False), ("Canopy", "", 503, "remote", True), ("Canopy", "", 506, "remote", False)]


def test_of_track_validates_remote_documents(spark, store):
    asked = spark.createDataFrame([("Canopy", "Fern"), ("Tide", "Harbour")], "track string, artist string")
    assert sorted((r["track"], r["release_id"]) for r in releases.releases_of_track(asked, store).collect()) == [("Canopy", 501), ("Tide", 101)]


def test_search(spark, store):
    asked = spark.createDataFrame([(1, "Harbour", "Night Songs"), (2, "Fern", "Bark"), (3, "Lichen", "Moss"), (4, None, "Deep Wood"), (5, "Nobody", None), (6, "Fern", None)], "req_id long, artist string, album string")
    got = {}
    for r in releases.search_tiers(asked, store).orderBy("req_id", "rank").collect():
        got.setdefault(r["req_id"], []).append((r["release_id"], r["confidence"], r["source"], r["artwork_url"]))
    assert got == {1: [(101, 1.0, "store", "img101")], 2: [(506, 1.0, "remote", None)], 3: [(505, 0.2, "remote", None)], 4: [(501, 0.4, "remote", "http://i/501")], 6: [(501, 0.4, "remote", "http://i/501"), (506, 0.4, "remote", None)]}


def test_lookup_runs_on_tiers(spark, store):
    catalog = spark.createDataFrame([(1, "Night Songs", "Harbour"), (2, "Deep Wood", "Fern"), (3, "Bark", "Fern")], "id long, title string, artist string")
    requests = spark.createDataFrame([(1, "Fern", "Canopy", None, "canopy"), (2, "Harbour", "Tide", None, "tide")], "req_id long, artist string, song string, album string, raw_message string")
    with_remote = {r["req_id"]: (r["id"], r["release_id"], r["artwork_url"], r["song_not_found"]) for r in lookup(requests, catalog, store).collect()}
    assert with_remote == {1: (2, 501, "http://i/501", False), 2: (1, 101, "img101", False)}
    alone = [(r["id"], r["release_id"]) for r in lookup(requests.where("req_id = 1"), catalog, Store(*store)).orderBy("rank").collect()]
    assert sorted(i for i, _ in alone) == [2, 3] and {release for _, release in alone} == {None}


def test_queries_have_both_sources(spark):
    from lodestone.plans import registry

    for name in ("releases_by_track_tiers", "release_search_tiers"):
        rows = registry.QUERIES[name](spark, "/root/testdata/sf0.001").groupBy("source").agg(F.count("*")).collect()
        assert sorted(r["source"] for r in rows) == ["remote", "store"] and min(r[1] for r in rows) > 20
