"""JSON requests and release documents: what is accepted, what is kept apart and why."""

import json

import pytest

from lodestone.plans import json_queries
from lodestone.sources.json_rows import FORMS, release_documents, requests


def split(spark, form, values):
    good, bad = requests(spark.createDataFrame(list(enumerate(values)), "id long, value string"), FORMS[form])
    return {r["id"]: r.asDict() for r in good.collect()}, {r["id"]: (r["value"], r["reason"]) for r in bad.collect()}


def test_lookup_requests(spark):
    values = [
        '{"raw_message":"play it"}', '{"raw_message":"","artist":"A","song":null,"album":"é 日本 \\" \\u00e9"}', '{"artist":"A"}', '{"raw_message":null}', '{"raw_message":1}', '{"raw_message":"m","artist":["a"]}',
        '{"raw_message":"m"', "", None, "[]", "7", '"raw_message"', '{"raw_message":"m","raw_messages":3}', '{"RAW_MESSAGE":"m"}', '{"raw_message":"' + "x" * 100_000 + '"}',
    ]
    good, bad = split(spark, "lookup", values)
    assert sorted(good) == [0, 1, 12, 14] and sorted([*good, *bad]) == list(range(len(values)))
    assert good[1] == {"id": 1, "artist": "A", "song": None, "album": 'é 日本 " é', "raw_message": ""} and len(good[14]["raw_message"]) == 100_000
    why = {2: "raw_message: missing", 3: "raw_message: not a text", 4: "raw_message: not a text", 5: "artist: not a text", 6: "not JSON", 7: "not JSON", 8: "not JSON", 9: "not an object", 10: "not an object", 11: "not an object", 13: "raw_message: missing"}
    assert {i: r for i, (_, r) in bad.items()} == why and all(bad[i][0] == values[i] for i in bad)


@pytest.mark.parametrize("form, field, most, default", [("catalog", "q", 100, 10), ("release", "track", 50, 5)])
def test_bounds(spark, form, field, most, default):
    limits = ["1", str(most), "0", str(most + 1), "-1", "1.5", '"3"', "null", "true", "99999999999999999999"]
    good, bad = split(spark, form, [f'{{"{field}":"x","limit":{n}}}' for n in limits] + [f'{{"{field}":"x"}}', f'{{"{field}":""}}', "{}", f'{{"{field}":null,"limit":2}}', f'{{"{field}":5}}'])
    assert {i: r["limit"] for i, r in good.items()} == {0: 1, 1: most, 10: default}
    outside, kind, nothing = "limit: out of bounds", "limit: not a whole number", "nothing to search for"
    assert {i: r for i, (_, r) in bad.items()} == {2: outside, 3: outside, 4: outside, 5: kind, 6: kind, 7: kind, 8: kind, 9: kind, 11: nothing, 12: nothing, 13: nothing, 14: f"{field}: not a text"}


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], "id long, value string")
    assert [x.count() for x in (*requests(empty, FORMS["lookup"]), *release_documents(empty))] == [0] * 4
    twice = spark.createDataFrame([(1, '{"q":"a"}')] * 2 + [(None, '{"q":"b"}')], "id long, value string")
    assert sorted(str(r["id"]) for r in requests(twice, FORMS["catalog"])[0].collect()) == ["1", "1", "None"]


FULL = {
    "id": 5, "title": "T", "year": 1999, "artists": [{"id": 7, "name": "First", "role": "x"}, {"id": 8, "name": "Second"}], "labels": [{"id": 3, "name": "L"}, {"id": 4, "name": "M"}], "genres": ["g", "h"], "styles": ["s"],
    "tracklist": [{"position": "A1", "title": "One", "duration": "3:00", "artists": [{"id": 1, "name": "X"}, {"name": "Y"}]}, {"title": "Two"}], "images": [{"uri": "http://i/1"}, {"uri": "http://i/2"}], "community": {"have": 3},
}


def test_release_documents(spark):
    values = [json.dumps(FULL), '{"id":6}', '{"id":7,"artists":[],"labels":[],"tracklist":[],"images":[],"genres":[]}', json.dumps(FULL | {"id": 8, "images": [{"uri": "http://x/spacer.gif"}], "tracklist": None})]
    broken = [json.dumps(FULL)[:-1], "{}", "", None, "[1]", json.dumps(FULL | {"year": "soon"}), json.dumps(FULL | {"id": "x"}), json.dumps(FULL | {"tracklist": 3}), '{"id":null}']
    good, bad = release_documents(spark.createDataFrame(list(enumerate([*values, *broken])), "id long, value string"), "r/")
    assert sorted(r["id"] for r in bad.collect()) == list(range(len(values), len(values) + len(broken)))
    found = {r["release_id"]: r.asDict(recursive=True) for r in good.collect()}
    tracks = [{"position": "A1", "title": "One", "duration": "3:00", "artists": ["X", "Y"]}, {"position": "", "title": "Two", "duration": None, "artists": []}]
    assert found[5] == {"release_id": 5, "title": "T", "artist": "First", "year": 1999, "label": "L", "artist_id": 7, "label_id": 3, "genres": ["g", "h"], "styles": ["s"], "tracklist": tracks, "artwork_url": "http://i/1", "release_url": "r/5"}
    bare = {"title": "", "artist": "", "year": None, "label": None, "artist_id": None, "label_id": None, "genres": [], "styles": [], "tracklist": [], "artwork_url": None}
    assert found[6] == {"release_id": 6, "release_url": "r/6"} | bare and found[7] == {"release_id": 7, "release_url": "r/7"} | bare
    assert found[8]["artwork_url"] is None and found[8]["tracklist"] == []


def test_documents_are_written_and_parsed_once(spark):
    """What reads a document's fields, and what tells broken ones, read one parsed value."""
    rows = spark.createDataFrame([(1, '{"id":5,"title":"a"}'), (2, "{"), (3, None)], "id long, value string")
    good, failed = release_documents(rows, "http://r/")
    for df in (good, failed):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert [(r["release_id"], r["release_url"]) for r in good.collect()] == [(5, "http://r/5")]
    assert sorted(r["id"] for r in failed.collect()) == [2, 3]
    plan = json_queries.release_document(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StructsToJsonEvaluator") == 1
