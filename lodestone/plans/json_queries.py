"""Queries of requests and release documents that arrive as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.releases import documents
from lodestone.sources import json_rows, views

#: What is told of a request in JSON, by its number: in turn as it should be, and with each kind of fault. {a}, {t} and {m} are artist, title and message.
TEXTS = {
    "lookup": [
        '{"artist":{a},"album":{t},"raw_message":{m}}', '{"song":{t},"artist":null,"raw_message":{m},"other":[1]}', '{"artist":7,"raw_message":{m}}', '{"artist":{a}}', '{"raw_message":null}',
        '{"raw_message":{m}', '[{m}]', '{"raw_message":"","song":{"x":1}}', '{"raw_message":""}', 'null', '', '{"raw_message":{m},"album":true}', ' {"raw_message" : {m}} ',
    ],
    "catalog": [
        '{"q":{t}}', '{"q":null,"artist":{a},"limit":100}', '{"q":"","artist":"","title":null}', '{"title":{t},"limit":0}', '{"title":{t},"limit":101}', '{"title":{t},"limit":1}',
        '{"title":{t},"limit":"5"}', '{"title":{t},"limit":2.5}', '{"limit":5}', '{"q":["x"]}', '{"q":{t},"limit":null}', '{{t}}',
    ],
    "release": ['{"artist":{a},"album":{t}}', '{"track":{t},"limit":50}', '{"track":{t},"limit":51}', '{"artist":"","track":""}', '{"artist":false}', '"text"', '{"album":{t},"limit":-3}', '{"limit":3}'],
}


def _request_texts(spark, sf_dir: str, kind: str) -> DataFrame:
    """(id, value): a text for each request, of the kind's forms in turn."""
    quoted = lambda c: F.concat(F.lit('"'), F.coalesce(c, F.lit("")), F.lit('"'))
    r = views.requests(spark, sf_dir)
    parts = {"{a}": quoted(F.coalesce("artist", F.lit("nobody"))), "{t}": quoted(F.coalesce("album", "song", F.lit("no title"))), "{m}": quoted(F.col("raw_message"))}
    n, value = len(TEXTS[kind]), F.lit(None).cast("string")
    for i, form in enumerate(TEXTS[kind]):
        text = F.lit(form)
        for name, part in parts.items():
            text = F.replace(text, F.lit(name), part)
        value = F.when(F.col("req_id") % (n + 1) == i, text).otherwise(value)
    return r.select(F.col("req_id").alias("id"), value.alias("value"))


def _accepted(kind: str):
    def query(spark, sf_dir):
        return json_rows.requests(_request_texts(spark, sf_dir, kind), json_rows.FORMS[kind])[0]

    return query


def _rejected(kind: str):
    def query(spark, sf_dir):
        return json_rows.requests(_request_texts(spark, sf_dir, kind), json_rows.FORMS[kind])[1]

    return query


def _release_texts(spark, sf_dir: str) -> DataFrame:
    """(id, value): each release of the store as a JSON document; some are cut off, some have a year that is none, some lack lists."""
    named = lambda id_, name: F.array(F.struct(id_.alias("id"), name.alias("name")))
    nations = views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("label_id"), F.col("n_name").alias("label"))
    docs = documents(views.store(spark, sf_dir)).join(nations, "label_id", "left")
    track = lambda t: F.struct(t["position"].alias("position"), t["title"].alias("title"), t["duration"].alias("duration"), F.transform(t["artists"], lambda a: F.struct(F.lit(None).cast("long").alias("id"), a.alias("name"))).alias("artists"))
    id_ = F.col("release_id")
    whole = F.struct(
        id_.alias("id"),
        "title",
        F.col("release_year").alias("year"),
        F.when(id_ % 7 > 0, named(F.col("artist_id"), F.col("artist"))).alias("artists"),
        F.concat(named(F.col("label_id"), F.col("label")), named(F.lit(0).cast("long"), F.lit("second"))).alias("labels"),
        F.when(id_ % 5 > 0, F.split("title", " ")).alias("genres"),
        F.array(F.lit("one"), F.lit("two")).alias("styles"),
        F.transform("tracklist", track).alias("tracklist"),
        F.when(F.col("artwork_url").isNotNull(), F.array(F.struct(F.col("artwork_url").alias("uri")), F.struct(F.lit("later").alias("uri")))).alias("images"),
    )
    docs, text = json_rows.computed_once(docs.select("release_id", whole.alias("whole")), "text", F.to_json("whole")), F.col("text")
    value = F.when(id_ % 17 == 3, F.substring(text, F.lit(1), F.length(text) - 1)).when(id_ % 19 == 4, F.regexp_replace(text, '"year":[0-9]+', '"year":"soon"')).when(id_ % 23 == 5, F.lit("{}")).otherwise(text)
    return json_rows.computed_once(docs, "value", value).select(id_.alias("id"), "value")


def release_document(spark, sf_dir):
    """Releases read back from their JSON documents."""
    good, _ = json_rows.release_documents(_release_texts(spark, sf_dir), "http://releases/")
    shown = F.array_join(F.transform("tracklist", lambda t: F.concat_ws("|", t["position"], t["title"], t["duration"], F.array_join(t["artists"], "&"))), ";")
    return good.select("release_id", "title", "artist", "year", "label", "artist_id", "label_id", F.array_join("genres", ",").alias("genres"), F.array_join("styles", ",").alias("styles"), shown.alias("tracks"), "artwork_url", "release_url")


def release_document_rejected(spark, sf_dir):
    """The numbers of documents that are no release."""
    return json_rows.release_documents(_release_texts(spark, sf_dir))[1].select("id")


QUERIES = {"release_document": release_document, "release_document_rejected": release_document_rejected}
for _name in TEXTS:
    QUERIES |= {f"{_name}_requests": _accepted(_name), f"{_name}_rejected": _rejected(_name)}


def _texts_sql(kind: str) -> str:
    """The CTE texts (id, value)."""
    quoted = lambda x: f"'\"' || {x} || '\"'"
    value = " ".join(f"WHEN {i} THEN replace(replace(replace('{form}', '{{a}}', a), '{{t}}', t), '{{m}}', m)" for i, form in enumerate(TEXTS[kind]))
    return f"""parts AS (SELECT req_id, {quoted("coalesce(artist, 'nobody')")} AS a, {quoted("coalesce(album, song, 'no title')")} AS t, {quoted('raw_message')} AS m FROM requests),
texts AS (SELECT req_id AS id, CASE req_id % {len(TEXTS[kind]) + 1} {value} END AS value FROM parts)"""


def _judged_sql(kind: str) -> str:
    form, checks = json_rows.FORMS[kind], []
    type_ = lambda c: f"json_type(j, '$.{c}')"
    checks = ["WHEN j IS NULL THEN 'not JSON'", "WHEN json_type(j) <> 'OBJECT' THEN 'not an object'"]
    for c in form.texts:
        if c in form.needed:
            checks += [f"WHEN {type_(c)} IS NULL THEN '{c}: missing'", f"WHEN {type_(c)} <> 'VARCHAR' THEN '{c}: not a text'"]
        else:
            checks += [f"WHEN {type_(c)} NOT IN ('VARCHAR', 'NULL') THEN '{c}: not a text'"]
    fields = [f"json_extract_string(j, '$.{c}') AS {c}" for c in form.texts]
    if form.limit:
        low, high, default = form.limit
        checks += [f"WHEN {type_('limit')} NOT IN ('UBIGINT', 'BIGINT') THEN 'limit: not a whole number'", f"WHEN CAST(json_extract_string(j, '$.limit') AS BIGINT) NOT BETWEEN {low} AND {high} THEN 'limit: out of bounds'"]
        fields.append(f"CASE WHEN {type_('limit')} IS NULL THEN {default} WHEN {type_('limit')} IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract_string(j, '$.limit') AS BIGINT) END AS \"limit\"")
    if form.one_of:
        checks.append(f"WHEN coalesce({', '.join(f'''nullif(json_extract_string(j, '$.{c}'), '')''' for c in form.one_of)}) IS NULL THEN 'nothing to search for'")
    return f"WITH {views.SQL}, {_texts_sql(kind)}, judged AS (SELECT id, value, {', '.join(fields)}, CASE {' '.join(checks)} END AS reason FROM (SELECT *, CASE WHEN json_valid(value) THEN CAST(value AS JSON) END AS j FROM texts))"


_GOOD = "NOT (id % 17 = 3 OR id % 19 = 4 OR id % 23 = 5)"
ORACLE_SQL = {
    "release_document": f"""WITH {views.SQL}, n AS (SELECT release_id, track_sequence, array_to_string(list(artist_name ORDER BY artist_name), '&') AS artists FROM release_track_artist GROUP BY ALL),
t AS (SELECT t.release_id, string_agg(position || '|' || title || '|' || duration || '|' || coalesce(artists, ''), ';' ORDER BY sequence) AS tracks FROM release_track t LEFT JOIN n ON n.release_id = t.release_id AND n.track_sequence = t.sequence GROUP BY t.release_id)
SELECT id AS release_id, title, CASE WHEN id % 7 > 0 THEN coalesce(a.artist_name, '') ELSE '' END AS artist, release_year AS year, n_name AS label, CASE WHEN id % 7 > 0 THEN artist_id END AS artist_id, label_id,
 CASE WHEN id % 5 > 0 THEN replace(title, ' ', ',') ELSE '' END AS genres, 'one,two' AS styles, coalesce(t.tracks, '') AS tracks, CASE WHEN artwork_url NOT LIKE '%spacer.gif%' THEN artwork_url END AS artwork_url, 'http://releases/' || id AS release_url
FROM release LEFT JOIN release_artist a ON a.release_id = id LEFT JOIN nation ON n_nationkey = label_id LEFT JOIN t ON t.release_id = id WHERE {_GOOD}""",
    "release_document_rejected": f"WITH {views.SQL} SELECT id FROM release WHERE NOT ({_GOOD})",
}
for _name, _form in json_rows.FORMS.items():
    _kept = ", ".join([*_form.texts, *(['"limit"'] if _form.limit else [])])
    ORACLE_SQL[f"{_name}_requests"] = f"{_judged_sql(_name)} SELECT id, {_kept} FROM judged WHERE reason IS NULL"
    ORACLE_SQL[f"{_name}_rejected"] = f"{_judged_sql(_name)} SELECT id, value, reason FROM judged WHERE reason IS NOT NULL"
