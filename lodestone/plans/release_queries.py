"""Queries of the release store and of the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.text import COMPILATION_KEYWORDS
from lodestone.operators import events, releases
from lodestone.plans.scalar_queries import similarity_sql
from lodestone.sources import sinks, views
from lodestone.sources.scratch import Scratch

K = 5


def _no():
    return F.lit(None).cast("string")


def releases_by_track(spark, sf_dir):
    asked = views.catalog(spark, sf_dir).select(F.col("title").alias("track"), _no().alias("artist")).distinct()
    found = releases.by_track(asked, views.store(spark, sf_dir))
    return found.select("track", "release_id", "title", "artist_name", "is_compilation", F.round("sim", 6).alias("sim"), "rank")


def _songs(spark, sf_dir):
    return views.catalog(spark, sf_dir).select(F.col("title").alias("track"), "artist").distinct()


def releases_by_track_artist(spark, sf_dir):
    """Releases of each catalog title as a track, by artists like the row's."""
    found = releases.by_track(_songs(spark, sf_dir), views.store(spark, sf_dir), 10)
    return found.select("track", "artist", "release_id", "title", "artist_name", "is_compilation", F.round("sim", 6).alias("sim"), "rank")


def releases_for_track(spark, sf_dir):
    """Those of them that have the track by the artist."""
    return releases.releases_of_track(_songs(spark, sf_dir), views.store(spark, sf_dir), 10)


def release_search_album(spark, sf_dir):
    asked = views.catalog(spark, sf_dir).select("title").distinct().select(F.col("title").alias("req_id"), _no().alias("artist"), F.col("title").alias("album"))
    return _shown(spark, sf_dir, asked)


def release_search_artist(spark, sf_dir):
    """Releases by the names of all suppliers, which are near those of customers, and by all artists of the catalog."""
    names = views.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("artist")).union(views.catalog(spark, sf_dir).select("artist")).distinct()
    return _shown(spark, sf_dir, names.select(F.col("artist").alias("req_id"), "artist", _no().alias("album")))


def release_search_both(spark, sf_dir):
    """Releases by each distinct title and artist of the catalog."""
    asked = views.catalog(spark, sf_dir).select(F.concat_ws(" - ", "artist", "title").alias("req_id"), "artist", F.col("title").alias("album")).distinct()
    return _shown(spark, sf_dir, asked)


def search_guard(spark, sf_dir):
    """What requests search releases for: a title from the album or else the song; those with nothing to search are left out."""
    asked = views.requests(spark, sf_dir).select("req_id", "artist", "album", F.col("song").alias("track"))
    return releases.searchable(asked)


def _shown(spark, sf_dir, asked):
    found = releases.search(asked, views.release(spark, sf_dir), views.release_artist(spark, sf_dir))
    return found.select("req_id", "release_id", "title", "artist_name", "artwork_url", F.round("score", 6).alias("score"), "confidence", "rank")


def _remote(spark, sf_dir):
    """Rows of a remote search: releases as "Artist - Album", some without an artist or without a number."""
    rows = views.release(spark, sf_dir).join(views.release_artist(spark, sf_dir), F.col("id") == F.col("release_id"))
    title = F.when(F.col("id") % 9 == 0, F.col("title")).when(F.col("id") % 10 == 0, "").otherwise(F.concat_ws(" - ", "artist_name", "title"))
    return rows.select(F.when(F.col("id") % 13 > 0, F.col("id")).alias("id"), title.alias("title"), F.col("artwork_url").alias("thumb"))


def remote_rows(spark, sf_dir):
    return releases.listed(_remote(spark, sf_dir))


def remote_keywords(spark, sf_dir):
    """The remote search's rows that hold all words of a title and a brand."""
    asked = _songs(spark, sf_dir).select(F.regexp_replace(F.concat_ws(" ", "track", "artist"), "#", " ").alias("query"))
    return releases.keyword_search(asked, _remote(spark, sf_dir), K)


def _fields(spark, sf_dir):
    """Artist, or album, or both, or the track as well, of catalog rows, by their number."""
    n = F.col("id") % 4
    return views.catalog(spark, sf_dir).select(F.col("id").alias("req_id"), F.when(n != 1, F.col("artist")).alias("artist"), F.when(n > 0, F.col("title")).alias("album"), F.when(n == 3, F.col("title")).alias("track"))


def remote_strict(spark, sf_dir):
    return releases.strict_search(_fields(spark, sf_dir), _remote(spark, sf_dir), views.store(spark, sf_dir).track, K)


def remote_supplement(spark, sf_dir):
    """Strict search, and keyword search for requests with fewer than three releases by it."""
    fields, rows = _fields(spark, sf_dir), _remote(spark, sf_dir)
    words = fields.select("req_id", F.regexp_replace(F.concat_ws(" ", "album", "artist"), "#", " ").alias("query"))
    second = words.join(releases.keyword_search(words, rows, K), "query").drop("query")
    scratch = Scratch(spark, "supplement")
    first = scratch.put(releases.strict_search(fields, rows, views.store(spark, sf_dir).track, K))
    return releases.supplemented(first, scratch.put(second), "req_id", K)


def _with_remote(spark, sf_dir):
    """The store's even releases, and all of them in the remote search."""
    store = views.store(spark, sf_dir)
    return views.Tiered.of(store._replace(release=store.release.where("id % 2 = 0"), artist=store.artist.where("release_id % 2 = 0")), _remote(spark, sf_dir))


def _hard(spark, sf_dir):
    """Titles by artists, by an artist's number alone, which is like no artist of the store, and artists as tracks."""
    c, number = views.catalog(spark, sf_dir), F.regexp_extract("artist", "[0-9]+$", 0)
    asked = F.array(*[F.struct(t.alias("track"), a.alias("artist")) for t, a in ((F.col("title"), F.col("artist")), (F.col("title"), number), (F.col("artist"), number), (F.col("artist"), _no()))])
    return c.select(F.explode(asked).alias("x")).select("x.*").distinct()


def releases_by_track_tiers(spark, sf_dir):
    """Releases by track from the store or else from the remote search, strict and then by words."""
    found = releases.by_track_tiers(_hard(spark, sf_dir), _with_remote(spark, sf_dir), 10)
    return found.select("track", "artist", "release_id", "title", "artist_name", "is_compilation", F.round("sim", 6).alias("sim"), "rank", "source")


def release_search_tiers(spark, sf_dir):
    """Releases from the store or else from the remote search."""
    asked = _hard(spark, sf_dir).select(F.concat_ws("|", "track", F.coalesce("artist", F.lit("-"))).alias("req_id"), F.nullif("artist", F.lit("")).alias("artist"), F.when(F.col("artist").rlike("^[0-9]*$") & ~F.col("track").contains("#"), F.concat_ws("", F.substring("track", 1, 1), F.lit("zq"))).otherwise(F.substring_index("track", "#", -1)).alias("album"))
    found = releases.search_tiers(releases.searchable(asked.withColumn("track", _no())), _with_remote(spark, sf_dir), K)
    return found.select("req_id", "release_id", "title", "artist_name", "artwork_url", F.round("score", 6).alias("score"), "confidence", "rank", "source")


def release_nested(spark, sf_dir):
    docs = releases.documents(views.store(spark, sf_dir))
    shown = F.array_join(F.transform("tracklist", lambda t: F.concat_ws("|", t["sequence"].cast("string"), t["title"], t["duration"], F.array_join(t["artists"], "&"))), ";")
    return docs.select("release_id", "title", "release_year", "artist", "artist_id", "label_id", shown.alias("tracks"))


def validate_track(spark, sf_dir):
    """Each order's first part and first artist against the order's tracks."""
    store = views.store(spark, sf_dir)
    asked = store.release.select(F.col("id").alias("release_id"), F.col("title").alias("track")).join(store.artist.select("release_id", F.col("artist_name").alias("artist")), "release_id")
    return releases.validate(asked, releases.documents(store)).select("release_id", "track", "artist", "valid")


def fallback_images(spark, sf_dir):
    store = views.store(spark, sf_dir)
    return releases.fallback_images(store.release.select(F.col("id").alias("release_id")), store)


def _new_releases(spark, sf_dir):
    return views.release(spark, sf_dir).where("release_year >= 1998").withColumn("title", F.upper("title"))


def upsert_release(spark, sf_dir):
    return releases.upsert(views.release(spark, sf_dir), _new_releases(spark, sf_dir), ["id"])


def upsert_merged(spark, sf_dir):
    """The same upsert into a table in buckets, of which those with new releases are written anew."""
    path = f"{Scratch(spark, 'bucketed').base}/release"
    sinks.create_bucketed(views.release(spark, sf_dir), path, ["id"], 16)
    sinks.merge_bucketed(_new_releases(spark, sf_dir), path, ["id"], 16)
    return spark.read.parquet(path).drop("_bucket")


def insert_if_absent(spark, sf_dir):
    old = views.release(spark, sf_dir).where("release_year < 1997")
    return releases.insert_absent(old, _new_releases(spark, sf_dir), ["id"])


def replace_children(spark, sf_dir):
    old = views.release_track(spark, sf_dir)
    new = old.where("release_id % 3 = 0 AND sequence = 1").withColumn("title", F.upper("title"))
    return releases.replace_children(old, new, "release_id").select("release_id", "sequence", "position", "title", "duration")


def upsert_cached(spark, sf_dir):
    """Releases cached by a dump, and those of later years cached again."""
    old = views.release(spark, sf_dir).select(F.col("id").alias("release_id"), F.lit("dump").alias("source"), F.make_timestamp(F.col("release_year"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("cached_at"))
    new = _new_releases(spark, sf_dir).select(F.col("id").alias("release_id"))
    found = sinks.upsert_cached(old, new, ["release_id"], now=F.lit("2024-05-06 07:08:09").cast("timestamp"))
    return found.select("release_id", "source", F.date_format("cached_at", "yyyy-MM-dd HH:mm:ss").alias("cached_at"))


def telemetry(spark, sf_dir):
    """Events as a batch's steps and their milliseconds."""
    return sinks.telemetry(views.table(spark, sf_dir, "events").select(F.col("event_type").alias("step"), F.col("value").alias("ms")))


def _events(function):
    def query(spark, sf_dir):
        return function(views.table(spark, sf_dir, "events"))

    return query


QUERIES = {f.__name__: f for f in (releases_by_track, releases_by_track_artist, releases_for_track, release_search_album, release_search_artist, release_search_both, search_guard, remote_rows, remote_keywords, remote_strict, remote_supplement, releases_by_track_tiers, release_search_tiers, release_nested, validate_track, fallback_images, upsert_release, upsert_merged, insert_if_absent, upsert_cached, telemetry, replace_children)} | {
    "counters": _events(events.counters),
    "health_rollup": _events(events.health),
    "ttl_cache_hits": _events(events.cache_hits),
    "rate_window": _events(events.rates),
}

_PART = """CASE WHEN {a} = '' OR {b} = '' THEN 0 WHEN {a} = {b} THEN 4 WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 3 ELSE 0 END"""


def search_ctes(asked: str, out: str, k: int = 5) -> str:
    """CTEs that end with `out` (req_id, release_id, title, artist_name, artwork_url, score, confidence, rank) for the CTE asked (req_id, artist, album)."""
    tenths = f"{_PART.format(a='qa', b='la')} + {_PART.format(a='qb', b='lt')}"
    p = f"{out}_"
    same = "req_id, release_id, title, artist_name, artwork_url, artist, album"
    return f"""{p}known AS (SELECT id AS release_id, title, artist_name, artwork_url FROM release JOIN release_artist ON release_id = id AND extra = 0),
{p}tp AS MATERIALIZED (SELECT * FROM (SELECT qb, lt, {similarity_sql('qb', 'lt')} AS s FROM (SELECT DISTINCT lower(album) AS qb FROM {asked} WHERE album IS NOT NULL), (SELECT DISTINCT lower(title) AS lt FROM {p}known)) WHERE s >= 0.3),
{p}ap AS MATERIALIZED (SELECT * FROM (SELECT qa, la, {similarity_sql('qa', 'la')} AS s FROM (SELECT DISTINCT lower(artist) AS qa FROM {asked} WHERE artist IS NOT NULL), (SELECT DISTINCT lower(artist_name) AS la FROM {p}known)) WHERE s >= 0.3),
{p}t AS (SELECT qb, k.*, s FROM {p}tp JOIN {p}known k ON lower(title) = lt QUALIFY row_number() OVER (PARTITION BY qb ORDER BY s DESC, release_id) <= {2 * k}),
{p}a AS (SELECT qa, k.*, s FROM {p}ap JOIN {p}known k ON lower(artist_name) = la QUALIFY row_number() OVER (PARTITION BY qa ORDER BY s DESC, release_id) <= {2 * k}),
{p}hits AS (SELECT {same}, s FROM {asked} JOIN {p}t ON qb = lower(album) UNION ALL SELECT {same}, s FROM {asked} JOIN {p}a ON qa = lower(artist)),
{p}one AS (SELECT {same}, max(s) AS score FROM {p}hits GROUP BY {same} QUALIFY row_number() OVER (PARTITION BY req_id, release_id ORDER BY max(s) DESC, artist_name) = 1),
{p}best AS (SELECT * FROM {p}one QUALIFY row_number() OVER (PARTITION BY req_id ORDER BY score DESC, release_id) <= {2 * k}),
{p}low AS (SELECT * FROM {p}best QUALIFY row_number() OVER (PARTITION BY req_id, lower(title) ORDER BY score DESC, release_id) = 1),
{p}five AS (SELECT * FROM {p}low QUALIFY row_number() OVER (PARTITION BY req_id ORDER BY score DESC, release_id) <= {k}),
{p}c AS (SELECT *, {tenths} AS t FROM (SELECT *, trim(lower(coalesce(artist, ''))) AS qa, trim(lower(coalesce(album, ''))) AS qb, trim(lower(artist_name)) AS la, trim(lower(title)) AS lt FROM {p}five)),
{p}d AS (SELECT *, least(CASE WHEN t >= 6 THEN t + 2 WHEN t = 0 THEN 2 ELSE t END, 10) / 10.0::DOUBLE AS confidence FROM {p}c),
{out} AS MATERIALIZED (SELECT req_id, release_id, title, artist_name, CASE WHEN artwork_url LIKE '%spacer.gif%' OR artwork_url = '' THEN NULL ELSE artwork_url END AS artwork_url, score, confidence,
 CAST(row_number() OVER (PARTITION BY req_id ORDER BY confidence DESC, score DESC, release_id) AS INTEGER) AS rank FROM {p}d)"""


def _search_sql(asked: str) -> str:
    return f"WITH {views.SQL}, asked AS ({asked}), {search_ctes('asked', 'found')} SELECT req_id, release_id, title, artist_name, artwork_url, round(CAST(score AS DOUBLE), 6) AS score, confidence, rank FROM found"


def by_track_ctes(asked: str, out: str, k: int) -> str:
    """CTEs that end with `out` (track, artist, release_id, title, artist_name, is_compilation, sim, rank) for the CTE asked (track, artist)."""
    p = f"{out}_"
    return f"""{p}p AS (SELECT low, known, {similarity_sql('low', 'known')} AS sim FROM (SELECT DISTINCT lower(track) AS low FROM {asked}), (SELECT DISTINCT lower(title) AS known FROM release_track)),
{p}h AS (SELECT DISTINCT release_id, title AS track_title, lower(title) AS known FROM release_track),
{p}b AS (SELECT low, release_id, track_title, sim FROM {p}p JOIN {p}h USING (known) WHERE sim >= 0.3 QUALIFY row_number() OVER (PARTITION BY low ORDER BY sim DESC, release_id, track_title) <= {2 * k}),
{p}n AS (SELECT low, b.release_id, track_title, sim, r.title, a.artist_name FROM {p}b b JOIN release r ON r.id = b.release_id JOIN release_artist a ON a.release_id = b.release_id AND extra = 0),
{p}s AS MATERIALIZED (SELECT x, y, {similarity_sql('x', 'y')} AS s FROM (SELECT DISTINCT lower(artist) AS x FROM {asked} WHERE artist IS NOT NULL), (SELECT DISTINCT lower(artist_name) AS y FROM {p}n)),
{p}f AS (SELECT q.track, q.artist, n.* FROM (SELECT DISTINCT track, artist FROM {asked}) q JOIN {p}n n ON low = lower(track) LEFT JOIN {p}s ON x = lower(artist) AND y = lower(artist_name) WHERE q.artist IS NULL OR s >= 0.3),
{p}o AS (SELECT * FROM {p}f QUALIFY row_number() OVER (PARTITION BY track, artist, lower(title) ORDER BY sim DESC, release_id, track_title, artist_name) = 1),
{out} AS MATERIALIZED (SELECT track, artist, release_id, title, artist_name, lower(artist_name) LIKE '%various%' AS is_compilation, sim, CAST(row_number() OVER (PARTITION BY track, artist ORDER BY sim DESC, release_id, track_title, artist_name) AS INTEGER) AS rank FROM {p}o QUALIFY rank <= {k})"""


def valid_ctes(asked: str, out: str) -> str:
    """CTEs that end with `out` (release_id, track, artist), those of the CTE asked whose release has the track by the artist."""
    p = f"{out}_"
    within = "(contains({0}, lower(artist)) OR contains(lower(artist), {0}))"
    bare = "regexp_replace(split_part(lower({}), '(', 1), '^\\s+|\\s+$', '', 'g')"
    return f"""{p}q AS (SELECT DISTINCT release_id, track, artist FROM {asked}),
{p}n AS (SELECT release_id, track_sequence, list({bare.format('artist_name')}) AS names FROM release_track_artist WHERE release_id IN (SELECT release_id FROM {p}q) GROUP BY ALL),
{p}a AS (SELECT release_id, {bare.format('min(artist_name)')} AS whose FROM release_artist WHERE extra = 0 GROUP BY release_id),
{out} AS MATERIALIZED (SELECT DISTINCT q.release_id, track, artist FROM {p}q q JOIN release_track t ON t.release_id = q.release_id LEFT JOIN {p}n n ON n.release_id = q.release_id AND n.track_sequence = t.sequence LEFT JOIN {p}a a ON a.release_id = q.release_id
 WHERE (contains(lower(t.title), lower(track)) OR contains(lower(track), lower(t.title))) AND CASE WHEN len(names) > 0 THEN len(list_filter(names, lambda x: {within.format('x')})) > 0 ELSE {within.format("coalesce(whose, '')")} END)"""


def of_track_ctes(asked: str, out: str, k: int) -> str:
    """CTEs that end with `out` (track, artist, release_id, title, artist_name, rank): by_track's releases that have the track by the artist."""
    return f"""{by_track_ctes(asked, f'{out}_by', k)}, {valid_ctes(f'{out}_by', f'{out}_valid')},
{out} AS MATERIALIZED (SELECT track, artist, release_id, title, artist_name, rank FROM {out}_by WHERE artist IS NULL OR (release_id, track, artist) IN (SELECT (release_id, track, artist) FROM {out}_valid))"""


_SONGS = "songs AS (SELECT DISTINCT title AS track, artist FROM catalog)"
_SIM = "round(CAST(sim AS DOUBLE), 6) AS sim"
_REMOTE = """remote AS (SELECT CASE WHEN id % 13 > 0 THEN id END AS id, CASE WHEN id % 9 = 0 THEN title WHEN id % 10 = 0 THEN '' ELSE artist_name || ' - ' || title END AS title, artwork_url AS thumb FROM release JOIN release_artist ON id = release_id),
listed AS (SELECT id, CASE WHEN contains(title, ' - ') THEN trim(split_part(title, ' - ', 1)) ELSE '' END AS artist, CASE WHEN contains(title, ' - ') THEN trim(title[instr(title, ' - ') + 3:]) ELSE title END AS album,
 CASE WHEN thumb NOT LIKE '%spacer.gif%' THEN thumb END AS thumb FROM remote WHERE id IS NOT NULL AND title <> '')"""
_TOK = r"list_filter(regexp_split_to_array(lower(strip_accents({})), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def _albums_once(source: str, key: str, order: str, k: int = 5) -> str:
    return f"SELECT *, CAST(row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS INTEGER) AS rank FROM (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY {key}, lower(album) ORDER BY {order}) = 1) QUALIFY rank <= {k}"


def _keyword_ctes(asked: str) -> str:
    return f"""km AS (SELECT query, l.* FROM (SELECT DISTINCT query FROM {asked}) JOIN listed l ON list_has_all(list_concat({_TOK.format('album')}, {_TOK.format('artist')}), {_TOK.format('query')}) QUALIFY row_number() OVER (PARTITION BY query ORDER BY id) <= 10),
keyword AS ({_albums_once('km', 'query', 'id')})"""


_STRICT = f"""fields AS (SELECT id AS req_id, CASE WHEN id % 4 <> 1 THEN artist END AS artist, CASE WHEN id % 4 > 0 THEN title END AS album, CASE WHEN id % 4 = 3 THEN title END AS track FROM catalog),
shapes AS (SELECT DISTINCT artist, album, track FROM fields), tl AS (SELECT id, artist, album, thumb, {_TOK.format('artist')} AS ta, {_TOK.format('album')} AS tb FROM listed),
tt AS (SELECT DISTINCT release_id, {_TOK.format('title')} AS t FROM release_track),
sm AS (SELECT s.artist AS qa, s.album AS qb, s.track AS qt, l.id, l.artist, l.album, l.thumb FROM shapes s JOIN tl l ON (s.artist IS NULL OR list_has_all(ta, {_TOK.format('s.artist')})) AND (s.album IS NULL OR list_has_all(tb, {_TOK.format('s.album')}))
 WHERE s.track IS NULL OR EXISTS (SELECT 1 FROM tt WHERE release_id = l.id AND list_has_all(t, {_TOK.format('s.track')}))),
so AS ({_albums_once('sm', 'qa, qb, qt', 'id')}),
strict AS (SELECT req_id, so.id, so.artist, so.album, so.thumb, rank FROM fields f JOIN so ON f.artist IS NOT DISTINCT FROM qa AND f.album IS NOT DISTINCT FROM qb AND f.track IS NOT DISTINCT FROM qt)"""

_HARD = "hard AS (SELECT DISTINCT unnest([title, title, artist, artist]) AS track, unnest([artist, regexp_extract(artist, '[0-9]+$'), regexp_extract(artist, '[0-9]+$'), NULL]) AS artist FROM catalog)"
#: The views with the store's even releases alone, and the remote search's rows of all.
_EVEN = views.SQL.replace("release AS (", "all_release AS (").replace("release_artist AS (", "all_artist AS (").rstrip() + f""",
release AS (SELECT * FROM all_release WHERE id % 2 = 0), release_artist AS (SELECT * FROM all_artist WHERE release_id % 2 = 0), {_REMOTE.replace('FROM release JOIN release_artist', 'FROM all_release JOIN all_artist')},
tl AS MATERIALIZED (SELECT id, artist, album, thumb, {_TOK.format('artist')} AS ta, {_TOK.format('album')} AS tb FROM listed), tt AS MATERIALIZED (SELECT DISTINCT release_id, {_TOK.format('title')} AS t FROM release_track)"""
_COMPILED = " OR ".join(f"contains(lower(artist_name), '{w}')" for w in COMPILATION_KEYWORDS)


def _words_ctes(asked: str, k: int) -> str:
    """kw (key, id, artist, album, thumb, rank): rows with all words q of asked (key, q)."""
    return f"""km AS (SELECT a.key, tl.* FROM {asked} a JOIN tl ON len(q) > 0 AND list_has_all(list_concat(tb, ta), q) QUALIFY row_number() OVER (PARTITION BY key ORDER BY id) <= {2 * k}), kw AS ({_albums_once('km', 'key', 'id', k)})"""


_TIERS = f"""open_ AS (SELECT track, h.artist, to_json([track, h.artist]) AS key FROM hard h WHERE track <> '' AND NOT EXISTS (SELECT 1 FROM found f WHERE f.track = h.track AND f.artist IS NOT DISTINCT FROM h.artist)),
sm AS (SELECT key, tl.* FROM open_ o JOIN tl ON nullif(o.artist, '') IS NULL OR len({_TOK.format('o.artist')}) > 0 AND list_has_all(ta, {_TOK.format('o.artist')}) WHERE EXISTS (SELECT 1 FROM tt WHERE release_id = tl.id AND len({_TOK.format('o.track')}) > 0 AND list_has_all(t, {_TOK.format('o.track')}))),
st AS ({_albums_once('sm', 'key', 'id', 10)}), few AS (SELECT key, {_TOK.format("concat_ws(' ', track, artist)")} AS q FROM open_ WHERE (SELECT count(*) FROM st WHERE st.key = open_.key) < 3), {_words_ctes('few', 10)},
u AS (SELECT key, id, artist, album, thumb, 1 AS way, rank AS place FROM st UNION ALL SELECT key, id, artist, album, thumb, 2, rank FROM kw), s AS ({_albums_once('u', 'key', 'way, place', 10)})"""
_SEARCH_TIERS = f"""open_ AS (SELECT * FROM asked WHERE req_id NOT IN (SELECT req_id FROM found)),
sm AS (SELECT req_id AS key, tl.* FROM open_ o JOIN tl ON (o.artist IS NULL OR len({_TOK.format('o.artist')}) > 0 AND list_has_all(ta, {_TOK.format('o.artist')})) AND (o.album IS NULL OR len({_TOK.format('o.album')}) > 0 AND list_has_all(tb, {_TOK.format('o.album')}))),
st AS ({_albums_once('sm', 'key', 'id', 5)}), few AS (SELECT req_id AS key, {_TOK.format("concat_ws(' ', artist, album)")} AS q FROM open_ WHERE req_id NOT IN (SELECT key FROM st)), {_words_ctes('few', 5)},
u AS (SELECT key, id, artist AS artist_name, album AS title, thumb, rank AS place FROM st UNION ALL SELECT key, id, artist, album, thumb, rank FROM kw),
c AS (SELECT *, {_PART.format(a='qa', b='la')} + {_PART.format(a='qb', b='lt')} AS t FROM (SELECT u.*, trim(lower(coalesce(o.artist, ''))) AS qa, trim(lower(coalesce(o.album, ''))) AS qb, trim(lower(artist_name)) AS la, trim(lower(title)) AS lt FROM u JOIN open_ o ON o.req_id = key)),
d AS (SELECT *, least(CASE WHEN t >= 6 THEN t + 2 WHEN t = 0 THEN 2 ELSE t END, 10) / 10.0::DOUBLE AS confidence FROM c)"""

ORACLE_SQL = {
    "releases_by_track_tiers": f"""WITH {_EVEN}, {_HARD}, {by_track_ctes('hard', 'found', 10)}, {_TIERS}
SELECT track, artist, release_id, title, artist_name, is_compilation, {_SIM}, rank, 'store' AS source FROM found UNION ALL
SELECT track, artist, id, album, artist_name, {_COMPILED}, NULL, rank, 'remote' FROM (SELECT track, o.artist, id, album, s.artist AS artist_name, rank FROM open_ o JOIN s USING (key))""",
    "release_search_tiers": f"""WITH {_EVEN}, {_HARD}, asked AS (SELECT DISTINCT req_id, nullif(artist, '') AS artist, nullif(album, '') AS album FROM (SELECT track || '|' || coalesce(artist, '-') AS req_id, artist, CASE WHEN regexp_matches(artist, '^[0-9]*$') AND NOT contains(track, '#') THEN track[1:1] || 'zq' ELSE split_part(track, '#', -1) END AS album FROM hard) WHERE coalesce(nullif(artist, ''), nullif(album, '')) IS NOT NULL),
{search_ctes('asked', 'found')}, {_SEARCH_TIERS}
SELECT req_id, release_id, title, artist_name, artwork_url, round(CAST(score AS DOUBLE), 6) AS score, confidence, rank, 'store' AS source FROM found UNION ALL
SELECT key, id, title, artist_name, thumb, NULL, confidence, CAST(row_number() OVER (PARTITION BY key ORDER BY confidence DESC, place) AS INTEGER), 'remote' FROM d""",
    "releases_by_track": f"WITH {views.SQL}, asked AS (SELECT DISTINCT title AS track, CAST(NULL AS VARCHAR) AS artist FROM catalog), {by_track_ctes('asked', 'found', 20)} SELECT track, release_id, title, artist_name, is_compilation, {_SIM}, rank FROM found",
    "releases_by_track_artist": f"WITH {views.SQL}, {_SONGS}, {by_track_ctes('songs', 'found', 10)} SELECT track, artist, release_id, title, artist_name, is_compilation, {_SIM}, rank FROM found",
    "releases_for_track": f"WITH {views.SQL}, {_SONGS}, {of_track_ctes('songs', 'found', 10)} SELECT track, artist, release_id, title, artist_name, rank FROM found",
    "release_search_album": _search_sql("SELECT DISTINCT title AS req_id, CAST(NULL AS VARCHAR) AS artist, title AS album FROM catalog"),
    "release_search_artist": _search_sql("SELECT artist AS req_id, artist, CAST(NULL AS VARCHAR) AS album FROM (SELECT s_name AS artist FROM supplier UNION SELECT artist FROM catalog)"),
    "release_search_both": _search_sql("SELECT DISTINCT artist || ' - ' || title AS req_id, artist, title AS album FROM catalog"),
    "search_guard": f"WITH {views.SQL} SELECT req_id, nullif(artist, '') AS artist, coalesce(nullif(album, ''), nullif(song, '')) AS album FROM requests WHERE coalesce(nullif(artist, ''), nullif(album, ''), nullif(song, '')) IS NOT NULL",
    "remote_rows": f"WITH {views.SQL}, {_REMOTE} SELECT * FROM listed",
    "remote_keywords": f"WITH {views.SQL}, {_SONGS}, {_REMOTE}, asked AS (SELECT replace(track || ' ' || artist, '#', ' ') AS query FROM songs), {_keyword_ctes('asked')} SELECT query, id, artist, album, thumb, rank FROM keyword",
    "remote_strict": f"WITH {views.SQL}, {_REMOTE}, {_STRICT} SELECT * FROM strict",
    "remote_supplement": f"""WITH {views.SQL}, {_REMOTE}, {_STRICT}, asked AS (SELECT req_id, replace(concat_ws(' ', album, artist), '#', ' ') AS query FROM fields), {_keyword_ctes('asked')},
u AS (SELECT req_id, id, artist, album, thumb, 1 AS way, rank AS place FROM strict UNION ALL SELECT req_id, k.id, k.artist, k.album, k.thumb, 2, k.rank FROM asked JOIN keyword k USING (query) WHERE (SELECT count(*) FROM strict s WHERE s.req_id = asked.req_id) < 3)
SELECT req_id, id, artist, album, thumb, rank FROM ({_albums_once('u', 'req_id', 'way, place')})""",
    "fallback_images": f"WITH {views.SQL} SELECT id AS release_id, coalesce(a.image, l.image) AS image FROM release LEFT JOIN artist_image a USING (artist_id) LEFT JOIN label_image l USING (label_id)",
    "upsert_cached": f"WITH {views.SQL} SELECT id AS release_id, CASE WHEN release_year >= 1998 THEN 'api_fetch' ELSE 'dump' END AS source, CASE WHEN release_year >= 1998 THEN '2024-05-06 07:08:09' ELSE release_year || '-01-01 00:00:00' END AS cached_at FROM release",
    "telemetry": "SELECT event_type AS step, count(*) AS calls, round(sum(value), 4) AS ms FROM events GROUP BY 1 UNION ALL SELECT 'total', count(*), round(sum(value), 4) FROM events",
    "release_nested": f"""WITH {views.SQL}, n AS (SELECT release_id, track_sequence, array_to_string(list(artist_name ORDER BY artist_name), '&') AS artists FROM release_track_artist GROUP BY ALL),
t AS (SELECT t.release_id, string_agg(sequence || '|' || title || '|' || duration || '|' || coalesce(artists, ''), ';' ORDER BY sequence) AS tracks FROM release_track t LEFT JOIN n ON n.release_id = t.release_id AND n.track_sequence = t.sequence GROUP BY t.release_id)
SELECT r.id AS release_id, r.title, r.release_year, a.artist_name AS artist, r.artist_id, r.label_id, coalesce(t.tracks, '') AS tracks FROM release r LEFT JOIN release_artist a ON a.release_id = r.id LEFT JOIN t ON t.release_id = r.id""",
    "validate_track": f"""WITH {views.SQL}, q AS (SELECT r.id AS release_id, r.title AS track, a.artist_name AS artist FROM release r JOIN release_artist a ON a.release_id = r.id), {valid_ctes('q', 'v')}
SELECT q.*, (release_id, track, artist) IN (SELECT (release_id, track, artist) FROM v) AS valid FROM q""",
    "upsert_release": f"WITH {views.SQL} SELECT id, CASE WHEN release_year >= 1998 THEN upper(title) ELSE title END AS title, release_year, artwork_url, artist_id, label_id FROM release",
    "upsert_merged": f"WITH {views.SQL} SELECT id, CASE WHEN release_year >= 1998 THEN upper(title) ELSE title END AS title, release_year, artwork_url, artist_id, label_id FROM release",
    "insert_if_absent": f"WITH {views.SQL} SELECT id, CASE WHEN release_year >= 1998 THEN upper(title) ELSE title END AS title, release_year, artwork_url, artist_id, label_id FROM release WHERE release_year < 1997 OR release_year >= 1998",
    "replace_children": f"WITH {views.SQL} SELECT release_id, sequence, position, CASE WHEN release_id % 3 = 0 THEN upper(title) ELSE title END AS title, duration FROM release_track WHERE release_id % 3 <> 0 OR sequence = 1",
    "counters": """SELECT user_id, count(*) FILTER (event_type = 'view') AS memory_hits, count(*) FILTER (event_type = 'click') AS pg_hits, count(*) FILTER (event_type = 'error') AS pg_misses,
 count(*) FILTER (event_type IN ('purchase', 'signup')) AS api_calls, round(sum(CASE WHEN event_type IN ('click', 'error') THEN value ELSE 0 END), 4) AS pg_time_ms,
 round(sum(CASE WHEN event_type IN ('purchase', 'signup') THEN value ELSE 0 END), 4) AS api_time_ms FROM events GROUP BY user_id""",
    "health_rollup": "SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN NOT bool_or(event_type = 'error') THEN 'healthy' WHEN bool_and(event_type = 'error') THEN 'unhealthy' ELSE 'degraded' END AS status FROM events GROUP BY 1",
    "ttl_cache_hits": "SELECT event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) <= 3600000000, false) AS hit FROM events",
    "rate_window": "SELECT event_id, count(*) OVER w AS in_window, count(*) OVER w <= 50 AS allowed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW)",
}
