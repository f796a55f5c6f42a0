"""Lookup of a batch of requests: correction, albums of songs, strategies in order, validation, artwork and context, as plans over all requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import catalog as search
from lodestone.operators import strategies
from lodestone.operators.ranking import top_k
from lodestone.operators.strategies import K
from lodestone.plans.release_queries import of_track_ctes, search_ctes, valid_ctes
from lodestone.plans.search_queries import _FLAT, _FUZZY_WHOLE, _WORDS, ALBUMS_SQL, cascade_sql, correction_sql, words_sql
from lodestone.sources import views
from lodestone.sources.scratch import Scratch, Steps
from lodestone.sources.views import Store


def corrected(requests: DataFrame, catalog: DataFrame, artists: int | None = search.ARTISTS) -> DataFrame:
    """Requests with the artist corrected where a near one is known, as `correct_artist` looks at them; corrected_artist says to what."""
    right = search.correct_artist(requests.select("artist"), catalog, artists=artists).withColumnRenamed("corrected", "corrected_artist")
    return requests.join(right, "artist", "left").withColumn("artist", F.coalesce("corrected_artist", "artist"))


def lookup(requests: DataFrame, catalog: DataFrame, store: Store, k: int = K, steps: Steps | None = None) -> DataFrame:
    """A row for each result of a request, or one without a result.

    req_id, rank, id, title and artist; release_id, album, release_artist,
    artwork_url and confidence of the release that goes with it; and for the
    request search_type, song_not_found, found_on_compilation, context and
    corrected_artist. With steps, each step's rows and milliseconds are told.
    """
    scratch, catalog = Scratch(requests.sparkSession, "lookup", steps), search.searchable(catalog)
    known = scratch.put(corrected(requests, catalog), "correction")
    asked = known.drop("corrected_artist")
    albums = scratch.put(strategies.resolve_albums(asked, store), "albums")
    # one search for the texts of all strategies; fuzzy search scores all rows that hold a start
    catalog = search.Searched(catalog, strategies.texts(asked, albums), k, None)
    state, rows = strategies.run_strategies(asked, albums, catalog, store, steps=steps)
    rows = scratch.put(top_k(rows, ["req_id"], [F.col("place")], k).drop("place"), "search")
    # of results that stand in for the song, those that have it count alone, if there are any
    open_ = state.where("song_not_found")
    # one search of the store for validation and artwork
    found = scratch.put(strategies.releases_for(rows, open_, catalog, store))
    good = scratch.put(strategies.validated(rows, open_, catalog, store, found), "validation")
    sure = good.select("req_id").distinct().withColumn("confirmed", F.lit(True))
    state = scratch.put(state.join(sure, "req_id", "left").withColumn("confirmed", F.coalesce("confirmed", F.lit(False))).withColumn("song_not_found", F.col("song_not_found") & ~F.col("confirmed")))
    kept = rows.join(state.where("confirmed").select("req_id"), "req_id", "left_anti").unionByName(rows.join(good, ["req_id", "id"], "left_semi"))
    shown = scratch.put(strategies.artwork(top_k(kept.withColumnRenamed("rank", "place"), ["req_id"], [F.col("place")], k).drop("place"), catalog, store, found).drop("release_title"), "artwork")
    named = shown.withColumnRenamed("album", "release_album").join(catalog.select("id", "title", F.col("artist").alias("known")), "id")
    whole = state.join(known.select("req_id", "corrected_artist"), "req_id").join(named, "req_id", "left")
    on_compilation = F.coalesce(F.col("found") == "track_on_compilation", F.lit(False))
    return whole.select(
        "req_id",
        "rank",
        "id",
        "title",
        F.col("known").alias("artist"),
        "release_id",
        F.col("release_album").alias("album"),
        "release_artist",
        "artwork_url",
        "confidence",
        # before validation a search that fell back is called so
        strategies.search_type(F.col("found"), F.col("last"), F.col("song_not_found") | F.col("confirmed")).alias("search_type"),
        "song_not_found",
        on_compilation.alias("found_on_compilation"),
        strategies.context_message(on_compilation, F.col("song_not_found"), F.col("id").isNotNull(), F.col("artist"), F.col("song"), F.col("album")).alias("context"),
        "corrected_artist",
    )


def _requests(spark, sf_dir: str, artists: int | None = search.ARTISTS) -> tuple[DataFrame, DataFrame]:
    """Corrected requests and the catalog."""
    catalog = search.searchable(views.catalog(spark, sf_dir))
    return Scratch(spark, "requests").put(corrected(views.requests(spark, sf_dir), catalog, artists)), catalog


def _written(spark, sf_dir: str) -> Store:
    """The store with its releases and tracks written once, as a lookup searches them several times."""
    scratch, store = Scratch(spark, "store"), views.store(spark, sf_dir)
    return Store(*map(scratch.put, store[:4]), *store[4:])


def lookup_e2e(spark, sf_dir: str) -> DataFrame:
    return lookup(views.requests(spark, sf_dir), views.catalog(spark, sf_dir), _written(spark, sf_dir))


def lookup_steps(spark, sf_dir: str) -> DataFrame:
    """(step, calls, rows) of a lookup of all requests, as its own steps tell of themselves."""
    steps = Steps(spark)
    lookup(views.requests(spark, sf_dir), views.catalog(spark, sf_dir), _written(spark, sf_dir), steps=steps)
    return steps.frame().groupBy("step").agg(F.count("*").alias("calls"), F.sum("rows").alias("rows"))


def lookup_response(spark, sf_dir: str) -> DataFrame:
    """The responses to all requests as documents: how many results each has and what the first is."""
    from lodestone.sources.sinks import responses

    found = responses(lookup_e2e(spark, sf_dir))
    value = lambda path: F.get_json_object("response", path)
    return found.select("req_id", value("$.total").cast("long").alias("total"), value("$.results[0].id").cast("long").alias("first_id"), value("$.results[0].artwork.artwork_url").alias("first_image"), value("$.search_type").alias("search_type"), value("$.context").alias("context"))


def album_resolution(spark, sf_dir: str) -> DataFrame:
    asked, _ = _requests(spark, sf_dir)
    return strategies.resolve_albums(asked, views.store(spark, sf_dir))


def _rows(found: DataFrame) -> DataFrame:
    return found.select("req_id", "id", "place", "release_title", "fallback")


def with_fallback(spark, sf_dir: str) -> DataFrame:
    """Corrected by all artists of a block."""
    asked, catalog = _requests(spark, sf_dir, None)
    albums = Scratch(spark, "albums").put(strategies.resolve_albums(asked, views.store(spark, sf_dir)))
    return _rows(strategies.with_fallback(asked, albums, catalog))


def swapped(spark, sf_dir: str) -> DataFrame:
    """Every message read both ways, whatever else its request says."""
    asked, catalog = _requests(spark, sf_dir)
    return _rows(strategies.swapped(asked, catalog))


def compilation(spark, sf_dir: str) -> DataFrame:
    """All requests for a song by an artist, whether or not something else is found."""
    asked, catalog = _requests(spark, sf_dir)
    return _rows(strategies.track_on_compilation(asked, catalog, views.store(spark, sf_dir)))


def song_as_artist(spark, sf_dir: str) -> DataFrame:
    asked, catalog = _requests(spark, sf_dir)
    return _rows(strategies.song_as_artist(asked.where("artist IS NULL"), catalog, views.store(spark, sf_dir)))


def track_validation(spark, sf_dir: str) -> DataFrame:
    """Requests for a song against the catalog row of their number."""
    asked, catalog = _requests(spark, sf_dir)
    return strategies.validated(asked.select("req_id", F.col("req_id").alias("id")), asked, catalog, views.store(spark, sf_dir))


def artwork_enrich(spark, sf_dir: str) -> DataFrame:
    """Every catalog row, those with an even number as led to by a release of that title in capitals."""
    catalog = views.catalog(spark, sf_dir)
    rows = catalog.select(F.col("id").alias("req_id"), "id", F.when(F.col("id") % 2 == 0, F.upper("title")).alias("release_title"))
    found = strategies.artwork(rows, catalog, views.store(spark, sf_dir))
    return found.select("id", "release_id", "album", "release_artist", "artwork_url", "confidence")


def _flags(spark, sf_dir: str) -> DataFrame:
    """Requests with each mix of what a search may have come to, by their number."""
    n = F.col("req_id")
    name = F.when(n % 7 == 0, "track_on_compilation").when(n % 7 < 3, "artist_plus_album").when(n % 7 == 3, "swapped_interpretation").when(n % 7 == 4, "song_as_artist")
    return views.requests(spark, sf_dir).select("*", name.alias("last"), F.when(n % 2 == 0, name).alias("found"), (n % 3 == 0).alias("missing"), (n % 4 > 0).alias("some"))


def context_message(spark, sf_dir: str) -> DataFrame:
    on_compilation = F.coalesce(F.col("found") == "track_on_compilation", F.lit(False))
    # the artist goes by the song's name where none is given
    said = strategies.context_message(on_compilation, F.col("missing"), F.col("some"), F.coalesce("artist", "song"), F.coalesce("song", "album"), F.col("album"))
    return _flags(spark, sf_dir).select("req_id", said.alias("context"))


def search_type(spark, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir).select("req_id", strategies.search_type(F.col("found"), F.col("last"), F.col("missing")).alias("search_type"))


QUERIES = {f.__name__: f for f in (lookup_e2e, lookup_steps, lookup_response, album_resolution, with_fallback, swapped, compilation, song_as_artist, track_validation, artwork_enrich, context_message, search_type)}


def _fixed(most: int | None = search.ARTISTS) -> str:
    """CTEs of corrected requests."""
    return f"""{correction_sql('requests', 'right_', most)},
fixed AS MATERIALIZED (SELECT r.req_id, coalesce(c.corrected, r.artist) AS artist, r.song, r.album, r.raw_message, c.corrected AS corrected_artist FROM requests r LEFT JOIN right_ c USING (artist))"""


#: Corrected requests, albums for their search, and what is asked of the store for them.
_FIXED = _fixed()
_NORM = "lower(strip_accents({}))"
_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_STARTS = f"starts_with({_NORM.format('{}')}, {_NORM.format('{}')})"
_COMPILATION = f"regexp_matches(lower({{}}), '{'|'.join(w.replace('.', '[.]') for w in text.COMPILATION_KEYWORDS)}')"
_UNKNOWN = f"song <> '' AND artist <> '' AND (coalesce(album, '') = '' OR {_TRIM.format(_NORM.format('album'))} = {_TRIM.format(_NORM.format('artist'))})"
_RESOLVED = f"""unknown AS (SELECT req_id, song AS track, artist FROM fixed WHERE {_UNKNOWN}), {of_track_ctes('unknown', 'own', 10)},
albums_for AS MATERIALIZED (SELECT req_id, 1 AS place, album FROM fixed WHERE album <> '' AND req_id NOT IN (SELECT req_id FROM unknown)
 UNION ALL SELECT req_id, min(rank), title FROM unknown JOIN own USING (track, artist) WHERE {_STARTS.format('artist_name', 'artist')} GROUP BY req_id, title)"""
_PARTS = f"""parts AS (SELECT req_id, CASE WHEN f <> '' AND s <> '' THEN f WHEN d > 0 AND o <> '' AND t <> '' THEN o END AS part1, CASE WHEN f <> '' AND s <> '' THEN s WHEN d > 0 AND o <> '' AND t <> '' THEN t END AS part2 FROM
 (SELECT req_id, {_TRIM.format("CASE WHEN a <> '' AND b <> '' THEN a ELSE c END")} AS f, {_TRIM.format("CASE WHEN a <> '' AND b <> '' THEN b ELSE e END")} AS s, instr(x, '. ') AS d, {_TRIM.format("x[1:instr(x, '. ') - 1]")} AS o, {_TRIM.format("x[instr(x, '. ') + 2:]")} AS t FROM
  (SELECT req_id, raw_message AS x, {', '.join(f"regexp_extract(raw_message, '{text.DASHED}', {i}) AS {n}" for i, n in enumerate('abce', 1))} FROM fixed)))"""
_FALLBACK_ASKED = """way_texts AS MATERIALIZED (SELECT req_id, f.artist, 0 AS way, a.place AS step, a.album AS wanted, f.artist || ' ' || a.album AS query FROM fixed f JOIN albums_for a USING (req_id) WHERE f.artist <> ''
 UNION ALL SELECT req_id, artist, 1, 1, song, artist || ' ' || song FROM fixed WHERE artist <> '' AND song <> '' UNION ALL SELECT req_id, artist, 2, 1, NULL, artist FROM fixed WHERE artist <> '')"""
_OVERLAP = f"CASE WHEN len({_WORDS.format('c.title', 2)}) <= 2 THEN starts_with({_FLAT.format('wanted')}, {_FLAT.format('c.title')}) ELSE len(list_intersect({_WORDS.format('wanted', 2)}, {_WORDS.format('c.title', 2)})) >= 2 END"
_FALLBACK = f"""way_rows AS (SELECT w.*, h.id, h.rank AS found, c.title FROM way_texts w JOIN hits h USING (query) JOIN catalog c USING (id) WHERE {_STARTS.format('c.artist', 'w.artist')} AND (way > 0 OR {_OVERLAP})),
way_best AS (SELECT * FROM way_rows QUALIFY way = min(way) OVER (PARTITION BY req_id)), way_once AS (SELECT * FROM way_best QUALIFY row_number() OVER (PARTITION BY req_id, id ORDER BY step, found) = 1),
fallback_found AS MATERIALIZED (SELECT req_id, id, CAST(row_number() OVER (PARTITION BY req_id ORDER BY coalesce(contains(lower(title), lower(CASE WHEN way = 0 THEN p.album ELSE wanted END)), false) DESC, step, found) AS INTEGER) AS place, CAST(NULL AS VARCHAR) AS release_title, way > 0 AS fallback
 FROM way_once LEFT JOIN (SELECT req_id, arg_min(album, place) AS album FROM albums_for GROUP BY 1) p USING (req_id) QUALIFY place <= 5)"""
_SWAP_ASKED = "swap_texts AS (SELECT req_id, 1 AS way, part1 AS artist, part1 || ' ' || part2 AS query FROM parts WHERE part1 IS NOT NULL UNION ALL SELECT req_id, 2, part2, part2 || ' ' || part1 FROM parts WHERE part1 IS NOT NULL)"
_SWAP = f"""swap_once AS (SELECT req_id, id, way, h.rank AS found FROM swap_texts s JOIN hits h USING (query) JOIN catalog c USING (id) WHERE {_STARTS.format('c.artist', 's.artist')} QUALIFY row_number() OVER (PARTITION BY req_id, id ORDER BY way, h.rank) = 1),
swap_found AS MATERIALIZED (SELECT req_id, id, CAST(row_number() OVER (PARTITION BY req_id ORDER BY way, found) AS INTEGER) AS place, CAST(NULL AS VARCHAR) AS release_title, false AS fallback FROM swap_once QUALIFY place <= 5)"""
_VERSION = f"regexp_extract(lower(raw_message), '{text.VERSION}', 1)"
_SONG_ASKED = f"""song_asked AS MATERIALIZED (SELECT req_id, artist, song, CASE WHEN {_VERSION} <> '' AND contains(lower(raw_message), lower(song)) THEN song || ' (' || {_VERSION} || ')' ELSE song END AS track,
 array_to_string(list_concat({_WORDS.format('artist', 3)}[1:2], {_WORDS.format('song', 3)}[1:2]), ' ') AS words FROM fixed WHERE artist <> '' AND song <> ''), {of_track_ctes('song_asked', 'on_', 20)},
song_albums AS MATERIALIZED (SELECT req_id, artist, song, rank AS step, artist_name AS whose, title AS album FROM song_asked JOIN on_ USING (track, artist) WHERE trim(lower(title)) <> trim(lower(artist)) AND length(trim(title)) >= 3),
album_names AS (SELECT DISTINCT album FROM song_albums), {words_sql('album_names')}"""
_COMPILED = f"""{ALBUMS_SQL}, comp_rows AS (SELECT s.req_id, s.song, s.step, s.album, a.id, a.rank AS found, c.title FROM song_albums s JOIN album_hits a USING (album) JOIN catalog c USING (id)
 WHERE {_STARTS.format('c.artist', 's.artist')} OR ({_COMPILATION.format('s.whose')} AND {_COMPILATION.format('c.artist')})),
comp_once AS (SELECT * FROM comp_rows QUALIFY row_number() OVER (PARTITION BY req_id, id ORDER BY step, found) = 1),
comp_kept AS MATERIALIZED (SELECT * FROM comp_once o WHERE (SELECT count(*) FROM comp_once p WHERE p.req_id = o.req_id AND p.step < o.step) < 5),
comp_found AS MATERIALIZED (SELECT req_id, id, CAST(row_number() OVER (PARTITION BY req_id ORDER BY contains(lower(title), lower(song)) DESC, step, found) AS INTEGER) AS place, album AS release_title, false AS fallback FROM comp_kept QUALIFY place <= 5
 UNION ALL SELECT req_id, h.id, 1, NULL, false FROM song_asked s JOIN hits h ON h.query = s.words JOIN catalog c ON c.id = h.id WHERE s.words <> '' AND req_id NOT IN (SELECT req_id FROM comp_kept) AND ({_STARTS.format('c.artist', 's.artist')} OR {_COMPILATION.format('c.artist')})
  QUALIFY row_number() OVER (PARTITION BY req_id ORDER BY h.rank) = 1)"""
_NAME_ASKED = f"""names AS (SELECT DISTINCT song AS req_id, song AS artist, CAST(NULL AS VARCHAR) AS album FROM fixed WHERE song <> '' AND artist IS NULL), {search_ctes('names', 'by_name', 10)}"""
_NAMED = f"""name_direct AS (SELECT req_id, h.id, h.rank AS found FROM fixed f JOIN hits h ON h.query = f.song JOIN catalog c ON c.id = h.id WHERE f.song <> '' AND f.artist IS NULL AND {_STARTS.format('c.artist', 'f.song')}),
name_rows AS (SELECT f.req_id, h.id, b.rank AS step, h.rank AS found FROM fixed f JOIN by_name b ON b.req_id = f.song JOIN hits h ON h.query = b.title JOIN catalog c ON c.id = h.id
 WHERE f.artist IS NULL AND f.req_id NOT IN (SELECT req_id FROM name_direct) AND ({_STARTS.format('c.artist', 'f.song')} OR {_COMPILATION.format('c.artist')})),
name_once AS (SELECT * FROM name_rows QUALIFY row_number() OVER (PARTITION BY req_id, id ORDER BY step, found) = 1),
name_found AS MATERIALIZED (SELECT req_id, id, CAST(row_number() OVER (PARTITION BY req_id ORDER BY step, found) AS INTEGER) AS place, CAST(NULL AS VARCHAR) AS release_title, false AS fallback FROM (SELECT req_id, id, 0 AS step, found FROM name_direct UNION ALL SELECT * FROM name_once) QUALIFY place <= 5)"""


def _validated_ctes(items: str, out: str) -> str:
    """CTEs that end with `out` (req_id, id) of the CTE items (req_id, id, title, artist, song)."""
    return f"""{out}_asked AS (SELECT DISTINCT artist || '|' || title AS req_id, artist, title AS album FROM {items}), {search_ctes(f'{out}_asked', f'{out}_best')},
{out}_first AS (SELECT i.req_id, i.id, b.release_id, i.song AS track, i.artist FROM {items} i JOIN {out}_best b ON b.req_id = i.artist || '|' || i.title AND b.rank = 1), {valid_ctes(f'{out}_first', f'{out}_good')},
{out} AS MATERIALIZED (SELECT DISTINCT req_id, id FROM {out}_first JOIN {out}_good USING (release_id, track, artist))"""


def _artwork_ctes(items: str, out: str) -> str:
    """CTEs that end with `out`, the CTE items (req_id, id, release_title, ...) with the release found for each."""
    return f"""{out}_items AS (SELECT i.*, CASE WHEN {_COMPILATION.format('c.artist')} THEN 'Various' ELSE c.artist END AS whose, coalesce(i.release_title, c.title) AS wanted FROM {items} i JOIN catalog c USING (id)),
{out}_asked AS (SELECT DISTINCT whose || '|' || wanted AS req_id, whose AS artist, wanted AS album FROM {out}_items), {search_ctes(f'{out}_asked', f'{out}_best')},
{out} AS MATERIALIZED (SELECT i.req_id, i.id, b.release_id, b.title AS album, b.artist_name AS release_artist, coalesce(b.artwork_url, ai.image, li.image) AS artwork_url, b.confidence
 FROM {out}_items i LEFT JOIN {out}_best b ON b.req_id = i.whose || '|' || i.wanted AND b.rank = 1 LEFT JOIN release r ON r.id = b.release_id LEFT JOIN artist_image ai ON ai.artist_id = r.artist_id LEFT JOIN label_image li ON li.label_id = r.label_id)"""


def _message_sql(on: str, missing: str, some: str, artist: str, song: str, album: str) -> str:
    return f"""CASE WHEN {on} THEN 'Found "' || {song} || '" by ' || {artist} || ' on:' WHEN {missing} AND {some} AND {song} <> '' AND {album} <> '' THEN '"' || {album} || '" not found in the library, but here are other albums by ' || {artist} || ':'
 WHEN {missing} AND {some} AND {song} <> '' THEN '"' || {song} || '" is not on any album in the library, but here are some albums by ' || {artist} || ':' WHEN {missing} AND NOT {some} AND {song} <> '' AND {artist} <> '' THEN '"' || {song} || '" by ' || {artist} || ' not found in library.' END"""


_ALL = f"""{views.SQL}, {_FIXED}, {_RESOLVED}, {_PARTS}, {_FALLBACK_ASKED}, {_SWAP_ASKED}, {_SONG_ASKED}, {_NAME_ASKED},
texts AS MATERIALIZED (SELECT query FROM way_texts UNION SELECT query FROM swap_texts UNION SELECT album FROM album_names UNION SELECT words FROM telling WHERE words <> '' UNION SELECT words FROM song_asked WHERE words <> '' UNION SELECT song FROM fixed WHERE song <> '' AND artist IS NULL
 UNION SELECT title FROM by_name WHERE title <> ''), {cascade_sql('texts', fuzzy=_FUZZY_WHOLE)}, {_FALLBACK}, {_SWAP}, {_COMPILED}, {_NAMED},
tries AS (SELECT req_id, EXISTS (SELECT 1 FROM fallback_found x WHERE x.req_id = f.req_id) AS a, coalesce((SELECT bool_or(fallback) FROM fallback_found x WHERE x.req_id = f.req_id), false) AS fell,
 coalesce(artist <> '', false) OR coalesce(song <> '', false) OR req_id IN (SELECT req_id FROM albums_for) AS can_a, (SELECT part1 FROM parts p WHERE p.req_id = f.req_id) IS NOT NULL AS can_b, coalesce(artist <> '' AND song <> '', false) AS can_c, coalesce(song <> '', false) AND coalesce(artist, '') = '' AS can_d FROM fixed f),
more AS (SELECT *, NOT a AND can_b AND req_id IN (SELECT req_id FROM swap_found) AS b, fell AND can_c AND req_id IN (SELECT req_id FROM comp_found) AS c FROM tries),
ends AS MATERIALIZED (SELECT req_id, CASE WHEN c THEN 'c' WHEN a THEN 'a' WHEN b THEN 'b' WHEN can_d AND req_id IN (SELECT req_id FROM name_found) THEN 'd' END AS found,
 CASE WHEN NOT a AND NOT b AND can_d THEN 'd' WHEN fell AND can_c THEN 'c' WHEN NOT a AND can_b THEN 'b' WHEN can_a THEN 'a' END AS last, fell AND NOT c AS missing FROM more),
picked AS (SELECT 'a' AS found, * FROM fallback_found UNION ALL SELECT 'b', * FROM swap_found UNION ALL SELECT 'c', * FROM comp_found UNION ALL SELECT 'd', * FROM name_found),
results AS MATERIALIZED (SELECT e.req_id, e.found, p.id, p.place, p.release_title FROM ends e JOIN picked p ON p.req_id = e.req_id AND p.found = e.found),
to_check AS (SELECT r.req_id, r.id, c.title, f.artist, f.song FROM results r JOIN ends e USING (req_id) JOIN fixed f USING (req_id) JOIN catalog c ON c.id = r.id WHERE e.missing AND f.song <> '' AND f.artist <> ''), {_validated_ctes('to_check', 'good')},
kept AS MATERIALIZED (SELECT req_id, id, release_title, CAST(row_number() OVER (PARTITION BY req_id ORDER BY place) AS INTEGER) AS rank FROM results r WHERE req_id NOT IN (SELECT req_id FROM good) OR (req_id, id) IN (SELECT (req_id, id) FROM good)), {_artwork_ctes('kept', 'art')},
told AS MATERIALIZED (SELECT f.*, e.found, e.last, e.missing AS fell, e.missing AND g.req_id IS NULL AS missing, coalesce(e.found = 'c', false) AS on_other FROM fixed f JOIN ends e USING (req_id) LEFT JOIN (SELECT DISTINCT req_id FROM good) g USING (req_id)),
shown AS MATERIALIZED (SELECT a.*, c.title, c.artist FROM art a JOIN catalog c ON c.id = a.id), ranked AS MATERIALIZED (SELECT s.*, k.rank FROM kept k JOIN shown s ON s.req_id = k.req_id AND s.id = k.id),
answer AS MATERIALIZED (SELECT t.req_id, k.rank, k.id, k.title, k.artist, k.release_id, k.album, k.release_artist, k.artwork_url, k.confidence,
 CASE WHEN on_other THEN 'compilation' WHEN last = 'a' THEN CASE WHEN fell THEN 'fallback' ELSE 'direct' END WHEN last = 'b' THEN 'alternative' WHEN last = 'c' THEN 'compilation' WHEN last = 'd' THEN 'song_as_artist' ELSE 'none' END AS search_type,
 missing AS song_not_found, on_other AS found_on_compilation, {_message_sql('on_other', 'missing', '(k.id IS NOT NULL)', 't.artist', 't.song', 't.album')} AS context, t.corrected_artist
 FROM told t LEFT JOIN ranked k ON k.req_id = t.req_id)"""

_FOUND = "SELECT req_id, id, place, release_title, fallback FROM"
_KIND = "CASE WHEN req_id % 7 = 0 THEN 'track_on_compilation' WHEN req_id % 7 < 3 THEN 'artist_plus_album' WHEN req_id % 7 = 3 THEN 'swapped_interpretation' WHEN req_id % 7 = 4 THEN 'song_as_artist' END"

_STEPS = {
    "correction": "fixed",
    "albums": "albums_for",
    "artist_plus_album": "fallback_found",
    "swapped_interpretation": "swap_found JOIN more USING (req_id) WHERE NOT a AND can_b",
    "track_on_compilation": "comp_found JOIN more USING (req_id) WHERE fell AND can_c",
    "song_as_artist": "name_found JOIN more USING (req_id) WHERE NOT a AND NOT b AND can_d",
    "search": "results",
    "validation": "good",
    "artwork": "kept",
}

ORACLE_SQL = {
    "lookup_steps": f"WITH {_ALL} " + " UNION ALL ".join(f"SELECT '{step}' AS step, CAST(1 AS BIGINT) AS calls, count(*) AS rows FROM {rows}" for step, rows in _STEPS.items()),
    "lookup_e2e": f"WITH {_ALL} SELECT * FROM answer",
    "lookup_response": f"WITH {_ALL} SELECT req_id, count(id) AS total, max(CASE WHEN rank = 1 THEN id END) AS first_id, max(CASE WHEN rank = 1 THEN artwork_url END) AS first_image, max(search_type) AS search_type, max(context) AS context FROM answer GROUP BY req_id",
    "album_resolution": f"WITH {views.SQL}, {_FIXED}, {_RESOLVED} SELECT req_id, place, album FROM albums_for",
    "with_fallback": f"WITH {views.SQL}, {_fixed(None)}, {_RESOLVED}, {_FALLBACK_ASKED}, texts AS (SELECT DISTINCT query FROM way_texts), {cascade_sql('texts')}, {_FALLBACK} {_FOUND} fallback_found",
    "swapped": f"WITH {views.SQL}, {_FIXED}, {_PARTS}, {_SWAP_ASKED}, texts AS (SELECT DISTINCT query FROM swap_texts), {cascade_sql('texts')}, {_SWAP} {_FOUND} swap_found",
    "compilation": f"WITH {views.SQL}, {_FIXED}, {_SONG_ASKED}, texts AS (SELECT album AS query FROM album_names UNION SELECT words FROM telling WHERE words <> '' UNION SELECT words FROM song_asked WHERE words <> ''), {cascade_sql('texts')}, {_COMPILED} {_FOUND} comp_found",
    "song_as_artist": f"WITH {views.SQL}, {_FIXED}, {_NAME_ASKED}, texts AS (SELECT song AS query FROM fixed WHERE song <> '' AND artist IS NULL UNION SELECT title FROM by_name WHERE title <> ''), {cascade_sql('texts')}, {_NAMED} {_FOUND} name_found",
    "track_validation": f"WITH {views.SQL}, {_FIXED}, items AS (SELECT f.req_id, c.id, c.title, f.artist, f.song FROM fixed f JOIN catalog c ON c.id = f.req_id WHERE f.song <> '' AND f.artist <> ''), {_validated_ctes('items', 'good')} SELECT req_id, id FROM good",
    "artwork_enrich": f"WITH {views.SQL}, items AS (SELECT id AS req_id, id, CASE WHEN id % 2 = 0 THEN upper(title) END AS release_title FROM catalog), {_artwork_ctes('items', 'art')} SELECT id, release_id, album, release_artist, artwork_url, confidence FROM art",
    "context_message": f"WITH {views.SQL} SELECT req_id, {_message_sql('(req_id % 14 = 0)', '(req_id % 3 = 0)', '(req_id % 4 > 0)', 'coalesce(artist, song)', 'coalesce(song, album)', 'album')} AS context FROM requests",
    "search_type": f"""WITH {views.SQL}, k AS (SELECT req_id, {_KIND} AS last, CASE WHEN req_id % 2 = 0 THEN {_KIND} END AS found FROM requests)
SELECT req_id, CASE WHEN found = 'track_on_compilation' OR last = 'track_on_compilation' THEN 'compilation' WHEN last = 'artist_plus_album' THEN CASE WHEN req_id % 3 = 0 THEN 'fallback' ELSE 'direct' END WHEN last = 'swapped_interpretation' THEN 'alternative'
 WHEN last = 'song_as_artist' THEN 'song_as_artist' ELSE 'none' END AS search_type FROM k""",
}
