"""Queries of catalog search over a batch of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import catalog as search
from lodestone.operators import strategies
from lodestone.plans.scalar_queries import STOP, ratio_sql, token_set_sql
from lodestone.sources import views

K = 5


def _queries(spark, sf_dir: str) -> DataFrame:
    """The distinct texts that requests search for."""
    r = views.requests(spark, sf_dir)
    return r.select(F.concat_ws(" ", "artist", F.coalesce("album", "song")).alias("query")).where("query <> ''").distinct()


def fts_and(spark, sf_dir):
    asked = _queries(spark, sf_dir).select(F.regexp_replace("query", "#", " ").alias("query")).distinct()
    return search.full_text(asked, views.catalog(spark, sf_dir), K)


def _pieces(spark, sf_dir: str) -> DataFrame:
    """Titles, artists, titles backwards and single words, as phrases to look for."""
    c = views.catalog(spark, sf_dir)
    title = text.tokens(F.col("title"))
    asked = [F.col("title"), F.col("artist"), F.array_join(F.reverse(title), " "), F.element_at(title, -1)]
    return c.select(F.explode(F.array(*asked)).alias("query")).distinct()


def fts_phrase(spark, sf_dir):
    return search.phrase(_pieces(spark, sf_dir), views.catalog(spark, sf_dir), K)


def fts_initial(spark, sf_dir):
    """Rows whose title starts with the phrase."""
    return search.phrase(_pieces(spark, sf_dir), views.catalog(spark, sf_dir), K, ("title",), initial=True)


def fts_near(spark, sf_dir):
    """Rows with the ends of the phrase next to each other, in either order."""
    return search.near(_pieces(spark, sf_dir), views.catalog(spark, sf_dir), K, within=0)


def fts_column(spark, sf_dir):
    return search.full_text(_pieces(spark, sf_dir).select(F.regexp_replace("query", "#", " ").alias("query")).distinct(), views.catalog(spark, sf_dir), K, ("title",))


def fts_prefix(spark, sf_dir):
    """Rows with a word that starts with each start of one, two, four and five letters that words have."""
    words = views.catalog(spark, sf_dir).select(F.explode(F.concat(text.tokens(F.col("title")), text.tokens(F.col("artist")))).alias("w")).distinct()
    asked = words.select(F.explode(F.array(*[F.substring("w", 1, n) for n in (1, 2, 4, 5)])).alias("query")).distinct()
    return search.prefix(asked, views.catalog(spark, sf_dir), K)


def fts_or(spark, sf_dir):
    return search.any_token(_pieces(spark, sf_dir), views.catalog(spark, sf_dir), K)


def fts_not(spark, sf_dir):
    """Rows with the first word of each title and without the last word of the first title, by letters, that starts with it."""
    title = text.tokens(F.col("title"))
    asked = views.catalog(spark, sf_dir).select(F.get(title, F.lit(0)).alias("query"), F.element_at(title, -1).alias("last")).groupBy("query").agg(F.min("last").alias("excluded"))
    return search.without(asked, views.catalog(spark, sf_dir), K)


def like_filter(spark, sf_dir):
    return search.like(views.catalog(spark, sf_dir), artist=F.lit("BRAND#1"), title=F.lit("Ring")).select("id", "title", "artist")


def like_all_words(spark, sf_dir):
    return search.all_words(_queries(spark, sf_dir), views.catalog(spark, sf_dir), K)


def fuzzy_search(spark, sf_dir):
    """Fuzzy search for the texts of all requests."""
    found = search.fuzzy(_queries(spark, sf_dir), views.catalog(spark, sf_dir), K)
    return found.withColumn("score", F.round("score", 6))


def search_cascade(spark, sf_dir):
    return search.search(_queries(spark, sf_dir), views.catalog(spark, sf_dir), K)


def correct_artist(spark, sf_dir):
    return search.correct_artist(views.requests(spark, sf_dir).select("artist"), views.catalog(spark, sf_dir))


def artist_prefix_filter(spark, sf_dir):
    """Search results that start with the request's artist; of those without an artist all."""
    r = views.requests(spark, sf_dir).withColumn("query", F.concat_ws(" ", "artist", F.coalesce("album", "song")))
    c = views.catalog(spark, sf_dir)
    hits = search.all_words(r.select("query").where("query <> ''").distinct(), c, K)
    rows = r.join(hits, "query").join(c.select("id", F.col("artist").alias("found")), "id")
    wanted = text.norm(F.col("artist"))
    return rows.where((wanted == "") | text.norm(F.col("found")).startswith(wanted)).select("req_id", "id", "rank")


def _overlap_keys(words, x):
    """What texts that overlap have in common: a word, or, where the title is short, the start."""
    return F.concat(words, F.array(F.concat(F.lit("^"), F.substring(strategies.flat(x), 1, 1)), F.lit("^")))


def album_overlap_filter(spark, sf_dir):
    """Albums asked for against catalog rows of the same artist."""
    r = views.requests(spark, sf_dir).where("album IS NOT NULL").select("artist", F.concat("album", F.lit(" - live")).alias("album")).distinct()
    c = views.catalog(spark, sf_dir).select("id", "artist", "title")
    words, titles = strategies.album_words(F.col("album")), c.select("artist", "title").distinct()
    asked = r.select("artist", "album", F.explode(F.array_distinct(_overlap_keys(words, F.col("album")))).alias("key"))
    short = F.size(strategies.album_words(F.col("title"))) <= 2
    own = F.when(short, F.array(F.concat(F.lit("^"), F.substring(strategies.flat(F.col("title")), 1, 1)))).otherwise(strategies.album_words(F.col("title")))
    posted = titles.select("artist", "title", F.explode(F.array_distinct(own)).alias("key"))
    met = asked.join(posted, ["artist", "key"]).where(strategies.overlaps(F.col("album"), F.col("title"))).select("artist", "album", "title").distinct()
    return met.join(c, ["artist", "title"]).select("artist", "album", "id")


def album_fuzzy(spark, sf_dir):
    """Albums named by a title, by a title twice with words that no row has, and by two titles."""
    title = views.catalog(spark, sf_dir).select("title").distinct()
    other = title.select(F.lag("title").over(Window.orderBy("title")).alias("before"), "title")
    album = F.array(F.col("title"), F.concat_ws(" ", "title", "title", F.lit("anniversary pressing")), F.concat_ws(" ", "before", "title", F.lit("anniversary pressing")))
    return search.album_fuzzy(other.select(F.explode(album).alias("query")), views.catalog(spark, sf_dir), K)


def distinct_artists(spark, sf_dir):
    return views.catalog(spark, sf_dir).select("artist").distinct()


def catalog_count(spark, sf_dir):
    return views.catalog(spark, sf_dir).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (fts_and, fts_phrase, fts_initial, fts_near, fts_column, fts_prefix, fts_or, fts_not, like_filter, like_all_words, fuzzy_search, search_cascade, correct_artist, artist_prefix_filter, album_overlap_filter, album_fuzzy, distinct_artists, catalog_count)}

_TOKENS = r"list_filter(regexp_split_to_array(lower(strip_accents({})), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_PLAIN = r"list_filter(regexp_split_to_array(regexp_replace(lower(strip_accents({})), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda w: w <> '')"
_Q = "asked AS (SELECT DISTINCT concat_ws(' ', artist, coalesce(album, song)) AS query FROM requests WHERE concat_ws(' ', artist, coalesce(album, song)) <> '')"
_FTS = f"""fts AS (SELECT query, id FROM (SELECT query, {_TOKENS.format('query')} AS q FROM {{source}} WHERE regexp_full_match(query, '[\\w\\s]+')) JOIN (SELECT id, list_concat({_TOKENS.format('title')}, {_TOKENS.format('artist')}) AS t FROM catalog) ON len(q) > 0 AND list_has_all(t, q))"""
_LIKE_WORDS = f"""lw AS (SELECT query, CASE WHEN len(list_filter(w, lambda x: x NOT IN ({STOP}))) > 0 THEN list_filter(w, lambda x: x NOT IN ({STOP})) ELSE w END AS w FROM (SELECT query, list_filter({_PLAIN.format('query')}, lambda x: length(x) > 1) AS w FROM {{source}})),
likes AS (SELECT query, id FROM lw JOIN (SELECT id, lower(title) AS t, lower(artist) AS a FROM catalog) ON len(w) > 0 AND len(list_filter(w, lambda x: contains(t, x) OR contains(a, x))) = len(w))"""
_FUZZY = f"""starts AS (SELECT query, list_reduce(list_prepend('', {_PLAIN.format('query')}), lambda a, x: CASE WHEN length(x) > length(a) THEN x ELSE a END)[1:3] AS start FROM {{source}}),
block AS (SELECT s.start, c.id, lower(c.artist || ' ' || c.title) AS text FROM (SELECT DISTINCT start FROM starts WHERE start <> '') s JOIN catalog c ON contains(lower(c.title), s.start) OR contains(lower(c.artist), s.start) QUALIFY row_number() OVER (PARTITION BY s.start ORDER BY c.id) <= 500),
tp AS (SELECT DISTINCT query, lower(query) AS a, text FROM starts JOIN block USING (start)),
sc AS ({token_set_sql('tp', 'a', 'text', 'query, text')}),
fuz AS (SELECT query, id, score FROM starts JOIN block USING (start) JOIN sc USING (query, text) WHERE score >= 70 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 5)"""
#: The same over all rows that hold a start.
_FUZZY_WHOLE = _FUZZY.replace(" QUALIFY row_number() OVER (PARTITION BY s.start ORDER BY c.id) <= 500", "")
_TOP = "SELECT query, id, CAST(row_number() OVER (PARTITION BY query ORDER BY id) AS INTEGER) AS rank FROM {} QUALIFY rank <= 5"
_WORDS = r"list_filter(regexp_split_to_array(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+'), lambda x: x <> '' AND length(x) > {} AND x NOT IN (" + STOP + "))"
_FLAT = r"trim(regexp_replace(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"



_PIECES = f"pieces AS (SELECT DISTINCT unnest([title, artist, array_to_string(list_reverse({_TOKENS.format('title')}), ' '), {_TOKENS.format('title')}[-1]]) AS query FROM catalog)"


def _from(sql: str, source: str) -> str:
    return sql.replace("{source}", source)


def cascade_sql(source: str, first: str | None = _FTS, fuzzy: str = _FUZZY) -> str:
    """CTEs that end with hits (query, id, rank, tier) for the queries in source; first makes fts, unless it is made already."""
    return f"""{_from(first, source) + ", " if first else ""}r1 AS (SELECT query FROM {source} WHERE query NOT IN (SELECT query FROM fts)), {_from(_LIKE_WORDS, 'r1')},
r2 AS (SELECT query FROM r1 WHERE query NOT IN (SELECT query FROM likes)), {_from(fuzzy, 'r2')},
hits AS MATERIALIZED (SELECT * FROM (SELECT query, id, CAST(row_number() OVER (PARTITION BY query ORDER BY id) AS INTEGER) AS rank, 1 AS tier FROM fts UNION ALL SELECT query, id, CAST(row_number() OVER (PARTITION BY query ORDER BY id) AS INTEGER), 2 FROM likes
 UNION ALL SELECT query, id, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER), 3 FROM fuz) WHERE rank <= 5)"""


def correction_sql(source: str, out: str, most: int | None = search.ARTISTS) -> str:
    """CTEs that end with `out` (artist, corrected) for the artists in source, by the first `most` artists of a block or all."""
    first = "" if most is None else f" QUALIFY row_number() OVER (PARTITION BY lower(artist[1:3]) ORDER BY artist) <= {most}"
    return f"""{out}a AS (SELECT DISTINCT artist, list_filter(regexp_split_to_array(lower(artist), '\\s+'), lambda w: length(w) >= 3)[1][1:3] AS block FROM {source} WHERE artist IS NOT NULL),
{out}k AS (SELECT artist AS known, lower(artist[1:3]) AS block FROM (SELECT DISTINCT artist FROM catalog){first}),
{out}p AS (SELECT a.artist, known, lower(a.artist) AS la, lower(known) AS lk FROM {out}a a JOIN {out}k USING (block)),
{out}s AS (SELECT artist, known, {ratio_sql('la', 'lk')} AS score FROM {out}p),
{out} AS MATERIALIZED (SELECT artist, known AS corrected FROM (SELECT * FROM {out}s WHERE score >= greatest(85, 100 - 2 * length(artist)) QUALIFY row_number() OVER (PARTITION BY artist ORDER BY score DESC, known) = 1) WHERE lower(known) <> lower(artist))"""


def words_sql(source: str) -> str:
    """telling (album, w, words): the telling words of the albums in source, and the first four as a text."""
    return f"telling AS (SELECT album, w, array_to_string(w[1:4], ' ') AS words FROM (SELECT album, {_WORDS.format('album', 3)} AS w FROM {source}))"


#: album_hits (album, id, rank) from hits and telling: an album's own rows, or those of its words that hold two of all of them and score 60.
ALBUMS_SQL = f"""worded AS (SELECT album, id, rank, w, lower(coalesce(title, '')) AS low, lower(album) AS la FROM telling JOIN hits ON query = words JOIN catalog USING (id) WHERE album NOT IN (SELECT query FROM hits)),
pairs AS (SELECT DISTINCT album, la, low FROM worded WHERE len(list_filter(w, lambda x: contains(low, x))) >= 2), near AS ({token_set_sql('pairs', 'la', 'low', 'album, low')}),
album_hits AS (SELECT album, id, rank FROM telling JOIN hits ON query = album UNION ALL SELECT album, id, rank FROM worded JOIN near USING (album, low) WHERE score >= 60)"""

ORACLE_SQL = {
    "fts_and": f"WITH {views.SQL}, {_Q}, plain AS (SELECT DISTINCT replace(query, '#', ' ') AS query FROM asked), {_from(_FTS, 'plain')} {_TOP.format('fts')}",
    "fts_phrase": f"WITH {views.SQL}, {_PIECES}, t AS (SELECT id, ' ' || array_to_string({_TOKENS.format('title')}, ' ') || ' ' AS a, ' ' || array_to_string({_TOKENS.format('artist')}, ' ') || ' ' AS b FROM catalog), m AS (SELECT query, id FROM (SELECT query, ' ' || array_to_string({_TOKENS.format('query')}, ' ') || ' ' AS q FROM pieces) JOIN t ON contains(a, q) OR contains(b, q)) {_TOP.format('m')}",
    "fts_initial": f"WITH {views.SQL}, {_PIECES}, m AS (SELECT query, id FROM (SELECT query, array_to_string({_TOKENS.format('query')}, ' ') || ' ' AS q FROM pieces) JOIN (SELECT id, array_to_string({_TOKENS.format('title')}, ' ') || ' ' AS a FROM catalog) ON starts_with(a, q)) {_TOP.format('m')}",
    "fts_near": f"""WITH {views.SQL}, {_PIECES}, t AS (SELECT id, unnest([{_TOKENS.format('title')}, {_TOKENS.format('artist')}]) AS t FROM catalog), p AS (SELECT DISTINCT id, t[i] AS x, t[i + 1] AS y FROM (SELECT id, t, unnest(range(1, len(t))) AS i FROM t)),
q AS (SELECT query, q[1] AS a, q[-1] AS b FROM (SELECT query, {_TOKENS.format('query')} AS q FROM pieces) WHERE len(q) > 1), m AS (SELECT DISTINCT query, id FROM q JOIN p ON a = x AND b = y OR a = y AND b = x) {_TOP.format('m')}""",
    "fts_column": f"WITH {views.SQL}, {_PIECES}, q AS (SELECT DISTINCT replace(query, '#', ' ') AS query FROM pieces), m AS (SELECT query, id FROM q JOIN (SELECT id, {_TOKENS.format('title')} AS t FROM catalog) ON list_has_all(t, {_TOKENS.format('query')})) {_TOP.format('m')}",
    "fts_prefix": f"""WITH {views.SQL}, w AS (SELECT id, unnest(list_concat({_TOKENS.format('title')}, {_TOKENS.format('artist')})) AS w FROM catalog), q AS (SELECT DISTINCT unnest([w[1:1], w[1:2], w[1:4], w[1:5]]) AS query FROM w),
m AS (SELECT DISTINCT query, id FROM q JOIN w ON starts_with(w, query)) {_TOP.format('m')}""",
    "fts_or": f"""WITH {views.SQL}, {_PIECES}, w AS (SELECT id, unnest(list_concat({_TOKENS.format('title')}, {_TOKENS.format('artist')})) AS w FROM catalog), q AS (SELECT query, unnest({_TOKENS.format('query')}) AS w FROM pieces),
m AS (SELECT DISTINCT query, id FROM q JOIN w USING (w)) {_TOP.format('m')}""",
    "fts_not": f"""WITH {views.SQL}, q AS (SELECT t[1] AS query, min(t[-1]) AS excluded FROM (SELECT {_TOKENS.format('title')} AS t FROM catalog) GROUP BY 1),
m AS (SELECT query, id FROM q JOIN (SELECT id, list_concat({_TOKENS.format('title')}, {_TOKENS.format('artist')}) AS t FROM catalog) ON list_contains(t, query) AND NOT list_contains(t, excluded)) {_TOP.format('m')}""",
    "like_filter": f"WITH {views.SQL} SELECT id, title, artist FROM catalog WHERE artist ILIKE '%BRAND#1%' AND title ILIKE '%Ring%'",
    "like_all_words": f"WITH {views.SQL}, {_Q}, {_from(_LIKE_WORDS, 'asked')} {_TOP.format('likes')}",
    "fuzzy_search": f"WITH {views.SQL}, {_Q}, {_from(_FUZZY, 'asked')} SELECT query, id, round(CAST(score AS DOUBLE), 6) AS score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank FROM fuz",
    "search_cascade": f"WITH {views.SQL}, {_Q}, {cascade_sql('asked')} SELECT query, id, rank, tier FROM hits",
    "correct_artist": f"WITH {views.SQL}, {correction_sql('requests', 'right_')} SELECT artist, corrected FROM right_",
    "artist_prefix_filter": f"""WITH {views.SQL}, {_Q}, {_from(_LIKE_WORDS, 'asked')}, h AS ({_TOP.format('likes')})
SELECT r.req_id, h.id, h.rank FROM requests r JOIN h ON h.query = concat_ws(' ', r.artist, coalesce(r.album, r.song)) JOIN catalog c ON c.id = h.id WHERE starts_with(lower(strip_accents(c.artist)), lower(strip_accents(coalesce(r.artist, ''))))""",
    "album_overlap_filter": f"""WITH {views.SQL}, a AS (SELECT DISTINCT artist, album || ' - live' AS album FROM requests WHERE album IS NOT NULL)
SELECT a.artist, a.album, c.id FROM a JOIN catalog c USING (artist) WHERE CASE WHEN len({_WORDS.format('c.title', 2)}) <= 2 THEN starts_with({_FLAT.format('a.album')}, {_FLAT.format('c.title')}) ELSE len(list_intersect({_WORDS.format('a.album', 2)}, {_WORDS.format('c.title', 2)})) >= 2 END""",
    "album_fuzzy": f"""WITH {views.SQL}, named AS (SELECT title, lag(title) OVER (ORDER BY title) AS before FROM (SELECT DISTINCT title FROM catalog)),
albums AS (SELECT DISTINCT unnest([title, title || ' ' || title || ' anniversary pressing', concat_ws(' ', before, title, 'anniversary pressing')]) AS album FROM named),
{words_sql('albums')}, texts AS (SELECT album AS query FROM albums UNION SELECT words FROM telling WHERE words <> ''), {cascade_sql('texts')}, {ALBUMS_SQL} SELECT album AS query, id, CAST(row_number() OVER (PARTITION BY album ORDER BY rank) AS INTEGER) AS rank FROM album_hits""",
    "distinct_artists": f"WITH {views.SQL} SELECT DISTINCT artist FROM catalog",
    "catalog_count": f"WITH {views.SQL} SELECT count(*) AS n FROM catalog",
}
