"""The strategies of a lookup, each over all requests it is for at once, and what follows them.

Requests are rows (req_id, artist, song, album, raw_message). A strategy
returns (req_id, id, place, release_title, fallback): catalog rows in order,
the title of the release that led to one, and whether something else was found
than what was asked for. What depends on what is decided for each request: of
several ways to search those that find nothing count as not tried.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import catalog as catalog_search
from lodestone.operators import releases
from lodestone.operators.ranking import keep_first, top_k
from lodestone.sources.scratch import Scratch, Steps
from lodestone.sources.views import Store

#: Results of a lookup, and releases looked at for the albums of a song, for a song on other releases and for an artist. Fixed values.
K, ALBUM_RELEASES, SONG_RELEASES, ARTIST_RELEASES = 5, 10, 20, 10


def _none() -> Column:
    return F.lit(None).cast("string")


def there(c: str) -> Column:
    return F.coalesce(F.col(c) != "", F.lit(False))


def starts_with(name: Column, wanted: Column) -> Column:
    """Whether the name starts with the one wanted, in normal form; every name does if none is wanted."""
    return text.norm(name).startswith(text.norm(wanted))


def album_is_artist() -> Column:
    return there("album") & there("artist") & (text.strip(text.norm(F.col("album"))) == text.strip(text.norm(F.col("artist"))))


def album_words(x: Column) -> Column:
    return text.significant(text.marked_words(x), 2)


def flat(x: Column) -> Column:
    """Lower case, punctuation as space, single spaces."""
    return text.squeeze(F.regexp_replace(F.lower(x), r"(?U)[^\w\s]", " "))


def overlaps(album: Column, title: Column) -> Column:
    """Two words in common, or, for titles of two words at most, the album starts with the title."""
    title = F.coalesce(title, F.lit(""))
    return F.when(F.size(album_words(title)) <= 2, flat(album).startswith(flat(title))).otherwise(F.size(F.array_intersect(album_words(album), album_words(title))) >= 2)


def _named(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    return rows.join(catalog.select("id", F.col("artist").alias("known"), F.coalesce("title", F.lit("")).alias("title")), "id")


def _found(asked: DataFrame, catalog: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(id, query, found, known, title): catalog rows for the distinct texts (query) asked, written.

    Requests are many and their texts few: as a table the texts' rows are told to
    be the smaller side, and neither requests nor catalog are broadcast for them.
    """
    found = scratch.put(catalog_search.search(asked.select("query"), catalog, k).select("query", "id", F.col("rank").alias("found")))
    return scratch.put(_named(found, catalog))


def _holds(title: Column, wanted: Column) -> Column:
    return F.coalesce(F.lower(title).contains(F.lower(wanted)), F.lit(False))


def _shaped(rows: DataFrame, order: list[Column], k: int, fallback: Column | None = None, release_title: Column | None = None) -> DataFrame:
    placed = top_k(rows, ["req_id"], order, k)
    return placed.select("req_id", "id", F.col("rank").alias("place"), (_none() if release_title is None else release_title).alias("release_title"), (F.lit(False) if fallback is None else fallback).alias("fallback"))


def resolve_albums(requests: DataFrame, store: Store) -> DataFrame:
    """(req_id, place, album): the album asked for, or, with a song and an artist but no album, or the artist's name for one, those of the artist's releases that have the song."""
    unknown = there("song") & there("artist") & (~there("album") | album_is_artist())
    asked = requests.where(unknown).select("req_id", F.col("song").alias("track"), "artist")
    found = releases.releases_of_track(asked.select("track", "artist"), store, ALBUM_RELEASES)
    rows = asked.join(found, ["track", "artist"]).where(starts_with(F.col("artist_name"), F.col("artist")))
    once = keep_first(rows.select("req_id", F.col("rank").alias("place"), F.col("title").alias("album")), ["req_id", "album"], [F.col("place")])
    return requests.where(~unknown & there("album")).select("req_id", F.lit(1).alias("place"), "album").unionByName(once)


def _ways(requests: DataFrame, albums: DataFrame) -> DataFrame:
    """(req_id, artist, way, step, wanted, query): the artist with each album, with the song, and alone."""
    r = requests.where(there("artist")).select("req_id", "artist", "song")
    query = lambda *parts: F.concat_ws(" ", *parts).alias("query")
    way = lambda n, step, wanted: (F.lit(n).alias("way"), step.alias("step"), wanted.alias("wanted"))
    with_album = r.join(albums, "req_id").select("req_id", "artist", *way(0, F.col("place"), F.col("album")), query("artist", "album"))
    with_song = r.where(there("song")).select("req_id", "artist", *way(1, F.lit(1), F.col("song")), query("artist", "song"))
    alone = r.select("req_id", "artist", *way(2, F.lit(1), _none()), query("artist"))
    return with_album.union(with_song).union(alone)


def _readings(requests: DataFrame) -> DataFrame:
    """(req_id, way, artist, query): both readings of a message "X - Y"."""
    parts = requests.select("req_id", text.ambiguous_parts(F.col("raw_message")).alias("parts")).where("parts IS NOT NULL").select("req_id", "parts.*")
    reading = lambda n, a, b: parts.select("req_id", F.lit(n).alias("way"), F.col(a).alias("artist"), F.concat_ws(" ", a, b).alias("query"))
    return reading(1, "part1", "part2").union(reading(2, "part2", "part1"))


def _songs(requests: DataFrame) -> DataFrame:
    """(req_id, artist, song, track, words) of requests for a song by an artist."""
    r = requests.where(there("song") & there("artist"))
    return r.select("req_id", "artist", "song", text.song_with_version(F.col("song"), F.coalesce("raw_message", F.lit(""))).alias("track"), text.keyword_query(F.col("artist"), F.col("song")).alias("words"))


def texts(requests: DataFrame, albums: DataFrame) -> DataFrame:
    """(query): what the strategies search the catalog for, as far as requests and their albums tell."""
    alone = requests.where(there("song") & ~there("artist")).select(F.col("song").alias("query"))
    every = [_ways(requests, albums), _readings(requests), _songs(requests).select(F.col("words").alias("query")).where("query <> ''"), alone]
    return reduce(DataFrame.union, [x.select("query") for x in every]).distinct()


def with_fallback(requests: DataFrame, albums: DataFrame, catalog: DataFrame, k: int = K) -> DataFrame:
    """Artist with each album; else artist with song; else the artist alone. The last two are fallbacks."""
    scratch = Scratch(requests.sparkSession, "fallback")
    ways = scratch.put(_ways(requests, albums))
    rows = ways.join(_found(ways, catalog, k, scratch), "query").where(starts_with(F.col("known"), F.col("artist")))
    kept = rows.where((F.col("way") > 0) | overlaps(F.col("wanted"), F.col("title"))).withColumn("best", F.min("way").over(Window.partitionBy("req_id")))
    once = keep_first(kept.where("way = best"), ["req_id", "id"], [F.col("step"), F.col("found")])
    # the first album says which titles come first, or else the song
    primary = albums.groupBy("req_id").agg(F.min_by("album", "place").alias("primary"))
    told = once.join(primary, "req_id", "left").withColumn("ahead", _holds(F.col("title"), F.when(F.col("way") == 0, F.col("primary")).otherwise(F.col("wanted"))))
    return _shaped(told, [F.desc("ahead"), F.col("step"), F.col("found")], k, F.col("way") > 0)


def swapped(requests: DataFrame, catalog: DataFrame, k: int = K) -> DataFrame:
    """A message "X - Y" read both ways, X and then Y as the artist."""
    scratch = Scratch(requests.sparkSession, "swapped")
    ways = scratch.put(_readings(requests))
    rows = ways.join(_found(ways, catalog, k, scratch), "query").where(starts_with(F.col("known"), F.col("artist")))
    return _shaped(keep_first(rows, ["req_id", "id"], [F.col("way"), F.col("found")]), [F.col("way"), F.col("found")], k)


def track_on_compilation(requests: DataFrame, catalog: DataFrame, store: Store, k: int = K) -> DataFrame:
    """Releases that have the song by the artist, looked for in the catalog; where none is there, the first row with telling words of both."""
    scratch = Scratch(requests.sparkSession, "compilation")
    asked = scratch.put(_songs(requests))
    on = releases.releases_of_track(asked.select("track", "artist"), store, SONG_RELEASES).withColumnRenamed("rank", "step")
    low = lambda c: text.strip(F.lower(c))
    telling = (low("title") != low("artist")) & (F.length(text.strip(F.col("title"))) >= 3)
    albums = scratch.put(asked.join(on, ["track", "artist"]).where(telling).select("req_id", "artist", "song", "step", F.col("artist_name").alias("by"), F.col("title").alias("query")))
    found = scratch.put(_named(scratch.put(catalog_search.album_fuzzy(albums.select("query"), catalog, k).withColumnRenamed("rank", "found")), catalog))
    rows = albums.withColumn("album", F.col("query")).join(found, "query")
    both = text.is_compilation(F.col("by")) & text.is_compilation(F.col("known"))
    once = keep_first(rows.where(starts_with(F.col("known"), F.col("artist")) | both), ["req_id", "id"], [F.col("step"), F.col("found")])
    # a release counts whole, and none is looked at once k rows are found
    before = F.count("*").over(Window.partitionBy("req_id").orderBy("step").rangeBetween(Window.unboundedPreceding, -1))
    kept = scratch.put(once.withColumn("before", before).where(F.col("before") < k))

    left = asked.where("words <> ''").join(kept.select("req_id").distinct(), "req_id", "left_anti").withColumnRenamed("words", "query")
    worded = left.join(_found(left, catalog, k, scratch), "query").where(starts_with(F.col("known"), F.col("artist")) | text.is_compilation(F.col("known")))
    by_release = _shaped(kept, [F.desc(_holds(F.col("title"), F.col("song"))), F.col("step"), F.col("found")], k, release_title=F.col("album"))
    return by_release.unionByName(_shaped(worded, [F.col("found")], 1))


def song_as_artist(requests: DataFrame, catalog: DataFrame, store: Store, k: int = K) -> DataFrame:
    """The song's name as an artist's in the catalog; else the releases of an artist of that name, looked for in the catalog."""
    scratch = Scratch(requests.sparkSession, "song_as_artist")
    asked = requests.where(there("song")).select("req_id", F.col("song").alias("query"))
    direct = scratch.put(asked.join(_found(asked, catalog, k, scratch), "query").where(starts_with(F.col("known"), F.col("query"))))
    left = scratch.put(asked.join(direct.select("req_id").distinct(), "req_id", "left_anti").withColumnRenamed("query", "song"))
    names = left.select(F.col("song").alias("req_id"), F.col("song").alias("artist"), _none().alias("album")).distinct()
    on = releases.search_tiers(names, store, ARTIST_RELEASES).where("title <> ''")
    albums = scratch.put(on.select(F.col("req_id").alias("song"), F.col("rank").alias("step"), F.col("title").alias("query")))
    rows = left.join(albums.join(_found(albums, catalog, k, scratch), "query"), "song").where(starts_with(F.col("known"), F.col("song")) | text.is_compilation(text.norm(F.col("known"))))
    # the first k rows by release are those found before the search would stop
    once = keep_first(rows, ["req_id", "id"], [F.col("step"), F.col("found")])
    return _shaped(direct, [F.col("found")], k).unionByName(_shaped(once, [F.col("step"), F.col("found")], k))


def first_releases(pairs: DataFrame, store: Store, k: int = K) -> DataFrame:
    """(artist, album, release_id, title, artist_name, artwork_url, confidence): the release found first for each distinct (artist, album), null for nothing asked."""
    key = F.to_json(F.struct("artist", "album"))
    asked = pairs.select("artist", "album").distinct().withColumn("req_id", key).withColumn("track", _none())
    best = releases.search_tiers(releases.searchable(asked), store, k).where("rank = 1").drop("rank", "score", "source")
    return asked.select("req_id", "artist", "album").join(best, "req_id").drop("req_id")


def _on_pair(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col("f_artist")) & F.col(b).eqNullSafe(F.col("f_album"))


def _to_validate(rows: DataFrame, requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows (req_id, id, song, artist, title) of requests that have a song and an artist."""
    asked = requests.where(there("song") & there("artist")).select("req_id", "song", "artist")
    return _named(rows.select("req_id", "id").join(asked, "req_id"), catalog.select("id", "artist", "title"))


def _to_picture(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """rows with the artist (by) and title (wanted) that artwork is looked for by."""
    known = catalog.select("id", F.when(text.is_compilation(F.col("artist")), "Various").otherwise(F.coalesce("artist", F.lit(""))).alias("by"), F.col("title").alias("own_title"))
    return rows.join(known, "id").withColumn("wanted", F.coalesce("release_title", "own_title")).drop("own_title")


def releases_for(rows: DataFrame, requests: DataFrame, catalog: DataFrame, store: Store) -> DataFrame:
    """first_releases of what validated and artwork ask for rows (req_id, id, release_title) of requests, in one search."""
    own = _to_validate(rows, requests, catalog).select("artist", F.col("title").alias("album"))
    return first_releases(own.union(_to_picture(rows, catalog).select("by", "wanted")), store)


def validated(rows: DataFrame, requests: DataFrame, catalog: DataFrame, store: Store, found: DataFrame | None = None) -> DataFrame:
    """(req_id, id) of those rows (req_id, id, ...) whose release has the song by the artist, for requests that have both.

    found has the releases of at least these rows, if they are known already.
    """
    scratch = Scratch(requests.sparkSession, "validated")
    items = _to_validate(rows, requests, catalog)
    if found is None:
        items = scratch.put(items)
        found = first_releases(items.select("artist", F.col("title").alias("album")), store)
    found = found.select(F.col("artist").alias("f_artist"), F.col("album").alias("f_album"), "release_id")
    checked = scratch.put(items.join(found, _on_pair("artist", "title")).select("req_id", "id", "release_id", F.col("song").alias("track"), "artist"))
    judged = releases.validate(checked.select("release_id", "track", "artist").distinct(), releases.known_documents(store, checked.select("release_id"))).where("valid")
    return checked.join(judged, ["release_id", "track", "artist"], "left_semi").select("req_id", "id")


def artwork(rows: DataFrame, catalog: DataFrame, store: Store, found: DataFrame | None = None) -> DataFrame:
    """rows (req_id, id, release_title, ...) with release_id, album, release_artist, artwork_url and confidence of the release found first for each.

    The release's title stands for the catalog's where it led to the row; a
    compilation is asked for as by "Various". Without an image of its own a
    release has its artist's, or else its label's. found has the releases of at
    least these rows, if they are known already.
    """
    scratch = Scratch(rows.sparkSession, "artwork")
    items = _to_picture(rows, catalog)
    if found is None:
        items = scratch.put(items)
        found = scratch.put(first_releases(items.select(F.col("by").alias("artist"), F.col("wanted").alias("album")), store))
    images = releases.fallback_images(found.where("artwork_url IS NULL").select("release_id"), store)
    shown = found.join(images, "release_id", "left").select(
        F.col("artist").alias("f_artist"), F.col("album").alias("f_album"), "release_id", F.col("title").alias("album"), F.col("artist_name").alias("release_artist"), F.coalesce("artwork_url", "image").alias("artwork_url"), "confidence"
    )
    return items.join(shown, _on_pair("by", "wanted"), "left").drop("by", "wanted", "f_artist", "f_album")


class Strategy(NamedTuple):
    """When a strategy is tried, given what is known of a request so far (found, song_not_found), what it does, and how a search that ends with it is called."""

    name: str
    condition: Callable[[], Column]
    run: Callable[[DataFrame, DataFrame, DataFrame, Store], DataFrame]
    kind: str


#: In the order in which they are tried. Each runs (requests, albums, catalog, store).
STRATEGIES = [
    Strategy("artist_plus_album", lambda: there("artist") | F.col("has_album") | there("song"), lambda r, albums, c, s: with_fallback(r, albums, c), "direct"),
    Strategy("swapped_interpretation", lambda: F.col("found").isNull() & text.ambiguous_parts(F.col("raw_message")).isNotNull(), lambda r, albums, c, s: swapped(r, c), "alternative"),
    Strategy("track_on_compilation", lambda: F.col("song_not_found") & there("artist") & there("song"), lambda r, albums, c, s: track_on_compilation(r, c, s), "compilation"),
    Strategy("song_as_artist", lambda: F.col("found").isNull() & there("song") & ~there("artist"), lambda r, albums, c, s: song_as_artist(r, c, s), "song_as_artist"),
]


def run_strategies(requests: DataFrame, albums: DataFrame, catalog: DataFrame, store: Store, strategies: list[Strategy] = STRATEGIES, steps: Steps | None = None) -> tuple[DataFrame, DataFrame]:
    """Requests with found and last, the strategies that gave results and that were tried last, and song_not_found; and the rows of the results."""
    scratch = Scratch(requests.sparkSession, "strategies", steps)
    having = albums.select("req_id").distinct().withColumn("has_album", F.lit(True))
    state = requests.join(having, "req_id", "left").select(*requests.columns, F.coalesce("has_album", F.lit(False)).alias("has_album"), _none().alias("found"), _none().alias("last"), F.lit(False).alias("song_not_found"))
    state, every = scratch.put(state), []
    for s in strategies:
        tried = F.coalesce(s.condition(), F.lit(False))
        todo = state.where(tried)
        if todo.limit(1).count():
            rows = scratch.put(s.run(todo.select(*requests.columns), albums, catalog, store), s.name)
            every.append(rows.withColumn("found", F.lit(s.name)))
            got = rows.groupBy("req_id").agg(F.bool_or("fallback").alias("fallback"))
            # the condition reads the state from before
            after = state.withColumn("tried", tried).join(got, "req_id", "left")
            state = scratch.put(
                after.withColumn("last", F.when(F.col("tried"), s.name).otherwise(F.col("last")))
                .withColumn("found", F.when(F.col("fallback").isNotNull(), s.name).otherwise(F.col("found")))
                .withColumn("song_not_found", F.coalesce("fallback", "song_not_found"))
                .drop("tried", "fallback")
            )
    if not every:
        return state, state.select("req_id", F.lit(None).cast("long").alias("id"), F.lit(1).alias("place"), _none().alias("release_title")).where("false")
    results = reduce(DataFrame.unionByName, every).join(state.select("req_id", "found"), ["req_id", "found"], "left_semi")
    return state, results.select("req_id", "id", "place", "release_title")


def search_type(found: Column, last: Column, song_not_found: Column) -> Column:
    """How a search is called: by what was found on other releases, or else by the strategy tried last."""
    kind = F.when(found == "track_on_compilation", "compilation")
    for s in STRATEGIES:
        kind = kind.when(last == s.name, F.when(song_not_found, "fallback").otherwise(s.kind) if s.kind == "direct" else F.lit(s.kind))
    return kind.otherwise("none")


def context_message(on_compilation: Column, song_not_found: Column, has_results: Column, artist: Column, song: Column, album: Column) -> Column:
    """What to tell about results that are not what was asked for; null if there is nothing to say. The texts are fixed values."""
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    filled = lambda x: F.coalesce(x != "", F.lit(False))
    other = song_not_found & has_results & filled(song)
    return (
        F.when(on_compilation, F.concat(F.lit("Found "), quoted(song), F.lit(" by "), artist, F.lit(" on:")))
        .when(other & filled(album), F.concat(quoted(album), F.lit(" not found in the library, but here are other albums by "), artist, F.lit(":")))
        .when(other, F.concat(quoted(song), F.lit(" is not on any album in the library, but here are some albums by "), artist, F.lit(":")))
        .when(song_not_found & ~has_results & filled(song) & filled(artist), F.concat(quoted(song), F.lit(" by "), artist, F.lit(" not found in library.")))
    )
