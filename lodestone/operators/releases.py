"""Release search, documents and validation, and upserts of the release store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.similarity import trigram_similarity, trigrams
from lodestone.functions.text import artist_and_album, confidence, image_or_null, is_compilation, tokens, without_suffix
from lodestone.operators.catalog import full_text, holders
from lodestone.operators.ranking import keep_first, top_k
from lodestone.sources.scratch import Scratch
from lodestone.sources.views import Store

#: Least trigram similarity. A fixed value.
SIMILAR = 0.3


#: Similarities at which the nearest texts are looked for first; who has enough of them asks no further.
LEVELS = (0.6,)


#: Bits by which two texts' trigrams are told apart, in numbers of 64.
SIGNS = 2


#: Pairs that would meet by one trigram beyond which keys of several are worth making, in all and for each known text.
#: Such keys have up to three trigrams, for known texts of more than so many two.
MEETINGS, MEETINGS_EACH, WIDTH, LONG = 20_000_000, 100, 3, 24


def _signs(hashed: Column) -> list[Column]:
    """For the hash of a trigram, numbers with its bit in one of them."""
    place = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(hashed, 8), F.lit(64)).cast("int"))
    return [F.when(F.pmod(hashed, F.lit(SIGNS)) == i, place).otherwise(F.lit(0).cast("long")).alias(f"signs_{i}") for i in range(SIGNS)]


def _keyed(rows: DataFrame, width: int, wanted: DataFrame | None = None) -> DataFrame:
    """rows (..., hs, m, some) with the key of each `width` of their trigrams' hashes (hs), and the place of the last (at): the first among `some`, each next one among one more. Of those wanted (m, width, h) alone, if given."""
    columns = rows.columns
    for i in range(width):
        begin = F.col("at") + 1 if i else F.lit(0)
        rows = rows.select("*", begin.alias("begin"), F.posexplode(F.slice("hs", begin + 1, F.greatest(F.col("some") + i - begin, F.lit(0)))).alias("step", f"h{i}"))
        rows = rows.withColumn("at", F.col("begin") + F.col("step")).drop("begin", "step")
        if wanted is not None:
            rows = rows.join(wanted.where(F.col("width") == width).select("m", F.col("h").alias(f"h{i}")), ["m", f"h{i}"], "left_semi")
    hashes = [F.col(f"h{i}") for i in range(width)]
    return rows.select(*[c for c in columns if c not in ("hs", "some")], "at", F.lit(width).alias("width"), (hashes[0] if width == 1 else F.xxhash64(*hashes)).alias("key"))


def _width(every: int) -> Column:
    """How many trigrams a key of an asked text has for known ones of a size, by the pairs that would meet: fewer by each more trigram, though neighbours come together, and more keys."""
    some, p = F.greatest(F.col("some"), F.lit(1)), F.col("often") / F.greatest(F.col("some"), F.lit(1)) / every
    fewer, keys, costs = F.least(10 * p, F.lit(1.0)), some.cast("double"), []
    for w in range(1, WIDTH + 1):
        if w > 1:
            keys = keys * (some + w - 1) / w
        cost = keys * (1 + F.col("of_size") * p * F.pow(fewer, F.lit(w - 1)))
        costs.append(F.when((F.col("c") >= w) & (F.lit(w <= 2) | (F.col("m") <= LONG)), F.struct(cost.alias("cost"), F.lit(w).alias("width"))))
    return F.least(*costs)["width"]


def nearest_texts(asked: DataFrame, known: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(asked, known, sim): the k texts of known (known, first) most similar to each asked text, of equal ones those of least first, all of SIMILAR at least.

    Texts of n and m trigrams as similar as t have c = t / (1 + t) * (n + m) of them
    in common, so they share one of the n - c + 1 rarest of the one and the m - c + 1
    rarest of the other. An asked text is looked for by these for each m
    that occurs; trigrams that no known text has count among its rarest, but meet
    nothing. Where very many pairs would meet by one trigram, as names that differ by
    their number do, a key is two or three of them: the first w that two texts share
    are among the n - c + w and m - c + w rarest. Of pairs that meet, those are verified whose signs, a bit for each
    trigram, leave c in common: a bit that only one side has is a trigram that
    the other lacks. The greater t, the fewer and rarer are those looked for, so the
    search starts from near equals and goes on for texts that have not found k yet.
    What comes last is not written: whoever reads the result more than once puts it.
    """
    # a text's trigrams are made once, by all tasks
    cut = lambda side, text: scratch.put(spread(side.where(f"{text} IS NOT NULL"), text).select("*", F.monotonically_increasing_id().alias("id"), trigrams(F.col(text)).alias("own")))
    asked, known = cut(asked.select("asked").distinct(), "asked"), cut(known, "known")
    often = scratch.put(known.select(F.explode("own").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")))

    signs = [f"signs_{i}" for i in range(SIGNS)]

    def rarest_first(side: DataFrame) -> DataFrame:
        columns = [c for c in side.columns if c != "own"]
        rows = spread(side.select(*columns, F.explode("own").alias("gram")).join(often, "gram", "left"), "id").withColumn("h", F.xxhash64("gram")).select("*", *_signs(F.col("h")))
        grams = F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "gram"))).alias("grams")
        return scratch.put(rows.groupBy(*columns).agg(grams, *[F.bit_or(s).alias(s) for s in signs]))

    left, all_known, found = rarest_first(asked), rarest_first(known), []
    sizes = scratch.put(all_known.groupBy(F.size("grams").alias("m")).agg(F.count("*").alias("of_size")))
    every = sizes.agg(F.sum("of_size")).first()[0] or 0
    for t in (*LEVELS, SIMILAR):
        # a known text's rarest trigrams as the least of similar texts asks for them
        most = F.size("grams") - F.ceil(t * F.size("grams") - 1e-9).cast("int") + 1
        theirs = all_known.select(F.col("id").alias("their_id"), *[F.col(s).alias(f"their_{s}") for s in signs], F.col("grams.h").alias("hs"), F.size("grams").alias("m"), most.alias("some"))
        met = F.filter("grams", lambda g: g["n"] > 0)
        ours = left.select("id", *signs, F.size("grams").alias("n"), met["h"].alias("hs"), met["n"].alias("ns")).join(F.broadcast(sizes), (F.col("m") >= t * F.col("n") - 1e-9) & (F.col("n") >= t * F.col("m") - 1e-9))
        ours = ours.withColumn("c", F.ceil(t / (1 + t) * (F.col("n") + F.col("m")) - 1e-9).cast("int")).withColumn("some", F.size("hs") - F.col("c") + 1).where((F.col("c") <= F.col("m")) & (F.col("some") > 0))
        ours = ours.withColumn("often", F.aggregate(F.slice("ns", F.lit(1), F.col("some")), F.lit(0).cast("long"), lambda a, x: a + x)).drop("ns")
        pairs_met = ours.agg(F.sum(F.col("often") * F.col("of_size") / max(every, 1))).first()[0] or 0
        if pairs_met > max(MEETINGS, MEETINGS_EACH * every):
            ours = scratch.put(ours.withColumn("width", _width(every)).drop("often", "of_size"))
            wanted = scratch.put(ours.select("m", "width", F.explode(F.slice("hs", F.lit(1), F.col("some") + F.col("width") - 1)).alias("h")).distinct())
            widths = sorted(r["width"] for r in wanted.select("width").distinct().collect())
            of_sizes = lambda w: theirs.join(wanted.where(F.col("width") == w).select("m").distinct(), "m", "left_semi")
            theirs = reduce(DataFrame.unionByName, [_keyed(of_sizes(w), w, wanted) for w in widths])
            ours = reduce(DataFrame.unionByName, [_keyed(ours.where(F.col("width") == w).drop("width"), w) for w in widths])
        else:
            ours, theirs = _keyed(ours.drop("often", "of_size"), 1), _keyed(theirs, 1)
        ours = ours.drop("at")
        lacking = lambda a, b: reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}{s}").bitwiseAND(F.bitwise_not(F.col(f"{b}{s}")))) for s in signs])
        could = (F.col("at") <= F.col("m") - F.col("c") + F.col("width") - 1) & (F.col("n") - lacking("", "their_") >= F.col("c")) & (F.col("m") - lacking("their_", "") >= F.col("c"))
        near = meeting(spread(ours, "id", "m", "key"), theirs).where(could).select("id", "their_id").distinct()
        # by their trigrams as they are
        mine, other = left.select("id", "asked", F.col("grams.gram").alias("grams")), all_known.select(F.col("id").alias("their_id"), "known", "first", F.col("grams.gram").alias("their_grams"))
        pairs = verified(spread(near.join(mine, "id").join(other, "their_id").drop("id", "their_id"), "asked", "known"), t)
        best = top_k(pairs.select("asked", "known", "first", "sim"), ["asked"], [F.desc("sim"), F.col("first"), F.col("known")], k).drop("rank", "first")
        if t > SIMILAR:
            best = scratch.put(best)
            enough = best.groupBy("asked").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("asked")
            left = left.join(enough, "asked", "left_anti")
            best = best.join(enough, "asked", "left_semi")
        found.append(best)
    return reduce(DataFrame.unionByName, found)


def spread(rows: DataFrame, *columns: str) -> DataFrame:
    """rows dealt over as many tasks as shuffles have: few bytes of them are much work, and by their size Spark would leave them to one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def meeting(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Asked texts with known ones of a size by a key, a trigram or several that are among the rarest of both."""
    return ours.join(theirs, ["key", "m", "width"])


def verified(pairs: DataFrame, t: float) -> DataFrame:
    """pairs (grams, their_grams, ...) with sim, their trigram similarity, those of at least t."""
    shared = F.size(F.array_intersect("grams", "their_grams"))
    return pairs.withColumn("sim", shared / (F.size("grams") + F.size("their_grams") - shared)).where(F.col("sim") >= t)


def first_by_title(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first row of each title in lower case, then the first k."""
    once = keep_first(rows.withColumn("low", F.lower("title")), [*keys, "low"], order).drop("low")
    return top_k(once, keys, order, k)


def _first_releases(rows: DataFrame, order: list[str], k: int) -> DataFrame:
    """Of the rows of each text (known) those of its first k releases, with the least of all as first."""
    same = Window.partitionBy("known")
    placed = rows.withColumn("place", F.dense_rank().over(same.orderBy("release_id"))).where(F.col("place") <= k).drop("place")
    return placed.withColumn("first", F.min(F.struct(*order)).over(same))


def by_track(asked: DataFrame, store: Store, k: int = 20) -> DataFrame:
    """(track, artist, release_id, title, artist_name, is_compilation, sim, rank): releases of the tracks most similar to each asked one.

    Twice k distinct (release, title) pairs by similarity, then the releases
    with their first artists, of which only those similar to an artist that is
    asked for stay, then one for each title.
    """
    scratch = Scratch(asked.sparkSession, "by_track")
    asked = scratch.put(asked.select("track", "artist", F.lower("track").alias("low")).where("track <> ''").distinct())
    titles = store.track.select("release_id", F.col("title").alias("track_title"), F.lower("title").alias("known")).distinct()
    # of releases with the same title the first 2k are enough, whoever asks
    held = scratch.put(_first_releases(titles, ["release_id", "track_title"], 2 * k))
    near = nearest_texts(asked.select(F.col("low").alias("asked")), held.select("known", "first").distinct(), 2 * k, scratch)
    order = [F.desc("sim"), F.col("release_id"), F.col("track_title")]
    best = scratch.put(top_k(near.join(held.drop("first"), "known"), ["asked"], order, 2 * k).drop("rank", "known"))
    some = best.select("release_id").distinct()
    artists = store.artist.where("extra = 0").select("release_id", "artist_name").join(some, "release_id")
    full = best.join(store.release.select(F.col("id").alias("release_id"), "title"), "release_id").join(artists, "release_id")
    rows = asked.join(full, F.col("low") == F.col("asked")).drop("low", "asked")
    rows = rows.where(F.col("artist").isNull() | (trigram_similarity(F.col("artist_name"), F.col("artist")) >= SIMILAR))
    # null artists are a key of their own
    found = first_by_title(rows, ["track", "artist"], [*order, F.col("artist_name")], k)
    return found.select("track", "artist", "release_id", "title", "artist_name", F.lower("artist_name").contains("various").alias("is_compilation"), "sim", "rank")


def searchable(asked: DataFrame) -> DataFrame:
    """Rows (req_id, artist, album, track) as search takes them: an album, or else a track, stands for the title; rows with nothing to search go."""
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    return asked.select("req_id", filled("artist").alias("artist"), F.coalesce(filled("album"), filled("track")).alias("album")).where("artist IS NOT NULL OR album IS NOT NULL")


def search(asked: DataFrame, releases: DataFrame, artists: DataFrame, k: int = 5) -> DataFrame:
    """(req_id, release_id, title, artist_name, artwork_url, score, confidence, rank) for rows (req_id, artist?, album?).

    With both, either similar enough will do and the better counts; with one,
    that one. The best 2k releases, one for each title, then by confidence.
    """
    # whatever is among the best 2k by the greater similarity is so by that one, and of
    # releases with the same title, or artist, the first 2k are enough
    scratch = Scratch(asked.sparkSession, "releases")
    asked = asked.select("req_id", "artist", "album", F.lower("artist").alias("low_artist"), F.lower("album").alias("low_album"))
    known = scratch.put(releases.select(F.col("id").alias("release_id"), "title", F.col("artwork_url")).join(artists.where("extra = 0").select("release_id", "artist_name"), "release_id"))
    ways, by = [], (("low_album", "title"), ("low_artist", "artist_name"))
    given = asked.agg(*[F.bool_or(F.col(low).isNotNull()).alias(low) for low, _ in by]).first()
    # what nobody asks by is not made ready
    for low, text in [way for way in by if given[way[0]]] or by:
        few = scratch.put(_first_releases(known.withColumn("known", F.lower(text)), ["release_id"], 2 * k))
        near = nearest_texts(asked.select(F.col(low).alias("asked")), few.select("known", "first").distinct(), 2 * k, scratch)
        # only the best of each asked text are given to all who ask for it
        best = near.join(few.drop("first"), "known").withColumn("place", F.dense_rank().over(Window.partitionBy("asked").orderBy(F.desc("sim"), "release_id"))).where(F.col("place") <= 2 * k)
        ways.append(asked.select("req_id", "artist", "album", F.col(low).alias("asked")).join(best, "asked").drop("asked", "known", "place"))
    # one row for each release: the greater similarity, first artist by name
    same = ["req_id", "artist", "album", "release_id", "title", "artwork_url", "artist_name"]
    scored = reduce(DataFrame.unionByName, ways).groupBy(*same).agg(F.max("sim").alias("score"))
    once = keep_first(scored, ["req_id", "release_id"], [F.desc("score"), F.col("artist_name")])
    best = top_k(once, ["req_id"], [F.desc("score"), F.col("release_id")], 2 * k).drop("rank")
    kept = first_by_title(best, ["req_id"], [F.desc("score"), F.col("release_id")], k).drop("rank")
    sure = kept.withColumn("confidence", confidence(F.col("artist"), F.col("album"), F.col("artist_name"), F.col("title")))
    ranked = top_k(sure, ["req_id"], [F.desc("confidence"), F.desc("score"), F.col("release_id")], k)
    return ranked.select("req_id", "release_id", "title", "artist_name", image_or_null(F.col("artwork_url")).alias("artwork_url"), "score", "confidence", "rank")


_REMOTE = ("id", "artist", "album", "thumb", "rank")


def listed(rows: DataFrame) -> DataFrame:
    """(id, artist, album, thumb) of a remote search's rows (id, title, thumb), titles being "Artist - Album": without an id or album they are no releases."""
    named = rows.select("id", artist_and_album(F.coalesce("title", F.lit(""))).alias("t"), image_or_null(F.col("thumb")).alias("thumb"))
    return named.select("id", "t.artist", "t.album", "thumb").where("album <> '' AND id IS NOT NULL")


def keyword_search(asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query, id, artist, album, thumb, rank): a remote search's rows that hold all words of the query, one for each album in lower case, by id."""
    known = listed(rows)
    met = full_text(asked.select("query").distinct(), known.select("id", F.col("album").alias("title"), "artist"), 2 * k).drop("rank")
    full = met.join(known, "id").withColumn("title", F.col("album"))
    return first_by_title(full, ["query"], [F.col("id")], k).select("query", *_REMOTE)


#: What a strict search asks for.
FIELDS = ("artist", "album", "track")


def strict_search(asked: DataFrame, rows: DataFrame, tracks: DataFrame, k: int) -> DataFrame:
    """(req_id, id, artist, album, thumb, rank) for rows (req_id, artist?, album?, track?): the fields given must hold their words, the track on one of the release's tracks (release_id, title).

    Requests with the same fields are searched for once, and a field's texts are
    met with the distinct texts of its entries. What holds each field of a request
    meets by id, so that no field that most releases have is handed to all who ask
    for it; requests come in by all of their fields, and their first k go back to them.
    """
    scratch = Scratch(asked.sparkSession, "strict")
    known = scratch.put(listed(rows))
    met = asked.select("req_id", *FIELDS).where("coalesce(artist, album, track) IS NOT NULL").withColumn("combined", _key(*FIELDS))
    combined = scratch.put(met.select("combined", *FIELDS).distinct())
    entries = {"artist": known.select("id", F.col("artist").alias("text")), "album": known.select("id", F.col("album").alias("text")), "track": tracks.select(F.col("release_id").alias("id"), F.col("title").alias("text"))}
    texts = {}
    for field in FIELDS:
        as_rows = entries[field].select(F.col("text").alias("id"), F.col("text").alias("title"), F.lit("").alias("artist")).where("id IS NOT NULL").distinct()
        held = holders(combined.where(F.col(field).isNotNull()).select(F.col(field).alias("req_id"), F.col(field).alias("query")).distinct(), as_rows, ("title",))
        texts[field] = scratch.put(held.select(F.col("req_id").alias(field), F.col("id").alias("text")))
    found = None
    # the sets of fields that are given, seven at most
    for given in combined.select(*[F.col(f).isNotNull().alias(f) for f in FIELDS]).distinct().collect():
        fields = [f for f in FIELDS if given[f]]
        of_these = combined.where(reduce(lambda a, b: a & b, [F.col(f).isNotNull() == given[f] for f in FIELDS]))
        sets = [of_these.select(f).distinct().join(texts[f], f).join(entries[f], "text").select("id", f).distinct() for f in fields]
        hits = reduce(lambda a, b: a.join(b, "id"), sets).join(of_these.select("combined", *fields), fields).select("combined", "id")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = combined.select("combined", F.lit(None).cast(known.schema["id"].dataType).alias("id")).limit(0)
    first = scratch.put(first_by_title(found.join(known, "id").withColumn("title", F.col("album")), ["combined"], [F.col("id")], k).select("combined", *_REMOTE))
    return met.select("req_id", "combined").join(first, "combined").select("req_id", *_REMOTE)


def supplemented(first: DataFrame, second: DataFrame, key: str, k: int, least: int = 3) -> DataFrame:
    """Rows (key, id, artist, album, thumb, rank) of first; where a key has fewer than `least`, those of second follow, one for each album over both."""
    full = first.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(key)
    more = second.join(full, key, "left_anti").withColumn("way", F.lit(2))
    both = first.withColumn("way", F.lit(1)).unionByName(more).withColumnRenamed("rank", "place").withColumn("title", F.col("album"))
    return first_by_title(both, [key], [F.col("way"), F.col("place")], k).select(key, *_REMOTE)


def _key(*columns: str) -> Column:
    """A text for values of which some may be null."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _words(*columns: str) -> Column:
    """The full-text tokens of columns as a plain query."""
    return F.array_join(tokens(F.concat_ws(" ", *columns)), " ")


def by_track_tiers(asked: DataFrame, store: Store, k: int = 20, least: int = 3) -> DataFrame:
    """by_track's rows with their source: store, or, for those it has nothing for, remote.

    The remote search is strict, by track and artist; where that gives fewer
    than `least`, one for all their words follows, without albums given before.
    """
    scratch = Scratch(asked.sparkSession, "track_tiers")
    found = by_track(asked, store, k).withColumn("source", F.lit("store"))
    if getattr(store, "remote", None) is None:
        return found
    found = scratch.put(found)
    key = _key("track", "artist")
    open_ = asked.where("track <> ''").select("track", "artist").distinct().withColumn("req_id", key)
    left = scratch.put(open_.join(found.select(key.alias("req_id")).distinct(), "req_id", "left_anti"))
    fields = left.select("req_id", F.nullif("artist", F.lit("")).alias("artist"), F.lit(None).cast("string").alias("album"), "track")
    strict = scratch.put(strict_search(fields, store.remote, store.track, k))
    enough = strict.groupBy("req_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("req_id")
    words = scratch.put(left.join(enough, "req_id", "left_anti").select("req_id", _words("track", "artist").alias("query")).where("query <> ''"))
    more = words.join(keyword_search(words, store.remote, k), "query").drop("query")
    both = supplemented(strict, scratch.put(more), "req_id", k, least).withColumnRenamed("artist", "artist_name")
    rows = left.join(both, "req_id").select("track", "artist", F.col("id").alias("release_id"), F.col("album").alias("title"), "artist_name", is_compilation(F.col("artist_name")).alias("is_compilation"), F.lit(None).cast(found.schema["sim"].dataType).alias("sim"), "rank", F.lit("remote").alias("source"))
    return found.unionByName(rows)


def search_tiers(asked: DataFrame, store: Store, k: int = 5) -> DataFrame:
    """search's rows with their source: store, or, for requests it has nothing for, remote.

    The remote search is strict, by artist and album; where that gives nothing
    at all, one for all their words.
    """
    scratch = Scratch(asked.sparkSession, "search_tiers")
    found = search(asked, store.release, store.artist, k).withColumn("source", F.lit("store"))
    if getattr(store, "remote", None) is None:
        return found
    found = scratch.put(found)
    left = scratch.put(asked.select("req_id", "artist", "album").join(found.select("req_id").distinct(), "req_id", "left_anti"))
    strict = scratch.put(strict_search(left.withColumn("track", F.lit(None).cast("string")), store.remote, store.track, k))
    words = scratch.put(left.join(strict.select("req_id").distinct(), "req_id", "left_anti").select("req_id", _words("artist", "album").alias("query")).where("query <> ''"))
    more = words.join(keyword_search(words, store.remote, k), "query").drop("query")
    rows = left.join(strict.unionByName(more).withColumnRenamed("artist", "artist_name").withColumnRenamed("album", "title"), "req_id")
    sure = rows.withColumn("confidence", confidence(F.col("artist"), F.col("album"), F.col("artist_name"), F.col("title"))).withColumnRenamed("rank", "place")
    ranked = top_k(sure, ["req_id"], [F.desc("confidence"), F.col("place")], k)
    remote = ranked.select("req_id", F.col("id").alias("release_id"), "title", "artist_name", F.col("thumb").alias("artwork_url"), F.lit(None).cast(found.schema["score"].dataType).alias("score"), "confidence", "rank", F.lit("remote").alias("source"))
    return found.unionByName(remote)


def known_documents(store: Store, ids: DataFrame) -> DataFrame:
    """(release_id, artist, tracklist) of ids (release_id): the store's, or else the remote documents'."""
    own = documents(store, ids)
    whole = lambda docs: docs.select("release_id", "artist", F.transform("tracklist", lambda t: F.struct(t["title"].alias("title"), t["artists"].alias("artists"))).alias("tracklist"))
    if getattr(store, "remote_documents", None) is None:
        return whole(own)
    there = store.release.select(F.col("id").alias("release_id"))
    missing = ids.select("release_id").distinct().join(there, "release_id", "left_anti")
    return whole(own).unionByName(whole(keep_first(store.remote_documents, ["release_id"], [F.col("title")])).join(missing, "release_id", "left_semi"))


def documents(store: Store, ids: DataFrame | None = None) -> DataFrame:
    """Each release, or each of ids (release_id), with its first artist, its images and its tracks in order, each with its artists."""
    some = (lambda rows: rows) if ids is None else (lambda rows: rows.join(ids.select("release_id").distinct(), "release_id", "left_semi"))
    names = some(store.track_artist).groupBy("release_id", "track_sequence").agg(F.array_sort(F.collect_list("artist_name")).alias("artists"))
    joined = some(store.track).join(names.withColumnRenamed("track_sequence", "sequence"), ["release_id", "sequence"], "left")
    nested = joined.groupBy("release_id").agg(F.array_sort(F.collect_list(F.struct("sequence", F.coalesce("position", F.lit("")).alias("position"), "title", "duration", F.coalesce("artists", F.array().cast("array<string>")).alias("artists")))).alias("tracklist"))
    first = some(store.artist).where("extra = 0").groupBy("release_id").agg(F.min("artist_name").alias("artist"))
    return (
        some(store.release.withColumnRenamed("id", "release_id"))
        .join(first, "release_id", "left")
        .join(nested, "release_id", "left")
        .withColumn("tracklist", F.coalesce("tracklist", F.array().cast(nested.schema["tracklist"].dataType)))
    )


def fallback_images(ids: DataFrame, store: Store) -> DataFrame:
    """(release_id, image): the first image of a release's artist, or else of its label."""
    first = lambda images, key: images.select(key, F.get("images", F.lit(0)).alias(f"{key}_image"))
    rows = store.release.withColumnRenamed("id", "release_id").join(ids.select("release_id").distinct(), "release_id", "left_semi")
    named = rows.join(first(store.artist_image, "artist_id"), "artist_id", "left").join(first(store.label_image, "label_id"), "label_id", "left")
    return named.select("release_id", F.coalesce("artist_id_image", "label_id_image").alias("image"))


def within(a: Column, b: Column) -> Column:
    """Either holds the other."""
    return a.contains(b) | b.contains(a)


def validate(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """asked (release_id, track, artist, ...) with valid: a track whose title and artist match; null for unknown releases.

    A track with artists of its own is judged by those alone, others by the
    release's artist.
    """
    known = docs.select("release_id", F.col("artist").alias("release_artist"), "tracklist", F.lit(True).alias("known"))
    track, artist = F.lower("track"), F.lower("artist")
    ok = F.exists(
        "tracklist",
        lambda t: within(F.lower(t["title"]), track) & F.when(F.size(t["artists"]) > 0, F.exists(t["artists"], lambda a: within(without_suffix(a), artist))).otherwise(within(without_suffix(F.coalesce("release_artist", F.lit(""))), artist)),
    )
    return asked.join(known, "release_id", "left").withColumn("valid", F.when(F.col("known"), F.coalesce(ok, F.lit(False)))).drop("release_artist", "tracklist", "known")


def releases_of_track(asked: DataFrame, store: Store, k: int = 20) -> DataFrame:
    """(track, artist, release_id, title, artist_name, rank) of by_track's releases; with an artist only those that have the track by that artist."""
    scratch = Scratch(asked.sparkSession, "of_track")
    found = scratch.put(by_track_tiers(asked, store, k))
    judged = validate(found.where("artist IS NOT NULL").select("release_id", "track", "artist").distinct(), known_documents(store, found.where("artist IS NOT NULL").select("release_id")))
    good = judged.where("valid").drop("valid")
    kept = found.where("artist IS NULL").unionByName(found.join(good, ["release_id", "track", "artist"], "left_semi"))
    return kept.select("track", "artist", "release_id", "title", "artist_name", "rank")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new, and what of old it does not replace."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old, and what of new it does not have."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"))


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Children of parents in new are replaced as a whole."""
    return new.unionByName(old.join(new.select(parent).distinct(), parent, "left_anti"))
