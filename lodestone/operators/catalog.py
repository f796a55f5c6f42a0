"""Search of the catalog for many queries at once, and correction of artists.

Queries are rows (query, ...), the distinct ones of a batch, so that a text
asked often is searched once; rows that share title and artist are one text,
which stands for the least of their ids. No operator compares all queries with
all texts: full text goes through the rarest token of the query, a prefix
through its first letters, substring search through its rarest pair of letters,
fuzzy search through the first letters of its longest word, and correction
through an artist's first letters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.similarity import indel_ratio, letters, ratio_bound, set_ratio_bound, token_set_ratio
from lodestone.functions.text import STOPWORDS, marked_words, plain_words, significant, tokens, words
from lodestone.operators.ranking import first_hit, top_k
from lodestone.sources.scratch import Scratch

#: Rows that fuzzy search scores at most, its least score, and the artists that correction looks at. Fixed values.
FUZZY_ROWS, FUZZY_SCORE, ARTISTS = 500, 70, 100
#: Rounding of a bound, so that none cuts a score right at the threshold.
SLACK = 1e-6
#: Least score of an album found by some of its words. A fixed value.
ALBUM_SCORE = 60


def _grams(x: Column, n: int) -> Column:
    """Distinct substrings of n characters."""
    return F.when(F.length(x) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - n + 1), lambda i: F.substring(x, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def texts_of(catalog: DataFrame, k: int) -> DataFrame:
    """(id, first, title, artist): the k least ids of each distinct text; first is the least, which stands for the text."""
    same = Window.partitionBy("title", "artist").orderBy("id")
    return catalog.select("id", F.first("id").over(same).alias("first"), F.row_number().over(same).alias("place"), "title", "artist").where(F.col("place") <= k).drop("place")


def _distinct(texts: DataFrame) -> DataFrame:
    return texts.where("id = first").select("first", "title", "artist")


def _least(matched: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(query, id, rank) of the k least ids of the matched (query, first): they are among those of the k texts with the least first ids."""
    few = top_k(matched.select("query", "first"), ["query"], [F.col("first")], k).drop("rank")
    return top_k(few.join(texts.select("first", "id"), "first").select("query", "id"), ["query"], [F.col("id")], k)


def _by_rarest(queries: DataFrame, units: str, rows: DataFrame, row_units: Column) -> DataFrame:
    """queries x rows that share the query's rarest unit; queries all of whose units occur."""
    posted = rows.select("*", F.explode(F.array_distinct(row_units)).alias("unit"))
    often = posted.groupBy("unit").agg(F.count("*").alias("n"))
    asked = queries.select("*", F.explode(F.array_distinct(units)).alias("unit"))
    rarest = asked.join(often, "unit").groupBy("query").agg(F.min_by("unit", F.struct("n", "unit")).alias("unit"), F.count("*").alias("met"))
    return queries.join(rarest, "query").where(F.col("met") == F.size(F.array_distinct(units))).drop("met").join(posted, "unit").drop("unit")


def is_plain(query: Column) -> Column:
    """Words alone, none of them an operator: what full text takes as all-of."""
    return query.rlike(r"^[\w\s\x{80}-\x{10ffff}]+$") & ~query.rlike(r"(^|\s)(AND|OR|NOT|NEAR)(\s|$)")


def _tokens_in(columns: tuple[str, ...]) -> Column:
    return F.concat(*[tokens(F.col(c)) for c in columns])


def _has_all(asked: DataFrame, texts: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """asked (query, asked, ...) with the texts (first and columns' tokens as found) that hold all tokens asked."""
    rows = _distinct(texts).select("first", _tokens_in(columns).alias("found"))
    return _by_rarest(asked.where(F.size("asked") > 0), "asked", rows, F.col("found")).where(F.size(F.array_except("asked", "found")) == 0)


BOTH = ("title", "artist")


def full_text(queries: DataFrame, catalog: DataFrame, k: int, columns: tuple[str, ...] = BOTH, texts: DataFrame | None = None) -> DataFrame:
    """(query, id, rank): rows with all tokens of the query in title or artist, or in the columns given, by id. Queries that are not plain find nothing here."""
    texts = texts_of(catalog, k) if texts is None else texts
    asked = queries.where(is_plain(F.col("query"))).select("query", tokens(F.col("query")).alias("asked"))
    return _least(_has_all(asked, texts, columns), texts, k)


def holders(asked: DataFrame, rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(req_id, id) for rows (req_id, query): all ids of rows that hold all tokens of the query in one of their entries."""
    words = asked.select("query").distinct().select("query", tokens(F.col("query")).alias("asked"))
    met = _has_all(words, rows.select(F.col("id").alias("first"), F.col("id"), "title", "artist"), columns).select("query", F.col("first").alias("id"))
    return asked.join(met, "query").select("req_id", "id").distinct()


def _spaced(found: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(found, " "), F.lit(" "))


def phrase(queries: DataFrame, catalog: DataFrame, k: int, columns: tuple[str, ...] = BOTH, initial: bool = False) -> DataFrame:
    """(query, id, rank): rows one of whose columns has the query's tokens one after the other, or starts with them if initial."""
    texts = texts_of(catalog, k)
    asked = queries.select("query", tokens(F.col("query")).alias("asked"))
    found = []
    for column in columns:
        met = _has_all(asked, texts, (column,))
        holds = _spaced(F.col("found")).startswith(_spaced(F.col("asked"))) if initial else _spaced(F.col("found")).contains(_spaced(F.col("asked")))
        found.append(met.where(holds).select("query", "first"))
    return _least(reduce(DataFrame.union, found).distinct(), texts, k)


def near(queries: DataFrame, catalog: DataFrame, k: int, within: int = 10, columns: tuple[str, ...] = BOTH) -> DataFrame:
    """(query, id, rank): rows one of whose columns has the query's first and last token, whatever is between these in the query, with `within` tokens between them at most. `index.match` has NEAR of any words."""
    texts = texts_of(catalog, k)
    ends = F.array(F.get("asked", F.lit(0)), F.element_at("asked", -1))
    asked = queries.select("query", tokens(F.col("query")).alias("asked")).where(F.size("asked") > 1).select("query", ends.alias("asked"))
    places = lambda i: F.filter(F.sequence(F.lit(0), F.size("found") - 1), lambda p: F.get("found", p) == F.get("asked", F.lit(i)))
    close = F.exists(places(0), lambda p: F.exists(places(1), lambda q: (p != q) & (F.abs(p - q) <= within + 1)))
    found = [_has_all(asked, texts, (c,)).where(close).select("query", "first") for c in columns]
    return _least(reduce(DataFrame.union, found).distinct(), texts, k)


def prefix(queries: DataFrame, catalog: DataFrame, k: int, columns: tuple[str, ...] = BOTH) -> DataFrame:
    """(query, id, rank): rows with a token that starts with the query, one token of any length."""
    texts = texts_of(catalog, k)
    asked = queries.select("query", F.get(tokens(F.col("query")), F.lit(0)).alias("start")).where("start IS NOT NULL").withColumn("letters", F.substring("start", 1, 3))
    posted = _distinct(texts).select("first", F.explode(F.array_distinct(_tokens_in(columns))).alias("token"))
    # a text's tokens meet through one, two and three letters, the distinct ones of all texts
    words = posted.select("token").distinct().select("token", F.explode(F.array_distinct(F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda n: F.substring("token", F.lit(1), n)))).alias("letters"))
    met = asked.join(words, "letters").where(F.col("token").startswith(F.col("start"))).select("query", "token")
    return _least(met.join(posted, "token").select("query", "first").distinct(), texts, k)


def any_token(queries: DataFrame, catalog: DataFrame, k: int) -> DataFrame:
    """(query, id, rank): rows with at least one of the query's tokens in title or artist."""
    texts = texts_of(catalog, k)
    asked = queries.select("query", F.explode(F.array_distinct(tokens(F.col("query")))).alias("token"))
    posted = _distinct(texts).select("first", F.explode(F.array_distinct(_tokens_in(BOTH))).alias("token"))
    # k texts of each token are enough, whoever asks
    few = top_k(posted, ["token"], [F.col("first")], k).drop("rank")
    return _least(asked.join(few, "token").select("query", "first").distinct(), texts, k)


def without(queries: DataFrame, catalog: DataFrame, k: int) -> DataFrame:
    """(query, id, rank) for rows (query, excluded): rows with all tokens of the query and none of those excluded."""
    texts = texts_of(catalog, k)
    asked = queries.select("query", tokens(F.col("query")).alias("asked"), tokens(F.coalesce("excluded", F.lit(""))).alias("no"))
    return _least(_has_all(asked, texts, BOTH).where(~F.arrays_overlap("no", "found")), texts, k)


def search_words(query: Column) -> Column:
    """Words of two letters or more without stop words; all of them if nothing else is left."""
    longer = F.filter(plain_words(query), lambda w: F.length(w) > 1)
    telling = F.filter(longer, lambda w: ~w.isin(STOPWORDS))
    return F.when(F.size(telling) > 0, telling).otherwise(longer)


def all_words(queries: DataFrame, catalog: DataFrame, k: int, texts: DataFrame | None = None) -> DataFrame:
    """(query, id, rank): rows that hold each word in title or artist, by id."""
    texts = texts_of(catalog, k) if texts is None else texts
    asked = queries.select("query", search_words(F.col("query")).alias("asked")).where(F.size("asked") > 0)
    asked = asked.withColumn("pairs", F.flatten(F.transform("asked", lambda w: _grams(w, 2))))
    title, artist = (F.lower(F.coalesce(c, F.lit(""))) for c in BOTH)
    rows = _distinct(texts).select("first", title.alias("low_title"), artist.alias("low_artist"), F.concat(_grams(title, 2), _grams(artist, 2)).alias("grams"))
    met = _by_rarest(asked, "pairs", rows, F.col("grams")).where(F.forall("asked", lambda w: F.col("low_title").contains(w) | F.col("low_artist").contains(w)))
    return _least(met, texts, k)


def like(rows: DataFrame, artist: Column | None = None, title: Column | None = None) -> DataFrame:
    """Rows whose artist and title hold the given texts, letters A to Z in either case."""
    fold = lambda x: F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for column, value in (("artist", artist), ("title", title)):
        if value is not None:
            rows = rows.where(fold(F.col(column)).contains(fold(value)))
    return rows


def fuzzy(queries: DataFrame, catalog: DataFrame, k: int, threshold: int = FUZZY_SCORE, texts: DataFrame | None = None, rows: int | None = FUZZY_ROWS) -> DataFrame:
    """(query, id, score, rank) of rows that hold the start of the query's longest word and score the threshold or more: of the first `rows` by id that hold it, or of all if None."""
    texts = texts_of(catalog, FUZZY_ROWS) if texts is None else texts
    found = plain_words(F.col("query"))
    # the first of the longest words
    longest = F.aggregate(found, F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    asked = queries.select("query", F.substring(longest, 1, 3).alias("start")).where("start <> ''")
    starts = asked.select("start").distinct()
    low = [F.lower(F.coalesce(c, F.lit(""))) for c in BOTH]
    held = _distinct(texts).select("first", F.explode(F.array_distinct(F.concat(*[_grams(x, n) for x in low for n in (1, 2, 3)]))).alias("start")).join(starts, "start")
    # the rows of a start are the same for all its queries; texts have the least ids that they need, of which k are enough where all rows are scored
    words = texts.select("first", "id", F.lower(F.concat_ws(" ", F.coalesce("artist", F.lit("")), F.coalesce("title", F.lit("")))).alias("text"))
    if rows is None:
        block = held.join(top_k(words, ["first"], [F.col("id")], k).drop("rank"), "first").select("start", "id", "text")
    else:
        block = top_k(held.join(words, "first").select("start", "id", "text"), ["start"], [F.col("id")], rows).drop("rank")
    # many rows share a text: each pair of texts is scored once
    texts_of_start = block.select("start", "text").distinct()
    known = texts_of_start.select("text").distinct().withColumn("theirs", letters(F.col("text")))
    mine, other = asked.withColumn("own", letters(F.lower("query"))), texts_of_start.join(known, "text")
    met = in_parts(mine, other, "start", "text") if rows is None else mine.join(other, "start")
    near = met.where(set_ratio_bound(F.col("own"), F.col("theirs")) >= threshold - SLACK).select("start", "query", "text")
    scored = near.withColumn("score", token_set_ratio(F.lower("query"), F.col("text"))).where(F.col("score") >= threshold)
    return top_k(scored.join(block, ["start", "text"]).select("query", "id", "score"), ["query"], [F.desc("score"), F.col("id")], k)


def in_parts(mine: DataFrame, other: DataFrame, key: str, text: str) -> DataFrame:
    """mine joined with other by key: as a key may have very many texts of other, each row of mine meets them in parts, which all tasks share."""
    parts = int(mine.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = mine.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(parts, key, "part")
    return dealt.join(other.withColumn("part", F.pmod(F.xxhash64(text), F.lit(parts)).cast("int")), [key, "part"]).drop("part")


TEXT_COLUMNS = ["id", "first", "title", "artist"]


def searchable(catalog: DataFrame) -> DataFrame:
    """The catalog's texts with what search needs of their ids, written: a catalog to search several times over. One that is made already stays as it is."""
    if catalog.columns == TEXT_COLUMNS:
        return catalog
    return Scratch(catalog.sparkSession, "texts").put(texts_of(catalog, FUZZY_ROWS))


class Searched:
    """A searchable catalog with what a search for many texts has found: asked for these again it looks them up. With rows as in `fuzzy`, for these texts and others."""

    def __init__(self, texts: DataFrame, queries: DataFrame, k: int, rows: int | None = FUZZY_ROWS):
        scratch = Scratch(texts.sparkSession, "searched")
        self.texts, self.k, self.rows = texts, k, rows
        self.asked = scratch.put(queries.select("query").where("query IS NOT NULL").distinct())
        self.hits = scratch.put(search(self.asked, texts, k, rows=rows))

    def __getattr__(self, name: str):
        return getattr(self.texts, name)


def _looked_up(queries: DataFrame, known: Searched, k: int) -> DataFrame:
    """search for queries of which most have been asked."""
    found = known.hits.join(queries, "query", "left_semi")
    left = Scratch(queries.sparkSession, "left").put(queries.join(known.asked, "query", "left_anti"))
    return found.unionByName(search(left, known.texts, k, rows=known.rows)) if left.limit(1).count() else found


def search(queries: DataFrame, catalog: DataFrame | Searched, k: int, kept=None, rows: int | None = FUZZY_ROWS) -> DataFrame:
    """(query, id, rank, tier): full text, else all words, else fuzzy; each tier sees what the one before left.

    With a kept index full text takes query strings of the whole grammar.
    """
    queries = queries.select("query").distinct()
    if isinstance(catalog, Searched):
        return _looked_up(queries, catalog, k) if k == catalog.k and kept is None else search(queries, catalog.texts, k, kept, catalog.rows)
    scratch, texts = Scratch(queries.sparkSession, "search"), searchable(catalog)
    # read by the next tier and by the result
    one = scratch.put(full_text(queries, catalog, k, texts=texts) if kept is None else kept.match(queries, k, scratch))
    left = queries.join(one.select("query").distinct(), "query", "left_anti")
    two = scratch.put(all_words(left, catalog, k, texts))
    three = fuzzy(left.join(two.select("query").distinct(), "query", "left_anti"), catalog, k, texts=texts, rows=rows).drop("score")
    return first_hit("query", [one, two, three])


def album_fuzzy(albums: DataFrame, catalog: DataFrame, k: int) -> DataFrame:
    """(query, id, rank): search for the albums; for those not found, a search for their first four telling words, whose rows `accepts` has to let pass."""
    scratch, catalog = Scratch(albums.sparkSession, "albums"), searchable(catalog)
    albums = albums.select("query").distinct()
    found = scratch.put(search(albums, catalog, k).select("query", "id", "rank"))
    telling = significant(marked_words(F.col("query")), 3)
    left = albums.join(found.select("query").distinct(), "query", "left_anti").select(F.col("query").alias("album"), F.array_join(F.slice(telling, 1, 4), " ").alias("query")).where("query <> ''")
    left = scratch.put(left)
    rows = left.join(search(left.select("query"), catalog, k), "query").join(catalog.select("id", "title"), "id")
    kept = rows.where(accepts(F.col("album"), F.col("title"))).select(F.col("album").alias("query"), "id", "rank")
    return found.unionByName(top_k(kept.withColumnRenamed("rank", "place"), ["query"], [F.col("place")], k).drop("place"))


def accepts(album: Column, title: Column) -> Column:
    """Whether the title holds two of the album's telling words, of all of them, and comes near enough to it."""
    low = F.lower(F.coalesce(title, F.lit("")))
    held = F.size(F.filter(significant(marked_words(album), 3), lambda w: low.contains(w)))
    return (held >= 2) & (set_ratio_bound(letters(F.lower(album)), letters(low)) >= ALBUM_SCORE - SLACK) & (token_set_ratio(F.lower(album), low) >= ALBUM_SCORE)


def artist_block(artist: Column) -> Column:
    """First three letters of the first word of three or more; null without one."""
    return F.substring(F.get(F.filter(words(F.lower(artist)), lambda w: F.length(w) >= 3), F.lit(0)), 1, 3)


def correct_artist(asked: DataFrame, catalog: DataFrame, threshold: int = 85, artists: int | None = ARTISTS) -> DataFrame:
    """(artist, corrected) where another artist of the block, of its first `artists` by name or of all if None, comes near enough: at least 100 less twice the name's length."""
    names = catalog.select("artist").where("artist IS NOT NULL").distinct()
    blocks = names.select(F.col("artist").alias("known"), F.lower(F.substring("artist", 1, 3)).alias("block"))
    low = F.lower("artist")
    named = asked.select("artist").where("artist IS NOT NULL").distinct().select("artist", artist_block(F.col("artist")).alias("block"), letters(low).alias("own"))
    if artists is None:
        pairs = in_parts(named.where("block IS NOT NULL"), blocks.withColumn("theirs", letters(F.lower("known"))), "block", "known")
    else:
        pairs = named.join(top_k(blocks, ["block"], [F.col("known")], artists).drop("rank").withColumn("theirs", letters(F.lower("known"))), "block")
    least = F.greatest(F.lit(threshold), 100 - 2 * F.length("artist"))
    scored = pairs.where(ratio_bound(F.col("own"), F.col("theirs")) >= least - SLACK).select("artist", "known").withColumn("score", indel_ratio(low, F.lower("known")))
    best = Window.partitionBy("artist").orderBy(F.desc("score"), "known")
    near = scored.where(F.col("score") >= least)
    first = near.withColumn("place", F.row_number().over(best)).where("place = 1").select("artist", F.col("known").alias("corrected"))
    return first.where(F.lower("corrected") != low)
