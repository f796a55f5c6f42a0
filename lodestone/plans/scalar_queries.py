"""Queries of the text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import similarity, text
from lodestone.sources import views

#: Where addresses of catalog rows and of releases start, in these queries.
LIBRARY, RELEASES = "http://catalog.example/row?id=", "http://releases.example/"
STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)


def norm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", text.norm(F.col("text")).alias("norm")).select("doc_id", F.md5("norm").alias("norm_md5"), F.length("norm").cast("long").alias("n"))


def compilation_flag(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", text.is_compilation(F.col("text")).alias("is_compilation"))


def ambiguous_split(spark, sf_dir):
    parts = text.ambiguous_parts(F.col("text"))
    said = views.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(parts["part1"]).alias("part1"), F.md5(parts["part2"]).alias("part2"))
    return said


def parse_title(spark, sf_dir):
    t = F.concat("p_brand", F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(" - "), "p_name", F.when(F.col("p_partkey") % 4 == 0, " - live (2)").otherwise(""))
    found = text.artist_and_album(F.col("t"))
    return views.table(spark, sf_dir, "part").select("p_partkey", t.alias("t")).select(F.col("p_partkey").alias("id"), found["artist"].alias("artist"), found["album"].alias("album"), text.without_suffix(F.col("t")).alias("bare"))


def significant_words(spark, sf_dir):
    found = text.significant(text.marked_words(F.col("text")), 3)
    return views.table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(found, 1, 4), " ").alias("words"), F.size(found).cast("long").alias("n"))


def call_number(spark, sf_dir):
    c = views.catalog(spark, sf_dir)
    return c.select("id", text.call_number(*(F.col(x) for x in ("genre", "format", "call_letters", "artist_call_number", "release_call_number"))).alias("call_number"), text.url_of(LIBRARY, F.col("id")).alias("library_url"), F.when(F.col("id") % 2 == 0, text.url_of(RELEASES, F.col("id"))).alias("release_url"))


def confidence_score(spark, sf_dir):
    r = views.requests(spark, sf_dir).select(F.col("req_id").alias("id"), F.col("artist").alias("asked_artist"), F.col("album").alias("asked_album"))
    both = r.join(views.catalog(spark, sf_dir), "id")
    return both.select("id", text.confidence(F.col("asked_artist"), F.col("asked_album"), F.col("artist"), F.col("title")).alias("confidence"))


def _pairs(spark, sf_dir) -> DataFrame:
    """Each part's name and brand against a changed form of them."""
    name = F.concat(F.regexp_replace("p_name", "[aeiou]", ""), F.lit(" "), F.lower("p_type"))
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lower(name).alias("a"), F.lower(F.concat("p_name", F.lit(" "), "p_type")).alias("b"))


def _scored(function):
    def query(spark, sf_dir):
        pairs = _pairs(spark, sf_dir)
        # a pair of texts that comes again is scored once
        scored = pairs.select("a", "b").distinct().withColumn("score", F.round(function(F.col("a"), F.col("b")), 6))
        return pairs.join(scored, ["a", "b"]).select("id", "score")

    return query


def lcs_sql(a: str, b: str) -> str:
    """DuckDB: the last number of the last row of the table, each row made from the one before."""
    return f"""CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE
 list_reduce(list_prepend(list_transform(range(length({b}) + 1), lambda z: CAST(0 AS BIGINT)), list_transform(string_split({a}, ''), lambda ca: [CAST(unicode(ca) AS BIGINT)])),
  lambda before, ca: list_reduce(list_prepend([CAST(0 AS BIGINT)], list_transform(range(1, length({b}) + 1), lambda z: [z])),
   lambda now, j: list_append(now, CASE WHEN unicode({b}[j[1]]) = ca[1] THEN before[j[1]] + 1 ELSE greatest(before[j[1] + 1], now[j[1]]) END)))[length({b}) + 1] END"""


def ratio_sql(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 100.0 ELSE 200.0 * ({lcs_sql(a, b)}) / (length({a}) + length({b})) END"


def trigrams_sql(x: str) -> str:
    return f"""list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''),
 lambda w: list_transform(range(1, length(w) + 2), lambda i: ('  ' || w || ' ')[i:i + 2]))))"""


def similarity_sql(a: str, b: str) -> str:
    x, y = trigrams_sql(a), trigrams_sql(b)
    return f"CASE WHEN len(list_distinct(list_concat({x}, {y}))) = 0 THEN 0.0 ELSE len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y}))) END"


def token_set_sql(source: str, a: str, b: str, keep: str) -> str:
    """A select of keep and score over source, step by step."""
    return f"""SELECT {keep}, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 WHEN s > 0 AND (n = 0 OR m = 0) THEN 100.0 WHEN s = 0 THEN rest
  ELSE greatest(rest, 100.0 - 100.0 * (g + n) / (s + s + g + n), 100.0 - 100.0 * (g + m) / (s + s + g + m)) END AS score
FROM (SELECT *, 100.0 - 100.0 * (n + m - 2 * ({lcs_sql('ox', 'oy')})) / (s + g + n + s + g + m) AS rest
 FROM (SELECT *, length(sh) AS s, length(ox) AS n, length(oy) AS m, CASE WHEN length(sh) > 0 THEN 1 ELSE 0 END AS g
  FROM (SELECT *, array_to_string(list_filter(x, lambda w: list_contains(y, w)), ' ') AS sh, array_to_string(list_filter(x, lambda w: NOT list_contains(y, w)), ' ') AS ox,
    array_to_string(list_filter(y, lambda w: NOT list_contains(x, w)), ' ') AS oy
   FROM (SELECT *, list_sort(list_distinct(list_filter(regexp_split_to_array({a}, '\\s+'), lambda w: w <> ''))) AS x,
     list_sort(list_distinct(list_filter(regexp_split_to_array({b}, '\\s+'), lambda w: w <> ''))) AS y FROM {source}))))"""


PAIRS_SQL = "(SELECT p_partkey AS id, lower(regexp_replace(p_name, '[aeiou]', '', 'g') || ' ' || lower(p_type)) AS a, lower(p_name || ' ' || p_type) AS b FROM part)"
_DASH = text.DASHED
_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"

QUERIES = {
    "norm_text": norm_text,
    "compilation_flag": compilation_flag,
    "ambiguous_split": ambiguous_split,
    "parse_title": parse_title,
    "significant_words": significant_words,
    "call_number": call_number,
    "confidence_score": confidence_score,
    "indel_ratio": _scored(similarity.indel_ratio),
    "token_set_ratio": _scored(similarity.token_set_ratio),
    "trigram_similarity": _scored(similarity.trigram_similarity),
}

ORACLE_SQL = {
    "norm_text": "SELECT doc_id, md5(coalesce(lower(strip_accents(text)), '')) AS norm_md5, CAST(length(coalesce(lower(strip_accents(text)), '')) AS BIGINT) AS n FROM documents",
    "compilation_flag": "SELECT doc_id, coalesce(regexp_matches(lower(text), 'various|soundtrack|compilation|v/a|v\\.a\\.'), false) AS is_compilation FROM documents",
    "ambiguous_split": f"""WITH g AS (SELECT conv_id, turn, text, regexp_extract(text, '{_DASH}', 1) AS a, regexp_extract(text, '{_DASH}', 2) AS b, regexp_extract(text, '{_DASH}', 3) AS c, regexp_extract(text, '{_DASH}', 4) AS d,
  instr(text, '. ') AS dot FROM conversations),
p AS (SELECT *, {_TRIM.format("CASE WHEN a <> '' AND b <> '' THEN a ELSE c END")} AS f, {_TRIM.format("CASE WHEN a <> '' AND b <> '' THEN b ELSE d END")} AS s,
  {_TRIM.format("text[1:dot - 1]")} AS o, {_TRIM.format("text[dot + 2:]")} AS t FROM g)
SELECT conv_id, turn, md5(CASE WHEN f <> '' AND s <> '' THEN f WHEN dot > 0 AND o <> '' AND t <> '' THEN o END) AS part1, md5(CASE WHEN f <> '' AND s <> '' THEN s WHEN dot > 0 AND o <> '' AND t <> '' THEN t END) AS part2 FROM p""",
    "parse_title": r"""WITH t AS (SELECT p_partkey AS id, p_brand || CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE ' - ' END || p_name || CASE WHEN p_partkey % 4 = 0 THEN ' - live (2)' ELSE '' END AS t FROM part)
SELECT id, CASE WHEN instr(t, ' - ') > 0 THEN trim(t[1:instr(t, ' - ') - 1]) ELSE '' END AS artist, CASE WHEN instr(t, ' - ') > 0 THEN trim(t[instr(t, ' - ') + 3:]) ELSE t END AS album,
  regexp_replace(split_part(lower(t), '(', 1), '^\s+|\s+$', '', 'g') AS bare FROM t""",
    "significant_words": f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda x: length(x) > 3 AND x NOT IN ({STOP})) AS w FROM documents)
SELECT doc_id, array_to_string(w[1:4], ' ') AS words, CAST(len(w) AS BIGINT) AS n FROM w""",
    "call_number": f"""WITH {views.SQL} SELECT id, CASE WHEN release_call_number IS NULL THEN concat_ws(' ', genre, format, call_letters, artist_call_number) ELSE concat_ws(' ', genre, format, call_letters, artist_call_number) || '/' || release_call_number END AS call_number,
  '{LIBRARY}' || id AS library_url, CASE WHEN id % 2 = 0 THEN '{RELEASES}' || id END AS release_url FROM catalog""",
    "confidence_score": f"""WITH {views.SQL},
j AS (SELECT c.id, trim(lower(coalesce(r.artist, ''))) AS a, trim(lower(coalesce(r.album, ''))) AS b, trim(lower(coalesce(c.artist, ''))) AS x, trim(lower(coalesce(c.title, ''))) AS y FROM requests r JOIN catalog c ON c.id = r.req_id),
s AS (SELECT id, CASE WHEN a = '' OR x = '' THEN 0 WHEN a = x THEN 4 WHEN contains(a, x) OR contains(x, a) THEN 3 ELSE 0 END + CASE WHEN b = '' OR y = '' THEN 0 WHEN b = y THEN 4 WHEN contains(b, y) OR contains(y, b) THEN 3 ELSE 0 END AS t FROM j)
SELECT id, least(CASE WHEN t >= 6 THEN t + 2 WHEN t = 0 THEN 2 ELSE t END, 10) / 10.0::DOUBLE AS confidence FROM s""",
    "indel_ratio": f"SELECT id, round(CAST({ratio_sql('a', 'b')} AS DOUBLE), 6) AS score FROM {PAIRS_SQL}",
    "token_set_ratio": f"SELECT id, round(CAST(score AS DOUBLE), 6) AS score FROM ({token_set_sql(PAIRS_SQL, 'a', 'b', 'id')})",
    "trigram_similarity": f"SELECT id, round(CAST({similarity_sql('a', 'b')} AS DOUBLE), 6) AS score FROM {PAIRS_SQL}",
}
