"""Queries through the kept full-text index, and query strings of its whole grammar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import catalog as search
from lodestone.operators import index
from lodestone.plans.search_queries import K, _queries, _TOKENS, _TOP, cascade_sql
from lodestone.plans import search_queries
from lodestone.sources import views
from lodestone.sources.scratch import Scratch


def _plain(spark, sf_dir: str) -> DataFrame:
    return _queries(spark, sf_dir).select(F.regexp_replace("query", "#", " ").alias("query")).distinct()


def fts_index(spark, sf_dir):
    """Plain words through the index, built and searched."""
    scratch = Scratch(spark, "index")
    kept = index.build(views.catalog(spark, sf_dir), f"{scratch.base}/index")
    return index.full_text(_plain(spark, sf_dir), kept, K, scratch)


def fts_extended(spark, sf_dir):
    """The same through an index of the lower half of ids to which the upper half was added."""
    scratch, rows = Scratch(spark, "index"), views.catalog(spark, sf_dir)
    middle = F.col("id") <= rows.agg(F.max("id")).head()[0] // 2
    kept = index.extend(index.build(rows.where(middle), f"{scratch.base}/index"), rows.where(~middle))
    return index.full_text(_plain(spark, sf_dir), kept, K, scratch)


#: Query strings made of a title's first word a and last word b and of an artist c, with what they ask for in SQL over
#: the tokens t of the title, u of the artist and q of c; the last ones are malformed and match nothing.
STRINGS = [
    ("{a} {b}", "has(a) AND has(b)"),
    ("{a} OR {b}", "has(a) OR has(b)"),
    ("{b} NOT {a}", "has(b) AND NOT has(a)"),
    ('"{a} {b}"', "contains(tt, ' ' || a || ' ' || b || ' ') OR contains(uu, ' ' || a || ' ' || b || ' ')"),
    ('title:{a} AND artist:"{c}"', "list_contains(t, a) AND contains(uu, qq)"),
    ("NEAR({b} {a}, 0)", "contains(tt, ' ' || a || ' ' || b || ' ') OR contains(tt, ' ' || b || ' ' || a || ' ') OR contains(uu, ' ' || a || ' ' || b || ' ') OR contains(uu, ' ' || b || ' ' || a || ' ') OR a = b AND has(a)"),
    ("{s}*", "contains(tt, ' ' || s) OR contains(uu, ' ' || s)"),
    ('({a} OR {b}) NOT artist : "{c}"', "(has(a) OR has(b)) AND NOT contains(uu, qq)"),
    ("^{b}", "starts_with(tt, ' ' || b || ' ') OR starts_with(uu, ' ' || b || ' ')"),
    ("- title : brand AND {a}", "list_contains(u, 'brand') AND has(a)"),
    ('{a} "" {b}', "has(a) AND has(b)"),
    ('{a} OR {b} NOT "brand"', "has(a) OR has(b) AND NOT has('brand')"),
    ('{a} {b} OR "{c}"', "has(a) AND has(b) OR contains(tt, qq) OR contains(uu, qq)"),
    ('{{title artist}}: ("{a}" + {b})', "contains(tt, ' ' || a || ' ' || b || ' ') OR contains(uu, ' ' || a || ' ' || b || ' ')"),
    ('{a} AND ""', "false"),
    ('"{c}" NOT {a} NOT {b} AND brand', "(contains(tt, qq) OR contains(uu, qq)) AND NOT has(a) AND NOT has(b) AND has('brand')"),
    ("{a} & {b}", "false"),
    ("({a} {b}", "false"),
    ("{a} AND", "false"),
    ("shelf:{a}", "false"),
    ('"{a} {b}', "false"),
    ("{c}", "false"),
]


def _strings(spark, sf_dir: str) -> DataFrame:
    """(kind, query) of every title with the least of its artists."""
    title = text.tokens(F.col("title"))
    parts = views.catalog(spark, sf_dir).groupBy("title").agg(F.min("artist").alias("c")).select(F.get(title, F.lit(0)).alias("a"), F.element_at(title, -1).alias("b"), "c")
    parts = parts.withColumn("s", F.substring("a", 1, 2))
    made = []
    for i, (form, _) in enumerate(STRINGS):
        pieces = form.replace("{{", "\x00").replace("}}", "\x01").replace("{", "\x02{").replace("}", "\x02").split("\x02")
        made.append(F.struct(F.lit(i).alias("kind"), F.concat(*[F.col(p[1:]) if p.startswith("{") else F.lit(p.replace("\x00", "{").replace("\x01", "}")) for p in pieces]).alias("query")))
    return parts.select(F.explode(F.array(*made)).alias("x")).select("x.*")


def fts_grammar(spark, sf_dir):
    """Strings of the whole grammar, through the index."""
    scratch = Scratch(spark, "index")
    kept = index.build(views.catalog(spark, sf_dir), f"{scratch.base}/index")
    return index.match(_strings(spark, sf_dir).select("query").distinct(), kept, K, scratch)


def search_grammar(spark, sf_dir):
    """The same strings through all tiers: what the first takes as malformed goes on to the next."""
    scratch, catalog = Scratch(spark, "index"), views.catalog(spark, sf_dir)
    kept = index.build(catalog, f"{scratch.base}/index")
    return search.search(_strings(spark, sf_dir).select("query").distinct(), kept.table("texts"), K, kept)


QUERIES = {f.__name__: f for f in (fts_index, fts_extended, fts_grammar, search_grammar)}


def _grammar_sql() -> str:
    """CTEs that end with fts (query, id)."""
    pieces = []
    for i, (form, _) in enumerate(STRINGS):
        quoted = "'" + form.replace("{{", "\x00").replace("}}", "\x01").replace("{", "' || ").replace("}", " || '").replace("\x00", "{").replace("\x01", "}") + "'"
        pieces.append(f"SELECT {i} AS kind, {quoted} AS query, * FROM parts")
    cases = " ".join(f"WHEN {i} THEN {sql}" for i, (_, sql) in enumerate(STRINGS))
    return f"""parts AS (SELECT t[1] AS a, t[-1] AS b, c, t[1][1:2] AS s, ' ' || array_to_string({_TOKENS.format('c')}, ' ') || ' ' AS qq FROM (SELECT {_TOKENS.format('title')} AS t, min(artist) AS c FROM catalog GROUP BY title)),
strings AS ({' UNION ALL '.join(pieces)}),
toks AS MATERIALIZED (SELECT id, t, u, ' ' || array_to_string(t, ' ') || ' ' AS tt, ' ' || array_to_string(u, ' ') || ' ' AS uu FROM (SELECT id, {_TOKENS.format('title')} AS t, {_TOKENS.format('artist')} AS u FROM catalog)),
fts AS MATERIALIZED (SELECT DISTINCT query, id FROM strings, toks WHERE CASE kind {cases.replace("has('brand')", "(list_contains(t, 'brand') OR list_contains(u, 'brand'))").replace('has(a)', '(list_contains(t, a) OR list_contains(u, a))').replace('has(b)', '(list_contains(t, b) OR list_contains(u, b))')} END)"""


ORACLE_SQL = {
    "fts_index": search_queries.ORACLE_SQL["fts_and"],
    "fts_extended": search_queries.ORACLE_SQL["fts_and"],
    "fts_grammar": f"WITH {views.SQL}, {_grammar_sql()} {_TOP.format('fts')}",
    "search_grammar": f"WITH {views.SQL}, {_grammar_sql()}, asked AS (SELECT DISTINCT query FROM strings), {cascade_sql('asked', None)} SELECT query, id, rank, tier FROM hits",
}
