"""Quality rules: a table of thresholds compiled into one projection of Spark's own functions.

No user function, pandas or Arrow code runs: words and lines are arrays, ratios
are sizes of arrays, and words under repeated 3-word windows are found by
sorting the document's own window hashes. Nothing is shuffled, so a hot source
or a group of copies is no different from other rows, and one row's work is
n log n in its length.

Edge cases: a null or empty text has no words and fails on n_words; a very long
text is one row, whose words and windows a task holds at once, some hundred
bytes a word; stop words count in lower case or with a capital first letter;
repeated rows each give a row, and a document right at a bound passes; an empty table gives an empty table; columns beyond
doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import SPACES, WORD_GAP

#: Function words of four languages. Fixed values.
STOP_WORDS = """
the of and to in a is that for it was on be with as by this are at from
der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als
de la le et les des en un du une que est dans qui par pour au sur pas elle
de la que el en y a los se del las un por con no una su para es al lo
""".split()

#: (measure, least, most): a document passes if every measure lies within. Null: no bound.
RULES = [
    ("mean_word_chars", 2.0, 20.0),
    ("symbols_per_word", None, 0.5),
    ("stop_words_per_word", 0.01, None),
    ("dup_lines_per_line", None, 0.5),
]
#: Bounds of the base verdict. Fixed values.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def _words(text: Column) -> Column:
    bare = F.trim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_GAP, -1))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and, for each document, the counts that the rules use."""
    stop = sorted({w for s in STOP_WORDS for w in (s, s.capitalize())})
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    arrays = texts.select(
        "doc_id",
        _words(F.col("t")).alias("w"),
        F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
    )
    windows = arrays.select(
        "*",
        F.size("w").cast("long").alias("n_words"),
        F.when(F.size("w") >= 3, F.transform(F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<long>")).alias("h"),
    )
    marked = windows.select(
        "*",
        F.when(F.size("h") > F.size(F.array_distinct("h")), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("s"),
    )
    repeated = marked.select(
        "*",
        F.transform(
            F.filter(F.transform("s", lambda x, i: F.when((F.get("s", i - 1)["h"] == x["h"]) | (F.get("s", i + 1)["h"] == x["h"]), x["i"])), lambda x: x.isNotNull()),
            lambda x: F.array(x, x + 1, x + 2),
        ).alias("covered"),
    )
    return repeated.select(
        "doc_id",
        "n_words",
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct(F.flatten("covered"))).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("w", lambda x: x.isin(stop))).cast("long").alias("n_stop_words"),
    )


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def compile_rules(rules: list[tuple] = RULES) -> Column:
    """One boolean column: all bounds of the table hold."""
    value = {
        "mean_word_chars": _ratio("word_chars", "n_words"),
        "symbols_per_word": _ratio("n_symbols", "n_words"),
        "stop_words_per_word": _ratio("n_stop_words", "n_words"),
        "dup_lines_per_line": _ratio("n_dup_lines", "n_lines"),
    }
    passed = F.lit(True)
    for name, least, most in rules:
        if least is not None:
            passed = passed & (value[name] >= least)
        if most is not None:
            passed = passed & (value[name] <= most)
    return passed


def quality_rules(docs: DataFrame, rules: list[tuple] = RULES) -> DataFrame:
    """All measures, base_failed and kept for each document."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measures(docs).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted({w for s in STOP_WORDS for w in (s, s.capitalize())}))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM a)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS p FROM r) GROUP BY doc_id),
m AS (SELECT a.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
      len(ls) AS n_lines, len(list_filter(w, lambda x: x IN ({stop}))) AS n_stop
      FROM a LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2 AND 20 AND n_symbols / n_words <= 0.5 AND n_stop / n_words >= 0.01
  AND n_dup_lines / n_lines <= 0.5 AS kept
FROM f"""


SQL = _sql()


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
