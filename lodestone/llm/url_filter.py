"""URL filters: rules by host and path, then a list behind a blocked Bloom filter.

The filter is an array of 256-bit blocks, built by one bit-or aggregation of
the listed canonical URLs: a URL sets eight bits of one block. Pages look up
their block and only those whose bits are all set go to the exact hash join
with the list, which removes false positives; the others are not in the list.
The filter is broadcast if its size, known from the count of the list, is
within `broadcast_bytes`, and joined by block number otherwise. All of it is
DataFrame operations, and the pages are read once: both joins are outer joins
on keys that are null for pages with nothing to look up. Those go to all tasks
by a hash of the page beside the key, as nulls alone would all go to one.

Edge cases: a null url or one without :// has an empty host and path, fits no
rule and is in no list; a url of any length is one value of its row; repeated
rows give a row each, and equal canonical urls the same verdict; an empty table
or list works as such; columns beyond page_id and url are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch

#: (rule, verdict): a rule is host and path, and holds for subdomains and longer paths.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: Labels of hosts whose pages make up the query's list. Fixed values.
LISTED_LABELS = ["spam-farm", "cheap-pills"]
BITS_PER_URL, WORDS = 16, 4
BROADCAST_BYTES = 64 << 20
#: Keys that pages without anything to look up are dealt to.
SPREAD = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str = "url") -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: str = "url") -> Column:
    """Host without www., path without a final slash, parameters sorted and without tracking; null if there is no host."""
    query = F.regexp_extract(url, r"://[^/?#]*[^?#]*\?([^#]*)", 1)
    own = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|ref)=")))
    whole = F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), r"/+\z", ""), F.when(F.size(own) > 0, F.concat(F.lit("?"), F.array_join(own, "&"))).otherwise(""))
    return F.when(host_of(url) != "", whole)


def best_rule(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, compiled into one expression."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is tested first
        own_host, slash, own_path = text.partition("/")
        fits = ((host == own_host) | host.endswith(f".{own_host}")) & path.startswith(slash + own_path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _masks(url: Column) -> list[Column]:
    """Two bits in each of a block's words."""
    h = F.xxhash64(url, F.lit("bits"))

    def bit(i: int) -> Column:
        at = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")
        return F.call_function("shiftleft", F.lit(1).cast("long"), at)

    return [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(WORDS)]


def _block(url: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(n_blocks))


def bloom_filter(listed: DataFrame, n_blocks: int) -> DataFrame:
    """(block, w0..w3) of the distinct canonical URLs in column c."""
    masks = [m.alias(f"m{w}") for w, m in enumerate(_masks(F.col("c")))]
    return listed.select(_block(F.col("c"), n_blocks).alias("block"), *masks).groupBy("block").agg(*[F.bit_or(f"m{w}").alias(f"w{w}") for w in range(WORDS)])


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]] = RULES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, host, path, rule and verdict: the longest rule's, else block for URLs in listed (column url) and allow for others."""
    scratch = Scratch(pages.sparkSession, "urls")
    known = scratch.put(listed.select(canonical().alias("c")).where("c IS NOT NULL").distinct())
    n_blocks = max(1, -(-known.count() * BITS_PER_URL // (64 * WORDS)))
    blocks = bloom_filter(known, n_blocks)
    if n_blocks * 8 * (WORDS + 1) <= broadcast_bytes:
        blocks = F.broadcast(blocks)
    rule, verdict = best_rule(rules, F.col("host"), F.col("path"))
    parsed = pages.select("page_id", host_of().alias("host"), path_of().alias("path"), canonical().alias("c"), F.pmod(F.xxhash64("page_id", "url"), F.lit(SPREAD)).alias("spread"))
    judged = parsed.withColumn("rule", rule).withColumn("ruled", verdict)
    looked = F.col("ruled").isNull() & F.col("c").isNotNull()
    # numbers below zero are no blocks
    filed = judged.withColumn("block", F.when(looked, _block(F.col("c"), n_blocks)).otherwise(-1 - F.col("spread"))).join(blocks, "block", "left")
    maybe = looked
    for w, m in enumerate(_masks(F.col("c"))):
        maybe = maybe & (F.coalesce(F.col(f"w{w}"), F.lit(0)).bitwiseAND(m) == m)
    sure = filed.withColumn("maybe", F.coalesce(maybe, F.lit(False)))
    keyed = sure.select("page_id", "host", "path", "rule", "ruled", F.when(F.col("maybe"), F.col("c")).alias("c"), F.when(F.col("maybe"), F.lit(0).cast("long")).otherwise(F.col("spread")).alias("spread"))
    exact = keyed.join(known.select("c", F.lit(0).cast("long").alias("spread"), F.lit(True).alias("hit")), ["c", "spread"], "left")
    return exact.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("hit"), "block").otherwise("allow")).alias("verdict"))


def listed_pages(pages: DataFrame) -> DataFrame:
    """The query's list: urls of pages on hosts with one of the listed labels."""
    return pages.where(host_of().rlike(r"(^|\.)(" + "|".join(LISTED_LABELS) + r")\.")).select("url")


_CANONICAL = r"""CASE WHEN regexp_extract(url, '://([^/?#]*)', 1) <> '' THEN
  regexp_replace(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^www\.', '')
  || regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '')
  || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '://[^/?#]*[^?#]*\?([^#]*)', 1), '&'),
     lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref)='))), '&'), ''), '') END"""

SQL = rf"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, {_CANONICAL} AS c FROM pages),
l AS (SELECT DISTINCT c FROM p WHERE regexp_matches(host, '(^|\.)(spam-farm|cheap-pills)\.') AND c IS NOT NULL),
r AS (SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow'
  ELSE CASE WHEN c IN (SELECT c FROM l) THEN 'block' ELSE 'allow' END END AS verdict
FROM r"""


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, listed_pages(pages))
