"""The domain's tables as views over the star schema's Parquet files, with explicit columns."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.sources.scratch import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Store(NamedTuple):
    """The release store: releases, their artists (extra 0 first), tracks, track artists, and the images of artists and labels."""

    release: DataFrame
    artist: DataFrame
    track: DataFrame
    track_artist: DataFrame
    artist_image: DataFrame
    label_image: DataFrame


class Tiered(Store):
    """A store and what lookups go on to where it has nothing: `remote`, rows (id, title, thumb) of a search, and `remote_documents`, as `json_rows.release_documents` gives them."""

    remote: DataFrame | None = None
    remote_documents: DataFrame | None = None

    @classmethod
    def of(cls, store: Store, remote: DataFrame, remote_documents: DataFrame | None = None) -> Tiered:
        out = cls(*store)
        out.remote, out.remote_documents = remote, remote_documents
        return out


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title, artist and what a call number is made of; each eleventh row is a compilation."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("title"),
        F.when(F.col("p_partkey") % 11 == 0, "Various Artists").otherwise(F.col("p_brand")).alias("artist"),
        F.col("p_type").alias("genre"),
        F.lit("CD").alias("format"),
        F.substring("p_name", 1, 1).alias("call_letters"),
        F.col("p_size").alias("artist_call_number"),
        F.when(F.col("p_partkey") % 3 > 0, F.col("p_partkey") % 10).alias("release_call_number"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request for each part: exact, misspelled, a song with or without an artist, the artist alone, or nothing but the message."""
    key = F.col("p_partkey")
    kind = key % 5
    misspelled = F.regexp_replace("p_brand", "^Brand#", "Brandd#")
    customer = F.concat(F.lit("Customer#"), F.lpad((key % 100).cast("string"), 9, "0"))
    return table(spark, sf_dir, "part").select(
        key.alias("req_id"),
        F.when(kind == 2, misspelled).when((kind != 3) & (key % 10 != 4), F.col("p_brand")).alias("artist"),
        F.when(kind == 1, F.col("p_name")).when(key % 10 == 3, F.col("p_brand")).when(kind == 3, customer).alias("song"),
        F.when(kind.isin(0, 2), F.col("p_name")).alias("album"),
        F.concat(F.col("p_brand"), F.when(kind == 4, " - ").otherwise(" "), F.col("p_name")).alias("raw_message"),
    )


def _parts(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias(key), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the part that they stand for."""
    n = _parts(spark, sf_dir, "k").agg(F.max("k").alias("n"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate", "o_custkey")
    keyed = orders.join(F.broadcast(n)).withColumn("k", F.pmod(F.col("id"), F.col("n") + 1))  # n is one row
    return keyed.join(_parts(spark, sf_dir, "k"), "k")


def release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a release; its title is the name of the part with its key. Some have no image, or a placeholder."""
    id_ = F.col("id")
    image = F.when(id_ % 8 == 3, "http://img/spacer.gif").when(id_ % 8 != 5, F.concat(F.lit("http://img/"), F.col("o_custkey")))
    return _orders(spark, sf_dir).select("id", "title", F.year("o_orderdate").alias("release_year"), image.alias("artwork_url"), F.col("o_custkey").alias("artist_id"), (F.col("o_custkey") % 25).cast("long").alias("label_id"))


def release_artist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first artist of an order, extra 0, is its part's brand, that with others, or its customer."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    name = F.when(F.col("id") % 4 == 1, F.col("brand")).when(F.col("id") % 4 == 2, F.concat("brand", F.lit(" & Various"))).otherwise(F.col("c_name"))
    return _orders(spark, sf_dir).join(customers, "o_custkey").select(F.col("id").alias("release_id"), name.alias("artist_name"), F.lit(0).alias("extra"))


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders with their number, which tracks and track artists share."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate"]
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", *order)
    return items.withColumn("sequence", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order))).select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "sequence")


def release_track(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    lines = lines or numbered(spark, sf_dir)
    return lines.join(_parts(spark, sf_dir, "l_partkey"), "l_partkey").select(F.col("l_orderkey").alias("release_id"), "sequence", F.col("sequence").cast("string").alias("position"), "title", F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(":00")).alias("duration"))


def release_track_artist(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """Tracks of a quantity above 25 have an artist: the part's brand on some releases, the supplier on others."""
    lines = (lines or numbered(spark, sf_dir)).where("l_quantity > 25")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    name = F.when((F.col("l_orderkey") % 4).isin(1, 2), F.col("brand")).otherwise(F.col("s_name"))
    return lines.join(suppliers, "l_suppkey").join(_parts(spark, sf_dir, "l_partkey"), "l_partkey").select(F.col("l_orderkey").alias("release_id"), F.col("sequence").alias("track_sequence"), name.alias("artist_name"))


def artist_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """artist_id and its images, the first of which counts."""
    key = F.col("c_custkey")
    images = F.when(key % 3 == 0, F.array(F.concat(F.lit("http://img/artist/"), key))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "customer").select(key.alias("artist_id"), images.alias("images"))


def label_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").where(key % 2 == 0).select(key.cast("long").alias("label_id"), F.array(F.concat(F.lit("http://img/label/"), key)).alias("images"))


def store(spark: SparkSession, sf_dir: str) -> Store:
    """All tables of the release store; lines are numbered once and written."""
    lines = Scratch(spark, "lines").put(numbered(spark, sf_dir))
    return Store(release(spark, sf_dir), release_artist(spark, sf_dir), release_track(spark, sf_dir, lines), release_track_artist(spark, sf_dir, lines), artist_image(spark, sf_dir), label_image(spark, sf_dir))


# The same views in DuckDB.
SQL = """
catalog AS (SELECT p_partkey AS id, p_name AS title, CASE WHEN p_partkey % 11 = 0 THEN 'Various Artists' ELSE p_brand END AS artist, p_type AS genre, 'CD' AS format, p_name[1:1] AS call_letters, p_size AS artist_call_number,
  CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 10 END AS release_call_number FROM part),
requests AS (SELECT p_partkey AS req_id, CASE WHEN p_partkey % 5 = 2 THEN regexp_replace(p_brand, '^Brand#', 'Brandd#') WHEN p_partkey % 5 <> 3 AND p_partkey % 10 <> 4 THEN p_brand END AS artist,
  CASE WHEN p_partkey % 5 = 1 THEN p_name WHEN p_partkey % 10 = 3 THEN p_brand WHEN p_partkey % 5 = 3 THEN 'Customer#' || lpad(CAST(p_partkey % 100 AS VARCHAR), 9, '0') END AS song,
  CASE WHEN p_partkey % 5 IN (0, 2) THEN p_name END AS album, p_brand || CASE WHEN p_partkey % 5 = 4 THEN ' - ' ELSE ' ' END || p_name AS raw_message FROM part),
order_parts AS (SELECT o_orderkey AS id, o_orderdate, o_custkey, p_name AS title, p_brand AS brand FROM orders JOIN part ON p_partkey = o_orderkey % (SELECT max(p_partkey) + 1 FROM part)),
release AS (SELECT id, title, CAST(year(o_orderdate) AS INTEGER) AS release_year, CASE WHEN id % 8 = 3 THEN 'http://img/spacer.gif' WHEN id % 8 <> 5 THEN 'http://img/' || o_custkey END AS artwork_url,
  o_custkey AS artist_id, CAST(o_custkey % 25 AS BIGINT) AS label_id FROM order_parts),
release_artist AS (SELECT id AS release_id, CASE id % 4 WHEN 1 THEN brand WHEN 2 THEN brand || ' & Various' ELSE c_name END AS artist_name, 0 AS extra FROM order_parts JOIN customer ON c_custkey = o_custkey),
numbered AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS INTEGER) AS sequence FROM lineitem),
release_track AS (SELECT l_orderkey AS release_id, sequence, CAST(sequence AS VARCHAR) AS position, p_name AS title, CAST(l_quantity AS INTEGER) || ':00' AS duration FROM numbered JOIN part ON p_partkey = l_partkey),
release_track_artist AS (SELECT l_orderkey AS release_id, sequence AS track_sequence, CASE WHEN l_orderkey % 4 IN (1, 2) THEN p_brand ELSE s_name END AS artist_name
  FROM numbered JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE l_quantity > 25),
artist_image AS (SELECT c_custkey AS artist_id, CASE WHEN c_custkey % 3 = 0 THEN 'http://img/artist/' || c_custkey END AS image FROM customer),
label_image AS (SELECT CAST(n_nationkey AS BIGINT) AS label_id, 'http://img/label/' || n_nationkey AS image FROM nation WHERE n_nationkey % 2 = 0)
"""
