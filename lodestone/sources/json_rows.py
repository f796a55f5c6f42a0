"""Requests and release documents as JSON texts: parsed by explicit schemas, what cannot be used kept apart with the reason.

Everything stays in the JVM. Rows are (id, value); ids need not be unique. A
rejected row keeps its text, so that nothing is lost: accepted and rejected rows
together are all rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import image_or_null


class Form(NamedTuple):
    """What a request may hold: texts, which of them it needs, of which it needs one that is not empty, and the bounds and default of its limit."""

    texts: tuple[str, ...]
    needed: tuple[str, ...] = ()
    one_of: tuple[str, ...] = ()
    limit: tuple[int, int, int] | None = None


# Kinds of requests with the bounds and defaults of their limits. Fixed values.
FORMS = {
    "lookup": Form(("artist", "song", "album", "raw_message"), needed=("raw_message",)),
    "catalog": Form(("q", "artist", "title"), one_of=("q", "artist", "title"), limit=(1, 100, 10)),
    "release": Form(("artist", "album", "track"), one_of=("artist", "album", "track"), limit=(1, 50, 5)),
}


def _kind(parsed: Column, name: str) -> Column:
    """The kind of a field's value; null without the field. A field that is null is VOID."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant")), "^[A-Z]+", 0)


def requests(rows: DataFrame, form: Form) -> tuple[DataFrame, DataFrame]:
    """(id, the form's texts and limit) of the rows (id, value) that a request can be read from, and (id, value, reason) of the others.

    A text is a string or null; a limit a whole number within its bounds, or its
    default where there is none. The first reason counts: not JSON, not an
    object, then field by field, then nothing to search for.
    """
    parsed, reason = F.col("parsed"), F.lit(None).cast("string")
    checks: list[tuple[Column, str]] = [
        (parsed.isNull(), "not JSON"),
        (~F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), "not an object"),
    ]
    for c in form.texts:
        kind = _kind(parsed, c)
        if c in form.needed:
            checks.append((kind.isNull(), f"{c}: missing"))
            checks.append((kind != "STRING", f"{c}: not a text"))
        else:
            checks.append((~kind.isin("STRING", "VOID"), f"{c}: not a text"))
    if form.limit:
        low, high, _ = form.limit
        checks.append((_kind(parsed, "limit") != "BIGINT", "limit: not a whole number"))
        checks.append((~F.col("limit").between(low, high), "limit: out of bounds"))
    if form.one_of:
        checks.append((F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in form.one_of]).isNull(), "nothing to search for"))
    for failed, why in reversed(checks):
        reason = F.when(failed, why).otherwise(reason)
    read = rows.select("id", "value", F.try_parse_json("value").alias("parsed"))
    fields = [F.try_variant_get(parsed, f"$.{c}", "string").alias(c) for c in form.texts]
    if form.limit:
        given = F.try_variant_get(parsed, "$.limit", "bigint")
        fields.append(F.when(_kind(parsed, "limit").isNull(), form.limit[2]).otherwise(given).alias("limit"))
    judged = read.select("id", "value", "parsed", *fields).withColumn("reason", reason)
    kept = [*form.texts, *(["limit"] if form.limit else [])]
    return judged.where("reason IS NULL").select("id", *kept), judged.where("reason IS NOT NULL").select("id", "value", "reason")


NAMED = "array<struct<id: bigint, name: string>>"
RELEASE = f"id bigint, title string, year int, artists {NAMED}, labels {NAMED}, genres array<string>, styles array<string>, tracklist array<struct<position: string, title: string, duration: string, artists: {NAMED}>>, images array<struct<uri: string>>"


def computed_once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with one more column, which what follows reads: Spark would else compute it anew for each filter and field that asks for it."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def release_documents(rows: DataFrame, base: str = "") -> tuple[DataFrame, DataFrame]:
    """Releases of the rows (id, value), and the rows whose text is no release.

    The first artist, label and image count; absent lists are empty; a track
    has its artists' names in order; the address is base and the number. A text
    with a value of another kind than the schema's is no release.
    """
    broken = "_broken"
    read = computed_once(rows.select("id", "value"), "r", F.from_json("value", f"{RELEASE}, {broken} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": broken}))
    failed = F.col("value").isNull() | F.col("r").isNull() | F.col(f"r.{broken}").isNotNull() | F.col("r.id").isNull()
    listed = lambda x, kind: F.coalesce(x, F.array().cast(kind))
    first = lambda name, field: F.get(F.col(f"r.{name}"), F.lit(0))[field]
    text = lambda x: F.coalesce(x, F.lit(""))
    track = lambda t: F.struct(
        text(t["position"]).alias("position"), text(t["title"]).alias("title"), t["duration"].alias("duration"), F.transform(listed(t["artists"], NAMED), lambda a: text(a["name"])).alias("artists")
    )
    good = read.where(~failed).select(
        F.col("r.id").alias("release_id"),
        text(F.col("r.title")).alias("title"),
        text(first("artists", "name")).alias("artist"),
        F.col("r.year").alias("year"),
        first("labels", "name").alias("label"),
        first("artists", "id").alias("artist_id"),
        first("labels", "id").alias("label_id"),
        listed(F.col("r.genres"), "array<string>").alias("genres"),
        listed(F.col("r.styles"), "array<string>").alias("styles"),
        F.transform(listed(F.col("r.tracklist"), "array<struct<position: string, title: string, duration: string, artists: array<struct<id: bigint, name: string>>>>"), track).alias("tracklist"),
        image_or_null(first("images", "uri")).alias("artwork_url"),
        F.concat(F.lit(base), F.col("r.id").cast("string")).alias("release_url"),
    )
    return good, read.where(failed).select("id", "value")
