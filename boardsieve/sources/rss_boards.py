"""RSS boards: landed XML to postings.

A body is parsed once by Spark's XML parser with a nested schema, so character data sections,
entities, namespaces and markup inside an item are read as XML has them.  A feed that is not
well-formed, such as one that was cut off, is searched for its whole items instead; one that has none is malformed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardsieve.functions import fixed_values as v
from boardsieve.functions.pin import evaluate_once
from boardsieve.functions.text import capped, present, rfc822_timestamp, strip
from boardsieve.operators.normalise import finish, with_reason
from boardsieve.sources import parsers as p
from boardsieve.sources.landing import CARRIED, adapter, dedup_items, keep_items, to_items, usable

_WHOLE_ITEM = r"(?s)(<item[ >].*?</item>)"
_FIELDS = ("title", "link", "guid", "author", "region", "pubDate", "description")
_ITEM = ", ".join(f"{name} STRING" for name in _FIELDS) + ", category ARRAY<STRING>"
_NESTED = f"ARRAY<STRUCT<{', '.join(f'{name}: STRING' for name in _FIELDS)}, category: ARRAY<STRING>>>"
#: Items lie in the channel, or beside it in the older form.
_FEED = f"channel STRUCT<title: STRING, item: {_NESTED}>, item {_NESTED}, _corrupt_record STRING"
_OPTIONS = {"ignoreNamespace": "true", "columnNameOfCorruptRecord": "_corrupt_record"}


def feed_items(landed: DataFrame, source: str) -> DataFrame:
    """One row per item with its feed position; ``malformed`` is an item that can't be read, or a body without any sign of a feed."""
    rows = usable(landed, source).select("request_seq", "request_key", "fetched_at", "body", F.from_xml("body", _FEED, _OPTIONS).alias("feed"))
    rows = evaluate_once(rows, "feed")
    whole = F.col("feed").isNotNull() & F.col("feed._corrupt_record").isNull()
    none = F.lit(None).cast("string")
    read = F.transform(F.coalesce("feed.channel.item", "feed.item"), lambda x: F.struct(x.alias("item"), none.alias("xml"), F.lit(False).alias("whole")))
    cut = F.transform(F.regexp_extract_all("body", F.lit(_WHOLE_ITEM), 1), lambda x: F.struct(
        F.lit(None).cast(_NESTED[6:-1]).alias("item"), x.alias("xml"), F.lit(False).alias("whole")))
    itself = F.array(F.struct(F.lit(None).cast(_NESTED[6:-1]).alias("item"), none.alias("xml"), F.lit(True).alias("whole")))
    empty = F.col("feed.channel").isNotNull() | F.contains("body", F.lit("<channel"))
    entries = F.when(whole, F.coalesce(read, F.when(~empty, itself))).otherwise(F.when(F.size(cut) > 0, cut).otherwise(itself))
    rows = rows.select("request_seq", "request_key", "fetched_at", F.posexplode(entries).alias("at", "entry"))
    item = F.coalesce("entry.item", F.when(F.col("entry.xml").isNotNull(), F.from_xml("entry.xml", _ITEM, _OPTIONS)))
    rows = rows.select("request_seq", "request_key", "fetched_at", F.when(~F.col("entry.whole"), F.col("at")).alias("pos"), item.alias("item"))
    return rows.select("request_seq", "request_key", "fetched_at", "pos", F.when(F.col("item").isNull(), "malformed").alias("reason"),
                       "item.*").withColumn("source", F.lit(source))


def _tags() -> Column:
    return F.filter(F.coalesce("category", F.array().cast("array<string>")), lambda t: t != "")


@adapter
def weworkremotely(landed: DataFrame) -> DataFrame:
    """'Company: Title' feeds."""
    title = strip(F.col("title"))
    named = F.contains(title, F.lit(": "))
    parts = F.split(title, ": ", 2)
    items = feed_items(landed, "weworkremotely").select(
        *CARRIED,
        F.when(named, F.get(parts, F.lit(0))).otherwise("Unknown").alias("company"),
        F.when(named, F.get(parts, F.lit(1))).otherwise(present(title)).alias("title"),
        F.coalesce(present(F.col("region")), F.lit("Remote")).alias("location"),
        F.lit(True).alias("is_remote"),
        F.coalesce(present(F.col("link")), present(F.col("guid"))).alias("url"),
        "description", F.slice(_tags(), 1, 1).alias("tags"),
        rfc822_timestamp(F.col("pubDate")).alias("posted_at"))
    return to_items(dedup_items(finish(with_reason(items)), "url"))


@adapter
def reliefweb(landed: DataFrame) -> DataFrame:
    """Three feeds in fixed order; all but the first keep technical titles only."""
    rank = F.lit(None).cast("int")
    for position, name in enumerate(v.RELIEFWEB_FEEDS):
        rank = F.when(F.col("request_key") == name, position).otherwise(rank)
    items = feed_items(landed, "reliefweb").withColumn("_feed", rank).filter(F.col("_feed").isNotNull())
    title = present(strip(F.col("title")))
    items = keep_items(items, title.isNull() | (F.col("_feed") == 0) | p.tech_title(title))
    parsed = items.select(
        "_feed", "pos", "reason", F.col("request_seq").alias("_request"), "fetched_at", "source", title.alias("title"),
        F.coalesce(present(F.col("author")), F.lit("Unknown")).alias("company"),
        p.tagged_country(F.col("description"), _tags(), F.col("author")).alias("location"),
        F.lit(False).alias("is_remote"),
        F.coalesce(present(F.col("link")), present(F.col("guid"))).alias("url"),
        present(capped(F.col("description"), 5000)).alias("description"),
        _tags().alias("tags"), F.lit(True).alias("is_ngo_source"),
        rfc822_timestamp(F.col("pubDate")).alias("posted_at"))
    # Feed order is rank, then response.
    ordered = finish(with_reason(parsed)).withColumn("request_seq", F.struct("_feed", "_request"))
    return to_items(dedup_items(ordered, "url").withColumn("request_seq", F.col("_request")))
