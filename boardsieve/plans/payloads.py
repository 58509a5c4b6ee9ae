"""Landed responses built from the posting view, and the fields the parsers read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boardsieve.plans import corpus
from boardsieve.plans.corpus import RAW_SQL, _pick, _sql_pick

PAGE = 50  # items per response

ZONES = ("WORLD", "COUNTRY", "STATE", "", None, "CITY", "WORLDWIDE")
ZONE_COUNTRIES = ("DE", "US", None, "FR", "", "GB", "PL")
CITIES = ("Berlin", None, "Austin", "", "Lyon")
STATES = (None, "TX", "", "Bavaria")
COUNTRIES = ("Germany", None, "United States", "France", "Poland", "")
CURRENCIES = ("USD", "EUR", None, "GBP", "PLN")
PERIODS = ("year", "MONTH", None, "hour", "decade")
AGES = ("5 days ago", "1 hour ago", "Reposted 3 weeks ago", "2 Months ago", "30 minutes ago", "yesterday", "")
SLUGS = ("Policy_Officer_EDF_Brussels_Belgium", "Coordinator_Prague_Czech_Republic", "Data_Lead_The_Hague",
         "Engineer_Outside_Europe", "Analyst", "Legal_Adviser_Geneva")
CARDS = ("Berlin | Remote Vollzeit", "Senior Dev gGmbH Hamburg | Hybrid 40.000€ – 47.000€",
         "Jahresgehalt 50.000€ - 65.000€ Kassel | Nur vor Ort", "Stiftung in Dresden", "nothing here",
         "NGO and Political Hybrid Legal Consultancy remote think tank", "EU Institution economist",
         "Academic and Think Tank, Bad Homburg | Vor Ort e.V.")
REGIONS = ("pl", "de", "eu", "pl,cz", "pl,DE,cz", "", "at,pl", "us")
RESTRICTIONS = ("", "Germany", "Germany,France", "United States", "Worldwide", "Poland", "Remote", "UK,US")
CATEGORIES = ("Software-Engineering", "Marketing", "Machine-Learning,Sales", "", "Customer-Success")
AREAS = ("Germany,Information Management", "Red Cross Society,Kenya", "Chad", "", "UN Agency", "Acme,Mali")
AUTHORS = ("Acme", "acme", "UN", "")
NOFLUFF = ("backend", "Fullstack", "sales", "devops", "data")


def _csv(values: tuple, index: Column) -> Column:
    return F.filter(F.split(_pick(values, index), ","), lambda x: x != "")


def fields(spark: SparkSession, sf_dir: str, page: int | None = None) -> DataFrame:
    """Raw postings with the board-specific fields; with ``page`` as :func:`corpus.raw_postings` lays them out for pages."""
    raw = corpus.raw_postings(spark, sf_dir, page)
    k = F.col("ingest_seq")
    m = F.floor(k / 7)
    return raw.withColumns({
        "zone": _pick(ZONES, k), "zone_country": _pick(ZONE_COUNTRIES, m), "city": _pick(CITIES, k),
        "state": _pick(STATES, m), "country": _pick(COUNTRIES, m), "currency": _pick(CURRENCIES, k),
        "period": _pick(PERIODS, m), "low": (k % 4 * 12500).cast("double"), "high": (m % 3 * 60000).cast("double"),
        "age": _pick(AGES, k), "slug": _pick(SLUGS, k), "card": _pick(CARDS, k),
        "regions": _csv(REGIONS, k), "restrictions": _csv(RESTRICTIONS, k), "categories": _csv(CATEGORIES, k),
        "areas": _csv(AREAS, k), "author": _pick(AUTHORS, m), "kind": _pick(NOFLUFF, k),
        "tags": F.filter(F.split("tags_csv", ","), lambda x: x != ""),
        "stamp": F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    })


def _sql_csv(values: tuple, index: str) -> str:
    return f"list_filter(string_split({_sql_pick(values, index)}, ','), lambda x: x <> '')"


_K, _M = "ingest_seq", "(ingest_seq // 7)"
FIELDS_SQL = RAW_SQL + f""",
fields AS (SELECT *, {_sql_pick(ZONES, _K)} AS zone, {_sql_pick(ZONE_COUNTRIES, _M)} AS zone_country,
  {_sql_pick(CITIES, _K)} AS city, {_sql_pick(STATES, _M)} AS state, {_sql_pick(COUNTRIES, _M)} AS country,
  {_sql_pick(CURRENCIES, _K)} AS currency, {_sql_pick(PERIODS, _M)} AS period,
  (ingest_seq % 4 * 12500)::DOUBLE AS low, ({_M} % 3 * 60000)::DOUBLE AS high, {_sql_pick(AGES, _K)} AS age,
  {_sql_pick(SLUGS, _K)} AS slug, {_sql_pick(CARDS, _K)} AS card, {_sql_csv(REGIONS, _K)} AS regions,
  {_sql_csv(RESTRICTIONS, _K)} AS restrictions, {_sql_csv(CATEGORIES, _K)} AS categories,
  {_sql_csv(AREAS, _K)} AS areas, {_sql_pick(AUTHORS, _M)} AS author, {_sql_pick(NOFLUFF, _K)} AS kind,
  list_filter(string_split(tags_csv, ','), lambda x: x <> '') AS tags
  FROM raw_postings)"""


def landed(items: DataFrame, source: str, wrapper: str | None, first: str = "", text: Column | None = None) -> DataFrame:
    """Pages of one board: 50 consecutive items (column ``item``, or their JSON ``text``) as one JSON body.

    The group is a page, so what is collected is bounded by the page size.  Items laid out by page don't move again.
    """
    text = F.to_json("item") if text is None else text
    pages = items.groupBy(*[c for c in items.columns if c == "page_group"], F.floor(F.col("ingest_seq") / PAGE).alias("request_seq")).agg(
        F.sort_array(F.collect_list(F.struct("ingest_seq", text.alias("item")))).alias("list"),
        F.max("fetched_at").alias("fetched_at"))
    listed = F.concat(F.lit("[" + first), F.array_join(F.transform("list", lambda x: x["item"]), ","), F.lit("]"))
    body = F.concat(F.lit('{"' + wrapper + '":'), listed, F.lit("}")) if wrapper else listed
    return _envelope(pages, source, body, F.lit(None).cast("string"))


def landed_xml(items: DataFrame, source: str, request_key: Column) -> DataFrame:
    """Pages of one RSS board; ``item`` is the XML text of an item."""
    pages = items.groupBy(F.floor(F.col("ingest_seq") / PAGE).alias("request_seq"), request_key.alias("key")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ingest_seq", "item"))), lambda x: x["item"]), "\n").alias("list"),
        F.max("fetched_at").alias("fetched_at"))
    body = F.concat(F.lit("<rss><channel>"), "list", F.lit("</channel></rss>"))
    return _envelope(pages, source, body, F.col("key"))


def _envelope(pages: DataFrame, source: str, body: Column, key: Column) -> DataFrame:
    return pages.select(
        F.lit(source).alias("source"), key.alias("request_key"), F.lit(1).alias("page"), "request_seq", "fetched_at",
        F.lit(200).alias("status"), body.alias("body"))
