"""JSON boards: landed responses to postings.

Every adapter has the shape gate -> ``from_json`` with a narrow schema ->
``posexplode`` -> projection -> dedup.  The schema names only the fields that
are read, so the rest of a body is skipped while it is parsed.  Items that can't be read
or lack a required field leave by the same frame, with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardsieve.functions import fixed_values as v
from boardsieve.functions.pin import evaluate_once
from boardsieve.functions.text import capped, iso_timestamp, present, strip
from boardsieve.operators.normalise import finish, split_tags, with_reason
from boardsieve.sources import parsers as p
from boardsieve.sources.landing import CARRIED, adapter, dedup_items, dedup_wide_items, keep_items, to_items, usable

_STRINGS = "ARRAY<STRING>"


def _items(landed: DataFrame, source: str, schema: str, path: str | None) -> DataFrame:
    """One row per item with its feed position; ``malformed`` is an item that is no object, or a body without a list of items.

    One item of a wrong kind makes Spark give up a whole list.  Only such a body is parsed again,
    to a list of texts, which are then read one by one.
    """
    element = schema[schema.index("ARRAY<") + len("ARRAY<"):-1]
    texts = F.from_json("body", f"{path} {_STRINGS}" if path else _STRINGS)
    if path is None:  # an object is no list of one
        listed = F.startswith(F.ltrim("body"), F.lit("["))
        items, texts = F.when(listed, F.from_json("body", schema)), F.when(listed, texts)
    else:
        items, texts = F.from_json("body", schema)[path], texts[path]
    rows = evaluate_once(usable(landed, source).select("request_seq", "fetched_at", "body", items.alias("items")), "items")

    def entry(item: Column | None = None, text: Column | None = None, whole: bool = False) -> Column:
        return F.struct((F.lit(None).cast(element) if item is None else item).alias("item"),
                        (F.lit(None).cast("string") if text is None else text).alias("text"), F.lit(whole).alias("whole"))

    # A body without the list stands for itself.
    again = F.coalesce(F.transform(texts, lambda x: entry(text=x)), F.array(entry(whole=True)))
    entries = F.when(F.col("items").isNotNull(), F.transform("items", lambda x: entry(item=x))).otherwise(again)
    rows = rows.select("request_seq", "fetched_at", F.posexplode(entries).alias("at", "entry"))
    read = F.when(F.startswith(F.ltrim("entry.text"), F.lit("{")), F.from_json("entry.text", element))
    rows = rows.select("request_seq", F.when(~F.col("entry.whole"), F.col("at")).alias("pos"), "fetched_at", F.coalesce("entry.item", read).alias("item"))
    return rows.select("request_seq", "pos", "fetched_at", F.when(F.col("item").isNull(), "malformed").alias("reason"), "item.*").withColumn(
        "source", F.lit(source))


def _done(df: DataFrame, source: str, url_key: bool, wide: bool = False) -> DataFrame:
    """Required fields, url dedup of valid items where the board has it, keys, posting schema; ``wide`` items hold whole descriptions."""
    df = finish(with_reason(df))
    if url_key:
        df = (dedup_wide_items if wide else dedup_items)(df, "url")
    return to_items(df)


def _or(value: Column, default: str) -> Column:
    return F.coalesce(present(value), F.lit(default))


def _list(column: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast("array<string>"))


def _filled(items: Column) -> Column:
    return F.filter(items, lambda t: t.isNotNull() & (t != ""))


def _names(column: str) -> Column:
    """Non-empty names of an array of structs."""
    return _filled(F.transform(F.coalesce(F.col(column), F.array()), lambda x: x["name"]))


def _epoch(seconds: Column) -> Column:
    """Epoch seconds to a timestamp; zero and absent mean unknown."""
    return F.timestamp_seconds(F.nullif(seconds.try_cast("double"), F.lit(0.0)))


def _json_tags(text: Column) -> Column:
    """Tags that may be a JSON list or a comma-separated text."""
    return F.coalesce(
        F.when(F.startswith(F.trim(text), F.lit("[")), F.from_json(text, _STRINGS)), split_tags(text))


@adapter
def remotive(landed: DataFrame) -> DataFrame:
    items = _items(landed, "remotive", f"""jobs ARRAY<STRUCT<title: STRING, company_name: STRING,
        candidate_required_location: STRING, url: STRING, description: STRING, salary: STRING,
        publication_date: STRING, tags: STRING>>""", "jobs").select(
        *CARRIED,
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("company_name", F.lit("")).alias("company"),
        F.coalesce("candidate_required_location", F.lit("Anywhere")).alias("location"),
        F.lit(True).alias("is_remote"),
        F.coalesce("url", F.lit("")).alias("url"),
        "description", present(F.col("salary")).alias("salary"),
        F.coalesce(F.when(F.startswith(F.trim("tags"), F.lit("[")), F.from_json("tags", _STRINGS)),
                   F.array().cast("array<string>")).alias("tags"),
        iso_timestamp(F.col("publication_date")).alias("posted_at"))
    return _done(items, source="remotive", url_key=True, wide=True)


@adapter
def arbeitnow(landed: DataFrame) -> DataFrame:
    items = _items(landed, "arbeitnow", """data ARRAY<STRUCT<title: STRING, company_name: STRING, location: STRING,
        url: STRING, description: STRING, salary: STRING, created_at: STRING, tags: STRING, remote: BOOLEAN>>""", "data")
    place = p.address(F.col("location"))
    return _done(items.withColumn("_place", place).select(
        *CARRIED,
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("company_name", F.lit("")).alias("company"),
        F.coalesce("location", F.lit("")).alias("location"),
        F.coalesce("remote", F.lit(False)).alias("is_remote"),
        F.coalesce("url", F.lit("")).alias("url"),
        "description", present(F.col("salary")).alias("salary"), _json_tags(F.col("tags")).alias("tags"),
        F.coalesce(_epoch(F.col("created_at")), iso_timestamp(F.col("created_at"))).alias("posted_at"),
        F.col("_place.city").alias("company_city"), F.col("_place.postal").alias("company_postal_code"),
        F.col("_place.country").alias("company_country")), source="arbeitnow", url_key=False)


@adapter
def remoteok(landed: DataFrame) -> DataFrame:
    items = _items(landed, "remoteok", """ARRAY<STRUCT<slug: STRING, position: STRING, company: STRING,
        location: STRING, url: STRING, apply_url: STRING, description: STRING, date: STRING, epoch: STRING,
        salary_min: STRING, salary_max: STRING, tags: STRING>>""", None)
    place = _or(F.col("location"), "Remote")
    url = F.coalesce(present(F.col("url")), present(F.col("apply_url")),
                     F.concat(F.lit(v.REMOTEOK_URL), present(F.col("slug"))))
    return _done(keep_items(items, (F.col("pos") > 0) & F.col("position").isNotNull()).select(
        *CARRIED,
        F.col("position").alias("title"), F.coalesce("company", F.lit("Unknown")).alias("company"),
        place.alias("location"), F.lit(True).alias("is_remote"), p.remoteok_scope(place).alias("remote_scope"),
        url.alias("url"), "description",
        p.plain_range(F.col("salary_min"), F.col("salary_max")).alias("salary"),
        _json_tags(F.col("tags")).alias("tags"),
        F.coalesce(iso_timestamp(F.col("date")), _epoch(F.col("epoch"))).alias("posted_at")), source="remoteok", url_key=False)


@adapter
def idealist(landed: DataFrame) -> DataFrame:
    items = _items(landed, "idealist", f"""hits ARRAY<STRUCT<objectID: STRING, name: STRING, orgName: STRING,
        orgType: STRING, remoteZone: STRING, remoteCountry: STRING, city: STRING, state: STRING, stateStr: STRING,
        country: STRING, description: STRING, url: MAP<STRING, STRING>, published: BIGINT, keywords: {_STRINGS},
        areasOfFocus: {_STRINGS}, functions: {_STRINGS}, salaryCurrency: STRING, salaryPeriod: STRING,
        salaryMinimum: DOUBLE, salaryMaximum: DOUBLE>>""", "hits")
    items = dedup_wide_items(items, "objectID")
    path = present(F.try_element_at("url", F.lit("en")))
    tags = F.transform(_filled(F.concat(_list("keywords"), _list("areasOfFocus"), _list("functions"))), strip)
    parsed = items.select(
        *CARRIED,
        present(strip(F.col("name"))).alias("title"), present(strip(F.col("orgName"))).alias("company"),
        p.composed_location(F.col("city"), F.coalesce(present(F.col("stateStr")), F.col("state")), F.col("country"),
                            F.col("remoteZone"), F.col("remoteCountry")).alias("location"),
        F.lit(True).alias("is_remote"),
        p.zone_scope(F.col("remoteZone"), F.col("remoteCountry")).alias("remote_scope"),
        F.concat(F.lit(v.IDEALIST_URL), path).alias("url"),
        present(capped(F.col("description"), 5000)).alias("description"),
        p.period_salary(F.col("salaryMinimum"), F.col("salaryMaximum"), F.col("salaryCurrency"),
                        F.col("salaryPeriod")).alias("salary"),
        tags.alias("tags"),
        F.upper(F.coalesce("orgType", F.lit(""))).isin(*v.IDEALIST_NGO_TYPES).alias("is_ngo_source"),
        _epoch(F.col("published")).alias("posted_at"))
    return _done(parsed, source="idealist", url_key=False)


@adapter
def devex(landed: DataFrame) -> DataFrame:
    items = _items(landed, "devex", """data ARRAY<STRUCT<id: BIGINT, name: STRING, slug_and_id: STRING,
        published_at: STRING, employer_company: STRUCT<name: STRING>, places: ARRAY<STRUCT<type: STRING, name: STRING>>,
        news_topics: ARRAY<STRUCT<name: STRING>>, is_remote: BOOLEAN>>""", "data")
    items = dedup_items(keep_items(items, F.coalesce("id", F.lit(0)) != 0), "id")
    title = strip(F.col("name"))
    slug = F.coalesce(present(F.col("slug_and_id")), F.col("id").cast("string"))
    return _done(keep_items(items, title.isNull() | (F.length(title) >= 5)).select(
        *CARRIED, title.alias("title"),
        F.coalesce("employer_company.name", F.lit("Unknown")).alias("company"),
        p.typed_location(F.coalesce("places", F.array())).alias("location"),
        F.lit(True).alias("is_remote"), F.concat(F.lit(v.DEVEX_URL), slug).alias("url"),
        F.slice(_names("news_topics"), 1, 10).alias("tags"), F.lit(True).alias("is_ngo_source"),
        iso_timestamp(F.col("published_at")).alias("posted_at")), source="devex", url_key=False)


@adapter
def stepstone(landed: DataFrame) -> DataFrame:
    items = _items(landed, "stepstone", """stellenangebote ARRAY<STRUCT<titel: STRING, beruf: STRING, refnr: STRING,
        arbeitgeber: STRING, aktuelleVeroeffentlichungsdatum: STRING, externeUrl: STRING,
        arbeitsort: STRUCT<ort: STRING, region: STRING, land: STRING, remote: BOOLEAN>>>""", "stellenangebote")
    items = dedup_items(items.withColumn("refnr", F.coalesce("refnr", F.lit(""))), "refnr")
    town, region = present(F.col("arbeitsort.ort")), present(F.col("arbeitsort.region"))
    location = F.coalesce(present(F.array_join(F.array_distinct(F.array_compact(F.array(town, region))), ", ")),
                          present(F.col("arbeitsort.land")), F.lit("Germany (Remote)"))
    url = F.coalesce(present(F.col("externeUrl")), F.concat(F.lit(v.STEPSTONE_URL), present(F.col("refnr"))))
    title = present(strip(F.coalesce(present(F.col("titel")), F.col("beruf"))))
    return _done(items.select(
        *CARRIED, title.alias("title"),
        strip(_or(F.col("arbeitgeber"), "Unknown")).alias("company"), location.alias("location"),
        F.lit(True).alias("is_remote"), F.lit("germany").alias("remote_scope"), url.alias("url"),
        F.array().cast("array<string>").alias("tags"),
        iso_timestamp(F.col("aktuelleVeroeffentlichungsdatum")).alias("posted_at")), source="stepstone", url_key=False)


@adapter
def nofluffjobs(landed: DataFrame) -> DataFrame:
    items = _items(landed, "nofluffjobs", f"""postings ARRAY<STRUCT<id: STRING, name: STRING, title: STRING,
        url: STRING, category: STRING, technology: STRING, seniority: {_STRINGS}, regions: {_STRINGS},
        fullyRemote: BOOLEAN, posted: BIGINT, salary: STRUCT<`from`: DOUBLE, `to`: DOUBLE, type: STRING, currency: STRING>,
        location: STRUCT<places: ARRAY<STRUCT<city: STRING, country: STRUCT<code: STRING, name: STRING>>>,
        fullyRemote: BOOLEAN>>>""", "postings")
    places = F.coalesce(F.col("location.places"), F.array())
    remote = (
        F.coalesce("fullyRemote", F.lit(False)) | F.coalesce("location.fullyRemote", F.lit(False))
        | F.exists(places, lambda x: F.lower(strip(F.coalesce(x["city"], F.lit("")))) == "remote"))
    age_ms = F.unix_millis("fetched_at") - F.col("posted")
    fresh = F.coalesce((F.col("posted") == 0) | (age_ms <= v.NOFLUFF_MAX_AGE_DAYS * 86_400_000), F.lit(True))
    wanted = F.lower(F.coalesce("category", F.lit(""))).isin(*v.NOFLUFF_CATEGORIES)
    items = dedup_items(keep_items(items, wanted & remote & fresh).withColumn("id", F.coalesce("id", F.lit(""))), "id")
    near = F.slice(places, 1, 5)
    cities = F.filter(_filled(F.transform(near, lambda x: x["city"])), lambda c: F.lower(c) != "remote")
    countries = F.array_distinct(_filled(F.transform(near, lambda x: x["country"]["name"])))
    location = F.coalesce(present(F.array_join(F.slice(cities, 1, 3), ", ")),
                          present(F.array_join(F.slice(countries, 1, 3), ", ")), F.lit("Remote"))
    tags = F.concat(_list("seniority"), F.array_compact(F.array(present(F.col("technology")), present(F.col("category")))))
    return _done(items.withColumn("_location", location).select(
        *CARRIED, present(strip(F.col("title"))).alias("title"),
        strip(_or(F.col("name"), "Unknown")).alias("company"), F.col("_location").alias("location"),
        F.lit(True).alias("is_remote"), p.regions_scope(F.col("regions"), F.col("_location")).alias("remote_scope"),
        F.concat(F.lit(v.NOFLUFF_URL), F.coalesce(present(F.col("url")), present(F.col("id")))).alias("url"),
        p.typed_salary(F.col("salary")).alias("salary"), F.slice(tags, 1, 10).alias("tags"),
        F.timestamp_millis(F.nullif("posted", F.lit(0))).alias("posted_at")), source="nofluffjobs", url_key=False)


@adapter
def himalayas(landed: DataFrame) -> DataFrame:
    items = _items(landed, "himalayas", f"""jobs ARRAY<STRUCT<title: STRING, companyName: STRING,
        employmentType: STRING, currency: STRING, excerpt: STRING, applicationLink: STRING, guid: STRING,
        minSalary: DOUBLE, maxSalary: DOUBLE, seniority: {_STRINGS}, locationRestrictions: {_STRINGS},
        categories: {_STRINGS}, pubDate: BIGINT>>""", "jobs")
    items = keep_items(items, p.category_wanted(F.col("categories"), F.col("title"))
                       & p.restrictions_eligible(F.col("locationRestrictions")))
    tags = F.concat(
        F.transform(_list("categories"), lambda c: F.replace(c, F.lit("-"), F.lit(" "))), _list("seniority"),
        F.array_compact(F.array(present(F.col("employmentType")))))
    return _done(items.select(
        *CARRIED, present(strip(F.col("title"))).alias("title"),
        strip(_or(F.col("companyName"), "Unknown")).alias("company"),
        F.coalesce(present(F.array_join(F.slice(_list("locationRestrictions"), 1, 3), ", ")),
                   F.lit("Remote (Worldwide)")).alias("location"),
        F.lit(True).alias("is_remote"), p.restrictions_scope(F.col("locationRestrictions")).alias("remote_scope"),
        present(strip(F.coalesce(present(F.col("applicationLink")), F.col("guid")))).alias("url"),
        present(capped(strip(F.col("excerpt")), 2000)).alias("description"),
        p.single_or_range(F.col("minSalary"), F.col("maxSalary"), F.coalesce("currency", F.lit("USD"))).alias("salary"),
        F.slice(tags, 1, 10).alias("tags"), _epoch(F.col("pubDate")).alias("posted_at")), source="himalayas", url_key=True)


@adapter
def landingjobs(landed: DataFrame) -> DataFrame:
    items = _items(landed, "landingjobs", f"""ARRAY<STRUCT<currency_code: STRING, title: STRING, published_at: STRING,
        type: STRING, url: STRING, remote: BOOLEAN, gross_salary_low: DOUBLE, gross_salary_high: DOUBLE,
        tags: {_STRINGS}, locations: ARRAY<STRUCT<city: STRING, country_code: STRING>>>>""", None)
    places = F.coalesce(F.col("locations"), F.array())
    named = F.filter(F.transform(F.slice(places, 1, 3), lambda x: F.concat_ws(
        ", ", present(x["city"]), present(x["country_code"]))), lambda t: t != "")
    location = F.when(F.size(places) == 0, "EU (Remote)").otherwise(
        F.coalesce(present(F.array_join(named, ", ")), F.lit("EU")))
    tags = F.slice(F.transform(_filled(_list("tags")), strip), 1, 10)
    kind = present(F.col("type"))
    with_kind = F.when(kind.isNotNull() & ~F.array_contains(tags, kind), F.concat(tags, F.array(kind))).otherwise(tags)
    return _done(items.select(
        *CARRIED, present(strip(F.col("title"))).alias("title"),
        p.company_from_url(F.col("url")).alias("company"), location.alias("location"),
        F.coalesce("remote", F.lit(False)).alias("is_remote"),
        p.country_codes_scope(F.transform(places, lambda x: F.coalesce(x["country_code"], F.lit("")))).alias("remote_scope"),
        present(strip(F.col("url"))).alias("url"),
        p.coded_range(F.col("gross_salary_low"), F.col("gross_salary_high"),
                      F.coalesce("currency_code", F.lit("EUR")), "/year").alias("salary"),
        F.coalesce(with_kind, tags).alias("tags"),
        iso_timestamp(F.col("published_at")).alias("posted_at")), source="landingjobs", url_key=True)


@adapter
def themuse(landed: DataFrame) -> DataFrame:
    items = _items(landed, "themuse", """results ARRAY<STRUCT<id: BIGINT, name: STRING, publication_date: STRING,
        locations: ARRAY<STRUCT<name: STRING>>, categories: ARRAY<STRUCT<name: STRING>>,
        levels: ARRAY<STRUCT<name: STRING>>, refs: STRUCT<landing_page: STRING>, company: STRUCT<name: STRING>>>""",
        "results")
    items = dedup_items(items, "id")
    places = _names("locations")
    real = F.filter(places, lambda n: ~F.lower(n).isin(*v.MUSE_NON_PLACES))
    return _done(items.select(
        *CARRIED, present(strip(F.col("name"))).alias("title"),
        strip(_or(F.col("company.name"), "Unknown")).alias("company"),
        F.coalesce(present(F.array_join(F.slice(real, 1, 3), ", ")), F.lit("Remote")).alias("location"),
        F.lit(True).alias("is_remote"), p.city_words_scope(places).alias("remote_scope"),
        present(F.col("refs.landing_page")).alias("url"),
        F.slice(F.concat(_names("categories"), _names("levels")), 1, 10).alias("tags"),
        iso_timestamp(F.col("publication_date")).alias("posted_at")), source="themuse", url_key=False)


@adapter
def hours80k(landed: DataFrame) -> DataFrame:
    items = _items(landed, "hours80k", f"""hits ARRAY<STRUCT<title: STRING, description_short: STRING,
        url_external: STRING, company_name: STRING, salary: STRING, card_locations: {_STRINGS},
        tags_country: {_STRINGS}, tags_city: {_STRINGS}, tags_area: {_STRINGS}, tags_skill: {_STRINGS},
        tags_role_type: {_STRINGS}, posted_at: BIGINT>>""", "hits")
    cities = F.when(F.size(_list("card_locations")) > 0, F.col("card_locations")).otherwise(_list("tags_city"))
    items = items.withColumns({"_cities": cities, "_countries": _list("tags_country")})
    location = F.coalesce(present(F.array_join(F.slice("_cities", 1, 3), ", ")),
                          present(F.array_join(F.slice("_countries", 1, 3), ", ")), F.lit("Remote"))
    parsed = items.withColumn("_location", location).select(
        *CARRIED, present(strip(F.col("title"))).alias("title"),
        strip(_or(F.col("company_name"), "Unknown")).alias("company"), F.col("_location").alias("location"),
        F.lit(True).alias("is_remote"),
        p.scope_words(F.concat("_cities", "_countries"), F.col("_location")).alias("remote_scope"),
        present(strip(F.col("url_external"))).alias("url"),
        present(capped(p.strip_html(F.col("description_short")), 2000)).alias("description"),
        present(strip(F.col("salary"))).alias("salary"),
        F.slice(F.concat(_list("tags_area"), _list("tags_skill"), _list("tags_role_type")), 1, 10).alias("tags"),
        F.lit(True).alias("is_ngo_source"), _epoch(F.col("posted_at")).alias("posted_at"))
    return keep_items(_done(parsed, source="hours80k", url_key=True), p.board_title_wanted(F.col("title")))
