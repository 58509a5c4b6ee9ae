"""Field parsers of the boards as Columns (S2a, S3a, S5a-c, S6a-b, S8a-b, S9a-c, S10a, S11a, S13a-b, S14a-c, S15a)."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from boardsieve.functions import fixed_values as v
from boardsieve.functions.text import (
    has_any, has_any_mixed, has_word, lookup, present, strip, thousands)


def _isin(text: Column, values) -> Column:
    return text.isin(*values)


def _lower_set(items: Column) -> Column:
    return F.array_distinct(F.transform(F.coalesce(items, F.array().cast("array<string>")), F.lower))


def _literals(values) -> Column:
    return F.array(*[F.lit(x) for x in values])


def _overlaps(items: Column, values) -> Column:
    return F.arrays_overlap(items, _literals(values))


def _first_n(items: Column, count: int) -> Column:
    return F.array_join(F.slice(items, 1, count), ", ")


# -- addresses ---------------------------------------------------------------
_POSTAL = r"(?s)^(\d{4,5})\s+(.+)"


def address(location: Column) -> Column:
    """Struct (city, postal, country) from 'postal city, country' texts.

    A fold over the comma parts: a known country always overwrites, a German
    city overwrites the city and implies Germany, any other place name is the
    city only while none is set.
    """
    text = strip(location)
    postal = present(F.regexp_extract(text, _POSTAL, 1))
    rest = F.when(postal.isNull(), text).otherwise(F.regexp_extract(text, _POSTAL, 2))
    parts = F.transform(F.split(rest, ",", -1), strip)
    start = F.struct(F.lit(None).cast("string").alias("city"), F.lit(None).cast("string").alias("country"))

    def step(state: Column, part: Column) -> Column:
        low = F.lower(part)
        country = lookup(v.ADDRESS_COUNTRIES, low)
        german = country.isNull() & _isin(low, v.ADDRESS_CITIES)
        other = country.isNull() & ~german & ~_isin(low, v.ADDRESS_NON_CITIES)
        city = F.when(german, part).when(other, F.coalesce(present(state["city"]), part)).otherwise(state["city"])
        return F.struct(
            city.alias("city"),
            F.coalesce(country, state["country"], F.when(german, "Germany")).alias("country"))

    found = F.aggregate(parts, start, step)
    country = F.coalesce(found["country"], F.when(_isin(F.lower(found["city"]), v.ADDRESS_CITIES), "Germany"))
    filled = F.struct(found["city"].alias("city"), postal.alias("postal"), country.alias("country"))
    nothing = F.struct(*[F.lit(None).cast("string").alias(n) for n in ("city", "postal", "country")])
    return F.when(present(location).isNull(), nothing).otherwise(filled)


# -- scopes ------------------------------------------------------------------
def remoteok_scope(location: Column) -> Column:
    loc = F.lower(strip(location))
    short = [t for t in v.REMOTEOK_RESTRICTED if len(t) <= v.REMOTEOK_WHOLE_WORD_MAX]
    locked = has_any_mixed(loc, v.REMOTEOK_RESTRICTED, short) & ~has_any(
        loc, [*v.EU_COUNTRIES, *v.WORLDWIDE_KEYWORDS])
    return (
        F.when(_isin(loc, ("", "remote")), "worldwide")
        .when(has_any(loc, v.REMOTEOK_WORLDWIDE), "worldwide")
        .when(has_any(loc, v.REMOTEOK_GERMANY), "germany")
        .when(has_any(loc, v.REMOTEOK_EU), "eu")
        .when(locked, "restricted")
        .otherwise("worldwide")
    )


def zone_scope(zone: Column, country_code: Column) -> Column:
    zone, code = F.upper(F.coalesce(zone, F.lit(""))), F.upper(F.coalesce(country_code, F.lit("")))
    return (
        F.when(zone == "WORLD", "worldwide")
        .when((zone == "COUNTRY") & _isin(code, v.IDEALIST_EU_CODES), "eu")
        .when(_isin(zone, ("COUNTRY", "STATE", "CITY")), "restricted")
        .otherwise("worldwide")
    )


def regions_scope(regions: Column, location: Column) -> Column:
    codes = _lower_set(regions)
    return (
        F.when(F.size(codes) > 2, "eu")
        .when(_overlaps(codes, ("eu", "europe")), "eu")
        .when(_overlaps(codes, v.DACH_CODES), "germany")
        .when((F.size(codes) == 1) & F.array_contains(codes, "pl"), "eu")
        .when(has_any(F.lower(location), v.SCOPE_WORLDWIDE_WORDS), "worldwide")
        .otherwise("eu")
    )


def restrictions_eligible(restrictions: Column) -> Column:
    places = _lower_set(restrictions)
    return (F.size(places) == 0) | _overlaps(places, v.HIMALAYAS_OPEN + v.HIMALAYAS_EU)


def restrictions_scope(restrictions: Column) -> Column:
    places = _lower_set(restrictions)
    eu = F.array_intersect(places, _literals(v.HIMALAYAS_EU))
    return (
        F.when(F.size(places) == 0, "worldwide")
        .when(_overlaps(places, v.SCOPE_WORLDWIDE_WORDS), "worldwide")
        .when(F.size(eu) > 1, "eu")
        .when(F.array_contains(eu, "germany"), "germany")
        .when(F.size(eu) == 1, "eu")
        .otherwise("worldwide")
    )


def country_codes_scope(codes: Column) -> Column:
    return F.when(_overlaps(_lower_set(codes), v.DACH_CODES), "germany").otherwise("eu")


def remote_evidence(title: Column, flag: Column) -> Column:
    """What says that a posting of the home-office feed is remote: its title, its own flag or only the feed's filter."""
    return F.when(has_any(F.lower(title), v.STEPSTONE_REMOTE), "title").when(F.coalesce(flag, F.lit(False)), "flag").otherwise("feed")


def city_words_scope(names: Column) -> Column:
    text = F.lower(F.array_join(F.coalesce(names, F.array().cast("array<string>")), " ", ""))
    return F.when(has_any(text, v.MUSE_GERMANY), "germany").when(has_any(text, v.MUSE_EU), "eu").otherwise("worldwide")


def scope_words(places: Column, location: Column) -> Column:
    tagged, loc = F.lower(F.array_join(places, " ")), F.lower(location)
    return (
        F.when(has_any(tagged, v.H80K_WORLDWIDE) | has_any(loc, v.H80K_WORLDWIDE), "worldwide")
        .when(has_any(tagged, v.H80K_GERMANY) | has_any(loc, v.H80K_GERMANY), "germany")
        .when(has_any(tagged, v.H80K_EU) | has_any(loc, v.H80K_EU), "eu")
        .otherwise("worldwide")
    )


# -- locations ---------------------------------------------------------------
def composed_location(city: Column, state: Column, country: Column, zone: Column, zone_country: Column) -> Column:
    base = F.concat_ws(", ", present(city), present(state), present(country))
    qualifier = (
        F.when(zone == "WORLDWIDE", "Remote (Worldwide)")
        .when(present(zone_country).isNotNull(), F.concat(F.lit("Remote ("), zone_country, F.lit(")")))
        .when(present(zone).isNotNull(), F.concat(F.lit("Remote ("), zone, F.lit(")")))
        .otherwise("Remote")
    )
    return F.when(base != "", F.concat(base, F.lit(" · "), qualifier)).otherwise(qualifier)


def tagged_country(summary: Column, tags: Column, author: Column) -> Column:
    """Country from the marked-up summary, else the first tag that is no category, author or organisation."""
    marked = F.regexp_extract(F.coalesce(summary, F.lit("")), v.RELIEFWEB_COUNTRY_PATTERN, 1)
    org_words = "|".join(re.escape(w) for w in v.RELIEFWEB_ORG_WORDS)
    writer = F.lower(F.coalesce(author, F.lit("")))
    places = F.filter(tags, lambda t: (
        (t != "") & ~t.isin(*v.RELIEFWEB_FEEDS.values()) & (F.lower(t) != writer) & ~t.rlike(org_words)))
    return F.when(marked != "", strip(marked)).otherwise(F.coalesce(F.try_element_at(places, F.lit(1)), F.lit("Unspecified")))


_JOB_SLUG = r"/job_display/\d+/(.+)$"


def slug_text(url: Column) -> Column:
    return F.regexp_extract(url, _JOB_SLUG, 1)


def slug_location(url: Column) -> Column:
    """Trailing run of city and country words of an underscore slug, '' when there is none."""
    places = _literals(v.SLUG_CITIES + v.SLUG_COUNTRIES)
    start = F.struct(F.lit(True).alias("open"), F.array().cast("array<string>").alias("words"))

    def step(state: Column, word: Column) -> Column:
        keep = state["open"] & F.array_contains(places, word)
        words = F.when(keep, F.concat(F.array(word), state["words"])).otherwise(state["words"])
        return F.struct(keep.alias("open"), words.alias("words"))

    backwards = F.reverse(F.split(slug_text(url), "_", -1))
    return F.array_join(F.aggregate(backwards, start, step)["words"], " ")


def phrase_tags(text: Column) -> Column:
    """Category names found in a lower-cased card text, then its work types."""
    found = [F.when(F.contains(text, F.lit(c.lower())), c) for c in v.EUROBRUSSELS_CATEGORIES]
    found += [F.when(F.contains(text, F.lit(w.lower())), w) for w in ("Hybrid", "Remote")]
    return F.array_compact(F.array(*found))


def phrase_ngo(text: Column) -> Column:
    return has_any(text, v.EUROBRUSSELS_NGO)


_WORK_TYPE = (
    "(" + "|".join(v.GOODJOBS_PATTERN_CITIES) + "|" + v.GOODJOBS_CITY_PATTERN + r")\s*\|\s*("
    + "|".join(v.GOODJOBS_WORK_TYPES) + ")")


def worktype_location(text: Column) -> Column:
    """'City | Hybrid' to 'City, Germany (Hybrid)', else a known city, else Germany."""
    city, kind = F.regexp_extract(text, _WORK_TYPE, 1), F.regexp_extract(text, _WORK_TYPE, 2)
    low = F.lower(text)
    known = F.coalesce(*[F.when(F.contains(low, F.lit(c.lower())), f"{c}, Germany") for c in v.GOODJOBS_CITIES])
    suffix = F.when(_isin(kind, ("Remote", "Hybrid")), F.concat(F.lit(" ("), kind, F.lit(")"))).otherwise("")
    return F.when(city != "", F.concat(city, F.lit(", Germany"), suffix)).otherwise(
        F.coalesce(known, F.lit("Germany")))


def first_of_type(places: Column, kind: str) -> Column:
    named = F.filter(places, lambda p: (p["type"] == kind) & (F.coalesce(p["name"], F.lit("")) != ""))
    return F.try_element_at(named, F.lit(1))["name"]


def typed_location(places: Column) -> Column:
    city, country, region = (first_of_type(places, k) for k in ("City", "Country", "Region"))
    return F.coalesce(F.concat(city, F.lit(", "), country), country, region, city, F.lit("Remote"))


# -- salaries ----------------------------------------------------------------
def period_salary(low: Column, high: Column, currency: Column, period: Column) -> Column:
    """'$50,000 – $60,000/yr' with the currency sign and period suffix."""
    unit = F.coalesce(lookup(v.SALARY_PERIODS, F.lower(F.coalesce(period, F.lit("")))), F.lit(""))
    code = F.coalesce(present(currency), F.lit("USD"))
    sign = F.coalesce(lookup(v.CURRENCY_SYMBOLS, code), F.concat(code, F.lit(" ")))
    lo, hi = F.concat(sign, F.format_number(low, 0)), F.concat(sign, F.format_number(high, 0))
    return (
        F.when((low > 0) & (high > 0), F.concat(lo, F.lit(" – "), hi, unit))
        .when(low > 0, F.concat(lo, F.lit("+"), unit))
        .when(high > 0, F.concat(F.lit("Up to "), hi, unit))
    )


def plain_range(low: Column, high: Column) -> Column:
    """'$50,000 – $60,000' from numeric texts, null when neither is positive."""
    lo, hi = low.try_cast("double"), high.try_cast("double")
    lo_text, hi_text = F.concat(F.lit("$"), thousands(lo)), F.concat(F.lit("$"), thousands(hi))
    return (
        F.when((lo > 0) & (hi > 0), F.concat(lo_text, F.lit(" – "), hi_text))
        .when(lo > 0, F.concat(lo_text, F.lit("+")))
        .when(hi > 0, F.concat(F.lit("Up to "), hi_text))
    )


def coded_range(low: Column, high: Column, currency: Column, suffix: str = "") -> Column:
    """'50,000–60,000 EUR', '50,000+ EUR' or 'up to 60,000 EUR'; zero means absent."""
    lo, hi = F.nullif(low, F.lit(0)), F.nullif(high, F.lit(0))
    tail = F.concat(F.lit(" "), currency, F.lit(suffix))
    return F.coalesce(
        F.concat(thousands(lo), F.lit("–"), thousands(hi), tail),
        F.concat(thousands(lo), F.lit("+"), tail),
        F.concat(F.lit("up to "), thousands(hi), tail),
    )


def single_or_range(low: Column, high: Column, currency: Column) -> Column:
    """'50,000–60,000 USD', or one number when both ends are equal or one is absent."""
    lo, hi = F.nullif(low, F.lit(0)), F.nullif(high, F.lit(0))
    tail = F.concat(F.lit(" "), currency)
    return F.coalesce(
        F.when(lo != hi, F.concat(thousands(lo), F.lit("–"), thousands(hi), tail)),
        F.concat(thousands(lo), tail),
        F.concat(thousands(hi), tail),
    )


def typed_salary(salary: Column) -> Column:
    """Struct (from, to, currency, type) to '10,000–15,000 PLN (b2b)'."""
    lo, hi = F.nullif(salary["from"], F.lit(0)), F.nullif(salary["to"], F.lit(0))
    numbers = F.coalesce(
        F.concat(thousands(lo), F.lit("–"), thousands(hi)),
        F.concat(thousands(lo), F.lit("+")),
        F.concat(F.lit("up to "), thousands(hi)),
    )
    kind = present(salary["type"])
    return F.when(numbers.isNotNull(), F.concat_ws(
        " ", numbers, present(salary["currency"]), F.concat(F.lit("("), kind, F.lit(")"))))


def german_salary_range(text: Column) -> Column:
    low, high = (F.regexp_extract(text, v.GOODJOBS_SALARY_PATTERN, i) for i in (1, 2))
    return F.when(low != "", F.concat(low, F.lit(" – "), high, F.lit("/yr")))


# -- dates, gates, flags -----------------------------------------------------
def relative_time(text: Column, base: Column) -> Column:
    """'5 days ago' counted back from ``base``; a month is 30 days; null when unreadable."""
    amount = F.regexp_extract(text, v.RELATIVE_TIME_PATTERN, 1).try_cast("long")
    unit = lookup(v.RELATIVE_TIME_SECONDS, F.lower(F.regexp_extract(text, v.RELATIVE_TIME_PATTERN, 2)))
    return F.timestamp_micros(F.unix_micros(base) - amount * unit * 1_000_000)


def category_wanted(categories: Column, title: Column) -> Column:
    words = [w.replace("-", " ") for w in v.HIMALAYAS_CATEGORIES]
    named = F.exists(
        F.coalesce(categories, F.array().cast("array<string>")),
        lambda c: has_any(F.replace(F.lower(c), F.lit("-"), F.lit(" ")), words))
    return named | has_any(F.lower(F.coalesce(title, F.lit(""))), v.HIMALAYAS_TITLES)


def board_title_wanted(title: Column) -> Column:
    low = F.lower(title)
    return ~has_any(low, v.H80K_REJECT) & has_any(low, v.H80K_DEV)


def tech_title(title: Column) -> Column:
    return has_any(F.lower(title), v.RELIEFWEB_TECH_TITLES)


def legal_form_ngo(company: Column, text: Column) -> Column:
    return has_any(F.lower(F.concat_ws(" ", company, text)), v.GOODJOBS_LEGAL_FORMS)


def strip_html(text: Column) -> Column:
    return strip(F.regexp_replace(text, "<[^>]+>", " "))


def company_from_url(url: Column) -> Column:
    slug = F.regexp_extract(url, "/at/([^/]*)", 1)
    named = F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))
    return F.when(F.contains(url, F.lit("/at/")), named).otherwise("Unknown")
