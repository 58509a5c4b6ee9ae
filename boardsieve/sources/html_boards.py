"""HTML boards: landed pages to postings."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardsieve.functions import fixed_values as v
from boardsieve.functions.text import capped, has_any, iso_timestamp, present
from boardsieve.operators.normalise import finish, with_reason
from boardsieve.sources import parsers as p
from boardsieve.sources.html import Around, Cards, card_elements
from boardsieve.sources.landing import adapter, dedup_items, to_items, usable

_BLOCKS = ("div", "li", "article", "section")
_OUTER_BLOCKS = ("div", "article", "section")


def _select(selector: str, tag: Column, classes: Column) -> Column:
    """'tag.class', 'tag' or '*part' (any class containing the part)."""
    if selector.startswith("*"):
        return F.contains(classes, F.lit(selector[1:]))
    name, _, wanted = selector.partition(".")
    return (tag == name) & F.contains(F.concat(F.lit(" "), classes, F.lit(" ")), F.lit(f" {wanted} ")) if wanted else tag == name


def _is(selector: str):
    return lambda x: _select(selector, x["tag"], x["classes"])


def _first(value: str, condition, among: str = "elements") -> Column:
    """Value of the first element in page order that meets the condition, the card left out."""
    met = F.filter(among, lambda x: condition(x) & (x["node"] != F.col("card")) if among == "elements" else condition(x))
    return F.get(met, F.lit(0))[value]


def _own(value: str) -> Column:
    """A value of the card itself."""
    return F.get("elements", F.lit(0))[value]


def _first_text(selectors: tuple) -> Column:
    """First selector whose first element has text."""
    return F.coalesce(*[present(_first("text", _is(s))) for s in selectors])


def _url(href: Column, base: str) -> Column:
    return F.when(F.startswith(href, F.lit("http")), href).otherwise(F.concat(F.lit(base), href))


def _done(df: DataFrame, source: str, url_key: bool) -> DataFrame:
    """A card without a title or a link is refused; the rest as for the other boards."""
    df = finish(with_reason(df.withColumn("source", F.lit(source))))
    return to_items(dedup_items(df, "url") if url_key else df)


@adapter
def linkedin(landed: DataFrame) -> DataFrame:
    """Cards are ``div.base-card``; a page without any falls back to ``li``."""
    rows = card_elements(usable(landed, "linkedin"), Cards(("div.base-card", "li")))
    href = F.coalesce(_first("href", _is("a.base-card__full-link")), _first("href", lambda x: (x["tag"] == "a") & x["href"].isNotNull()))
    found = rows.select(
        "request_seq", "card", "fetched_at",
        F.coalesce(_first("text", _is("h3.base-search-card__title")), _first("text", _is("h3"))).alias("title"),
        F.coalesce(_first("text", _is("h4.base-search-card__subtitle")), _first("text", _is("h4")), F.lit("Unknown")).alias("company"),
        href.alias("href"),
        F.coalesce(_first("text", _is("span.job-search-card__location")), F.lit("Remote")).alias("location"),
        _first("datetime", _is("time")).alias("datetime"), _first("text", _is("time")).alias("ago"))
    return _done(found.select(
        "request_seq", F.col("card").alias("pos"), "fetched_at", present(F.col("title")).alias("title"), "company", "location", F.lit(True).alias("is_remote"),
        _url(F.substring_index(present(F.col("href")), "?", 1), v.LINKEDIN_URL).alias("url"), F.lit("").alias("description"),
        F.array().cast("array<string>").alias("tags"),
        F.coalesce(iso_timestamp(F.col("datetime")), p.relative_time(F.col("ago"), F.col("fetched_at"))).alias("posted_at")),
        "linkedin", url_key=True)


_TECH_CARDS = ("div.job-listing", "div.job-card", "article.job", "div.listing", "li.job-item", "*job")
_TECH_TAGS = ("span.tag", "span.skill", "span.badge", "*tag", "*skill")
_JOB_HREF = r"/jobs?/\d+|/jobs?/[a-z0-9-]+"


@adapter
def techjobsforgood(landed: DataFrame) -> DataFrame:
    """The first card selector that matches on a page decides; a page without cards
    uses the blocks around links to detail pages."""
    inside = card_elements(usable(landed, "techjobsforgood"), Cards(_TECH_CARDS, _JOB_HREF, _BLOCKS))
    job_link = lambda x: (x["tag"] == "a") & F.contains(x["href"], F.lit("/jobs/"))
    any_link = lambda x: (x["tag"] == "a") & x["href"].isNotNull()
    tag_text = lambda x: reduce(or_, [_is(s)(x) for s in _TECH_TAGS]) & (x["text"] != "") & (F.length(x["text"]) < 50)
    found = inside.select(
        "request_seq", "card", "fetched_at",
        F.coalesce(_first("text", job_link), _first("text", any_link)).alias("title"),
        F.coalesce(_first("href", job_link), _first("href", any_link)).alias("href"),
        _first_text(("span.company", "div.company", "span.org", "div.org", "span.company-name", "div.company-name",
                     "*company", "*org")).alias("company"),
        _first_text(("span.location", "div.location", "span.loc", "*location", "*remote")).alias("location"),
        _first_text(("p.description", "div.description", "p.summary", "*description", "*summary")).alias("description"),
        F.transform(F.filter("elements", tag_text), lambda x: x["text"]).alias("tags"))
    return _done(found.select(
        "request_seq", F.col("card").alias("pos"), "fetched_at", present(F.col("title")).alias("title"), F.coalesce("company", F.lit("Unknown")).alias("company"),
        F.coalesce("location", F.lit("Remote")).alias("location"), F.lit(True).alias("is_remote"),
        _url(present(F.col("href")), v.TECHJOBS_URL).alias("url"), capped(F.col("description"), 5000).alias("description"),
        F.slice("tags", 1, 10).alias("tags"), F.lit(True).alias("is_ngo_source")),
        "techjobsforgood", url_key=False)


_GOOD_HREF = r"^(?:/jobs/[a-z0-9-]+|https://goodjobs\.eu/jobs/[a-z0-9-]+)"


@adapter
def goodjobs(landed: DataFrame) -> DataFrame:
    """A job card is the anchor that leads to the posting."""
    rows = card_elements(usable(landed, "goodjobs"), Cards((), _GOOD_HREF), box="div.mb-1")
    paragraphs = F.filter("elements", lambda x: (x["tag"] == "p") & (x["box"] > F.col("card")))
    found = rows.select(
        "request_seq", "card", "fetched_at", _own("href").alias("href"), F.col("spaced_text").alias("full"), _first("text", _is("h3")).alias("title"),
        F.sort_array(F.transform(paragraphs, lambda x: F.struct(x["box"].alias("box"), x["node"].alias("node"), x["text"].alias("text")))).alias("boxes"))
    found = found.withColumn("url", _url(F.col("href"), v.GOODJOBS_URL)).filter(
        ~has_any(F.col("url"), ("?category=", "?page=", "previous-page")) & (F.regexp_replace("url", "/+$", "") != v.GOODJOBS_URL + "/jobs"))
    found = dedup_items(found.withColumn("pos", F.col("card")), "url")
    low = F.lower("full")
    firsts = F.filter("boxes", lambda x, i: (i == 0) | (F.get("boxes", i - 1)["box"] != x["box"]))
    named = F.filter(F.transform(firsts, lambda x: x["text"]), lambda t: (
        (F.length(t) > 2) & (F.length(t) < 100) & ~has_any(t, v.GOODJOBS_COMPANY_NOISE)))
    written = F.trim(F.regexp_extract("full", v.GOODJOBS_COMPANY_PATTERN, 1))
    for prefix in v.GOODJOBS_COMPANY_PREFIXES:
        written = F.trim(F.replace(written, F.lit(prefix), F.lit("")))
    found = found.withColumn("company", F.coalesce(F.try_element_at(named, F.lit(1)), present(written), F.lit("Unknown")))
    tags = F.array_compact(F.array(
        F.when(F.contains(low, F.lit("hybrid")), "Hybrid"), F.when(F.contains(low, F.lit("remote")), "Remote"),
        F.when(has_any(low, ("vollzeit", "full-time")), "Full-time"), F.when(has_any(low, ("teilzeit", "part-time")), "Part-time")))
    wanted = (F.length("full") >= 10) & ~has_any(low, v.GOODJOBS_SKIP) & (F.col("title").isNull() | (F.length("title") >= 3))
    return _done(found.filter(wanted).select(
        "request_seq", "pos", "fetched_at", "title", "company", p.worktype_location(F.col("full")).alias("location"),
        has_any(low, ("remote", "hybrid")).alias("is_remote"), "url", capped(F.col("full"), 2000).alias("description"),
        p.german_salary_range(F.col("full")).alias("salary"), tags.alias("tags"),
        p.legal_form_ngo(F.col("company"), F.col("full")).alias("is_ngo_source")), "goodjobs", url_key=False)


@adapter
def eurobrussels(landed: DataFrame) -> DataFrame:
    """Links to postings; company, place, tags and text come from the blocks around them."""
    links = card_elements(usable(landed, "eurobrussels"), Cards((), r"/job_display/[0-9]+/"),
                          around=Around(_BLOCKS, _OUTER_BLOCKS, ("div",), ("p", "span")))
    # Title candidates per anchor: its own text and the alternative text of an image in it.
    found = links.select(
        "request_seq", "fetched_at", "card", F.col("card").alias("pos"), _own("text").alias("text"), _url(_own("href"), v.EUROBRUSSELS_URL).alias("url"),
        _first("alt", lambda x: (x["tag"] == "img") & x["alt"].isNotNull()).alias("alt"),
        _first("text", _is("div.companyName"), "around").alias("company"), _first("text", _is("div.location"), "around").alias("place"),
        F.lower("outer_text").alias("card_text"),
        F.transform(F.filter("outer", lambda x: F.length(x["text"]) > 30), lambda x: x["text"]).alias("snippets"))
    enough = lambda text: F.when(F.length(text) >= 5, text)
    found = found.withColumn("title", F.coalesce(enough(F.col("text")), enough(F.trim("alt")),
                                                 enough(F.replace(p.slug_text(F.col("url")), F.lit("_"), F.lit(" ")))))
    lines = F.filter("snippets", lambda t: ~t.eqNullSafe(F.col("title")))
    found = found.select(
        "request_seq", "card", "pos", "fetched_at", "title", "url", (F.length("text") >= 5).alias("has_text"), F.coalesce(present(F.col("company")), F.lit("Unknown")).alias("company"),
        F.coalesce(present(F.col("place")), present(p.slug_location(F.col("url"))), F.lit(v.EUROBRUSSELS_DEFAULT_LOCATION)).alias("location"),
        F.lit(False).alias("is_remote"), present(capped(F.array_join(F.slice(lines, 1, 3), " "), 5000)).alias("description"),
        F.slice(p.phrase_tags(F.coalesce("card_text", F.lit(""))), 1, 10).alias("tags"),
        p.phrase_ngo(F.coalesce("card_text", F.lit(""))).alias("is_ngo_source"))
    # Within a page the last link with text stands for the url; across pages the first page does.  Rows lie by url for both.
    order = Window.partitionBy("request_seq", "url").orderBy(F.col("has_text").desc(), F.when(F.col("has_text"), -F.col("card")).otherwise(F.col("card")))
    found = found.repartition("url").withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    found = found.filter(F.col("title").isNull() | ~F.lower("title").isin(*v.EUROBRUSSELS_NAV))
    return _done(found.drop("card", "has_text", "_n"), "eurobrussels", url_key=True)
