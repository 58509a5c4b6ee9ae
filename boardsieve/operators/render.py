"""Message texts as columns (R1-R3, R5); delivery is not part of this library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardsieve.functions import fixed_values as v
from boardsieve.functions.text import lookup, present
from boardsieve.operators.enrich import match_label, score_bar


# -- ages --------------------------------------------------------------------
def _elapsed(moment: Column, as_of: Column) -> Column:
    return F.unix_seconds(as_of) - F.unix_seconds(moment)


def _plural(count: Column, unit: str, suffix: str = " ago") -> Column:
    return F.concat(count.cast("string"), F.lit(f" {unit}"), F.when(count != 1, "s").otherwise(""), F.lit(suffix))


def age_short(moment: Column, as_of: Column) -> Column:
    """'just now', '5h ago', '3d ago'."""
    seconds = _elapsed(moment, as_of)
    hours, days = F.floor(seconds / 3600), F.floor(seconds / 86400)
    return (
        F.when(moment.isNull(), "age unknown")
        .when(seconds < 0, "posted today")
        .when(hours == 0, "just now")
        .when(days == 0, F.concat(hours.cast("string"), F.lit("h ago")))
        .otherwise(F.concat(days.cast("string"), F.lit("d ago")))
    )


def age_long(moment: Column, as_of: Column) -> Column:
    """'12 minutes ago', '1 hour ago', '2 days ago'."""
    minutes = F.floor(_elapsed(moment, as_of) / 60)
    return (
        F.when(moment.isNull(), "never")
        .when(minutes < 1, "just now")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" minutes ago")))
        .when(minutes < 1440, _plural(F.floor(minutes / 60), "hour"))
        .otherwise(_plural(F.floor(minutes / 1440), "day"))
    )


def age_counted(moment: Column, as_of: Column) -> Column:
    """The long form with a singular minute."""
    minutes = F.floor(_elapsed(moment, as_of) / 60)
    return F.when((minutes >= 1) & (minutes < 60), _plural(minutes, "minute")).otherwise(age_long(moment, as_of))


def age_relative(moment: Column, as_of: Column) -> Column:
    """Relative for five days, then the date; future moments show the date."""
    seconds = _elapsed(moment, as_of)
    days = F.floor(seconds / 86400)
    date = F.date_format(moment, "yyyy-MM-dd")
    return (
        F.when(seconds < 0, date)
        .when(seconds < 3600, "a few minutes ago")
        .when(seconds < 7200, "1 hour ago")
        .when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit(" hours ago")))
        .when(days < 6, _plural(days, "day"))
        .otherwise(date)
    )


def time_until(moment: Column, as_of: Column) -> Column:
    """'in 5 minutes', 'in 1 hour', 'any moment'."""
    minutes = F.floor((F.unix_seconds(moment) - F.unix_seconds(as_of)) / 60)
    return (
        F.when(moment.isNull(), "unknown")
        .when(minutes <= 0, "any moment")
        .when(minutes < 60, F.concat(F.lit("in "), _plural(minutes, "minute", "")))
        .otherwise(F.concat(F.lit("in "), _plural(F.floor(minutes / 60), "hour", "")))
    )


# -- cards -------------------------------------------------------------------
def _lines(*parts: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*parts)), "\n")


def card_description() -> Column:
    address = F.concat_ws(", ", present(F.col("company_postal_code")), present(F.col("company_city")),
                          present(F.col("company_country")))
    company = F.concat(
        F.lit("**🏢  "), F.coalesce(present(F.col("company")), F.lit("Unknown")), F.lit("**"),
        F.when(address != "", F.concat(F.lit("\n> 📫 "), address)).otherwise(""))
    scope = F.coalesce(present(F.col("remote_scope")), F.lit("unknown"))
    label = F.coalesce(lookup(v.SCOPE_LABELS, scope), F.initcap(scope))
    suffix = F.when(F.contains(F.lower("location"), F.lower(label)), "").otherwise(
        F.concat(F.lit("  ·  *"), label, F.lit(" remote*")))
    place = F.when(
        F.col("is_remote"),
        F.concat(F.coalesce(lookup(v.SCOPE_EMOJI, scope), F.lit("📍")), F.lit("  "), "location", suffix),
    ).otherwise(F.concat(F.lit("📍  "), "location"))
    salary = F.when(present(F.col("salary")).isNotNull(), F.concat(F.lit("💰  "), "salary"))
    score = F.col("match_score")
    bar = F.concat(F.lit("`"), score_bar(F.coalesce(score, F.lit(0))), F.lit("`"))
    match = (
        F.when(score > 0, F.concat(match_label(score), F.lit(" match — **"), score.cast("string"), F.lit("%**\n"), bar))
        .when(score.isNotNull(), F.concat(F.lit("📊 Match — **0%**\n"), bar))
        .otherwise("📊 Match — *not scored*")
    )
    return _lines(company, place, salary, F.lit(""), match)


def render_card(rows: DataFrame, as_of: Column, separate_ngo_channel: bool = True) -> DataFrame:
    """One message payload per posting: route, colour, title, body, tags and footer."""
    high = F.col("match_score") >= v.HIGH_MATCH_FROM
    badge = F.when(F.col("is_ngo"), "🏛️ NGO / Nonprofit").otherwise("💼 General")
    chips = F.transform(F.slice("tags", 1, 6), lambda t: F.concat(F.lit("`"), t, F.lit("`")))
    icon = F.coalesce(lookup(v.SOURCE_ICONS, F.col("source")), F.lit(v.DEFAULT_ICON))
    posted = F.coalesce(age_relative(F.col("posted_at"), as_of), F.lit("Unknown date"))
    route = F.when(F.col("is_ngo") & F.lit(separate_ngo_channel), "ngo").otherwise("general")
    return rows.select(
        "id",
        route.alias("route"),
        F.when(high, v.COLOUR_HIGH_MATCH).when(F.col("is_ngo"), v.COLOUR_NGO).otherwise(v.COLOUR_GENERAL).alias("colour"),
        F.when(high, F.concat(F.lit("\ufffd High Match · "), badge)).otherwise(badge).alias("author"),
        F.substring("title", 1, 256).alias("title"),
        "url",
        card_description().alias("description"),
        F.when(F.size("tags") > 0, F.array_join(chips, "  ")).alias("tags_field"),
        F.concat(icon, F.lit(" "), "source", F.lit("  ·  📅 "), posted).alias("footer"),
    )


def payload_json(cards: DataFrame) -> DataFrame:
    """Cards as one JSON document per row, ready for a delivery job."""
    return cards.select("id", "route", F.to_json(F.struct(*[c for c in cards.columns if c not in ("id", "route")])).alias("payload"))


def escape_html(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def render_html() -> Column:
    """The posting as a short HTML message."""
    ngo = F.col("is_ngo")
    head = F.concat(F.when(ngo, "🟢").otherwise("🔵"), F.lit(" <b>"), escape_html(F.col("title")),
                    F.lit("</b> — "), escape_html(F.col("company")))
    place = F.concat(F.lit("📍 "), escape_html(F.col("location")), F.lit(" ("),
                     F.coalesce(present(F.col("remote_scope")), F.lit("unknown")), F.lit(") · "),
                     F.when(ngo, "NGO/Nonprofit").otherwise("General"))
    salary = F.when(present(F.col("salary")).isNotNull(), F.concat(F.lit("💰 "), escape_html(F.col("salary"))))
    match = F.concat(F.lit("📊 "), F.col("match_score").cast("string"), F.lit("% match "), score_bar(F.col("match_score")))
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("🏷️ "), escape_html(F.array_join(F.slice("tags", 1, 5), ", "))))
    source = F.concat(F.lit("🌍 Source: "), escape_html(F.col("source")))
    posted = F.concat(F.lit("📅 Posted: "), F.date_format("posted_at", "yyyy-MM-dd"))
    link = F.concat(F.lit('🔗 <a href="'), "url", F.lit('">Apply here</a>'))
    return _lines(head, place, salary, match, tags, source, posted, link)


# -- digests -----------------------------------------------------------------
def digest_line() -> Column:
    icon = F.coalesce(lookup(v.DIGEST_ICONS, F.col("source")), F.lit(v.DEFAULT_ICON))
    return F.concat(icon, F.lit(" **"), "title", F.lit("**\n> 🏢 "), "company", F.lit("  ·  `"), "source", F.lit("`"))


def weekly_line(as_of: Column) -> Column:
    icon = F.coalesce(lookup(v.SOURCE_ICONS, F.col("source")), F.lit(v.DEFAULT_ICON))
    scope = F.when(present(F.col("remote_scope")).isNotNull(), F.concat(F.lit("  🌍 "), "remote_scope")).otherwise("")
    score = F.when(F.col("match_score") > 0, F.concat(
        F.lit("  📊 "), score_bar(F.col("match_score")), F.lit(" "), F.col("match_score").cast("string"), F.lit("%"))).otherwise("")
    seen = F.coalesce(F.concat(F.lit("\n> 🕐 "), age_relative(F.col("fetched_at"), as_of)), F.lit(""))
    return F.concat(icon, F.lit(" **["), "title", F.lit("]("), "url", F.lit(")**\n> 🏢 "), "company",
                    F.lit("  ·  `"), "source", F.lit("`"), scope, score, seen)


def digest_body(top_rows: DataFrame, line: Column, order: list[Column], shown: int, more_suffix: str) -> DataFrame:
    """Join the first ``shown`` lines of a top-k result and count the rest.

    ``top_rows`` is already limited by a top-k plan, so the one row built here
    holds at most that many lines.
    """
    ranked = top_rows.withColumn("_rank", F.row_number().over(Window.orderBy(*order)))
    one = ranked.agg(F.sort_array(F.collect_list(F.struct("_rank", line.alias("line")))).alias("all"))
    total = F.size("all")
    lines = F.array_join(F.transform(F.slice("all", 1, shown), lambda x: x["line"]), "\n\n")
    more = F.when(total > shown, F.concat(
        F.lit("\n\n*…and "), (total - shown).cast("string"), F.lit(f" more{more_suffix}*"))).otherwise("")
    return one.select(total.alias("listed"), F.concat(lines, more).alias("body"))
