"""Row-local enrichment: remote scope, organisation type, match score."""

from __future__ import annotations

from functools import reduce
from operator import add, or_
from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardsieve.functions import fixed_values as v
from boardsieve.functions.pin import evaluate_once
from boardsieve.functions.text import (
    capped, found_terms, has_any, has_any_in_long, has_any_mixed, has_found, has_word)
from boardsieve.settings import RuleSet


def with_rule_texts(df: DataFrame) -> DataFrame:
    """Lower-cased texts every rule reads, computed once per row.

    ``description`` is cut before lower-casing: only the organisation score and
    the on-site Germany check read the whole text, and they run on few rows.
    """
    description = F.coalesce(F.col("description"), F.lit(""))
    return df.withColumns({
        "_title": F.lower("title"),
        "_loc": F.lower("location"),
        "_tags": F.lower(F.array_join("tags", " ")),
        "_desc500": F.lower(capped(description, 500)),
        "_desc200": F.lower(capped(description, 200)),
    }).withColumns({
        "_loc_tags": F.concat_ws(" ", "_loc", "_tags"),
        "_combined": F.concat_ws(" ", "_loc", "_tags", "_desc500"),
    })


RULE_TEXTS = ("_title", "_loc", "_tags", "_desc500", "_desc200", "_loc_tags", "_combined")


# -- places ------------------------------------------------------------------
def in_germany(text: Column, rules: RuleSet) -> Column:
    return has_any(text, rules.germany_terms)


def in_eu_country(text: Column, rules: RuleSet) -> Column:
    return has_any(text, rules.eu_countries)


def on_country_blocklist(location: Column, rules: RuleSet) -> Column:
    short = [t for t in rules.country_blocklist if len(t) <= 4]
    return has_any_mixed(location, rules.country_blocklist,
                         [*rules.country_blocklist_whole_word, *short])


def blocklist_override(location: Column, rules: RuleSet) -> Column:
    """Worldwide, an EU region or an EU country lifts a country block."""
    return has_any(location, [*rules.worldwide_keywords, *rules.eu_region_keywords, *rules.eu_countries])


def outside_eu(location: Column, rules: RuleSet) -> Column:
    return has_any_mixed(location, rules.non_eu_patterns, rules.non_eu_whole_word)


def resident_in_eu(text: Column, rules: RuleSet) -> Column:
    """An EU country within a fixed distance after the first hit of a residency phrase."""
    def near(phrase: str) -> Column:
        at = F.locate(phrase, text)
        window = F.substring(text, at, F.lit(len(phrase) + rules.residency_window))
        return (at > 0) & in_eu_country(window, rules)

    return has_any_in_long(text, rules.residency_phrases) & reduce(or_, map(near, rules.residency_phrases))


def classify_scope(rules: RuleSet) -> Column:
    """Remote scope from place, tags and the head of the description.

    The first matching branch decides: Germany, EU country, EU region, EU
    residency, worldwide, blocked country, other non-EU place, unknown.
    """
    loc, both, combined = F.col("_loc"), F.col("_loc_tags"), F.col("_combined")
    doubtful = (
        (F.col("source") == "arbeitnow")
        & has_any(loc, rules.worldwide_in_location)
        & ~has_any(F.col("_desc500"), rules.worldwide_keywords)
    )
    return (
        F.when(in_germany(both, rules), "germany")
        .when(in_eu_country(both, rules), "eu")
        .when(has_any_in_long(combined, rules.eu_region_keywords), "eu")
        .when(resident_in_eu(combined, rules), "eu")
        .when(has_any(both, rules.worldwide_keywords), F.when(doubtful, "germany").otherwise("worldwide"))
        .when(on_country_blocklist(loc, rules) & ~blocklist_override(loc, rules), "restricted")
        .when(outside_eu(loc, rules), "restricted")
        .otherwise("unknown")
    )


def effective_scope(rules: RuleSet) -> Column:
    """A usable scope set by the board wins over classification."""
    return F.when(F.col("remote_scope").isin(*v.PRESET_SCOPES), F.col("remote_scope")).otherwise(
        classify_scope(rules))


# -- organisation type -------------------------------------------------------
def with_ngo_score(df: DataFrame, rules: RuleSet) -> DataFrame:
    """Add ``ngo_score`` >= 0 and ``is_ngo``.

    Only a named or known organisation can score above 0, so the whole
    description is lower-cased and searched for those rows alone, once for all lists.
    The other two lists are searched in the company, too, and across its end.
    """
    company = F.col("_company")
    df = df.withColumn("_company", F.lower("company")).withColumns({
        "_named": has_any(company, rules.ngo_company),
        "_known": has_any(company, rules.known_ngos),
    })
    likely = F.col("_named") | F.col("_known")
    df = df.withColumn("_org_text", F.when(likely, F.lower(F.coalesce("description", F.lit("")))))
    terms = list(dict.fromkeys([*rules.ngo_description, *rules.not_ngo, *rules.not_ngo_strong]))
    longest = max(map(len, terms), default=0)
    df = df.withColumns({
        "_org_found": found_terms(F.col("_org_text"), terms),
        "_org_head": F.concat(F.col("_company"), F.lit(" "), capped(F.col("_org_text"), longest)),
    })

    def mentioned(listed: Iterable[str]) -> Column:
        places = [i for i, term in enumerate(terms) if term in set(listed)]
        return has_found(F.col("_org_found"), places) | has_any_in_long(F.col("_org_head"), listed)

    mentions = reduce(add, [F.array_contains("_org_found", terms.index(t)).cast("int") for t in rules.ngo_description], F.lit(0))
    points = F.col("_named").cast("int") * 2 + F.col("_known").cast("int") + (mentions >= 2).cast("int")
    df = df.withColumn("_points", F.when(likely, points - F.when(mentioned(rules.not_ngo), 2).otherwise(0)).otherwise(0))
    strong = F.when(mentioned(rules.not_ngo_strong), 3).otherwise(0)
    df = df.withColumn("ngo_score", F.when(F.col("_points") > 0, F.greatest(F.col("_points") - strong, F.lit(0)))
                       .otherwise(0))
    df = df.withColumn("is_ngo", F.col("ngo_score") >= rules.min_ngo_score)
    return evaluate_once(df, "ngo_score", "is_ngo")


# -- match score -------------------------------------------------------------
def _keyword_hits(text: Column, rules: RuleSet) -> dict[str, Column]:
    """Per keyword whether the text holds it; only those found as substrings are looked at as whole words."""
    found = found_terms(text, list(rules.stack_weights))

    def hit(place: int, keyword: str) -> Column:
        inside = F.array_contains(found, place)
        return inside & has_word(text, [keyword]) if keyword in rules.stack_whole_word else inside

    return {keyword: hit(place, keyword) for place, keyword in enumerate(rules.stack_weights)}


def _keyword_groups(rules: RuleSet) -> dict[str, list[str]]:
    groups: dict[str, list[str]] = {}
    for keyword in rules.stack_weights:
        groups.setdefault(rules.stack_synonyms.get(keyword, keyword), []).append(keyword)
    return groups


def match_text() -> Column:
    return F.concat_ws(" ", "_title", "_tags", "_desc500", F.lower("company"))


def match_score_raw(text: Column, is_ngo: Column, rules: RuleSet) -> Column:
    """Sum of keyword weights, each synonym group once (first keyword in list order)."""
    total, hits = [], _keyword_hits(text, rules)
    for name, keywords in _keyword_groups(rules).items():
        weights = {rules.stack_weights[k] for k in keywords}
        if len(weights) == 1:
            hit = reduce(or_, [hits[k] for k in keywords])
            points = F.when(hit, weights.pop())
        else:
            points = reduce(
                lambda branch, k: branch.when(hits[k], rules.stack_weights[k]),
                keywords, F)
        if name == "ngo":
            points = points.when(is_ngo, rules.ngo_flag_bonus)
        total.append(points.otherwise(0))
    if "ngo" not in _keyword_groups(rules):
        total.append(F.when(is_ngo, rules.ngo_flag_bonus).otherwise(0))
    return reduce(add, total)


def normalise_score(raw: Column) -> Column:
    """Raw points to 0..100 along the fixed piecewise-linear curve, fractions cut."""
    curve = F
    for start, base, gain, per in v.SCORE_CURVE:
        step = F.lit(base) + F.floor((raw - start) * gain / per).cast("int")
        curve = curve.when((raw >= start) if start else (raw > 0), F.least(step, F.lit(v.SCORE_MAX)))
    return curve.otherwise(0).cast("int")


def matched_keywords(text: Column, is_ngo: Column, rules: RuleSet, limit: int = 8) -> Column:
    """The keywords that scored, in list order: the audit column of the score."""
    hits, held, first_of = [], _keyword_hits(text, rules), {}
    for keyword in rules.stack_weights:
        name = rules.stack_synonyms.get(keyword, keyword)
        earlier = first_of.setdefault(name, [])
        blocked = reduce(or_, [held[k] for k in earlier]) if earlier else F.lit(False)
        hits.append(F.when(held[keyword] & ~blocked, keyword))
        earlier.append(keyword)
    ngo_hit = reduce(or_, [held[k] for k in first_of.get("ngo", [])] or [F.lit(False)])
    hits.append(F.when(is_ngo & ~ngo_hit, "ngo (flag)"))
    return F.slice(F.array_compact(F.array(*hits)), 1, limit)


def score_bar(score: Column) -> Column:
    """Ten-cell text bar; halves round to the even cell."""
    filled = F.bround(score / 10).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(10) - filled))


def match_label(score: Column) -> Column:
    label = F
    for start, text in v.MATCH_LABELS[:-1]:
        label = label.when(score >= start, text)
    return label.otherwise(v.MATCH_LABELS[-1][1])


def with_match_score(df: DataFrame, rules: RuleSet) -> DataFrame:
    """Add ``match_raw`` and ``match_score`` from the rule texts and ``is_ngo``."""
    df = df.withColumn("_match_text", match_text())
    df = df.withColumn("match_raw", match_score_raw(F.col("_match_text"), F.col("is_ngo"), rules))
    return evaluate_once(df.withColumn("match_score", normalise_score(F.col("match_raw"))), "match_raw", "match_score")


def with_scores(df: DataFrame, rules: RuleSet) -> DataFrame:
    """Both scores.  The flag set by the board is expected in ``is_ngo_source``."""
    return with_match_score(with_ngo_score(df, rules), rules)
