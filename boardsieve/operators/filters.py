"""Accept rules as boolean Columns (F1-F11); true means the row passes.

They read the texts of :func:`boardsieve.operators.enrich.with_rule_texts` and
the column ``scope``.  Each is usable alone as ``df.filter(rule)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from boardsieve.functions import fixed_values as v
from boardsieve.functions.text import has_any, has_any_in_long, has_word, lookup
from boardsieve.operators import enrich
from boardsieve.operators.normalise import company_key
from boardsieve.settings import RuleSet

SECONDS_PER_DAY = 86400


def not_onsite_board() -> Column:
    """One board delivers on-site German rows with an explicit flag."""
    return ~((F.col("source") == "arbeitnow") & ~F.col("is_remote") & (F.col("scope") == "germany"))


def not_blocked_company(rules: RuleSet) -> Column:
    if not rules.company_blocklist:
        return F.lit(True)
    return ~has_any(company_key(F.col("company")), rules.company_blocklist)


def eligible_location(rules: RuleSet) -> Column:
    """Accept remote rows with a usable scope; judge on-site rows by their texts."""
    loc, combined, scope = F.col("_loc"), F.col("_combined"), F.col("scope")
    worldwide = has_any_in_long(combined, rules.worldwide_keywords)
    # On-site rows in Germany may say so anywhere in the description.
    remote_anywhere = has_any(F.col("_loc_tags"), rules.remote_keywords) | F.coalesce(
        has_any(F.col("description"), rules.remote_keywords, ignore_case=True), F.lit(False))
    return (
        F.when(scope.isin(*v.ACCEPTED_SCOPES) & F.col("is_remote"), True)
        .when(scope.isin("restricted", "unknown"), False)
        .when(has_any_in_long(combined, rules.block_phrases) & ~worldwide, False)
        .when(has_any_in_long(combined, rules.uk_signals), False)
        .when(enrich.on_country_blocklist(loc, rules) & ~enrich.blocklist_override(loc, rules), False)
        .when(worldwide, True)
        .when(has_any_in_long(combined, rules.eu_region_keywords), True)
        .when(enrich.in_germany(combined, rules), remote_anywhere)
        .when(enrich.in_eu_country(combined, rules) & has_any_in_long(combined, rules.remote_keywords), True)
        .when(enrich.in_eu_country(loc, rules), True)
        .when(enrich.resident_in_eu(combined, rules), True)
        .otherwise(False)
    )


def wanted_role(rules: RuleSet) -> Column:
    title = F.col("_title")
    intern = title.rlike(rf"(?U)^\s*{v.INTERN_TITLE}(?:\s*$| )")
    profile = F.concat_ws(" ", "_title", "_tags", "_desc200")
    return (
        ~has_any(title, rules.title_reject)
        & ~has_word(title, rules.title_reject_whole_word)
        & ~intern
        & has_any(profile, rules.role_accept)
    )


def compatible_stack(rules: RuleSet) -> Column:
    text = F.concat_ws(" ", "_title", "_tags")
    foreign = has_any(text, rules.incompatible_stacks) | (
        has_word(text, ["go"]) & has_any(text, rules.go_context))
    return ~(foreign & ~has_any(text, rules.user_stack))


def not_onsite_germany(rules: RuleSet) -> Column:
    if rules.accept_onsite_germany:
        return F.lit(True)
    return ~((F.col("scope") == "germany") & ~F.col("is_remote"))


def senior_enough(rules: RuleSet) -> Column:
    title = F.col("_title")
    return has_any(title, rules.senior_accept) | ~has_any(title, rules.senior_reject)


def annual_salary(salary: Column) -> Column:
    """First number of a salary text, taken as monthly below 10000; null when unreadable."""
    number = F.regexp_extract(F.replace(salary, F.lit(","), F.lit("")), r"[\d,.]+", 0).try_cast("double")
    return F.when(number < 10000, number * 12).otherwise(number)


def enough_salary(rules: RuleSet) -> Column:
    return F.coalesce(annual_salary(F.col("salary")) >= rules.min_salary, F.lit(True))


def age_limit_days(rules: RuleSet, max_age_days: int | None) -> Column:
    """Limit per row: the board's own limit, else the argument, else the default."""
    fallback = F.lit(rules.max_age_days if max_age_days is None else max_age_days)
    return F.coalesce(lookup(dict(rules.max_age_by_source), F.col("source")), fallback)


def age_seconds(as_of: Column) -> Column:
    return F.unix_micros(as_of) / F.lit(1e6) - F.unix_micros("posted_at") / F.lit(1e6)


def recent_enough(rules: RuleSet, as_of: Column, max_age_days: int | None = None) -> Column:
    """Posted within the limit; rows without a date pass, future dates pass."""
    oldest = as_of - F.make_dt_interval(age_limit_days(rules, max_age_days))
    return F.coalesce(F.col("posted_at") >= oldest, F.lit(True))


def enough_match(rules: RuleSet) -> Column:
    return F.col("match_score") >= rules.min_match_score
