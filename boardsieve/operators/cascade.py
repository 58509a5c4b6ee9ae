"""The whole filter cascade: first failing rule, dedup, cap, order, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from boardsieve.functions.pin import evaluate_once, pinned, pinned_wide
from boardsieve.functions.text import capped
from boardsieve.operators import dedup, enrich, filters
from boardsieve.operators.language import ENGLISH, only_english, with_language
from boardsieve.operators.normalise import default_scope
from boardsieve.settings import RuleSet

LANGUAGE_REASON = "language: non-English content detected"
DEDUP_REASON = "dedup (content hash)"


def with_scope(df: DataFrame, rules: RuleSet) -> DataFrame:
    """Add ``scope``: preset, classified or board default."""
    return df.withColumn("scope", enrich.effective_scope(rules)).withColumn(
        "scope", default_scope(F.col("scope"), F.col("source"), rules))


def _quoted(prefix: str, column: str, suffix: str = "'") -> Column:
    return F.concat(F.lit(prefix), F.coalesce(F.col(column), F.lit("None")), F.lit(suffix))


def _rules_before_language(rules: RuleSet) -> list[tuple[Column, Column]]:
    return [
        (filters.not_onsite_board(), F.lit("location: arbeitnow on-site (germany, not remote)")),
        (filters.not_blocked_company(rules), _quoted("company blocklist: '", "company")),
        (filters.eligible_location(rules),
         F.concat(F.lit("location: scope="), "scope", F.lit(", loc='"), "location", F.lit("'"))),
        (filters.wanted_role(rules), _quoted("role: no dev keyword in title '", "title")),
        (filters.compatible_stack(rules), _quoted("stack: incompatible stack in '", "title")),
    ]


def _rules_after_language(rules: RuleSet, as_of: Column, max_age_days: int | None) -> list[tuple[Column, Column]]:
    checks = []
    if not rules.accept_onsite_germany:
        checks.append((filters.not_onsite_germany(rules),
                       _quoted("on-site Germany: no remote/hybrid signal in '", "title")))
    if rules.senior_only:
        checks.append((filters.senior_enough(rules),
                       _quoted("senior filter: title '", "title", "' has junior/mid-level")))
    if rules.min_salary > 0:
        checks.append((filters.enough_salary(rules),
                       _quoted("salary filter: '", "salary", f"' below min {rules.min_salary}")))
    days = F.bround(filters.age_seconds(as_of) / filters.SECONDS_PER_DAY).cast("long").cast("string")
    limit = filters.age_limit_days(rules, max_age_days).cast("string")
    checks.append((filters.recent_enough(rules, as_of, max_age_days),
                   F.concat(F.lit("recency: "), days, F.lit("d old (max "), limit, F.lit("d)"))))
    return checks


def _first_reason(checks: list[tuple[Column, Column]]) -> Column:
    chain = F
    for passes, reason in checks:
        chain = chain.when(~passes, reason)
    return chain.otherwise(F.lit(None).cast("string"))


def label_rows(df: DataFrame, rules: RuleSet, as_of: Column, max_age_days: int | None = None) -> DataFrame:
    """Add ``scope`` and, per row, the first failing rule before and after language.

    One narrow stage: every rule reads the same lower-cased texts, computed once.
    """
    texts = evaluate_once(with_scope(enrich.with_rule_texts(df), rules), "scope", *enrich.RULE_TEXTS)
    return texts.withColumns({
        "_early": _first_reason(_rules_before_language(rules)),
        "_late": _first_reason(_rules_after_language(rules, as_of, max_age_days)),
    })


def language_text() -> Column:
    """Title plus the head of the description."""
    return F.concat_ws(" ", "title", capped(F.col("description"), 300))


def sequenced(df: DataFrame) -> DataFrame:
    """Rows with a checked sequence: a null one is an error, because rows are told apart by it."""
    wrong = F.raise_error(F.lit("a row has no ingest_seq")).cast("long")
    return df.withColumn("ingest_seq", F.coalesce("ingest_seq", wrong))


def check_unique(df: DataFrame) -> Row:
    """Raise if two rows share a sequence; else their number and times as ``raw``, ``started_at`` and ``completed_at``."""
    per_key = df.groupBy("ingest_seq").agg(F.count(F.lit(1)).alias("n"), F.min("fetched_at").alias("low"), F.max("fetched_at").alias("high"))
    facts = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("raw"), F.min("low").alias("started_at"), F.max("high").alias("completed_at"),
                        F.max("n").alias("most"), F.max_by("ingest_seq", "n").alias("ingest_seq")).first()
    if (facts.most or 0) > 1:
        raise ValueError(f"ingest_seq {facts.ingest_seq} stands for {facts.most} rows")
    return facts


def _check_language(rules: RuleSet, profile: DataFrame | None) -> None:
    if rules.english_only and profile is None:
        raise ValueError("english_only needs a language profile; train one or set english_only=False")


def _keep_survivors(passed: DataFrame, rules: RuleSet) -> DataFrame:
    return dedup.cap_companies(dedup.dedup_in_scan(passed), rules.max_per_company)


def _drop_helpers(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_")])


MAX_BROADCAST_SURVIVORS = 1_000_000
SURVIVOR_COLUMNS = ("ingest_seq", "content_hash", "company", "posted_at", "fetched_at")


def run_cascade(df: DataFrame, rules: RuleSet, as_of: Column, max_age_days: int | None = None,
                profile: DataFrame | None = None) -> DataFrame:
    """Accepted rows with scope, organisation flag and scores.

    Acceptance is the conjunction of all row rules, so their order is free here.
    Age and title rules run first in the scan stage; scope and location search
    the long texts of what is left.  Only keys, times and the head of the text go
    through the language rule, dedup and cap; the wide rows of the survivors are
    fetched back by sequence and scored then, unless a score decides who passes.
    """
    _check_language(rules, profile)
    df = sequenced(df)
    recent = df.filter(filters.recent_enough(rules, as_of, max_age_days))
    cheap = filters.wanted_role(rules) & filters.compatible_stack(rules) & filters.not_blocked_company(rules)
    if rules.senior_only:
        cheap = cheap & filters.senior_enough(rules)
    if rules.min_salary > 0:
        cheap = cheap & filters.enough_salary(rules)
    texts = enrich.with_rule_texts(recent).withColumn("_cheap", cheap)
    likely = evaluate_once(texts, "_cheap", *enrich.RULE_TEXTS).filter("_cheap").drop("_cheap")
    scoped = evaluate_once(with_scope(likely, rules), "scope").withColumn(
        "_place", filters.not_onsite_board() & filters.not_onsite_germany(rules) & filters.eligible_location(rules))
    passed = evaluate_once(scoped, "_place").filter("_place").drop("_place")
    if rules.min_match_score > 0:
        passed = enrich.with_scores(passed, rules).filter(filters.enough_match(rules))
    narrow = passed.select(*SURVIVOR_COLUMNS, language_text().alias("_lang_text"))
    if rules.english_only:
        narrow = only_english(narrow, "ingest_seq", F.col("_lang_text"), profile, pinned)
    kept = pinned(_keep_survivors(narrow.select(*SURVIVOR_COLUMNS), rules).select("ingest_seq"))
    wide = dedup.with_keys(df, kept, "ingest_seq", MAX_BROADCAST_SURVIVORS)
    texts = evaluate_once(with_scope(enrich.with_rule_texts(wide), rules), "scope", *enrich.RULE_TEXTS)
    return _drop_helpers(enrich.with_scores(texts, rules))


REPORT_COLUMNS = ("ingest_seq", "id", "content_hash", "source", "title", "company", "location",
                  "url", "posted_at", "fetched_at", "scope")


def with_reject_reason(df: DataFrame, rules: RuleSet, as_of: Column, max_age_days: int | None = None,
                       profile: DataFrame | None = None, columns: Sequence[str] = REPORT_COLUMNS) -> DataFrame:
    """Every row (``columns`` only) with ``reject_reason``, null for accepted rows.

    A row that repeats an accepted earlier row is a duplicate whatever else is
    wrong with it.  Accepted rows are unique per content hash, so the join side
    is narrow and a hot hash is split by the skew join; beside many accepted rows only those move
    whose hash a key filter lets pass.
    """
    _check_language(rules, profile)
    labelled = label_rows(sequenced(df), rules, as_of, max_age_days)
    if rules.min_match_score > 0:
        too_low = F.concat(F.lit("match score: "), F.col("match_score").cast("string"),
                           F.lit(f"% < minimum {rules.min_match_score}%"))
        labelled = enrich.with_scores(labelled, rules)
        labelled = labelled.withColumn("_late", F.coalesce("_late", F.when(~filters.enough_match(rules), too_low)))
    labelled = labelled.withColumn("_lang_text", F.when(F.col("_early").isNull(), language_text()))
    read = dict.fromkeys([*columns, *SURVIVOR_COLUMNS])
    rows = labelled.select(*read, "_early", "_late", "_lang_text")
    language = F.lit(None).cast("string")
    if rules.english_only:
        rows = with_language(rows, "ingest_seq", "_lang_text", profile, pinned_wide)
        language = F.when(F.col("detected_lang") != ENGLISH, LANGUAGE_REASON)
    rows = pinned_wide(rows.select(*read, F.coalesce("_early", language, "_late").alias("_local")))
    rows = rows.withColumn("_sort_ts", F.coalesce("posted_at", "fetched_at"))
    winners = pinned(_keep_survivors(rows.filter(F.col("_local").isNull()), rules).select(
        "content_hash", F.col("_sort_ts").alias("_kept_ts"), F.col("ingest_seq").alias("_kept_seq")))
    joined = _with_winners(rows, winners)
    earlier = (F.col("_kept_ts") > F.col("_sort_ts")) | (
        (F.col("_kept_ts") == F.col("_sort_ts")) & (F.col("_kept_seq") < F.col("ingest_seq")))
    over_cap = F.concat(F.lit(f"company cap: already {rules.max_per_company} from '"), "company", F.lit("'"))
    reason = (
        F.when(F.col("_kept_seq") == F.col("ingest_seq"), F.lit(None).cast("string"))
        .when(earlier, DEDUP_REASON)
        .otherwise(F.coalesce("_local", over_cap))
    )
    return joined.withColumn("reject_reason", reason).select(*columns, "reject_reason")


#: Accepted rows beyond which rows without one of their hashes are kept out of the join.
MANY_WINNERS = 100_000


def _with_winners(rows: DataFrame, winners: DataFrame) -> DataFrame:
    """Rows with the accepted row of their content hash, if there is one."""
    count = winners.count()
    if count <= MANY_WINNERS:
        return rows.join(winners, "content_hash", "left")
    met = F.coalesce(dedup.key_filter(winners, "content_hash", count)(F.col("content_hash")), F.lit(False))
    none = [F.lit(None).cast(kind).alias(name) for name, kind in winners.dtypes if name != "content_hash"]
    return rows.filter(met).join(winners, "content_hash", "left").unionByName(rows.filter(~met).select("*", *none))


def in_final_order(accepted: DataFrame) -> DataFrame:
    """Best match first; newest first among equals."""
    return accepted.orderBy(F.col("match_score").desc(), *dedup.recency_order())


def reason_category(reason: Column) -> Column:
    return F.trim(F.substring_index(reason, ":", 1))


def reject_report(reasoned: DataFrame) -> DataFrame:
    """Rejected rows per category, largest first."""
    rejected = reasoned.filter(F.col("reject_reason").isNotNull())
    counts = rejected.groupBy(reason_category(F.col("reject_reason")).alias("category")).agg(
        F.count(F.lit(1)).alias("rejected"))
    return counts.orderBy(F.col("rejected").desc(), "category")


def funnel(reasoned: DataFrame, ledger_keys: DataFrame, max_broadcast_rows: int | None = None) -> DataFrame:
    """Raw, accepted and new rows per source, in one pass over the labelled rows, of which the keys of accepted ones are kept."""
    passed = F.col("reject_reason").isNull()
    keys = [F.when(passed, F.col(c)).alias(c) for c in ("id", "content_hash")]
    rows = pinned_wide(reasoned.select("source", "ingest_seq", passed.alias("_accepted"), *keys))
    accepted = rows.filter("_accepted").select("id", "content_hash", "ingest_seq")
    stored = dedup.askable(ledger_keys, accepted)
    new = dedup.filter_unseen(accepted, stored, max_broadcast_rows).select("ingest_seq", F.lit(True).alias("_new"))
    joined = rows.select("source", "ingest_seq", "_accepted").join(new, "ingest_seq", "left")
    return joined.groupBy("source").agg(
        F.count(F.lit(1)).alias("raw"),
        F.count_if("_accepted").alias("accepted"),
        F.count_if("_new").alias("new"),
    )
