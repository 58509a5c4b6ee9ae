"""Registered queries of the record, rule and cascade operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardsieve.functions.text import has_any, has_any_in_long
from boardsieve.operators import cascade, dedup, enrich, filters, language, normalise
from boardsieve.plans import corpus
from boardsieve.settings import RuleSet

RULES = RuleSet()


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.with_rule_texts(corpus.postings(spark, sf_dir))


def _scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.evaluate_once(cascade.with_scope(_texts(spark, sf_dir), RULES), "scope", *enrich.RULE_TEXTS)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All postings with scope and scores: the ledger content of the other queries."""
    rows = enrich.with_scores(_scoped(spark, sf_dir), RULES)
    return rows.drop("_title", "_loc", "_tags", "_desc500", "_desc200", "_loc_tags", "_combined", "remote_scope") \
        .withColumnRenamed("scope", "remote_scope")


def _passing(rule, *columns: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _scoped(spark, sf_dir).filter(rule()).select("ingest_seq", *columns)
    return run


def _scope_of(spark, sf_dir):
    return _texts(spark, sf_dir).select("ingest_seq", enrich.classify_scope(RULES).alias("scope"))


def _scope_defaults(spark, sf_dir):
    rows = _texts(spark, sf_dir).withColumn("scope0", enrich.effective_scope(RULES))
    return rows.select("ingest_seq", "source", "scope0",
                       normalise.default_scope(F.col("scope0"), F.col("source"), RULES).alias("scope"))


def _tags_split(spark, sf_dir):
    tags = normalise.split_tags(F.col("tags_csv"))
    return corpus.raw_postings(spark, sf_dir).select("ingest_seq", F.size(tags).alias("n"), F.array_join(tags, "|").alias("tags"))


def _tags_roundtrip(spark, sf_dir):
    rows = corpus.postings(spark, sf_dir).withColumn("stored", normalise.join_tags(F.col("tags")))
    return rows.select("ingest_seq", "stored", (normalise.split_tags(F.col("stored")) == F.col("tags")).alias("same"))


def _quarantine(spark, sf_dir):
    broken = corpus.postings(spark, sf_dir).withColumns({
        "title": F.when(F.col("salary").isNotNull(), F.col("title")),
        "company": F.when(F.col("posted_at").isNotNull(), F.col("company")),
    })
    return normalise.quarantine(broken).select("ingest_seq", "missing")


def _has_any(spark, sf_dir):
    whole = F.lower(F.coalesce("description", F.lit("")))
    return _texts(spark, sf_dir).withColumn("_whole", whole).select(
        "ingest_seq", has_any_in_long(F.col("_combined"), RULES.worldwide_keywords).alias("worldwide"),
        has_any(F.col("_combined"), RULES.remote_keywords).alias("remote"),
        has_any_in_long(F.col("_whole"), RULES.ngo_description).alias("mission"))


def _non_eu(spark, sf_dir):
    return _texts(spark, sf_dir).select(
        "ingest_seq", enrich.outside_eu(F.col("_loc"), RULES).alias("outside"),
        enrich.on_country_blocklist(F.col("_loc"), RULES).alias("blocked"))


def _residency(spark, sf_dir):
    return _texts(spark, sf_dir).select("ingest_seq", enrich.resident_in_eu(F.col("_combined"), RULES).alias("resident"))


def _scores(*columns):
    def run(spark, sf_dir):
        return scored(spark, sf_dir).select("ingest_seq", *columns)
    return run


def _min_score(spark, sf_dir):
    rules = replace(RULES, min_match_score=20)
    rows = cascade.evaluate_once(scored(spark, sf_dir), "match_score")
    return rows.filter(filters.enough_match(rules)).select("ingest_seq", "match_score")


def _blocklist(spark, sf_dir):
    rules = replace(RULES, company_blocklist=("unknown", "saas", "#00000001"))
    return corpus.postings(spark, sf_dir).filter(filters.not_blocked_company(rules)).select("ingest_seq", "company")


def _salary(spark, sf_dir):
    rules = replace(RULES, min_salary=50000)
    return corpus.postings(spark, sf_dir).filter(filters.enough_salary(rules)).select("ingest_seq", "salary")


def _recency(spark, sf_dir):
    rows = corpus.postings(spark, sf_dir)
    return rows.filter(filters.recent_enough(RULES, corpus.as_of(), corpus.PIPE_MAX_AGE)).select("ingest_seq", "source")


def _language_filter(spark, sf_dir):
    profile = corpus.language_profile(spark, sf_dir)
    rows = corpus.postings(spark, sf_dir)
    return language.only_english(rows, "ingest_seq", cascade.language_text(), profile).select("ingest_seq", "title")


def _language_id(spark, sf_dir):
    profile = corpus.language_profile(spark, sf_dir)
    return language.detect_language(corpus.table(spark, sf_dir, "documents"), "doc_id", "text", profile)


def _wanted(spark, sf_dir):
    return _texts(spark, sf_dir).filter(filters.wanted_role(RULES))


def _scan_dedup(spark, sf_dir):
    return dedup.dedup_in_scan(_wanted(spark, sf_dir)).select("ingest_seq", "content_hash")


def _company_cap(spark, sf_dir):
    return dedup.cap_companies(dedup.dedup_in_scan(_wanted(spark, sf_dir)), RULES.max_per_company).select("ingest_seq", "company")


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the whole cascade over all postings, best match first."""
    profile = corpus.language_profile(spark, sf_dir)
    rows = cascade.run_cascade(corpus.postings(spark, sf_dir), RULES, corpus.as_of(), corpus.PIPE_MAX_AGE, profile)
    return cascade.in_final_order(rows).select(
        "ingest_seq", "id", "title", "company", "location", "source", "scope", "is_ngo", "match_score")


def reasoned(spark: SparkSession, sf_dir: str, columns: Sequence[str] = cascade.REPORT_COLUMNS) -> DataFrame:
    profile = corpus.language_profile(spark, sf_dir)
    return cascade.with_reject_reason(corpus.postings(spark, sf_dir), RULES, corpus.as_of(), corpus.PIPE_MAX_AGE, profile, columns)


QUERIES = {
    "posting_id": lambda s, d: corpus.postings(s, d).select("ingest_seq", "id"),
    "content_hash": lambda s, d: corpus.postings(s, d).select("ingest_seq", "content_hash"),
    "tags_split": _tags_split,
    "tags_roundtrip": _tags_roundtrip,
    "quarantine": _quarantine,
    "scope_defaults": _scope_defaults,
    "classify_scope": _scope_of,
    "has_any": _has_any,
    "non_eu_location": _non_eu,
    "residency_eu": _residency,
    "ngo_score": _scores("ngo_score", "is_ngo"),
    "match_score_raw": _scores("match_raw"),
    "match_score": _scores("match_score"),
    "score_bar": lambda s, d: scored(s, d).select(
        "ingest_seq", "match_score", enrich.score_bar(F.col("match_score")).alias("bar")),
    "match_label": lambda s, d: scored(s, d).select(
        "ingest_seq", enrich.match_label(F.col("match_score")).alias("label"), (F.col("match_score") >= 60).alias("high")),
    "onsite_source": _passing(filters.not_onsite_board, "source"),
    "company_blocklist": _blocklist,
    "location_filter": _passing(lambda: filters.eligible_location(RULES), "scope"),
    "role_filter": lambda s, d: _wanted(s, d).select("ingest_seq", "title"),
    "stack_filter": lambda s, d: _texts(s, d).filter(filters.compatible_stack(RULES)).select("ingest_seq", "title"),
    "language_filter": _language_filter,
    "language_id": _language_id,
    "onsite_germany": _passing(lambda: filters.not_onsite_germany(RULES), "scope"),
    "senior_filter": lambda s, d: _texts(s, d).filter(filters.senior_enough(RULES)).select("ingest_seq", "title"),
    "salary_filter": _salary,
    "recency_filter": _recency,
    "min_score": _min_score,
    "scan_dedup": _scan_dedup,
    "company_cap": _company_cap,
    "filter_cascade": accepted,
    "reject_report": lambda s, d: cascade.reject_report(reasoned(s, d)),
    "reject_reasons": lambda s, d: reasoned(s, d).select("ingest_seq", "reject_reason"),
}
