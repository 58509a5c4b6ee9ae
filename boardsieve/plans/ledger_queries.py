"""Registered queries over the ledger, its statistics, messages and time windows.

The ledger is every scored posting fetched before the last 24 hours and the
batch is the rest, so both together are the whole posting view.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardsieve.functions import fixed_values as v
from boardsieve.functions.pin import pinned
from boardsieve.operators import cascade, dedup, dictionary, enrich, ledger, render, stats
from boardsieve.plans import corpus
from boardsieve.plans.rule_queries import RULES, reasoned, scored
from boardsieve.session import ensure_checkpoint_dir
from boardsieve.sources.parsers import address
from boardsieve.streaming import windows

_TIME = "yyyy-MM-dd HH:mm:ss"


def _text(column: str):
    return F.date_format(column, _TIME).alias(column)


def _classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings with the organisation flag only, for queries that need no other score."""
    return enrich.with_ngo_score(corpus.postings(spark, sf_dir), RULES)


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.postings(spark, sf_dir).filter(F.col("fetched_at") >= ledger.cutoff(corpus.as_of(), 24))


def _stored_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.postings(spark, sf_dir).filter(
        F.col("fetched_at") < ledger.cutoff(corpus.as_of(), 24)).select("id", "content_hash")


def _ledger_and_marks(spark: SparkSession, sf_dir: str, *columns: str) -> tuple[DataFrame, DataFrame]:
    """The named ledger columns, scored once, and the marks: every high match was announced."""
    rows = pinned(scored(spark, sf_dir).select("id", "fetched_at", "match_score", *columns))
    return rows, rows.filter("match_score >= 60").select("id", corpus.as_of().alias("notified_at"))


def _filter_unseen(s, d):
    return dedup.filter_unseen(_batch(s, d), _stored_keys(s, d), ledger.MAX_BROADCAST_KEYS).select("ingest_seq", "id")


def _ledger_append(s, d):
    return ledger.append_new(_batch(s, d), _stored_keys(s, d), ledger.MAX_BROADCAST_KEYS).select("ingest_seq", "id")


def _seen_semi(s, d):
    return dedup.seen(_batch(s, d).select("ingest_seq", "id"), _stored_keys(s, d), ledger.MAX_BROADCAST_KEYS)


def _overview(s, d):
    return stats.overview(_classed(s, d), corpus.as_of()).withColumn("last_fetched_at", _text("last_fetched_at"))


def _digest(s, d, day_floor=False, columns=("title",)):
    return ledger.digest_recent(*_ledger_and_marks(s, d, *columns), corpus.as_of(), day_floor=day_floor)


def _digest_recent(s, d):
    return _digest(s, d).select("id", "title", _text("fetched_at"))


def _digest_day(s, d):
    return _digest(s, d, True).select("id", "title", _text("fetched_at"))


def _weekly_ngo(s, d):
    return ledger.weekly_ngo(scored(s, d), corpus.as_of()).select("id", "company", "match_score", _text("fetched_at"))


def _mark(s, d):
    stored, marks = _ledger_and_marks(s, d)
    pending = stored.filter(F.col("fetched_at") >= ledger.cutoff(corpus.as_of(), v.DIGEST_HOURS))
    rows = ledger.mark_notified(pending, marks, corpus.as_of())
    return rows.select("id", _text("notified_at"))


def _backfill(s, d):
    """Every fifth board delivered rows without a score and with empty places."""
    old = scored(s, d).withColumns({
        "match_score": F.when(F.col("source") < "i", F.lit(0)).otherwise(F.col("match_score")),
        "tags": F.array_join("tags", ","),
    })
    return ledger.backfill_scores(old, RULES, corpus.as_of()).groupBy("id").agg(F.max("score").alias("score"))


def _schema_evolve(s, d):
    """A file written before the score column existed and one with it, read as one table."""
    folder = f"{ensure_checkpoint_dir(s)}/evolved-{uuid.uuid4().hex}"
    rows = pinned(scored(s, d).select("ingest_seq", "id", "match_score"))
    rows.filter("match_score < 60").drop("match_score").write.parquet(f"{folder}/batch=1")
    rows.filter("match_score >= 60").write.parquet(f"{folder}/batch=2")
    return ledger.with_match_score_column(s.read.schema(rows.schema).parquet(folder)).select("ingest_seq", "match_score")


def _snapshots(s, d):
    """A snapshot folder per day, pruned to the newest and read again."""
    folder = f"{ensure_checkpoint_dir(s)}/snapshots-{uuid.uuid4().hex}"
    rows = corpus.postings(s, d).select("id", F.date_format("fetched_at", "yyyy-MM-dd").alias("snapshot"))
    rows.write.partitionBy("snapshot").parquet(folder)
    ledger.prune_snapshots(s, folder)
    left = s.read.schema("id STRING, snapshot STRING").parquet(folder)
    return left.groupBy("snapshot").agg(F.count(F.lit(1)).alias("cnt"))


def _funnel(s, d):
    return cascade.funnel(reasoned(s, d, ("ingest_seq", "id", "content_hash", "source")), _stored_keys(s, d), ledger.MAX_BROADCAST_KEYS)


def _with_address(s, d):
    return scored(s, d).withColumn("_a", address(F.col("location"))).select(
        "*", F.col("_a.city").alias("company_city"), F.col("_a.postal").alias("company_postal_code"),
        F.col("_a.country").alias("company_country"))


def _card(s, d):
    return render.render_card(_with_address(s, d).withColumn("id", F.col("ingest_seq")), corpus.as_of()) \
        .withColumnRenamed("id", "ingest_seq").drop("url")


def _ages(s, d):
    t, now = F.col("posted_at"), corpus.as_of()
    f = F.col("fetched_at")
    return corpus.postings(s, d).select(
        "ingest_seq", render.age_short(t, now).alias("short"), render.age_long(f, now).alias("long"),
        render.age_counted(f, now).alias("counted"), render.age_relative(t, now).alias("relative"),
        render.age_relative(f, now).alias("relative_fetched"), render.time_until(now, f).alias("until"))


def _digest_body(s, d):
    order = [F.col("fetched_at").desc(), F.col("id")]
    return render.digest_body(_digest(s, d, columns=("title", "company", "url", "is_ngo", "remote_scope", "location", "source")), render.digest_line(), order, v.DIGEST_LIMIT, "")


def _weekly_body(s, d):
    order = [F.col("match_score").desc(), F.col("fetched_at").desc(), F.col("id")]
    return render.digest_body(ledger.weekly_ngo(scored(s, d), corpus.as_of()), render.weekly_line(corpus.as_of()),
                              order, v.WEEKLY_SHOWN, " NGO jobs this week")


def _events(s, d):
    return corpus.table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _digest_windows(s, d):
    rows = windows.digest_windows(_events(s, d), "ts", "event_type")
    return rows.select(_text("window_start"), _text("window_end"), "event_type", "cnt")


def _weekly_windows(s, d):
    rows = windows.weekly_windows(_events(s, d), "ts", "event_type")
    return rows.select(_text("window_start"), _text("window_end"), "event_type", "cnt")


def _stale_gap(s, d):
    rows = windows.heartbeat_gaps(_events(s, d), "ts", "user_id", "6 hours")
    return rows.select("user_id", _text("silent_from"), _text("silent_to"))


def _dictionary(s: SparkSession) -> DataFrame:
    rows = [(k, w, v.STACK_SYNONYMS.get(k, k), i, k in v.STACK_WHOLE_WORD) for i, (k, w) in enumerate(v.STACK_WEIGHTS.items())]
    return s.createDataFrame(rows, "keyword STRING, weight INT, grp STRING, ord INT, whole_word BOOLEAN")


def _dict_join(s, d):
    texts = enrich.with_rule_texts(corpus.postings(s, d)).select("ingest_seq", enrich.match_text().alias("text"))
    return dictionary.weighted_score(texts, "ingest_seq", "text", _dictionary(s))


def _explain(s, d):
    rows = scored_texts(s, d)
    return rows.select("ingest_seq", F.array_join(
        enrich.matched_keywords(F.col("_match_text"), F.col("is_ngo"), RULES), ", ").alias("keywords"))


def scored_texts(s, d):
    texts = enrich.with_ngo_score(enrich.with_rule_texts(corpus.postings(s, d)), RULES)
    return cascade.evaluate_once(texts.withColumn("_match_text", enrich.match_text()), "_match_text", "is_ngo")


QUERIES = {
    "match_dict_join": _dict_join,
    "match_explain": _explain,
    "filter_unseen": _filter_unseen,
    "ledger_append": _ledger_append,
    "seen_semi": _seen_semi,
    "split_counts": lambda s, d: stats.split_counts(_classed(s, d)),
    "stats_overview": _overview,
    "stats_sources": lambda s, d: stats.by_source(corpus.postings(s, d)),
    "stats_companies": lambda s, d: stats.top_companies(corpus.postings(s, d)),
    "stats_bars": lambda s, d: stats.source_bars(corpus.postings(s, d)),
    "stats_names": lambda s, d: stats.company_names(corpus.postings(s, d)),
    "digest_recent": _digest_recent,
    "digest_day_floor": _digest_day,
    "weekly_ngo": _weekly_ngo,
    "weekly_general": lambda s, d: ledger.weekly_general(_classed(s, d), corpus.as_of()),
    "mark_notified": _mark,
    "backfill_scores": _backfill,
    "schema_evolve": _schema_evolve,
    "snapshot_retention": _snapshots,
    "scan_funnel": _funnel,
    "render_card": _card,
    "render_html": lambda s, d: scored(s, d).select("ingest_seq", render.render_html().alias("message")),
    "age_text": _ages,
    "batch_header": lambda s, d: stats.batch_header(_classed(s, d)),
    "digest_body": _digest_body,
    "weekly_body": _weekly_body,
    "digest_windows": _digest_windows,
    "weekly_windows": _weekly_windows,
    "stale_gap": _stale_gap,
}
