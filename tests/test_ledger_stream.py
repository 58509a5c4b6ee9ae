"""Ledger rules and the scan stream on temporary folders."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from boardsieve import RuleSet, schema
from boardsieve.operators import dedup, ledger, stats
from boardsieve.streaming import scan, windows

RULES = RuleSet(english_only=False)


def as_of():
    return F.to_timestamp(F.lit("2026-03-23 12:00:00"))


def test_unseen_checks_id_and_hash(make):
    stored = make(dict(url="u1", title="A dev"), dict(url="u2", title="B dev"))
    batch = make(dict(url="u1", title="New"), dict(url="u9", title="B dev"), dict(url="u5", title="C"), dict(url="u5", title="D"))
    for limit in (None, 100, 0):
        rows = dedup.filter_unseen(batch, stored, limit)
        assert sorted(r.ingest_seq for r in rows.collect()) == [2, 3]
    assert [r.ingest_seq for r in ledger.append_new(batch, stored).collect()] == [2]


def test_digest_marks_once(spark, make):
    rows = make(*[dict(url=f"u{i}", fetched_at=datetime(2026, 3, 23, 12) - timedelta(hours=i)) for i in range(20)])
    empty = spark.createDataFrame([], schema.NOTIFIED_LOG)
    shown = ledger.digest_recent(rows, empty, as_of())
    assert [r.ingest_seq for r in shown.collect()] == list(range(7))
    marks = ledger.mark_notified(shown, empty, as_of())
    assert ledger.digest_recent(rows, marks, as_of()).count() == 0
    assert ledger.mark_notified(shown, marks, as_of()).count() == 0


def test_backfill_is_idempotent(spark, make):
    rows = make(dict(title="React Developer", url="a"), dict(title="Cook", url="b"), dict(title="React", url="c", match_score=5))
    first = ledger.backfill_scores(rows, RULES, as_of())
    assert [r.score for r in first.collect()] == [60]
    empty = spark.createDataFrame([], schema.NOTIFIED_LOG)
    state = ledger.current_state(rows, empty, first)
    assert ledger.backfill_scores(state, RULES, as_of()).count() == 0
    assert {r.match_score for r in state.collect()} == {60, 0, 5}


def test_stream_equals_batch_and_retry_is_harmless(spark, make, tmp_path):
    rows = make(*[dict(url=f"u{i}", title=f"Engineer {i % 7}", company=f"C{i % 5}", location="Berlin",
                       fetched_at=datetime(2026, 3, 23, 8) + timedelta(minutes=i)) for i in range(40)])
    landed = str(tmp_path / "landed")
    rows.coalesce(1).write.parquet(landed)
    store = scan.Store(str(tmp_path / "store"))
    stream = spark.readStream.schema(rows.schema).parquet(landed)
    scan.scan_stream(stream, store, RULES, str(tmp_path / "ck"), as_of()).awaitTermination()
    ids = lambda: sorted(r.id for r in ledger.read_table(spark, store.ledger, schema.POSTING).collect())
    first = ids()
    other = scan.Store(str(tmp_path / "other"))
    scan.scan_batch(rows, 0, other, RULES, as_of())
    assert first == sorted(r.id for r in ledger.read_table(spark, other.ledger, schema.POSTING).collect())
    scan.scan_batch(rows, 0, store, RULES, as_of())  # retried batch
    assert ids() == first
    scan.scan_batch(rows, 1, store, RULES, as_of())  # same rows again: nothing new
    assert ids() == first
    log = ledger.read_table(spark, store.scan_log, schema.SCAN_LOG).orderBy("scan_id").collect()
    assert [(r.raw, r.accepted, r.new) for r in log] == [(40, len(first), len(first)), (40, len(first), 0)]


def test_gaps_and_staleness(spark):
    start = datetime(2026, 3, 23)
    beats = spark.createDataFrame([("a", start + timedelta(minutes=m)) for m in (0, 5, 30, 200, 201, 500)], "k STRING, at TIMESTAMP")
    gaps = windows.heartbeat_gaps(beats, "at", "k").orderBy("silent_from").collect()
    assert [(g.silent_from, g.silent_to) for g in gaps] == [
        (start + timedelta(minutes=30), start + timedelta(minutes=200)), (start + timedelta(minutes=201), start + timedelta(minutes=500))]
    log = spark.createDataFrame([], schema.SCAN_LOG)
    assert windows.is_stale(log, as_of()).first().stale


def test_overview(make):
    rows = make(dict(is_ngo=True), dict(fetched_at=datetime(2026, 3, 1)))
    out = stats.overview(rows, as_of()).first()
    assert (out.total, out.ngo, out.general, out.new_24h) == (2, 1, 1, 1)
