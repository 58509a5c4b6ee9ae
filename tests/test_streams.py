"""Streams over landed files: expiring dedup, silence alerts, weekly counts, corrupt lines; landed table by board."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from boardsieve import RuleSet, schema
from boardsieve.operators import ledger
from boardsieve.plans.stream_queries import in_steps
from boardsieve.sources import boards, landing
from boardsieve.streaming import scan, windows
from boardsieve.streaming.alerts import rocksdb_state, silence_alerts

PLAIN = RuleSet(english_only=False)
START = datetime(2026, 3, 1)


def as_of():
    return F.to_timestamp(F.lit("2026-03-23 12:00:00"))


def _drain(frame, path, name):
    query = frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{path}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return frame.sparkSession.table(name).collect(), query


def test_dedup_state_expires(spark, tmp_path):
    days = [(0, "a"), (0, "b"), (3, "a"), (16, "b"), (24, "a"), (36, "a"), (36, "c")]
    rows = spark.createDataFrame([(k, START + timedelta(days=d)) for d, k in days], "k STRING, at TIMESTAMP")
    parts = [rows.filter(F.col("at") == F.lit(START + timedelta(days=d))) for d in (0, 3, 16, 24, 36)]
    files = in_steps(parts, str(tmp_path / "rows"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(str(tmp_path / "rows"))
    found, query = _drain(scan.stream_dedup(stream, ["k"], "at", "7 days"), tmp_path, "expiring")
    # State of day 0 is dropped by the batch of day 24, since day 16 moved the watermark past it; so a returns on day 36 only.
    assert sorted(((r.at - START).days, r.k) for r in found) == [(0, "a"), (0, "b"), (36, "a"), (36, "c")]
    states = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    assert sum(s["numRowsRemoved"] for s in states) >= 2 and states[-1]["numRowsTotal"] <= 2


BEATS = [("a", 0), ("a", 1), ("a", 30), ("b", 2), ("a", 31), ("b", 40), ("c", 5), ("a", 90), ("c", 89), ("b", 91), ("c", 91.5)]


def _gaps(beats, limit, end):
    found = []
    for key in {k for k, _ in beats}:
        times = sorted(t for k, t in beats if k == key)
        found += [(key, a) for a, b in zip(times, [*times[1:], end]) if b - a > limit]
    return sorted(found)


@pytest.mark.parametrize("cuts", [(), (10, 35), (1, 2, 6, 33, 50, 90)])
def test_alerts_are_the_same_however_beats_are_cut(spark, tmp_path, cuts):
    at = lambda hours: START + timedelta(hours=hours)
    rows = spark.createDataFrame([(k, at(h)) for k, h in BEATS], "k STRING, at TIMESTAMP")
    edges = [-1, *cuts, 1000]
    parts = [rows.filter((F.col("at") > F.lit(at(low))) & (F.col("at") <= F.lit(at(high)))) for low, high in zip(edges, edges[1:])]
    files = in_steps([p for p in parts if p.count()], str(tmp_path / "beats"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(str(tmp_path / "beats"))
    with rocksdb_state(spark):
        found, _ = _drain(silence_alerts(stream, "k", "at", 24, watermark="1 hour"), tmp_path, f"alerts{len(cuts)}")
    assert sorted((r.k, (r.silent_from - START).total_seconds() / 3600) for r in found) == _gaps(BEATS, 24, 90.5)


def test_total_silence_raises_an_alert(spark, tmp_path):
    """One old beat and an older one in the scan log, then nothing at all."""
    beats = spark.createDataFrame([("a", START)], "k STRING, at TIMESTAMP")
    beats.coalesce(1).write.parquet(f"{tmp_path}/beats")
    known = spark.createDataFrame([("z", START - timedelta(days=1)), ("z", START - timedelta(days=9))], "k STRING, at TIMESTAMP")
    stream = spark.readStream.schema(beats.schema).parquet(f"{tmp_path}/beats")
    with rocksdb_state(spark):
        alerts = silence_alerts(stream, "k", "at", 2, known)
        query = alerts.writeStream.format("memory").queryName("silence").outputMode("append").option(
            "checkpointLocation", f"{tmp_path}/state").trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(120):
            if spark.table("silence").count() >= 2 or not query.isActive:
                break
            query.awaitTermination(0.5)
        assert sorted((r.k, r.silent_from) for r in spark.table("silence").collect()) == [("a", START), ("z", START - timedelta(days=1))]
    finally:
        query.stop()


def test_weekly_stream_chains_daily_counts(spark, tmp_path):
    rows = spark.createDataFrame([("a" if i % 3 else "b", START + timedelta(hours=7 * i)) for i in range(60)], "k STRING, at TIMESTAMP")
    rows.coalesce(1).write.parquet(f"{tmp_path}/rows")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/rows")
    found, query = _drain(windows.weekly_windows(stream, "at", "k", "1 hour"), tmp_path, "weekly")
    end = START + timedelta(hours=7 * 59 - 1)
    batch = windows.weekly_windows(rows, "at", "k").filter(F.col("window_end") <= F.lit(end))
    assert sorted(map(tuple, found)) == sorted(map(tuple, batch.collect()))
    plan = query._jsq.explainInternal(False)
    assert plan.index("Expand") < plan.index("EventTimeWatermark")  # windows are made of daily counts, above the first aggregate


def _remotive(*titles):
    return json.dumps({"jobs": [{"title": t, "company_name": f"C{t}", "candidate_required_location": "Worldwide", "url": f"https://e.org/{t}"} for t in titles]})


def _responses(spark, *responses):
    rows = [(source, None, 1, seq, datetime(2026, 3, 23, 12), status, body) for source, seq, status, body in responses]
    return spark.createDataFrame(rows, schema.LANDED)


def test_landed_files_with_corrupt_lines(spark, tmp_path):
    first = _responses(spark, ("remotive", 0, 200, _remotive("Software Engineer", "Frontend Developer")), ("devex", 0, 500, ""))
    second = _responses(spark, ("remotive", 1, 200, _remotive("Backend Developer", "Software Engineer")), ("devex", 1, 200, "{"))
    path = f"{tmp_path}/landed"
    for part in (first, second, first):
        landing.write_landed(part.coalesce(1), path, "json")
    (tmp_path / "landed" / "source=remotive" / "broken.json").write_text('{"request_seq": 7, "status"\nnot json\n')
    store = scan.Store(f"{tmp_path}/store")
    scan.landed_stream(landing.landed_files(spark, path, 2), store, PLAIN, f"{tmp_path}/state", as_of()).awaitTermination()
    stored = ledger.read_table(spark, store.ledger, schema.POSTING)
    assert sorted(r.title for r in stored.collect()) == ["Backend Developer", "Frontend Developer", "Software Engineer"]
    assert stored.select("batch").distinct().count() >= 2
    rejects = ledger.read_table(spark, store.reject_log, schema.REJECT_LOG).groupBy("source", "reason").count().collect()
    assert {(r.source, r.reason): r["count"] for r in rejects} == {("remotive", "corrupt"): 2, ("devex", "http_error"): 2, ("devex", "malformed"): 1}


def test_one_board_reads_one_folder(spark, tmp_path):
    path = f"{tmp_path}/landed"
    landing.write_landed(_responses(spark, ("remotive", 0, 200, _remotive("a")), ("devex", 0, 200, "[]"), ("idealist", 0, 200, "{}")).coalesce(1), path)
    landed = landing.read_landed(spark, path)
    one = landing.usable(landed, "remotive")
    assert one.count() == 1 and one.inputFiles() and "PartitionFilters: [isnotnull(source" in one._jdf.queryExecution().executedPlan().toString()
    assert set(boards.landed_boards(landed)) == {"remotive", "devex", "idealist"}
    wanted = spark.createDataFrame([("devex", 1), ("none", 2), ("devex", 3)], "source STRING, rank INT").filter("rank < 3")
    some = landing.of_boards(landed, wanted)
    assert [r.source for r in some.collect()] == ["devex"]
    assert "dynamicpruning" in some._jdf.queryExecution().executedPlan().toString().lower()


def test_scan_of_nothing(spark, tmp_path):
    store = scan.Store(f"{tmp_path}/store")
    scan.scan_landed(_responses(spark, ("devex", 0, 500, "")).limit(0), 0, store, PLAIN, as_of())
    scan.scan_landed(_responses(spark, ("devex", 0, 500, "")), 1, store, PLAIN, as_of())
    log = ledger.read_table(spark, store.scan_log, schema.SCAN_LOG).orderBy("scan_id").collect()
    assert [(r.raw, r.accepted, r.new, r.started_at) for r in log] == [(0, 0, 0, None), (0, 0, 0, None)]
    assert ledger.read_table(spark, store.ledger, schema.POSTING).count() == 0
