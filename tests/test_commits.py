"""Commit lists: what breaks off has not happened; compaction, folding and delivery change nothing that is read."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from boardsieve import schema
from boardsieve.operators import commits, dedup, ledger
from boardsieve.sources.landing import to_posting
from boardsieve.streaming import delivery

NOW = datetime(2026, 3, 23, 12)


class Broken(Exception):
    pass


def _rows(make, *numbers, day=0, **fields):
    return make(*[dict(url=f"u{i}", title=f"T{i}", fetched_at=NOW - timedelta(days=day), **fields) for i in numbers])


def _ids(spark, path):
    return sorted(r.url for r in ledger.read_table(spark, path, schema.POSTING).select("url").collect())


def _broken_at(monkeypatch, name):
    def broken(*args, **kwargs):
        raise Broken(name)

    monkeypatch.setattr(commits, name, broken)


@pytest.mark.parametrize("step", ["write", "commit", "_publish"])
def test_an_append_that_breaks_off_has_not_happened(spark, make, tmp_path, monkeypatch, step):
    path = f"{tmp_path}/ledger"
    assert ledger.append_batch(_rows(make, 1, 2), path, 1, "fetched_at") == 2
    with monkeypatch.context() as patch:
        _broken_at(patch, step)
        for numbers, batch in (((3, 4), 2), ((1,), 1)):  # a new batch, and an earlier one again
            with pytest.raises(Broken):
                ledger.append_batch(_rows(make, *numbers), path, batch, "fetched_at")
    assert _ids(spark, path) == ["u1", "u2"]
    ledger.append_batch(_rows(make, 3, 4), path, 2, "fetched_at")
    ledger.append_batch(_rows(make, 1, day=3), path, 1, "fetched_at")
    assert _ids(spark, path) == ["u1", "u3", "u4"]
    commits._publish  # restored
    gone = commits.vacuum(spark, path)
    assert (len(gone) > 0) == (step != "write") and _ids(spark, path) == ["u1", "u3", "u4"]


@pytest.mark.parametrize("step", [None, "write", "_publish"])
def test_compaction_is_one_change(spark, make, tmp_path, monkeypatch, step):
    path = f"{tmp_path}/ledger"
    for batch in range(1, 7):
        ledger.append_batch(_rows(make, 10 * batch, 10 * batch + 1, day=batch % 2), path, batch, "fetched_at")
    before = _ids(spark, path)
    day = str(NOW.date())
    if step:
        with monkeypatch.context() as patch:
            _broken_at(patch, step)
            with pytest.raises(Broken):
                ledger.compact_day(spark, path, schema.POSTING, day, 6)
        assert _ids(spark, path) == before
    ledger.compact_day(spark, path, schema.POSTING, day, 6, target_bytes=4096)
    ledger.compact_day(spark, path, schema.POSTING, day, 6)
    assert _ids(spark, path) == before
    assert sorted((e["day"], int(e["batch"])) for e in commits.current(spark, path).entries if e["day"] == day) == [(day, 4), (day, 6)]
    ledger.append_batch(_rows(make, 7), path, 6, "fetched_at")  # a batch that was not merged can still be repeated
    assert _ids(spark, path) == sorted({*before, "u7"} - {"u60", "u61"})
    old = commits.current(spark, path, 6)
    assert sorted(r.url for r in commits.read(spark, path, schema.POSTING, ledger.KEYS, old).collect()) == before  # a reader of an older version


def test_batches_on_both_sides_of_a_fold_stay_apart(spark, make, tmp_path):
    path = f"{tmp_path}/ledger"
    for batch in range(1, 6):
        ledger.append_batch(_rows(make, batch), path, batch, "fetched_at")
    ledger.compact_day(spark, path, schema.POSTING, str(NOW.date()), 10, apart=[2])
    assert sorted(int(e["batch"]) for e in commits.current(spark, path).entries) == [2, 5]
    assert sorted(r.url for r in ledger.read_table(spark, path, schema.POSTING, after_batch=2).collect()) == ["u3", "u4", "u5"]


def test_a_second_writer_is_refused(spark, make, tmp_path):
    path = f"{tmp_path}/ledger"
    base = commits.current(spark, path)
    ledger.append_batch(_rows(make, 1), path, 1, "fetched_at")
    with pytest.raises(RuntimeError, match="someone else"):
        commits.commit(spark, path, base, [], lambda e: False)
    for batch in range(2, commits.KEPT_VERSIONS + 5):
        commits.commit(spark, path, commits.current(spark, path), [], lambda e: False)
    assert len(commits._numbers(spark, path)) == commits.KEPT_VERSIONS + 1
    assert _ids(spark, path) == ["u1"]


def _log(spark, root, name, batch, rows, kind, time):
    ledger.append_batch(spark.createDataFrame(rows, kind), f"{root}/{name}", batch, time)


def test_state_folds_touched_buckets_only(spark, make, tmp_path, monkeypatch):
    root = str(tmp_path)
    first, second = _rows(make, *range(20), match_score=5), _rows(make, *range(20, 24), match_score=0)
    ids = {r.url: r.id for r in first.unionByName(second).select("url", "id").collect()}
    ledger.append_batch(to_posting(first), f"{root}/ledger", 1, "fetched_at")
    ledger.fold_state(spark, root, 2, buckets=8)
    whole = commits.current(spark, f"{root}/state")
    _log(spark, root, "score_log", 2, [(ids["u1"], 50, NOW), (ids["u1"], 0, NOW + timedelta(hours=1)), (ids["u2"], 60, NOW - timedelta(days=1))], schema.SCORE_LOG, "scored_at")
    _log(spark, root, "notified_log", 2, [(ids["u3"], NOW), (ids["u3"], NOW)], schema.NOTIFIED_LOG, "notified_at")
    ledger.append_batch(to_posting(second), f"{root}/ledger", 2, "fetched_at")
    _log(spark, root, "score_log", 3, [(ids["u2"], 7, NOW), (ids["u20"], 9, NOW)], schema.SCORE_LOG, "scored_at")

    def state():
        rows = ledger.read_state(spark, root).collect()
        assert len(rows) == 24
        return {r.url: (r.match_score, r.notified) for r in rows}

    expected = {f"u{i}": (5 if i < 20 else 0, False) for i in range(24)} | {"u1": (50, False), "u2": (7, False), "u3": (5, True), "u20": (9, False)}
    assert state() == expected
    with monkeypatch.context() as patch:
        _broken_at(patch, "_publish")
        with pytest.raises(Broken):
            ledger.fold_state(spark, root, 3, buckets=8)
    assert state() == expected
    ledger.fold_state(spark, root, 3, buckets=8)
    assert state() == expected
    folded = commits.current(spark, f"{root}/state")
    assert folded.notes == {"ledger": 2, "notified_log": 2, "score_log": 2}
    ledger.fold_state(spark, root, 4, buckets=8)
    assert state() == expected
    last = commits.current(spark, f"{root}/state")
    same = lambda a, b: {e["bucket"] for e in a.entries if e in b.entries}
    assert same(folded, last) and len(same(folded, last)) >= len(folded.entries) - 2 and whole.entries
    plan = ledger.read_state(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_delivery_is_idempotent(spark, make, tmp_path, monkeypatch):
    root, at = str(tmp_path), F.lit(NOW)
    first = _rows(make, 1, 2, 2, is_ngo=True, tags=["a"]).unionByName(_rows(make, 3)).withColumn("scope", F.lit("eu"))
    read = lambda: sorted((r.route, r.batch, r.id) for r in delivery.payloads(spark, root).collect())
    marks = lambda: sorted(r.id for r in ledger.read_table(spark, f"{root}/notified_log", schema.NOTIFIED_LOG).collect())
    with monkeypatch.context() as patch:
        patch.setattr(ledger, "append_batch", lambda *a: (_ for _ in ()).throw(Broken()))
        with pytest.raises(Broken):
            delivery.deliver(first, 1, root, at)  # broke off between payloads and marks
    assert delivery.deliver(first, 1, root, at) == 3
    once = read()
    assert [(r, b) for r, b, _ in once] == [("general", 1), ("ngo", 1), ("ngo", 1)] and len(marks()) == 3
    assert delivery.deliver(first, 1, root, at) == 3 and read() == once and len(marks()) == 3
    assert delivery.deliver(first, 2, root, at) == 0 and read() == once and len(marks()) == 3
    assert {r.route for r in delivery.payloads(spark, root, "ngo").collect()} == {"ngo"}


def _rows_scanned(frame):
    frame.collect()
    nodes, total = [frame._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
            continue
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            total += node.metrics().apply("numOutputRows").value()
        nodes += [node.children().apply(k) for k in range(node.children().size())]
    return total


def test_few_keys_skip_row_groups(spark, make, tmp_path):
    path = f"{tmp_path}/ledger"
    for batch in (1, 2, 3):
        ledger.append_batch(_rows(make, *range(100 * batch, 100 * batch + 100)).coalesce(1), path, batch, "fetched_at")
    stored = ledger.read_table(spark, path, schema.POSTING).select("id", "content_hash")
    absent, one = _rows(make, *range(900, 930)), _rows(make, 205, *range(901, 930))
    assert _rows_scanned(dedup.listed(stored, absent, ("id", "content_hash"))) == 0  # within the range of all ids
    assert _rows_scanned(dedup.listed(stored, one, ("id", "content_hash"))) == 100
    assert _rows_scanned(dedup.listed(stored, one, ("id", "content_hash"), 10)) == 300
    for limit in (0, 10, 1000):
        found = dedup.filter_unseen(one, stored, 100, limit)
        assert sorted(r.url for r in found.collect()) == sorted(f"u{i}" for i in range(901, 930))
