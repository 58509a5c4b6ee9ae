"""Append-only ledger on Parquet: append, marks, digests, backfill, snapshots.

Parquet has no row update, so a change is a row in a side log and the current
state is the ledger joined with the latest log entries.  Every write is keyed by
day and batch and becomes visible by a commit list, in which it replaces an earlier try of
its batch; look-back windows read the folders of their days only.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F, types as T

from boardsieve.functions import fixed_values as v
from boardsieve.operators import commits, dedup, enrich
from boardsieve.operators.commits import folder as _folder
from boardsieve.operators.normalise import split_tags
from boardsieve.schema import NOTIFIED_LOG, POSTING, SCORE_LOG
from boardsieve.settings import RuleSet


MAX_BROADCAST_KEYS = 1_000_000
_UNDATED = "1970-01-01"
KEYS = {"day": T.DateType(), "batch": T.LongType()}
#: Size a compacted file is meant to have.
TARGET_BYTES = 128 << 20
#: Keys that a small batch looks up by; their filters let it skip row groups.
LOOKED_UP = ("id", "content_hash")


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the sub-folders that partition a table: as many as snapshots, not rows."""
    folder, store = _folder(spark, path)
    if not store.exists(folder):
        return []
    return sorted(s.getPath().getName() for s in store.listStatus(folder) if s.isDirectory() and "=" in s.getPath().getName())


def read_table(spark: SparkSession, path: str, schema: T.StructType, after_batch: int | None = None) -> DataFrame:
    """A table with its ``day`` and ``batch`` columns, or its batches after one; a missing folder is an empty table."""
    newer = None if after_batch is None else lambda e: int(e["batch"]) > after_batch
    return commits.read(spark, path, schema, KEYS, wanted=newer)


def append_batch(rows: DataFrame, path: str, batch_id: int, time: str) -> int:
    """Write one batch under the days of its ``time`` column and commit it; the same batch again replaces it.

    Returns the number of rows, observed while they are written.
    """
    spark = rows.sparkSession
    day = F.coalesce(F.to_date(time), F.to_date(F.lit(_UNDATED)))
    filters = [c for c in LOOKED_UP if c in rows.columns]
    entries, count = commits.write(rows, path, {"day": day, "batch": F.lit(batch_id).cast("long")}, filters)
    commits.commit(spark, path, commits.current(spark, path), entries, lambda e: int(e["batch"]) == batch_id)
    return count


def compact_day(spark: SparkSession, path: str, schema: T.StructType, day: str, before_batch: int, target_bytes: int = TARGET_BYTES,
                apart: Collection[int] = ()) -> None:
    """Merge the batches of a day that are older than ``before_batch`` into files of about ``target_bytes``, by many tasks.

    Batches from ``before_batch`` on may still be repeated and stay as they are.  Merged rows belong to the newest of their
    batches; batches up to and after one of ``apart``, such as the last one folded into the state, are not merged with each
    other.  The merged folder takes the place of the others in one commit.
    """
    base = commits.current(spark, path)
    bounds = sorted(apart)
    section = lambda e: sum(int(e["batch"]) > b for b in bounds)
    old = [e for e in base.entries if e["day"] == day and int(e["batch"]) < before_batch]
    for number in sorted({section(e) for e in old}):
        merged = [e for e in old if section(e) == number]
        if len(merged) < 2:
            continue
        files = max(1, -(-commits.size(spark, path, merged) // target_bytes))
        rows = commits.read(spark, path, schema, KEYS, base, lambda e: e in merged).drop(*KEYS)
        newest = max(int(e["batch"]) for e in merged)
        keys = {"day": F.lit(day).cast("date"), "batch": F.lit(newest).cast("long")}
        entries, _ = commits.write(rows.repartition(files), path, keys, [c for c in LOOKED_UP if c in rows.columns])
        base = commits.commit(spark, path, base, entries, lambda e: e in merged)


def within(table: DataFrame, start: Column) -> DataFrame:
    """A table's rows from the day of ``start`` on; the filter is on the folder name where there is one."""
    return table.filter(F.col("day") >= F.to_date(start)) if "day" in table.columns else table


def cutoff(as_of: Column, hours: int, day_floor: bool = False) -> Column:
    """Start of a look-back window; ``day_floor`` moves it to midnight of its day."""
    start = as_of - F.make_dt_interval(F.lit(0), F.lit(hours))
    return F.date_trunc("day", start) if day_floor else start


STATE = T.StructType([*POSTING.fields, T.StructField("notified", T.BooleanType()), T.StructField("scored_at", T.TimestampType())])
_BUCKET = {"bucket": T.IntegerType()}


def _state_sources(spark: SparkSession, root: str, notes: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ledger rows, marks and scores of the batches after those already folded."""
    after = lambda name: notes.get(name, -1)
    rows = read_table(spark, f"{root}/ledger", POSTING, after("ledger"))
    marks = read_table(spark, f"{root}/notified_log", NOTIFIED_LOG, after("notified_log"))
    return rows, marks, read_table(spark, f"{root}/score_log", SCORE_LOG, after("score_log"))


def _with_logs(rows: DataFrame, marks: DataFrame, scores: DataFrame) -> DataFrame:
    """Marks and the latest non-zero scores applied to state rows.  Logs that a count proves small are broadcast: the rows don't move."""
    marks = dedup.bounded_broadcast(marks.select("id", F.lit(True).alias("_marked")).distinct(), MAX_BROADCAST_KEYS)
    latest = scores.filter("score > 0").groupBy("id").agg(F.max(F.struct("scored_at", "score")).alias("_new"))
    latest = dedup.bounded_broadcast(latest, MAX_BROADCAST_KEYS)
    newer = F.col("_new").isNotNull() & (F.col("scored_at").isNull() | (F.col("_new.scored_at") >= F.col("scored_at")))
    return rows.join(marks, "id", "left").join(latest, "id", "left").withColumns({
        "match_score": F.when(newer, F.col("_new.score")).otherwise(F.coalesce("match_score", F.lit(0))),
        "scored_at": F.when(newer, F.col("_new.scored_at")).otherwise(F.col("scored_at")),
        "notified": F.coalesce("_marked", "notified", F.lit(False)),
    }).drop("_marked", "_new")


def _as_state(rows: DataFrame) -> DataFrame:
    return rows.select(*POSTING.names, F.lit(None).cast("boolean").alias("notified"), F.lit(None).cast("timestamp").alias("scored_at"))


def read_state(spark: SparkSession, root: str) -> DataFrame:
    """The ledger under ``root`` with marks and scores applied: the folded state and what the logs hold since."""
    version = commits.current(spark, f"{root}/state")
    rows, marks, scores = _state_sources(spark, root, version.notes)
    base = commits.read(spark, f"{root}/state", STATE, _BUCKET, version).drop("bucket")
    return _with_logs(base.unionByName(_as_state(rows)), marks, scores)


def fold_state(spark: SparkSession, root: str, before_batch: int, buckets: int = 64, target_bytes: int = TARGET_BYTES) -> None:
    """Fold the closed batches of ledger and logs, those before ``before_batch``, into the state.

    The state lies in buckets of ids.  Only buckets that a new row, mark or score falls into are written again; the commit
    that puts them in the place of the old ones also notes up to which batch the logs are folded.
    A mark or score comes with its row's batch or later; one that is folded before there is a row is dropped.
    """
    path = f"{root}/state"
    version = commits.current(spark, path)
    closed = F.col("batch") < before_batch
    rows, marks, scores = (x.filter(closed) for x in _state_sources(spark, root, version.notes))
    bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")
    ids = rows.select("id").unionByName(marks.select("id")).unionByName(scores.select("id"))
    touched = {r[0] for r in ids.select(bucket.alias("bucket")).distinct().collect()}  # at most as many as buckets
    notes = {}
    for name, log in (("ledger", rows), ("notified_log", marks), ("score_log", scores)):
        notes[name] = log.agg(F.max("batch")).first()[0] or version.notes.get(name, -1)
    in_touched = lambda e: int(e["bucket"]) in touched
    base = commits.read(spark, path, STATE, _BUCKET, version, in_touched).drop("bucket")
    old = [e for e in version.entries if in_touched(e)]
    spread = max(1, -(-commits.size(spark, path, old) // (max(len(touched), 1) * target_bytes)))
    applied = _with_logs(base.unionByName(_as_state(rows)), marks, scores).withColumn("_bucket", bucket)
    placed = applied.repartition(max(1, len(touched) * spread), "_bucket", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(spread)))
    entries, _ = commits.write(placed.drop("_bucket"), path, {"bucket": bucket}, ["id"])
    commits.commit(spark, path, version, entries, in_touched, notes)


def current_state(ledger: DataFrame, notified_log: DataFrame, score_log: DataFrame) -> DataFrame:
    """Ledger with ``notified`` and the latest non-zero score applied."""
    latest = score_log.filter("score > 0").groupBy("id").agg(F.max_by("score", "scored_at").alias("_score"))
    notified = notified_log.select("id", F.lit(True).alias("_notified")).distinct()
    joined = ledger.join(latest, "id", "left").join(notified, "id", "left")
    return joined.withColumns({
        "match_score": F.coalesce("_score", "match_score", F.lit(0)),
        "notified": F.coalesce("_notified", F.lit(False)),
    }).drop("_score", "_notified")


def digest_recent(ledger: DataFrame, notified_log: DataFrame, as_of: Column, hours: int = v.DIGEST_HOURS,
                  limit: int = v.DIGEST_LIMIT, day_floor: bool = False) -> DataFrame:
    """Newest rows of the window that no digest has shown yet.

    A mark can't be older than the row it marks, so only marks of the window are read.
    """
    start = cutoff(as_of, hours, day_floor)
    recent = within(ledger, start).filter(F.col("fetched_at") >= start)
    marks = within(notified_log, start).filter(F.col("notified_at") >= start)
    pending = recent.join(marks.select("id").distinct(), "id", "left_anti")
    return pending.orderBy(F.col("fetched_at").desc(), "id").limit(limit)


def weekly_ngo(ledger: DataFrame, as_of: Column, days: int = v.WEEKLY_DAYS,
               limit: int = v.WEEKLY_LIMIT, day_floor: bool = False) -> DataFrame:
    """Best non-profit rows of the week."""
    start = cutoff(as_of, days * 24, day_floor)
    week = within(ledger, start).filter(F.col("is_ngo") & (F.col("fetched_at") > start))
    return week.orderBy(F.col("match_score").desc(), F.col("fetched_at").desc(), "id").limit(limit)


def weekly_general(ledger: DataFrame, as_of: Column, days: int = v.WEEKLY_DAYS, day_floor: bool = False) -> DataFrame:
    """Number of other rows of the week."""
    start = cutoff(as_of, days * 24, day_floor)
    week = within(ledger, start).filter(~F.col("is_ngo") & (F.col("fetched_at") > start))
    return week.agg(F.count(F.lit(1)).alias("general"))


def mark_notified(shown: DataFrame, notified_log: DataFrame, at: Column, max_broadcast_rows: int | None = MAX_BROADCAST_KEYS) -> DataFrame:
    """Log rows to append; an id that is already marked is not marked twice."""
    ids = shown.select("id").distinct()
    marked = dedup.seen(ids, notified_log, max_broadcast_rows)
    fresh = ids.join(marked, "id", "left_anti")
    return fresh.select("id", at.alias("notified_at"))


def backfill_scores(ledger: DataFrame, rules: RuleSet, at: Column) -> DataFrame:
    """Score-log rows for ledger rows whose score is missing or zero and computes above zero."""
    pending = ledger.filter(F.coalesce("match_score", F.lit(0)) == 0)
    if dict(ledger.dtypes)["tags"] == "string":
        pending = pending.withColumn("tags", split_tags(F.col("tags")))
    pending = pending.withColumns({
        "location": F.coalesce(F.nullif("location", F.lit("")), F.lit("Remote")),
        "source": F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown")),
    })
    scored = enrich.with_match_score(enrich.with_rule_texts(pending), rules)
    return scored.select("id", F.col("match_score").alias("score"), at.alias("scored_at")).filter("score > 0")


def with_match_score_column(df: DataFrame) -> DataFrame:
    """Rows written before the score column existed read as score 0."""
    if "match_score" not in df.columns:
        df = df.withColumn("match_score", F.lit(None).cast("int"))
    return df.withColumn("match_score", F.coalesce("match_score", F.lit(0)))


def write_snapshot(ledger: DataFrame, path: str, label: str, keep: int = v.SNAPSHOTS_KEPT) -> list[str]:
    """Copy the ledger under a label that sorts by time, prune to the newest ``keep``, return their labels.

    The copy is complete before anything is pruned; the same label again replaces its copy.
    """
    ledger.write.mode("overwrite").parquet(f"{path}/snapshot={label}")
    return prune_snapshots(ledger.sparkSession, path, keep)


def prune_snapshots(spark: SparkSession, path: str, keep: int = v.SNAPSHOTS_KEPT) -> list[str]:
    """Delete all but the newest ``keep`` snapshot folders; returns the labels left."""
    names = folders(spark, path)
    for name in names[:-keep] if keep else names:
        old, store = _folder(spark, f"{path}/{name}")
        store.delete(old, True)
    return [name.split("=", 1)[1] for name in (names[-keep:] if keep else [])]


def read_snapshot(spark: SparkSession, path: str, label: str | None = None) -> DataFrame:
    """A snapshot by label, by default the newest."""
    name = f"snapshot={label}" if label else folders(spark, path)[-1]
    return spark.read.parquet(f"{path}/{name}")


def kept_snapshots(snapshots: DataFrame, column: str = "snapshot", keep: int = v.SNAPSHOTS_KEPT) -> DataFrame:
    """The newest ``keep`` snapshot labels.

    Labels are reduced to distinct values before they are ranked, so the single
    ranking task sees one row per snapshot, never the rows in it.
    """
    labels = snapshots.select(column).distinct()
    return labels.orderBy(F.col(column).desc()).limit(keep)


def retain_snapshots(snapshots: DataFrame, column: str = "snapshot", keep: int = v.SNAPSHOTS_KEPT) -> DataFrame:
    """Rows of the newest snapshots."""
    return snapshots.join(F.broadcast(kept_snapshots(snapshots, column, keep)), column, "left_semi")


def append_new(batch: DataFrame, ledger: DataFrame, max_broadcast_rows: int | None = None, max_listed_keys: int = 0) -> DataFrame:
    """What one scan adds: unseen by id and hash, then the first row per id.

    Ids of the ledger are gone after the first step, so the second looks at the batch only.
    """
    unseen = dedup.filter_unseen(batch, ledger.select("id", "content_hash"), max_broadcast_rows, max_listed_keys)
    return dedup.keep_first(unseen, ["id"], [F.col("ingest_seq").asc()])
