"""The scan cycle as a stream and cross-batch dedup."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from boardsieve import schema
from boardsieve.functions.pin import pinned_wide
from boardsieve.operators import cascade, dedup, ledger
from boardsieve.session import configure
from boardsieve.settings import RuleSet
from boardsieve.sources import boards, landing
from boardsieve.sources.landing import to_posting

@dataclass(frozen=True)
class Store:
    """Folders of the ledger and its logs under one root."""

    root: str

    @property
    def ledger(self) -> str:
        return f"{self.root}/ledger"

    @property
    def notified_log(self) -> str:
        return f"{self.root}/notified_log"

    @property
    def score_log(self) -> str:
        return f"{self.root}/score_log"

    @property
    def scan_log(self) -> str:
        return f"{self.root}/scan_log"

    @property
    def reject_log(self) -> str:
        return f"{self.root}/reject_log"


def scan_batch(batch: DataFrame, batch_id: int, store: Store, rules: RuleSet, as_of: Column | None = None,
               max_age_days: int | None = None, profile: DataFrame | None = None) -> None:
    """One scan: filter, anti join with the ledger, append, log.

    Repeating a batch id is harmless: the ledger is read without that batch and
    the commit replaces it, so a retried micro-batch gives the same ledger.
    A null or repeated ``ingest_seq`` is an error.  What the log counts is observed in the passes
    that write, and the check of the sequences gives the rest.
    """
    spark = configure(batch.sparkSession)
    facts = cascade.check_unique(batch)
    if as_of is None:
        as_of = F.lit(facts.completed_at)
    stored = ledger.read_table(spark, store.ledger, schema.POSTING).filter(F.col("batch") != batch_id)
    accepted = cascade.run_cascade(batch, rules, as_of, max_age_days, profile).drop("remote_scope")
    passed = Observation()
    accepted = pinned_wide(accepted.withColumnRenamed("scope", "remote_scope").observe(passed, F.count(F.lit(1)).alias("rows")))
    new = to_posting(ledger.append_new(accepted, stored, ledger.MAX_BROADCAST_KEYS, dedup.LISTED_KEYS))
    added = ledger.append_batch(new, store.ledger, batch_id, "fetched_at")
    row = (batch_id, facts.started_at, facts.completed_at, facts.raw, passed.get["rows"], added)
    ledger.append_batch(spark.createDataFrame([row], schema.SCAN_LOG), store.scan_log, batch_id, "completed_at")


def scan_landed(landed: DataFrame, batch_id: int, store: Store, rules: RuleSet, as_of: Column | None = None,
                max_age_days: int | None = None, profile: DataFrame | None = None, board: str | None = None) -> None:
    """One scan from responses: gate, adapters, union, cascade, ledger.

    Only boards that the batch has responses of are planned.  Bodies are parsed once; the items are kept in the shared folder while the scan reads them.
    Responses no adapter may read, bodies and items that can't be read and items without a required
    field go to the reject log.
    """
    spark = configure(landed.sparkSession)
    items = landing.resequenced(pinned_wide(boards.board_items(landed, board, boards.landed_boards(landed)).drop("ingest_seq")))
    postings = landing.kept(items).withColumn("ingest_seq", landing.batch_seq(F.col("ingest_seq"), batch_id))
    scan_batch(postings, batch_id, store, rules, as_of, max_age_days, profile)
    log_rejects(landed, items, batch_id, store)


def log_rejects(landed: DataFrame, items: DataFrame, batch_id: int, store: Store) -> None:
    """Append unusable responses and refused items of a batch to the reject log: board, response, place, reason, field."""
    rejected = landing.rejected_responses(landed).unionByName(landing.refused(items), allowMissingColumns=True)
    ledger.append_batch(rejected.withColumn("logged_at", F.current_timestamp()), store.reject_log, batch_id, "logged_at")


def landed_stream(landed: DataFrame, store: Store, rules: RuleSet, checkpoint: str, as_of: Column | None = None,
                  max_age_days: int | None = None, profile: DataFrame | None = None, every: str | None = None) -> StreamingQuery:
    """Run :func:`scan_landed` on every micro-batch of responses."""
    def run(batch: DataFrame, batch_id: int) -> None:
        scan_landed(batch, batch_id, store, rules, as_of, max_age_days, profile)

    writer = landed.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def scan_stream(postings: DataFrame, store: Store, rules: RuleSet, checkpoint: str, as_of: Column | None = None,
                max_age_days: int | None = None, profile: DataFrame | None = None,
                every: str | None = None) -> StreamingQuery:
    """Run :func:`scan_batch` on every micro-batch; once over what is there, or ``every`` interval."""
    def run(batch: DataFrame, batch_id: int) -> None:
        scan_batch(batch, batch_id, store, rules, as_of, max_age_days, profile)

    writer = postings.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def stream_dedup(postings: DataFrame, keys: list[str], time: str = "fetched_at", keep_for: str = "14 days") -> DataFrame:
    """First row per key within the watermark; state is dropped after ``keep_for``.

    Beyond that bound only the ledger anti join of the scan is exact.
    """
    return postings.withWatermark(time, keep_for).dropDuplicatesWithinWatermark(keys)
