"""Payload table of routed messages, written and marked by one micro-batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from boardsieve import schema
from boardsieve.functions.pin import pinned
from boardsieve.operators import commits, dedup, ledger, render
from boardsieve.session import configure

PAYLOADS = T.StructType([T.StructField("id", T.StringType()), T.StructField("payload", T.StringType()), T.StructField("made_at", T.TimestampType())])
KEYS = {"route": T.StringType(), "batch": T.LongType()}


def deliver(batch: DataFrame, batch_id: int, root: str, as_of: Column, separate_ngo_channel: bool = True) -> int:
    """Payloads of the batch's postings that no other batch has marked, by route, and their marks; returns how many.

    Both tables are keyed by the batch and committed as a whole, payloads first: a batch that is repeated, after it
    broke off or from the start, takes the place of what it wrote, and postings of an earlier batch add nothing.
    """
    spark = configure(batch.sparkSession)
    marks = ledger.read_table(spark, f"{root}/notified_log", schema.NOTIFIED_LOG).filter(F.col("batch") != batch_id)
    once = dedup.keep_first(batch, ["id"], [F.col("ingest_seq").asc()])
    marked = dedup.seen(once.select("id"), marks.select("id"), ledger.MAX_BROADCAST_KEYS)
    fresh = once.join(dedup.bounded_broadcast(marked, ledger.MAX_BROADCAST_KEYS), "id", "left_anti")
    cards = pinned(render.payload_json(render.render_card(fresh, as_of, separate_ngo_channel)).withColumn("made_at", as_of))
    path = f"{root}/payloads"
    entries, count = commits.write(cards, path, {"route": F.col("route"), "batch": F.lit(batch_id).cast("long")}, ["id"])
    commits.commit(spark, path, commits.current(spark, path), entries, lambda e: int(e["batch"]) == batch_id)
    ledger.append_batch(cards.select("id", F.col("made_at").alias("notified_at")), f"{root}/notified_log", batch_id, "notified_at")
    return count


def payloads(spark, root: str, route: str | None = None) -> DataFrame:
    """The payload table, or the folders of one route."""
    return commits.read(spark, f"{root}/payloads", PAYLOADS, KEYS, wanted=None if route is None else lambda e: e["route"] == route)


def delivery_stream(postings: DataFrame, root: str, checkpoint: str, as_of: Column, every: str | None = None) -> StreamingQuery:
    """Run :func:`deliver` on every micro-batch of scored postings."""
    writer = postings.writeStream.foreachBatch(lambda batch, batch_id: deliver(batch, batch_id, root, as_of) and None).option("checkpointLocation", checkpoint)
    return writer.trigger(**({"processingTime": every} if every else {"availableNow": True})).start()
