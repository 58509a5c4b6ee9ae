"""Keyed de-duplication, per-key caps and set operations.

Every ranking is ``row_number() <= k``.  Spark plans a group limit before the
exchange, so one task sends at most ``k`` rows of a key: a key that holds a
third of all rows crosses the network as a few rows per task.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardsieve.functions.pin import pinned
from boardsieve.operators.normalise import company_key


def recency_order() -> list[Column]:
    """Newest first; the ingest sequence settles ties."""
    return [F.coalesce("posted_at", "fetched_at").desc(), F.col("ingest_seq").asc()]


def keep_first(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], count: int = 1) -> DataFrame:
    """First ``count`` rows of each key in the given order."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= count).drop("_rank")


def dedup_in_scan(accepted: DataFrame) -> DataFrame:
    """One row per content hash among rows that passed the filters."""
    return keep_first(accepted, ["content_hash"], recency_order())


def cap_companies(accepted: DataFrame, limit: int) -> DataFrame:
    """Newest ``limit`` rows per company."""
    return keep_first(accepted, [company_key(F.col("company"))], recency_order(), limit)


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only when a count proves the side small; otherwise a normal join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


#: A key filter has ten bits per key, up to 16 MB; beyond that it refuses less and stays right.
KEY_BITS, MAX_FILTER_BITS = 10, 1 << 27
_HASHES = 4


def key_filter(keys: DataFrame, key: str, count: int) -> Callable[[Column], Column]:
    """A test that each of ``count`` keys passes, and of others one in eighty: a Bloom filter, written once.

    Rows read it as a scalar subquery where they are scanned, so those it refuses need not move to be joined.
    """
    bits = 64 * max(1, -(-min(KEY_BITS * count, MAX_FILTER_BITS) // 64))

    def places(value: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(n), value), F.lit(bits)) for n in range(_HASHES)]

    at = keys.select(F.explode(F.array(*places(F.col(key)))).alias("at"))
    set_bits = at.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 AS int))").alias("bits"))
    every = keys.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = set_bits.unionByName(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    held = pinned(words.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias("words")))

    def passes(value: Column) -> Column:
        met = F.lit(True)
        for place in places(value):
            met = met & (F.getbit(F.get(held.scalar(), F.shiftright(place, 6).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return met

    return passes


def with_keys(rows: DataFrame, keys: DataFrame, key: str, max_broadcast_rows: int) -> DataFrame:
    """Wide rows whose key is among ``keys``, which are written: broadcast if few, else rows a key filter refuses stay where they are."""
    count = keys.count()
    if count <= max_broadcast_rows:
        return rows.join(F.broadcast(keys), key, "left_semi")
    return rows.filter(key_filter(keys, key, count)(F.col(key))).join(keys, key, "left_semi")


def _met(stored: DataFrame, probe: DataFrame, key: str, max_broadcast_rows: int | None) -> DataFrame:
    """Distinct stored keys that the probe asks for.

    A probe proven small visits the stored rows instead of the other way round: it is broadcast
    into a semi join, so they are streamed without a shuffle and only the hits travel.
    """
    if max_broadcast_rows is not None:
        wanted = probe.select(key).distinct()
        hinted = bounded_broadcast(wanted, max_broadcast_rows)
        if hinted is not wanted:
            stored = stored.join(hinted, key, "left_semi")
    # A key may repeat in the ledger without end: it is combined before it travels.
    return stored.select(key).distinct()


def _both_keys(*kept: str) -> list:
    """Columns ``kept`` and one row per key, each key marked with its kind."""
    marked = F.array(F.concat(F.lit("i"), "id"), F.concat(F.lit("h"), "content_hash"))
    return [*kept, F.explode(F.array_compact(marked)).alias("_key")]


#: Up to so many keys of a small batch are listed in the filter of a scan.
LISTED_KEYS = 1000


def listed(stored: DataFrame, probe: DataFrame, keys: Sequence[str], max_keys: int = LISTED_KEYS) -> DataFrame:
    """Stored rows that share one of the keys with the probe, by a filter that lists them, if they are few; else all rows.

    Parquet tests a list against the statistics and Bloom filters of a row group, so a small batch reads
    the row groups that may hold its keys and no others.
    """
    rows = probe.select(*keys).distinct().limit(max_keys + 1).collect()
    if len(rows) > max_keys:
        return stored
    met = F.lit(False)
    for key in keys:
        met = met | F.col(key).isin(sorted({r[key] for r in rows if r[key] is not None}))
    return stored.filter(met)


def askable(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored rows but most of those that share neither key with the batch, which is written: the others don't move."""
    asked = batch.select(*_both_keys())
    passes = key_filter(asked, "_key", asked.count())
    return stored.filter(passes(F.concat(F.lit("i"), "id")) | passes(F.concat(F.lit("h"), "content_hash")))


def filter_unseen(batch: DataFrame, ledger_keys: DataFrame, max_broadcast_rows: int | None = None, max_listed_keys: int = 0) -> DataFrame:
    """Rows of the batch whose id and content hash are both absent from the ledger.

    One pass over the ledger answers for both keys.  Rows are told apart by ``ingest_seq``.
    """
    if max_listed_keys:
        ledger_keys = listed(ledger_keys, batch, ("id", "content_hash"), max_listed_keys)
    asked = batch.select(*_both_keys("ingest_seq"))
    met = _met(ledger_keys.select(*_both_keys()), asked, "_key", max_broadcast_rows)
    known = asked.join(met, "_key", "left_semi").select("ingest_seq").distinct()
    return batch.join(known, "ingest_seq", "left_anti")


def insert_or_ignore(batch: DataFrame, ledger_keys: DataFrame, max_broadcast_rows: int | None = None) -> DataFrame:
    """Rows an append may write: first row per id in the batch, id not in the ledger."""
    first = keep_first(batch, ["id"], [F.col("ingest_seq").asc()])
    return first.join(_met(ledger_keys, batch, "id", max_broadcast_rows), "id", "left_anti")


def seen(ids: DataFrame, ledger_keys: DataFrame, max_broadcast_rows: int | None = None) -> DataFrame:
    """Probe ids that exist in the ledger."""
    return ids.join(_met(ledger_keys, ids, "id", max_broadcast_rows), "id", "left_semi")
