"""Mixing sources to target weights with DataFrame operations only.

Tokens are aggregated per source, each source gets a target from its weight, the repetition
rate is target / size, and a document is emitted ``floor(rate)`` times plus one copy that a
hash of its id grants with a probability equal to the fraction of the rate.

Defined cases: a null text has size 0; null is a source of its own and comes last; a source
of size 0 has target 0; rows that repeat a doc_id make the same draw; an empty table gives an
empty result.  Columns besides the named ones are not looked at, whatever they are called; only those of ``ADDED`` and,
when rows are emitted, ``copy`` are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardsieve.llm.common import WORD, spare, stored

#: A source table is broadcast up to this many rows and bytes of names, and joined by shuffle beyond.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_fraction(value: Column, seed: str) -> Column:
    """A number in [0, 1) fixed by seed and value: the first 52 bits of an MD5 sum."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(value.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sized: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeat: float = 3.0) -> DataFrame:
    """``(source, source_size, target)`` per source of ``(source, size)`` rows.

    Sources in code-point order, null last, weigh ``weights`` in turn and share all sizes.  A
    target stops at ``max_repeat`` times its source's size; what is above is shared again by
    weight.  That ends at one level: with sources ordered by cap / weight, the level is the
    largest (total - caps before) / (weights left), and a target is min(cap, weight * level).
    The windows have no key because the aggregated source table is one row per source.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    capped = (per_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
              .withColumn("ratio", F.col("cap") / F.col("weight")))
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = capped.withColumn("step", rest / left).withColumn("level", F.max("step").over(everything))
    return level.select("source", "source_size", F.least("cap", F.col("weight") * F.col("level")).alias("target"))


def _bounded(targets: DataFrame) -> DataFrame:
    """``targets`` stored; marked for broadcast only if its counted rows and bytes are within the bound."""
    kept = stored(targets, "mix-targets")
    rows, size = kept.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first()
    return F.broadcast(kept) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else kept


ADDED = ("mix_size", "mix_source_size", "mix_target", "mix_copies")


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeat: float = 3.0, seed: str = "mix") -> DataFrame:
    """``docs`` with the columns ``ADDED``.

    Rows and the other columns stay as they are; ``mix_copies`` says how often a row is emitted.
    """
    sized = docs.select(F.col("source"), word_count(F.col("text")).alias("size"))
    docs = docs.drop(*ADDED)
    name = spare(docs.columns, "mix_source")
    targets = _bounded(source_targets(sized, weights, max_repeat)).select(
        F.col("source").alias(name), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    joined = docs.withColumn("mix_size", word_count(F.col("text"))).join(targets, F.col("source").eqNullSafe(F.col(name)), "left").drop(name)
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(F.lit(0.0))
    extra = (hash_fraction(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")
    return joined.withColumn("mix_copies", F.floor(rate) + extra)


def emitted(mixed: DataFrame) -> DataFrame:
    """Each row of ``mix()`` as often as its copies say, without ``ADDED``, numbered by ``copy`` from 1."""
    plain = [c for c in mixed.columns if c not in (*ADDED, "copy")]
    rows = mixed.where(F.col("mix_copies") > 0)
    return rows.select(*[F.col(f"`{c}`") for c in plain], F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))).alias("copy"))


def op9_mixing(spark, folder: str) -> DataFrame:
    """All documents mixed with weights 1, 2, 3."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"),
        (F.col("mix_copies") * F.col("mix_size")).alias("taken"))


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap
  FROM per_source),
steps AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - COALESCE(sum(cap) OVER before, 0)) / (sum(weight) OVER () - COALESCE(sum(weight) OVER before, 0)) AS step
  FROM weighted
  WINDOW before AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(cap, weight * max(step) OVER ()) AS target FROM steps),
rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix:' || COALESCE(doc_id::VARCHAR, 'null')), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS draw
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""
