"""Ledger statistics (A1-A4, A11, A12) and class counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardsieve.functions import fixed_values as v
from boardsieve.operators.ledger import cutoff


def overview(ledger: DataFrame, as_of: Column, day_floor: bool = False) -> DataFrame:
    """All counters of the overview in one pass."""
    recent = F.col("fetched_at") >= cutoff(as_of, v.RECENT_HOURS, day_floor)
    return ledger.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_ngo").alias("ngo"),
        F.count_if(~F.col("is_ngo")).alias("general"),
        F.count_if(recent).alias("new_24h"),
        F.max("fetched_at").alias("last_fetched_at"),
    )


def by_source(ledger: DataFrame) -> DataFrame:
    counts = ledger.groupBy("source").agg(F.count(F.lit(1)).alias("cnt"))
    return counts.orderBy(F.col("cnt").desc(), "source")


def top_companies(ledger: DataFrame, limit: int = 10) -> DataFrame:
    counts = ledger.groupBy("company").agg(F.count(F.lit(1)).alias("cnt"))
    return counts.orderBy(F.col("cnt").desc(), "company").limit(limit)


def shorten(text: Column, limit: int) -> Column:
    """Names over the limit end in three dots and fill it exactly."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def source_bars(ledger: DataFrame) -> DataFrame:
    """Counts per source with an eight-cell relative and a forty-cell absolute bar.

    The maximum is taken over the per-source counts, one row per source.
    """
    counts = by_source(ledger)
    highest = counts.agg(F.max("cnt")).scalar()
    cells = F.greatest(F.lit(1), F.floor(F.col("cnt") * 8 / highest).cast("int"))
    return counts.select(
        "source", "cnt",
        F.repeat(F.lit("█"), cells).alias("bar"),
        F.repeat(F.lit("█"), F.least(F.col("cnt"), F.lit(40)).cast("int")).alias("long_bar"),
    )


def company_names(ledger: DataFrame, limit: int = 10) -> DataFrame:
    """Top companies with names cut for the two display widths."""
    return top_companies(ledger, limit).select(
        "company", "cnt",
        shorten(F.col("company"), 25).alias("name_25"),
        shorten(F.col("company"), 35).alias("name_35"),
    )


def split_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("is_ngo").agg(F.count(F.lit(1)).alias("cnt"))


def batch_header(rows: DataFrame) -> DataFrame:
    """One line that announces a batch: counts per class and the sorted source list."""
    totals = rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_ngo").alias("ngo"),
        F.count_if(~F.col("is_ngo")).alias("general"),
        F.sort_array(F.collect_set("source")).alias("names"),
    )
    found = F.format_string("**%d** new job%s found", "total", F.when(F.col("total") != 1, "s").otherwise(""))
    parts = F.array_compact(F.array(
        found,
        F.when(F.col("ngo") > 0, F.format_string("🟢 %d NGO", "ngo")),
        F.when(F.col("general") > 0, F.format_string("🔵 %d General", "general")),
    ))
    return totals.select(
        "total", "ngo", "general",
        F.array_join(parts, " · ").alias("headline"),
        F.array_join(F.transform("names", lambda s: F.concat(F.lit("`"), s, F.lit("`"))), " ").alias("sources"),
    )
