"""Windowed counts and staleness (T3-T6), in the same form for batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardsieve.functions import fixed_values as v


def window_counts(df: DataFrame, time: str, key: str, size: str, slide: str | None = None,
                  watermark: str | None = None) -> DataFrame:
    """Rows per time window and key; with a watermark also for ``readStream`` input.

    Counting combines map-side, so a hot key costs one partial row per task and window.
    """
    if watermark is not None and df.isStreaming:
        df = df.withWatermark(time, watermark)
    window = F.window(time, size, slide) if slide else F.window(time, size)
    counts = df.groupBy(window.alias("w"), key).agg(F.count(F.lit(1)).alias("cnt"))
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "cnt")


def digest_windows(df: DataFrame, time: str = "fetched_at", key: str = "source", watermark: str | None = None) -> DataFrame:
    """Tumbling digest periods."""
    return window_counts(df, time, key, f"{v.DIGEST_HOURS} hours", watermark=watermark)


def weekly_windows(df: DataFrame, time: str = "fetched_at", key: str = "is_ngo", watermark: str | None = None) -> DataFrame:
    """Seven-day look-back, advanced daily.

    Rows are counted by day first, so that daily counts are repeated for the windows they
    lie in and never rows.  On a stream these are two stateful aggregates in a chain: a day is
    handed on once the watermark has passed it, so each keeps only what is still open.
    """
    if df.isStreaming:
        if watermark is not None:
            df = df.withWatermark(time, watermark)
        days = df.groupBy(F.window(time, "1 day").alias("day"), key).agg(F.count(F.lit(1)).alias("cnt"))
        weeks = days.groupBy(F.window(F.window_time("day"), f"{v.WEEKLY_DAYS} days", "1 day").alias("w"), key).agg(F.sum("cnt").alias("cnt"))
        return weeks.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "cnt")
    daily = window_counts(df, time, key, "1 day")
    back = F.explode(F.sequence(F.lit(0), F.lit(v.WEEKLY_DAYS - 1)))
    starts = daily.select(key, "cnt", "window_start", back.alias("_back")).withColumn(
        "window_start", F.col("window_start") - F.make_dt_interval(F.col("_back")))
    sums = starts.groupBy("window_start", key).agg(F.sum("cnt").alias("cnt"))
    return sums.select("window_start", (F.col("window_start") + F.make_dt_interval(F.lit(v.WEEKLY_DAYS))).alias("window_end"), key, "cnt")


def heartbeat_gaps(beats: DataFrame, time: str, key: str, limit: str = f"{v.STALE_HOURS} hours") -> DataFrame:
    """Silences longer than the limit between consecutive heartbeats of a key.

    Beats are first reduced to the first and last beat per key and time bucket of
    the limit's length.  A gap over the limit cannot lie inside one bucket, so
    nothing is lost, and ordering sees two rows per bucket however many beats a
    hot key has.
    """
    bucketed = beats.groupBy(key, F.window(time, limit).alias("w")).agg(F.min(time).alias("first"), F.max(time).alias("last"))
    previous = F.lag("last").over(Window.partitionBy(key).orderBy("first"))
    gaps = bucketed.withColumn("silent_from", previous).filter(
        F.col("first") - F.col("silent_from") > F.expr(f"INTERVAL {limit}"))
    return gaps.select(key, "silent_from", F.col("first").alias("silent_to"))


def is_stale(scan_log: DataFrame, as_of: Column, hours: int = v.STALE_HOURS) -> DataFrame:
    """One row: the last completed scan and whether it is too long ago (or never happened)."""
    last = scan_log.agg(F.max("completed_at").alias("last_scan"))
    late = F.coalesce(F.col("last_scan") < as_of - F.make_dt_interval(F.lit(0), F.lit(hours)), F.lit(True))
    return last.select("last_scan", late.alias("stale"))
