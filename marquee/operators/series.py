"""Recurring series: occasions by gaps and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import series_key

# Fixed values.
RUN_GAP_DAYS = 2
RECURRENCE_THRESHOLD = 3


def series_dates(listings: DataFrame, gap_days: int = RUN_GAP_DAYS) -> DataFrame:
    """Per venue and series key: distinct dates and occasions.

    Rows are reduced to distinct dates before the window, so a series' window holds
    at most one row per calendar day however many rows share its key.
    """
    return occasions(listings.select("venue_id", series_key("name").alias("series_key"), "date").distinct(), gap_days)


def occasions(days: DataFrame, gap_days: int = RUN_GAP_DAYS) -> DataFrame:
    """:func:`series_dates` from distinct ``(venue_id, series_key, date)``."""
    w = Window.partitionBy("venue_id", "series_key").orderBy("date")
    gap = F.datediff("date", F.lag("date").over(w))
    return (
        days.withColumn("_opens", F.coalesce(gap > gap_days, F.lit(True)).cast("bigint"))
        .groupBy("venue_id", "series_key")
        .agg(F.count(F.lit(1)).alias("n_dates"), F.sum("_opens").alias("n_occasions"))
    )


def recurring_series(listings: DataFrame, threshold: int = RECURRENCE_THRESHOLD, gap_days: int = RUN_GAP_DAYS) -> DataFrame:
    """Series with enough occasions. A blank key is never a series."""
    return series_dates(listings, gap_days).where(
        (F.col("n_occasions") >= threshold) & (F.col("series_key") != "")
    )


def recurring_rows(listings: DataFrame, threshold: int = RECURRENCE_THRESHOLD) -> DataFrame:
    """``(id, n_dates)`` of the rows that belong to a recurring series."""
    found = recurring_series(listings, threshold).select("venue_id", "series_key", "n_dates")
    return (
        listings.select("id", "venue_id", series_key("name").alias("series_key"))
        .join(found, ["venue_id", "series_key"]).select("id", "n_dates")
    )


def series_sizes(listings: DataFrame) -> DataFrame:
    """Rows per venue and series key."""
    return listings.groupBy("venue_id", series_key("name").alias("series_key")).agg(
        F.count(F.lit(1)).alias("series_size")
    )


def series_rollup(rows: DataFrame) -> DataFrame:
    """One row per series of a moderation list; a row with a blank key stands alone."""
    key = F.coalesce(
        F.when(F.col("series_key") != "", F.concat(F.lit("series:"), F.col("series_key"))),
        F.concat(F.lit("row:"), F.col("id").cast("string")),
    )
    live = F.count_if(F.col("is_live_music"))
    size = F.count(F.lit(1))
    return rows.groupBy("venue_id", key.alias("group_key")).agg(
        size.alias("size"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        live.alias("live"),
        F.when(live == size, "live").when(live == 0, "non-live").otherwise("mixed").alias("label"),
    )
