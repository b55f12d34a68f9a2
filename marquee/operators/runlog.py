"""Run log, freshness and integrity checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import describe_error

STALE_HOURS = 13  # Fixed value: two missed refreshes and an hour of slack.
ERROR_LENGTH = 2000


def latest_success(log: DataFrame) -> DataFrame:
    """When the last successful run finished. A success without an end time is ignored."""
    return log.where(F.col("status") == "success").agg(F.max("finished_at").alias("last_run"))


def freshness(log: DataFrame, listings: DataFrame, venues: DataFrame, now: dt.datetime) -> DataFrame:
    """One row: status, row counts and the last success."""
    def part(df: DataFrame, ended=None, event: int = 0, venue: int = 0) -> DataFrame:
        ended = F.lit(None) if ended is None else ended
        return df.select(ended.cast("timestamp").alias("ended"), F.lit(event).alias("event"), F.lit(venue).alias("venue"))

    # One aggregate over three narrow scans, so that no one-row tables have to be joined.
    done = log.where(F.col("status") == "success")
    seen = part(done, F.col("finished_at")).unionByName(part(listings, event=1)).unionByName(part(venues, venue=1))
    row = seen.agg(F.max("ended").alias("last_run"), F.sum("event").alias("event_count"), F.sum("venue").alias("venue_count"))
    limit = F.lit(now - dt.timedelta(hours=STALE_HOURS))
    stale = F.col("last_run").isNull() | (F.col("last_run") < limit)
    return row.select(F.when(stale, "stale").otherwise("ok").alias("status"), "event_count", "venue_count", "last_run")


def run_log_rows(venues: DataFrame, scraped: DataFrame, outcomes: DataFrame, errors: DataFrame | None,
                 started: dt.datetime, finished: dt.datetime) -> DataFrame:
    """One log row per refreshed venue. ``errors``: (venue_id, kind, message); a failed venue created nothing."""
    found = scraped.groupBy("venue_id").agg(F.count(F.lit(1)).alias("found"))
    rows = venues.select(F.col("id").alias("venue_id"), "source_kind").join(found, "venue_id", "left").join(outcomes, "venue_id", "left")
    if errors is not None:
        said = errors.groupBy("venue_id").agg(
            F.substring(F.array_join(F.array_sort(F.collect_set(describe_error("kind", "message"))), "; "), 1, ERROR_LENGTH).alias("error_message")
        )
        rows = rows.join(said, "venue_id", "left")
    else:
        rows = rows.withColumn("error_message", F.lit(None).cast("string"))
    failed = F.col("error_message").isNotNull()
    number = lambda c: F.when(~failed, F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).cast("bigint")
    return rows.select(
        "venue_id", "source_kind", F.lit(started).alias("started_at"), F.lit(finished).alias("finished_at"),
        F.when(failed, "failed").otherwise("success").alias("status"), number("found").alias("events_found"),
        number("created").alias("events_created"), number("updated").alias("events_updated"), "error_message",
        F.lit((finished - started).total_seconds()).alias("duration_seconds"),
    )


# --- integrity ---

def repeated_values(df: DataFrame, *columns: str) -> DataFrame:
    """Values that should be unique but are not; must be empty."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def self_folds(listings: DataFrame) -> DataFrame:
    return listings.where(F.col("duplicate_of_id") == F.col("id"))


def unknown_statuses(df: DataFrame, allowed: tuple[str, ...], column: str = "status") -> DataFrame:
    return df.where(~F.col(column).isin(*allowed) | F.col(column).isNull())


def clear_dangling(df: DataFrame, column: str, parents: DataFrame, spread_by: str = "id") -> DataFrame:
    """Null a pointer whose target is gone."""
    from .joins import sparse_left_join

    ids = parents.select(F.col("id").alias("_parent"), F.lit(True).alias("_there"))
    return sparse_left_join(df, ids, column, "_parent", spread_by).withColumn(
        column, F.when(F.col("_there"), F.col(column))
    ).select(*df.columns)


def drop_orphans(df: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """Rows whose parent still exists."""
    return df.join(parents.select(F.col("id").alias(column)), column, "left_semi")
