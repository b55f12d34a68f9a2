"""Moderation: the queue with its context, and decisions as tables merged by key.

In one batch the latest decision on a target wins; decisions on targets that do not
exist change nothing and are listed by the ``*_decisions`` functions.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import series_key
from .enrich import fold_counts, with_submitter, with_survivor_name, with_venue
from .filters import moderation_base, moderation_queue, revision_floor
from .joins import is_true
from .series import series_sizes


def queue_counts(listings: DataFrame, as_of: dt.date, **base) -> DataFrame:
    """``total`` rows shown and ``approved_hidden`` rows the approval filter holds back."""
    return moderation_base(listings, as_of, **base).agg(
        F.count_if(F.col("approved_at").isNull()).alias("total"),
        F.count_if(F.col("approved_at").isNotNull()).alias("approved_hidden"),
    )


def queue_view(listings: DataFrame, venues: DataFrame, overrides: DataFrame, as_of: dt.date, *,
               submissions: DataFrame | None = None, show_approved: bool = False, **base) -> DataFrame:
    """Queue rows with venue, series size, series override, folds, survivor and proposer.

    Series sizes count every row from the revision floor on, whatever the view's filters.
    """
    rows = moderation_queue(listings, as_of, show_approved=show_approved, **base)
    rows = with_survivor_name(with_venue(rows, venues), listings).withColumn("series_key", series_key("name"))
    sizes = series_sizes(listings.where(F.col("date") >= F.lit(revision_floor(as_of))))
    chosen = overrides.select(
        "venue_id", F.col("normalized_name").alias("series_key"), F.col("id").alias("series_override_id"),
        F.col("is_live_music").alias("series_override_is_live"),
    )
    rows = rows.join(sizes, ["venue_id", "series_key"], "left").join(chosen, ["venue_id", "series_key"], "left")
    folds = fold_counts(listings).withColumnRenamed("duplicate_of_id", "_survivor")
    rows = rows.join(folds, F.col("id") == F.col("_survivor"), "left").drop("_survivor")
    if submissions is not None:
        rows = with_submitter(rows, submissions)
    else:
        rows = rows.withColumn("submitted_by", F.lit(None).cast("string"))
    return rows.withColumns({
        "series_size": F.coalesce("series_size", F.lit(1).cast("bigint")),
        "hidden_duplicate_count": F.coalesce("hidden_duplicate_count", F.lit(0).cast("bigint")),
        "is_approved": F.col("approved_at").isNotNull(),
    }).select(
        "id", "venue_id", "name", "artist", "date", "venue_name", "venue_slug", "is_live_music", "is_manual_override",
        "classification_reason", "is_approved", "is_manually_created", "duplicate_of_id", "duplicate_of_name",
        "hidden_duplicate_count", "description", "genre", "ticket_url", "age_restriction", "show_min", "submitted_by",
        "series_key", "series_size", "series_override_id", "series_override_is_live",
    )


def apply_verdicts(listings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Set or clear a person's verdict. ``verdicts``: (event_id, is_live_music or null to clear, decided_at).

    Setting also approves; clearing also unapproves. Reclassify afterwards.
    """
    last = verdicts.groupBy("event_id").agg(
        F.max_by("is_live_music", "decided_at").alias("_last"),
        F.max("decided_at").alias("_when"),
        F.max_by("is_live_music", F.when(F.col("is_live_music").isNotNull(), F.col("decided_at"))).alias("_set"),
    )
    rows = listings.join(last, listings["id"] == last["event_id"], "left")
    touched, sets = F.col("event_id").isNotNull(), F.col("_last").isNotNull()
    kind = listings.schema["approved_at"].dataType
    return rows.withColumns({
        "is_live_music": F.coalesce("_set", "is_live_music"),
        "is_manual_override": F.when(touched, sets).otherwise(F.col("is_manual_override")),
        "classification_reason": F.when(F.col("_set").isNotNull(), F.lit("manual")).otherwise(F.col("classification_reason")),
        "approved_at": F.when(touched, F.when(sets, F.col("_when").cast(kind))).otherwise(F.col("approved_at")),
    }).drop("event_id", "_last", "_when", "_set")


def approval_decisions(listings: DataFrame, approvals: DataFrame) -> DataFrame:
    """Approvals with their target. ``approvals``: (event_id, whole_series, approve, decided_at).

    A whole-series decision on a title without letters is refused: such titles share an
    empty key without being a series.
    """
    samples = listings.select(F.col("id").alias("_id"), "venue_id", series_key("name").alias("series_key"))
    rows = approvals.join(samples, approvals["event_id"] == samples["_id"], "left")
    reason = F.when(F.col("_id").isNull(), "missing row").when(
        F.col("whole_series") & (F.col("series_key") == ""), "title has no series key"
    )
    return rows.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull()).drop("_id")


def apply_approvals(listings: DataFrame, approvals: DataFrame, as_of: dt.date) -> DataFrame:
    """Approve or unapprove single rows and whole series from the revision floor on.

    A series approval leaves rows alone that are approved already.
    """
    ok = approval_decisions(listings, approvals).where("accepted")
    one = ok.where(~F.col("whole_series")).groupBy("event_id").agg(
        F.max_by("approve", "decided_at").alias("_one"), F.max("decided_at").alias("_one_at")
    )
    newest = F.struct("decided_at", "event_id")
    many = ok.where("whole_series").groupBy("venue_id", F.col("series_key").alias("_key")).agg(
        F.max_by("approve", newest).alias("_many"), F.max("decided_at").alias("_many_at")
    )
    rows = listings.withColumn("_key", series_key("name"))
    rows = rows.join(one, rows["id"] == one["event_id"], "left").join(many, ["venue_id", "_key"], "left")
    in_range = F.col("date") >= F.lit(revision_floor(as_of))
    by_series = in_range & F.col("_many").isNotNull() & F.coalesce(F.col("_many_at") > F.col("_one_at"), F.lit(True))
    kind = listings.schema["approved_at"].dataType
    before = F.when(F.col("_one"), F.col("_one_at").cast(kind)).when(F.col("_one").isNull(), F.col("approved_at"))
    after = F.when(by_series & F.col("_many"), F.coalesce(before, F.col("_many_at").cast(kind))).when(~by_series, before)
    return rows.withColumn("approved_at", after).select(*listings.columns)


def series_decisions(listings: DataFrame, requests: DataFrame) -> DataFrame:
    """Override requests with the series they stand for. ``requests``: (event_id, is_live_music, note, decided_at)."""
    samples = listings.select(F.col("id").alias("_id"), "venue_id", "name", series_key("name").alias("normalized_name"))
    rows = requests.join(samples, requests["event_id"] == samples["_id"], "left")
    reason = F.when(F.col("_id").isNull(), "missing row").when(F.col("normalized_name") == "", "title has no series key")
    return rows.withColumn("reason", reason).drop("_id")


def upsert_overrides(overrides: DataFrame, listings: DataFrame, requests: DataFrame) -> DataFrame:
    """Series overrides after the requests; one row per venue and key, the latest request wins."""
    keys = ["venue_id", "normalized_name"]
    order = F.struct("decided_at", "event_id")
    newest = series_decisions(listings, requests).where(F.col("reason").isNull()).groupBy(*keys).agg(
        F.max_by("is_live_music", order).alias("_live"), F.max_by("note", order).alias("_note"),
        F.max_by("name", order).alias("_shown"), F.max("decided_at").alias("_when"),
    )
    old = overrides.select("id", *keys, "display_name", "is_live_music", "note", "created_at")
    new_id = F.xxhash64(*keys)
    given = F.col("_when").isNotNull()
    return old.join(newest, keys, "full").select(
        F.coalesce("id", new_id.cast(overrides.schema["id"].dataType)).alias("id"), *keys,
        F.when(given, F.col("_shown")).otherwise(F.col("display_name")).alias("display_name"),
        F.when(given, F.col("_live")).otherwise(F.col("is_live_music")).alias("is_live_music"),
        F.when(given, F.col("_note")).otherwise(F.col("note")).alias("note"),
        F.coalesce("created_at", F.col("_when").cast(overrides.schema["created_at"].dataType)).alias("created_at"),
    )


def delete_overrides(overrides: DataFrame, ids: DataFrame) -> DataFrame:
    return overrides.join(ids.select("id"), "id", "left_anti")


def override_list(overrides: DataFrame, venues: DataFrame) -> DataFrame:
    """Overrides with their venue's name, newest first."""
    names = venues.select(F.col("id").alias("venue_id"), F.col("name").alias("venue_name"))
    return overrides.join(names, "venue_id").orderBy(F.col("created_at").desc(), F.col("id").desc())


def pending_submissions(submissions: DataFrame) -> DataFrame:
    """Oldest first."""
    return submissions.where(F.col("status") == "pending").orderBy("submitted_at", "id")


def newest_submissions(submissions: DataFrame, who: str, limit: int = 50) -> DataFrame:
    mine = submissions.where(F.col("submitted_by") == who)
    return mine.orderBy(F.col("submitted_at").desc(), F.col("id").desc()).limit(limit)


def pending_per_submitter(submissions: DataFrame) -> DataFrame:
    return submissions.where(F.col("status") == "pending").groupBy("submitted_by").agg(F.count(F.lit(1)).alias("pending"))
