"""Listings joined with venues, survivors and submitters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import http_url
from ..schema import MANUAL_KIND
from .filters import listed_in, unfolded, upcoming
from .joins import sparse_left_join

VENUE_COLUMNS = ("name", "slug", "city", "color")


def with_venue(listings: DataFrame, venues: DataFrame, how: str = "left") -> DataFrame:
    """Many-to-one; a listing whose venue is missing is kept."""
    dim = venues.select(F.col("id").alias("_venue"), *[F.col(c).alias(f"venue_{c}") for c in VENUE_COLUMNS])
    clash = [f"venue_{c}" for c in VENUE_COLUMNS if f"venue_{c}" in listings.columns]
    return listings.drop(*clash).join(dim, F.col("venue_id") == F.col("_venue"), how).drop("_venue")


def at_venues(listings: DataFrame, venues: DataFrame, city: str | None = None, size: str | None = None,
              slug: str | None = None) -> DataFrame:
    """Listings of the venues selected by comma-separated lists.

    The join exists only when a venue predicate is given. It is a semi join, so no
    venue column is carried along.
    """
    if not (city or size or slug):
        return listings
    chosen = venues
    for column, csv in (("city", city), ("size_category", size), ("slug", slug)):
        if csv:
            chosen = chosen.where(listed_in(column, csv))
    return listings.join(chosen.select(F.col("id").alias("venue_id")), "venue_id", "left_semi")


def response_rows(listings: DataFrame, venues: DataFrame) -> DataFrame:
    """The list projection, with venue columns and only absolute addresses."""
    own = (
        "id venue_id name artist support_artists date doors_min show_min price_min price_max genre subgenre "
        "status age_restriction description source is_live_music"
    ).split()
    return with_venue(listings, venues).select(
        *own, http_url("ticket_url").alias("ticket_url"), http_url("image_url").alias("image_url"),
        *[f"venue_{c}" for c in VENUE_COLUMNS],
    )


def upcoming_counts(listings: DataFrame, as_of: dt.date) -> DataFrame:
    """Unfolded listings from ``as_of`` on, per venue."""
    return unfolded(upcoming(listings, as_of)).groupBy("venue_id").agg(F.count(F.lit(1)).alias("upcoming"))


def _counted_venues(venues: DataFrame, listings: DataFrame, as_of: dt.date) -> DataFrame:
    counts = upcoming_counts(listings, as_of)
    return venues.join(counts, venues["id"] == counts["venue_id"], "left").withColumn(
        "upcoming", F.coalesce("upcoming", F.lit(0).cast("bigint"))
    ).drop("venue_id")


def public_venues(venues: DataFrame, listings: DataFrame, as_of: dt.date) -> DataFrame:
    """Venues by city and name with their counts; an empty hand-kept venue is left out."""
    v = _counted_venues(venues, listings, as_of)
    return v.where((F.col("source_kind") != MANUAL_KIND) | (F.col("upcoming") > 0)).orderBy("city", "name", "id")


def admin_venues(venues: DataFrame, listings: DataFrame, as_of: dt.date) -> DataFrame:
    """Every venue with its count, and whether a source feeds it."""
    v = _counted_venues(venues, listings, as_of)
    group = F.when(F.col("source_kind") == MANUAL_KIND, "manual").otherwise("sourced")
    return v.select("id", "name", "city", "color", "upcoming", group.alias("venue_group")).orderBy("city", "name", "id")


def with_survivor_name(rows: DataFrame, listings: DataFrame) -> DataFrame:
    """Adds the title of the row a folded row points at. Few rows are folded."""
    names = listings.select(F.col("id").alias("_survivor"), F.col("name").alias("duplicate_of_name"))
    return sparse_left_join(rows, names, "duplicate_of_id", "_survivor", "id")


def with_submitter(rows: DataFrame, submissions: DataFrame) -> DataFrame:
    who = (
        submissions.where(F.col("event_id").isNotNull())
        .groupBy(F.col("event_id").alias("_event")).agg(F.max("submitted_by").alias("submitted_by"))
    )
    return rows.join(who, rows["id"] == who["_event"], "left").drop("_event")


def fold_counts(listings: DataFrame) -> DataFrame:
    """How many rows are folded into each survivor."""
    return (
        listings.where(F.col("duplicate_of_id").isNotNull())
        .groupBy("duplicate_of_id").agg(F.count(F.lit(1)).alias("hidden_duplicate_count"))
    )


def cities(venues: DataFrame) -> DataFrame:
    return venues.select("city").distinct().orderBy("city")


def visible_venues_per_city(venues: DataFrame, hidden: DataFrame) -> DataFrame:
    """Per user and city: venues the user has not hidden. ``hidden``: (user_id, venue_slug).

    Every city is there for every user, also those with nothing hidden. Users do not pair
    with venues: the hidden ones are counted and subtracted from the city's total.
    """
    total = venues.groupBy("city").agg(F.count(F.lit(1)).alias("venues"))
    every = total.agg(F.collect_list(F.struct("city", "venues")).alias("cities"))  # one row: as long as there are cities
    pairs = hidden.select("user_id").distinct().crossJoin(every).select("user_id", F.inline("cities"))
    gone = (
        hidden.distinct().join(venues.select(F.col("slug").alias("venue_slug"), "city"), "venue_slug")
        .groupBy("user_id", "city").agg(F.count(F.lit(1)).alias("hidden_venues"))
    )
    return pairs.join(gone, ["user_id", "city"], "left").select(
        "user_id", "city", (F.col("venues") - F.coalesce("hidden_venues", F.lit(0))).alias("visible_venues")
    )
