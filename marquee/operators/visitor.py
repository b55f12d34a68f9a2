"""What a visitor sees: saved and hidden shows, taste matches, the nights ahead."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, first_nonblank, taste_form
from .contains import contained_pairs
from .display import one_tile_per_day
from .enrich import with_venue
from .joins import is_true

# Fixed values.
NIGHTS, CELLS, LEAST_SCALE = 14, 8, 6
POSTER_SHOWS = 15


def title_of() -> Column:
    return first_nonblank("artist", "name")


def search_text() -> Column:
    """Title, name, artist and venue in one lower-case line."""
    parts = [title_of(), blank_to_null("name"), blank_to_null("artist"), blank_to_null("venue_name")]
    return F.lower(F.concat_ws(" ", *parts))


def _marked(rows: DataFrame, ids: DataFrame | None, column: str, on: str, right: str) -> DataFrame:
    if ids is None:
        return rows.withColumn(column, F.lit(False))
    flags = ids.select(F.col(right).alias("_k"), F.lit(True).alias("_hit")).distinct()
    return rows.join(flags, rows[on] == flags["_k"], "left").withColumn(column, is_true("_hit")).drop("_k", "_hit")


def visible_to(favorites_only: bool = False, include_non_music: bool = False, for_you: bool = False,
               search: str | None = None, city: str | None = None) -> Column:
    """The visibility rule over ``is_favorite``, ``is_venue_hidden`` and ``is_taste_match``.

    Only an explicit "not live" hides. A saved show is exempt from that in the
    favourites view only. Taste mode ignores venue and search choices.
    """
    keep = F.lit(True)
    if city:
        keep = keep & is_true(F.col("venue_city") == city)
    if favorites_only:
        keep = keep & F.col("is_favorite")
    if not include_non_music:
        shown = F.coalesce("is_live_music", F.lit(True))
        keep = keep & (shown | F.col("is_favorite") if favorites_only else shown)
    if for_you:
        return keep & F.col("is_taste_match")
    keep = keep & ~F.col("is_venue_hidden")
    if search:
        keep = keep & search_text().contains(search.lower())
    return keep


def visitor_view(listings: DataFrame, venues: DataFrame, *, favorites: DataFrame | None = None,
                 hidden: DataFrame | None = None, hidden_venues: DataFrame | None = None,
                 artists: DataFrame | None = None, for_you: bool = False, **choices) -> DataFrame:
    """One visitor's calendar: hidden rows out, the rule above, one tile per grouped venue and day.

    ``favorites`` and ``hidden`` hold ``event_id``, ``hidden_venues`` holds
    ``venue_slug``, ``artists`` holds normalised ``artist`` names.
    """
    rows = with_venue(listings, venues)
    if hidden is not None:
        rows = rows.join(hidden.select(F.col("event_id").alias("id")), "id", "left_anti")
    rows = _marked(rows, favorites, "is_favorite", "id", "event_id")
    rows = _marked(rows, hidden_venues, "is_venue_hidden", "venue_slug", "venue_slug")
    matches = taste_matches(listings, artists) if for_you and artists is not None else None
    rows = _marked(rows, matches, "is_taste_match", "id", "id")
    seen = rows.where(visible_to(for_you=for_you, **choices))
    return one_tile_per_day(seen, [F.col("date").asc(), F.col("id").asc()])


def _taste_texts(listings: DataFrame) -> DataFrame:
    words = F.concat(F.coalesce(title_of(), F.lit("")), F.lit(" "), F.coalesce("artist", F.lit("")))
    return listings.select("id", taste_form(words).alias("hay"), taste_form(title_of()).alias("title"))


def _taste_text_pairs(texts: DataFrame, names: DataFrame) -> DataFrame:
    """``(id, artist)`` matches of non-blank titles, both directions."""
    forward = contained_pairs(names.select(F.col("artist").alias("needle")), texts, shortest=2)
    backward = contained_pairs(
        texts.select(F.col("title").alias("needle")),
        names.where(F.length("artist") > 3).select(F.col("artist").alias("hay")),
    )
    a = texts.join(forward, "hay").select("id", F.col("needle").alias("artist"))
    b = texts.join(backward.select(F.col("needle").alias("title"), F.col("hay").alias("artist")), "title").select("id", "artist")
    return a.unionByName(b).distinct()


def taste_matches(listings: DataFrame, artists: DataFrame) -> DataFrame:
    """Ids of listings matching any of one visitor's artists.

    The listing's text holds an artist, or an artist of more than three letters holds
    the title; a title without words is held by any of those.
    """
    texts = _taste_texts(listings)
    names = artists.select("artist").where(F.length("artist") > 1).distinct()
    found = _taste_text_pairs(texts, names).select("id")
    # Titles without words match if there is any longer name at all: a semi join with at most one row.
    zero = lambda c: F.pmod(F.xxhash64(c), F.lit(1)).alias("_zero")
    longer = names.where(F.length("artist") > 3).select(zero("artist")).distinct()
    blank = texts.where(F.col("title") == "").select("id", zero("id")).join(longer, "_zero", "left_semi").select("id")
    return found.unionByName(blank).distinct()


def taste_pairs(listings: DataFrame, user_artists: DataFrame) -> DataFrame:
    """``(user_id, id)`` matches for many visitors.

    Titles without words match everybody who has an artist of more than three letters;
    they are not multiplied out here, see :func:`visitors_with_long_artists`.
    """
    names = user_artists.where(F.length("artist") > 1).select("user_id", "artist").distinct()
    pairs = _taste_text_pairs(_taste_texts(listings), names.select("artist").distinct())
    return pairs.join(names, "artist").select("user_id", "id").distinct()


def visitors_with_long_artists(user_artists: DataFrame) -> DataFrame:
    return user_artists.where(F.length("artist") > 3).select("user_id").distinct()


def artist_list(entries: DataFrame) -> DataFrame:
    """Distinct normalised artists per user in first-seen order.

    ``entries``: (user_id, artist, list_no, pos); lists are read in the order of ``list_no``.
    """
    named = entries.withColumn("artist", taste_form("artist")).where(F.length("artist") > 1)
    return named.groupBy("user_id", "artist").agg(F.min(F.struct("list_no", "pos")).alias("first_seen"))


def night_histogram(visible: DataFrame, as_of: dt.date, favorites: DataFrame | None = None) -> DataFrame:
    """Fourteen nights from ``as_of``: shows, saved shows and lit cells, empty nights included."""
    last = as_of + dt.timedelta(days=NIGHTS - 1)
    near = _marked(visible.where(F.col("date").between(F.lit(as_of), F.lit(last))).select("id", "date"),
                   favorites, "is_favorite", "id", "event_id")
    counts = near.groupBy("date").agg(F.count(F.lit(1)).alias("_n"), F.count_if("is_favorite").alias("_f"))
    spark = visible.sparkSession
    nights = spark.range(NIGHTS).select(F.date_add(F.lit(as_of), F.col("id").cast("int")).alias("night"))
    rows = nights.join(counts, F.col("night") == F.col("date"), "left").select(
        "night", F.coalesce("_n", F.lit(0).cast("bigint")).alias("shows"), F.coalesce("_f", F.lit(0).cast("bigint")).alias("saved")
    )
    scale = F.greatest(F.max("shows").over(Window.partitionBy(F.lit(1))), F.lit(LEAST_SCALE))  # fourteen rows
    lit = F.when(F.col("shows") > 0, F.greatest(F.lit(1), F.floor(F.col("shows") / scale * CELLS + 0.5))).otherwise(F.lit(0))
    rows = rows.withColumn("lit", lit.cast("bigint"))
    saved = F.least(F.col("lit"), F.greatest(F.lit(1), F.floor(F.col("saved") / F.col("shows") * F.col("lit") + 0.5)))
    return rows.withColumn("saved_lit", F.when(F.col("saved") > 0, saved).otherwise(F.lit(0)).cast("bigint")).orderBy("night")


def hidden_per_day(listings: DataFrame, hidden: DataFrame) -> DataFrame:
    """Per user and day: listings the user has hidden. ``hidden``: (user_id, event_id)."""
    h = hidden.select("user_id", F.col("event_id").alias("id")).distinct()
    return h.join(listings.select("id", "date"), "id").groupBy("user_id", "date").agg(F.count(F.lit(1)).alias("hidden_shows"))


def saved_events(favorites: DataFrame, listings: DataFrame, venues: DataFrame) -> DataFrame:
    """Favourites as stored in a browser: title, day as text, venue and link."""
    rows = with_venue(listings, venues).select(
        F.col("id").alias("event_id"), title_of().alias("title"), F.date_format("date", "yyyy-MM-dd").alias("date"),
        "show_min", "venue_name", "venue_city", "ticket_url",
    )
    return favorites.select("user_id", "event_id").distinct().join(rows, "event_id")


def poster_events(saved: DataFrame, as_of: dt.date, shows: int = POSTER_SHOWS) -> DataFrame:
    """Each user's soonest saved shows; rows without a well-formed date are dropped."""
    ahead = saved.where(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.col("date") >= as_of.isoformat()))
    w = Window.partitionBy("user_id").orderBy("date", "title", "event_id")
    return ahead.withColumn("place", F.row_number().over(w)).where(F.col("place") <= shows)


def same_day_group(listings: DataFrame, venue_id, day: dt.date) -> DataFrame:
    """One venue's day by show time, unknown times last."""
    rows = listings.where((F.col("venue_id") == venue_id) & (F.col("date") == F.lit(day)))
    return rows.orderBy(F.col("show_min").asc_nulls_last(), "id")
