"""Filters, joins, ordering and the calendar reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.moneytime import calendar_price_label, clock_12h, feed_price_label
from ...operators import display, enrich, filters, moderation, series, visitor
from .. import calendar
from .entry import in_order, q
from .standin import AS_OF

LABEL = "regexp_replace(lower(coalesce(nullif(artist, ''), name)), '[^a-z0-9]', '', 'g')"
FILLED = "(image_url IS NOT NULL)::INT + (ticket_url IS NOT NULL)::INT + (price_min IS NOT NULL)::INT"
CLOCK = ("CASE WHEN {m} // 60 % 12 = 0 THEN '12' ELSE ({m} // 60 % 12)::VARCHAR END || ':' || lpad(({m} % 60)::VARCHAR, 2, '0') "
         "|| CASE WHEN {m} // 60 < 12 THEN ' AM' ELSE ' PM' END")
DOLLARS = "'$' || round_even({p}, 0)::BIGINT"
CAL_PRICE = f"""CASE WHEN price_min IS NULL THEN NULL WHEN price_min = 0 AND coalesce(price_max, 0) = 0 THEN 'Free'
  WHEN price_max <> 0 AND price_max <> price_min THEN {DOLLARS.format(p='price_min')} || '-' || {DOLLARS.format(p='price_max')}
  ELSE {DOLLARS.format(p='price_min')} END"""
FEED_PRICE = f"""CASE WHEN price_min IS NULL THEN NULL WHEN price_min = 0 THEN 'Free'
  WHEN price_max <> 0 AND price_max <> price_min THEN {DOLLARS.format(p='price_min')} || '–' || {DOLLARS.format(p='price_max')}
  ELSE {DOLLARS.format(p='price_min')} END"""
BEST = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY venue_id, date, {LABEL}
    ORDER BY is_manual_override DESC, is_live_music DESC, {FILLED} DESC, updated_at DESC, id DESC) AS place FROM folded
  WHERE duplicate_of_id IS NULL) WHERE place = 1"""


def _count(df, **extra):
    return df.agg(F.count(F.lit(1)).alias("total"), *[e.alias(n) for n, e in extra.items()])


def _price_span():
    return {"lowest": F.min("price_min"), "last_day": F.max("date")}


def _flat(cal):
    d = lambda c: F.col(f"details.{c}").alias(c)
    return cal.select(
        "id", "title", "start", "all_day", "background_color", *map(d, (
            "name", "artist", "support_artists", "venue_name", "venue_slug", "venue_city", "doors_time", "show_time", "price",
            "ticket_url", "image_url", "genre", "status", "is_live_music")),
    )


def _busiest_day(t):
    """The listings of the venue's day with the most, in their order."""
    top = t.listings().groupBy("venue_id", "date").count().orderBy(F.desc("count"), "venue_id", "date").first()
    return in_order(visitor.same_day_group(t.listings(), top["venue_id"], top["date"]), "venue_id").select("id", "venue_id", "date", "show_min", "place")


ENTRIES = [
    q("archive_scan", "S1", lambda t: filters.date_window(t.listings(), "1996-01-01", "1996-12-31")
      .select("id", "venue_id", "name", "date", "status", "updated_at").orderBy("date", "venue_id", "id"),
      "SELECT id, venue_id, name, date, status, updated_at FROM listings WHERE date BETWEEN '1996-01-01' AND '1996-12-31'"),
    q("date_window", "F1", lambda t: _count(filters.date_window(t.listings(), "1998-06-01T00:00:00", "not a date"), **_price_span()),
      "SELECT count(*) AS total, min(price_min) AS lowest, max(date) AS last_day FROM listings WHERE date >= '1998-06-01'"),
    q("venue_lists", "F2 J2", lambda t: enrich.at_venues(t.listings(), t.venues(), city="NATION_1, NATION_2,NATION_3", size="small,medium")
      .groupBy("venue_id").agg(F.count(F.lit(1)).alias("shows")),
      """SELECT venue_id, count(*) AS shows FROM listings JOIN venues v ON venue_id = v.id
      WHERE v.city IN ('NATION_1', 'NATION_2', 'NATION_3') AND v.size_category IN ('small', 'medium') GROUP BY 1"""),
    q("unfolded_rows", "F3", lambda t: _count(filters.unfolded(t.folded()), **_price_span()),
      "SELECT count(*) AS total, min(price_min) AS lowest, max(date) AS last_day FROM folded WHERE duplicate_of_id IS NULL"),
    q("title_search", "F4", lambda t: t.listings().where(filters.title_search("RED_W%t")).select("id", "name", "artist"),
      "SELECT id, name, artist FROM listings WHERE name ILIKE '%RED_W%t%' OR artist ILIKE '%RED_W%t%'"),
    q("genre_and_status", "F5 F6", lambda t: filters.list_filter(t.folded(), genre="PROM", status="sold_out").select("id", "genre", "status"),
      "SELECT id, genre, status FROM folded WHERE duplicate_of_id IS NULL AND genre ILIKE '%PROM%' AND status = 'sold_out' AND is_live_music"),
    q("upcoming_rows", "F7", lambda t: filters.upcoming(t.listings(), AS_OF).groupBy("date").agg(F.count(F.lit(1)).alias("shows")),
      "SELECT date, count(*) AS shows FROM listings WHERE date >= '1998-06-01' GROUP BY 1"),
    q("revision_floor", "F8", lambda t: _count(t.listings().where(F.col("date") >= F.lit(filters.revision_floor(AS_OF)))),
      "SELECT count(*) AS total FROM listings WHERE date >= DATE '1998-06-01' - 30"),
    q("moderation_filters", "F9", lambda t: filters.moderation_queue(t.listings(), AS_OF, view="non_live", search="widget", manual_only=True)
      .select("id", "name", "date"),
      """SELECT id, name, date FROM listings WHERE date >= DATE '1998-06-01' - 30 AND NOT is_live_music AND name ILIKE '%widget%'
      AND is_manually_created AND approved_at IS NULL"""),
    q("refreshable_venues", "F10", lambda t: filters.refreshable_venues(t.venues(), exclude=["mec"]).select("id", "source_kind"),
      "SELECT id, source_kind FROM venues WHERE source_kind <> 'manual' AND source_kind <> 'mec'"),
    q("venue_text_filter", "S13", lambda t: t.venues().where(filters.venue_text_keeps("name", "SUPPLIER#0", "#00000001")).select("id", "name"),
      "SELECT id, name FROM venues WHERE contains(lower(name), 'supplier#0') AND NOT contains(lower(name), '#00000001')"),
    q("point_lookup", "F13", lambda t: filters.by_id(t.folded(), filters.unfolded(t.folded()).agg(F.max("id")).first()[0]).select("id", "name", "date"),
      "SELECT id, name, date FROM folded WHERE id = (SELECT max(id) FROM folded WHERE duplicate_of_id IS NULL)"),
    q("response_rows", "F14 F16 J1", lambda t: enrich.response_rows(t.listings(), t.venues())
      .select("id", "name", "date", "status", "ticket_url", "image_url", "venue_name", "venue_slug", "venue_city", "venue_color"),
      """SELECT l.id, l.name, l.date, l.status, l.ticket_url, l.image_url, v.name AS venue_name, v.slug AS venue_slug, v.city AS venue_city,
      v.color AS venue_color FROM listings l LEFT JOIN venues v ON l.venue_id = v.id"""),
    q("calendar_tiles", "F15 W3 P16 O1", lambda t: _flat(calendar.calendar(t.folded(), t.venues(), start="1998-01-01")),
      f"""SELECT b.id, coalesce(nullif(b.artist, ''), b.name) AS title, strftime(b.date, '%Y-%m-%d') AS start, true AS all_day,
      v.color AS background_color, b.name, b.artist, b.support_artists, v.name AS venue_name, v.slug AS venue_slug, v.city AS venue_city,
      {CLOCK.format(m='doors_min')} AS doors_time, {CLOCK.format(m='show_min')} AS show_time, {CAL_PRICE} AS price, ticket_url, image_url,
      genre, status, is_live_music FROM ({BEST}) b JOIN venues v ON b.venue_id = v.id WHERE b.date >= '1998-01-01'"""),
    q("best_per_show", "W3", lambda t: display.best_per_show(filters.unfolded(t.folded())).select("id", "venue_id", "date", "name"),
      f"SELECT id, venue_id, date, name FROM ({BEST})"),
    q("one_tile_per_day", "W5", lambda t: display.one_tile_per_day(
        t.listings(), [F.col("date").asc(), F.col("id").asc()], [f"supplier-{n:09d}" for n in range(1, 10)]).select("id", "venue_slug", "date", "status"),
      """SELECT id, venue_slug, date, status FROM listings WHERE NOT (venue_id BETWEEN 1 AND 9)
      UNION ALL SELECT id, venue_slug, date, status FROM (SELECT *, row_number() OVER (PARTITION BY venue_id, date
        ORDER BY status <> 'on_sale', id) AS place FROM listings WHERE venue_id BETWEEN 1 AND 9) WHERE place = 1"""),
    q("list_page", "O1 O2 P17", lambda t: calendar.listing_page(t.folded(), t.venues(), 3, 50, start="1997-01-01", search="ring")[0]
      .select("id", "name", "date", "venue_city"),
      """SELECT l.id, l.name, l.date, v.city AS venue_city FROM (SELECT * FROM folded WHERE duplicate_of_id IS NULL AND date >= '1997-01-01'
      AND (name ILIKE '%ring%' OR artist ILIKE '%ring%') AND is_live_music ORDER BY date, id LIMIT 50 OFFSET 100) l LEFT JOIN venues v ON l.venue_id = v.id"""),
    q("list_totals", "A1 O2", lambda t: calendar.listing_page(t.folded(), t.venues(), 1, 50, start="1997-01-01", search="ring")[1],
      """SELECT count(*) AS total, ceil(count(*) / 50)::BIGINT AS pages FROM folded WHERE duplicate_of_id IS NULL AND date >= '1997-01-01'
      AND (name ILIKE '%ring%' OR artist ILIKE '%ring%') AND is_live_music"""),
    q("capped_queue", "O3", lambda t: filters.capped(filters.moderation_queue(t.listings(), AS_OF), 1000, "date", "id").select("id", "date"),
      """SELECT id, date FROM listings WHERE date >= DATE '1998-06-01' - 30 AND NOT is_live_music AND approved_at IS NULL
      ORDER BY date, id LIMIT 1000"""),
    q("public_venues", "J9 A2 O4", lambda t: in_order(enrich.public_venues(t.venues(), t.folded(), AS_OF), "city").select("id", "name", "city", "upcoming", "place"),
      """SELECT v.id, v.name, v.city, coalesce(n, 0) AS upcoming, row_number() OVER (PARTITION BY v.city ORDER BY v.name, v.id)::INT AS place FROM venues v LEFT JOIN (SELECT venue_id, count(*) AS n FROM folded
      WHERE date >= '1998-06-01' AND duplicate_of_id IS NULL GROUP BY 1) ON v.id = venue_id WHERE source_kind <> 'manual' OR coalesce(n, 0) > 0"""),
    q("admin_venues", "J17", lambda t: enrich.admin_venues(t.venues(), t.folded(), AS_OF),
      """SELECT v.id, v.name, v.city, v.color, coalesce(n, 0) AS upcoming, CASE source_kind WHEN 'manual' THEN 'manual' ELSE 'sourced' END AS venue_group
      FROM venues v LEFT JOIN (SELECT venue_id, count(*) AS n FROM folded WHERE date >= '1998-06-01' AND duplicate_of_id IS NULL GROUP BY 1)
      ON v.id = venue_id"""),
    q("override_list", "J3 O10", lambda t: in_order(moderation.override_list(t.overrides(), t.venues()), "venue_id").select(
        "id", "venue_id", "venue_name", "normalized_name", "is_live_music", "place"),
      """SELECT o.id, venue_id, v.name AS venue_name, normalized_name, is_live_music,
      row_number() OVER (PARTITION BY venue_id ORDER BY o.created_at DESC, o.id DESC)::INT AS place FROM overrides o JOIN venues v ON venue_id = v.id"""),
    q("survivor_names", "J7", lambda t: enrich.with_survivor_name(t.folded().select("id", "duplicate_of_id"), t.listings()),
      "SELECT f.id, f.duplicate_of_id, s.name AS duplicate_of_name FROM folded f LEFT JOIN listings s ON f.duplicate_of_id = s.id"),
    q("submitters", "J8", lambda t: enrich.with_submitter(t.listings().select("id", "name"), t.submissions()),
      "SELECT l.id, l.name, s.submitted_by FROM listings l LEFT JOIN submissions s ON l.id = s.event_id"),
    q("same_day_group", "O11", _busiest_day, """SELECT id, venue_id, date, show_min, row_number() OVER (ORDER BY show_min NULLS LAST, id)::INT AS place FROM listings
      WHERE (venue_id, date) = (SELECT (venue_id, date) FROM listings GROUP BY venue_id, date ORDER BY count(*) DESC, venue_id, date LIMIT 1)"""),
    q("time_and_price_labels", "T30 T31 T32", lambda t: t.listings().select(
        "id", clock_12h("show_min").alias("show_time"), calendar_price_label("price_min", "price_max").alias("calendar_price"),
        feed_price_label("price_min", "price_max").alias("feed_price")),
      f"SELECT id, {CLOCK.format(m='show_min')} AS show_time, {CAL_PRICE} AS calendar_price, {FEED_PRICE} AS feed_price FROM listings"),
    q("series_sizes", "A5", lambda t: series.series_sizes(t.listings().where(F.col("date") >= F.lit(filters.revision_floor(AS_OF)))),
      """SELECT venue_id, regexp_replace(lower(name), '[^a-z]', '', 'g') AS series_key, count(*) AS series_size FROM listings
      WHERE date >= DATE '1998-06-01' - 30 GROUP BY 1, 2"""),
]
