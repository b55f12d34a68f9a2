"""Counts, histograms, run-log figures and integrity checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ...operators import enrich, filters, moderation, runlog, series, visitor
from ...schema import EVENT_STATUSES
from .entry import in_order, q
from .standin import AS_OF, KEY, LOG_NOW

STATIONS = f"""
  SELECT venue_id, series_key, count(*) AS n_dates, count(*) FILTER (WHERE gap IS NULL OR gap > 2) AS n_occasions FROM (
    SELECT venue_id, series_key, date - lag(date) OVER (PARTITION BY venue_id, series_key ORDER BY date) AS gap FROM (
      SELECT DISTINCT venue_id, {KEY} AS series_key, date FROM listings)) GROUP BY 1, 2"""


def _user_favorites(t):
    """The shows saved by the customer with the most saved shows."""
    f = t.favorites()
    top = f.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "user_id").limit(1)
    return f.join(top, "user_id", "left_semi").select("event_id")


TOP_USER = "(SELECT user_id FROM favorites GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 1)"

def _busiest_submitter(t):
    return t.submissions().groupBy("submitted_by").count().orderBy(F.desc("count"), "submitted_by").first()[0]


def _outcomes(t):
    """A first refresh: whatever was found was created."""
    zero = F.lit(0).cast("bigint")
    return t.scraped().groupBy("venue_id").agg(F.count(F.lit(1)).alias("created")).withColumns({"updated": zero, "merged": zero, "expired": zero})


ENTRIES = [
    q("upcoming_counts", "A2", lambda t: enrich.upcoming_counts(t.folded(), AS_OF),
      "SELECT venue_id, count(*) AS upcoming FROM folded WHERE date >= '1998-06-01' AND duplicate_of_id IS NULL GROUP BY 1"),
    q("fold_counts", "A4", lambda t: enrich.fold_counts(t.folded()),
      "SELECT duplicate_of_id, count(*) AS hidden_duplicate_count FROM folded WHERE duplicate_of_id IS NOT NULL GROUP BY 1"),
    q("queue_counts", "A6 A1", lambda t: moderation.queue_counts(t.listings(), AS_OF),
      """SELECT count(*) FILTER (WHERE approved_at IS NULL) AS total, count(*) FILTER (WHERE approved_at IS NOT NULL) AS approved_hidden
      FROM listings WHERE date >= DATE '1998-06-01' - 30 AND NOT is_live_music"""),
    q("series_occasions", "W1 A7", lambda t: series.series_dates(t.listings()), STATIONS),
    q("recurring_rows", "A7", lambda t: series.recurring_rows(t.listings()),
      f"SELECT id, n_dates FROM listings l JOIN ({STATIONS}) s ON l.venue_id = s.venue_id AND {KEY} = series_key WHERE n_occasions >= 3 AND series_key <> ''"),
    q("series_rollup", "A24", lambda t: series.series_rollup(
        filters.moderation_queue(t.listings(), AS_OF, view="all").withColumn("series_key", series.series_key("name"))),
      f"""SELECT venue_id, CASE WHEN {KEY} = '' THEN 'row:' || id ELSE 'series:' || {KEY} END AS group_key, count(*) AS size, min(date) AS first_date,
      max(date) AS last_date, count(*) FILTER (WHERE is_live_music) AS live, CASE WHEN bool_and(is_live_music) THEN 'live'
      WHEN NOT bool_or(is_live_music) THEN 'non-live' ELSE 'mixed' END AS label
      FROM listings WHERE date >= DATE '1998-06-01' - 30 AND approved_at IS NULL GROUP BY 1, 2"""),
    q("cities", "A20", lambda t: enrich.cities(t.venues()), "SELECT DISTINCT city FROM venues"),
    q("visible_venues_per_city", "A21", lambda t: enrich.visible_venues_per_city(t.venues(), t.hidden_venues()),
      """SELECT u.user_id, c.city, c.n - coalesce(h.n, 0) AS visible_venues FROM (SELECT DISTINCT user_id FROM hidden_venues) u
      CROSS JOIN (SELECT city, count(*) AS n FROM venues GROUP BY 1) c LEFT JOIN (SELECT h.user_id, v.city, count(*) AS n
      FROM (SELECT DISTINCT user_id, venue_slug FROM hidden_venues) h JOIN venues v ON h.venue_slug = v.slug GROUP BY 1, 2) h
      ON h.user_id = u.user_id AND h.city = c.city"""),
    q("night_histogram", "A13", lambda t: visitor.night_histogram(filters.live_only(filters.unfolded(t.folded())), AS_OF, _user_favorites(t)),
      f"""SELECT night, shows, saved, lit, CASE WHEN saved > 0 THEN least(lit, greatest(1, floor(saved / shows * lit + 0.5)))::BIGINT ELSE 0 END AS saved_lit
      FROM (SELECT *, CASE WHEN shows > 0 THEN greatest(1, floor(shows / greatest(max(shows) OVER (), 6) * 8 + 0.5))::BIGINT ELSE 0 END AS lit FROM (
        SELECT n::DATE AS night, count(f.id) AS shows, count(s.event_id) AS saved
        FROM generate_series(DATE '1998-06-01', DATE '1998-06-14', INTERVAL 1 DAY) g(n)
        LEFT JOIN (SELECT * FROM folded WHERE duplicate_of_id IS NULL AND is_live_music) f ON f.date = n::DATE
        LEFT JOIN (SELECT DISTINCT event_id FROM favorites WHERE user_id = {TOP_USER}) s ON s.event_id = f.id GROUP BY 1))"""),
    q("hidden_per_day", "A14", lambda t: visitor.hidden_per_day(t.listings(), t.hidden()),
      "SELECT user_id, date, count(*) AS hidden_shows FROM hidden JOIN listings ON id = event_id GROUP BY 1, 2"),
    q("latest_success", "A18", lambda t: runlog.latest_success(t.run_log()).select(F.date_format("last_run", "yyyy-MM-dd HH:mm:ss").alias("last_run")),
      "SELECT strftime(max(finished_at), '%Y-%m-%d %H:%M:%S') AS last_run FROM run_log WHERE status = 'success'"),
    q("freshness", "P19 A18", lambda t: runlog.freshness(t.run_log(), t.listings(), t.venues(), LOG_NOW)
      .withColumn("last_run", F.date_format("last_run", "yyyy-MM-dd HH:mm:ss")),
      """SELECT CASE WHEN last_run IS NULL OR last_run < TIMESTAMP '2024-01-31 06:00:00' - INTERVAL 13 HOUR THEN 'stale' ELSE 'ok' END AS status,
      (SELECT count(*) FROM listings) AS event_count, (SELECT count(*) FROM venues) AS venue_count, strftime(last_run, '%Y-%m-%d %H:%M:%S') AS last_run
      FROM (SELECT max(finished_at) AS last_run FROM run_log WHERE status = 'success')"""),
    q("runs_by_source", "S16", lambda t: t.run_log().groupBy("venue_id").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "failed").alias("failed"), F.max("duration_seconds").alias("longest")),
      "SELECT venue_id, count(*) AS runs, count(*) FILTER (WHERE status = 'failed') AS failed, max(duration_seconds) AS longest FROM run_log GROUP BY 1"),
    q("run_log_rows", "S16", lambda t: runlog.run_log_rows(
        t.venues(), t.scraped(), _outcomes(t), t.run_log().where("status = 'failed'").select(
            "venue_id", F.lit("ReadTimeout").alias("kind"), F.date_format("finished_at", "yyyy-MM-dd").alias("message")),
        dt.datetime(1998, 6, 1), dt.datetime(1998, 6, 1, 0, 1)).select("venue_id", "status", "events_found", "events_created", "error_message", "duration_seconds"),
      """SELECT v.id AS venue_id, CASE WHEN e.m IS NULL THEN 'success' ELSE 'failed' END AS status, CASE WHEN e.m IS NULL THEN coalesce(s.n, 0) ELSE 0 END AS events_found,
      CASE WHEN e.m IS NULL THEN coalesce(s.n, 0) ELSE 0 END AS events_created, e.m AS error_message, 60.0::DOUBLE AS duration_seconds
      FROM venues v LEFT JOIN (SELECT venue_id, count(*) AS n FROM scraped GROUP BY 1) s ON s.venue_id = v.id
      LEFT JOIN (SELECT venue_id, string_agg(DISTINCT m, '; ' ORDER BY m)[1:2000] AS m FROM (SELECT venue_id, 'ReadTimeout: ' || strftime(finished_at, '%Y-%m-%d') AS m
        FROM run_log WHERE status = 'failed') GROUP BY 1) e ON e.venue_id = v.id"""),
    q("pending_per_submitter", "A19", lambda t: moderation.pending_per_submitter(t.submissions()),
      "SELECT submitted_by, count(*) AS pending FROM submissions WHERE status = 'pending' GROUP BY 1"),
    q("pending_submissions", "O8", lambda t: in_order(moderation.pending_submissions(t.submissions()), "submitted_by").select("id", "submitted_by", "submitted_at", "name", "place"),
      """SELECT id, submitted_by, submitted_at, name, row_number() OVER (PARTITION BY submitted_by ORDER BY submitted_at, id)::INT AS place
      FROM submissions WHERE status = 'pending'"""),
    q("newest_submissions", "O9", lambda t: in_order(moderation.newest_submissions(t.submissions(), _busiest_submitter(t)), "submitted_by").select(
        "id", "status", "submitted_at", "place"),
      """SELECT id, status, submitted_at, row_number() OVER (ORDER BY submitted_at DESC, id DESC)::INT AS place FROM submissions WHERE submitted_by =
      (SELECT submitted_by FROM submissions GROUP BY 1 ORDER BY count(*) DESC, submitted_by LIMIT 1) ORDER BY submitted_at DESC, id DESC LIMIT 50"""),
    q("repeated_source_ids", "integrity", lambda t: runlog.repeated_values(t.listings(), "external_id"),
      "SELECT external_id, count(*) AS rows FROM listings GROUP BY 1 HAVING count(*) > 1"),
    q("repeated_hashes", "integrity", lambda t: runlog.repeated_values(t.hashed(), "hash"),
      "SELECT hash, count(*) AS rows FROM hashed GROUP BY 1 HAVING count(*) > 1"),
    q("integrity_report", "integrity", lambda t: runlog.self_folds(t.folded()).agg(F.count(F.lit(1)).alias("found")).withColumn("rule", F.lit("self fold"))
      .unionByName(runlog.unknown_statuses(t.listings(), EVENT_STATUSES).agg(F.count(F.lit(1)).alias("found")).withColumn("rule", F.lit("unknown status")))
      .unionByName(runlog.repeated_values(t.venues(), "slug").agg(F.count(F.lit(1)).alias("found")).withColumn("rule", F.lit("repeated slug")))
      .unionByName(runlog.repeated_values(t.overrides(), "venue_id", "normalized_name").agg(F.count(F.lit(1)).alias("found")).withColumn("rule", F.lit("repeated override"))),
      """SELECT (SELECT count(*) FROM folded WHERE id = duplicate_of_id) AS found, 'self fold' AS rule
      UNION ALL SELECT (SELECT count(*) FROM listings WHERE status NOT IN ('on_sale', 'sold_out', 'cancelled', 'free')), 'unknown status'
      UNION ALL SELECT (SELECT count(*) FROM (SELECT slug FROM venues GROUP BY 1 HAVING count(*) > 1)), 'repeated slug'
      UNION ALL SELECT (SELECT count(*) FROM (SELECT venue_id FROM overrides GROUP BY venue_id, normalized_name HAVING count(*) > 1)), 'repeated override'"""),
    q("cleared_pointers", "integrity", lambda t: runlog.clear_dangling(
        t.folded().select("id", "duplicate_of_id"), "duplicate_of_id", t.listings().where("is_live_music")),
      """SELECT f.id, CASE WHEN s.id IS NOT NULL THEN f.duplicate_of_id END AS duplicate_of_id FROM folded f
      LEFT JOIN (SELECT id FROM listings WHERE is_live_music) s ON f.duplicate_of_id = s.id"""),
    q("overrides_of_kept_venues", "integrity", lambda t: runlog.drop_orphans(
        t.overrides().select("id", "venue_id"), "venue_id", t.venues().where(F.col("source_kind") != "manual").where(F.col("market") != "ASIA")),
      "SELECT id, venue_id FROM overrides WHERE venue_id IN (SELECT id FROM venues WHERE source_kind <> 'manual' AND market <> 'ASIA')"),
]
