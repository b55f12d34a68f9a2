"""Folds, verdicts, approvals, series overrides and validation of entered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...operators import duplicates, moderation, validation
from ...session import cut_lineage

from .entry import q
from .standin import AS_OF, KEY, LATER_AS_OF, NOW, later

FOLDS = """
  SELECT r.request_id, r.survivor_id, CASE WHEN bool_or(s.duplicate_of_id IS NOT NULL) THEN 'survivor is folded'
      WHEN bool_or(r.duplicate_id IN (SELECT duplicate_of_id FROM folded WHERE duplicate_of_id IS NOT NULL)) THEN 'duplicate has dependents' END AS reason,
    bool_or(s.venue_id <> d.venue_id OR s.date <> d.date) AS crosses
  FROM fold_requests r JOIN folded s ON r.survivor_id = s.id JOIN folded d ON r.duplicate_id = d.id GROUP BY 1, 2"""


def _joined(df: DataFrame) -> DataFrame:
    return df.withColumn("reasons", F.array_join("reasons", "; "))


def _bodies(r: DataFrame) -> DataFrame:
    """Hand-added shows: the new batch, with the faults that its gaps suggest."""
    return r.select(
        F.col("id").alias("seq"), F.when(F.col("show_min").isNull(), F.col("venue_id") + 1000000).otherwise(F.col("venue_id")).alias("venue_id"),
        F.when(F.col("support_artists").isNotNull(), "  ").otherwise(F.col("name")).alias("name"),
        F.when(F.col("ticket_url").isNull(), "soon").otherwise(F.date_format("date", "yyyy-MM-dd")).alias("date"),
        F.col("price_min"), F.when(F.col("image_url").isNull(), F.col("price_min") - 1).otherwise(F.col("price_max")).alias("price_max"),
        F.when(F.col("doors_min").isNotNull(), "7pm").alias("doors_time"), F.lit("20:00").alias("show_time"), "artist", "support_artists",
        "ticket_url", "genre", "age_restriction", "description", "is_live_music",
    )


BODIES = f"""SELECT *, list_filter([CASE WHEN show_min IS NULL THEN 'no such venue' END, CASE WHEN support_artists IS NOT NULL THEN 'name missing' END,
    CASE WHEN ticket_url IS NULL THEN 'date malformed' END,
    CASE WHEN ticket_url IS NOT NULL AND date NOT BETWEEN '2015-01-01' AND '2020-12-31' THEN 'date out of range' END,
    CASE WHEN image_url IS NULL AND price_min - 1 < price_min THEN 'highest price below lowest' END,
    CASE WHEN doors_min IS NOT NULL THEN 'doors_time malformed' END], lambda x: x IS NOT NULL) AS faults FROM scraped_later"""
MANUAL = f"""
  SELECT id AS seq, CASE WHEN len(faults) > 0 THEN array_to_string(faults, '; ') WHEN hash IN (SELECT hash FROM stored_later) THEN 'already on the calendar'
    WHEN row_number() OVER (PARTITION BY hash, len(faults) = 0 ORDER BY id) > 1 THEN 'already in this batch' ELSE '' END AS reasons FROM ({BODIES})"""


def _folded_after_requests(t) -> DataFrame:
    """Rows and requests, written once: the check reads the rows three times and the requests twice."""
    rows = cut_lineage(t.folded().select("id", "venue_id", "date", "duplicate_of_id"), "rows-to-fold")
    requests = cut_lineage(t.fold_requests(), "fold-requests")
    return duplicates.apply_folds(rows, requests, duplicates.fold_decisions(rows, requests))


def _patches(t) -> DataFrame:
    r = t.stored()
    return r.select(
        F.col("id").alias("seq"), F.col("id").alias("event_id"), F.lit(None).cast("bigint").alias("venue_id"),
        F.when(F.col("support_artists").isNotNull(), "").otherwise(F.concat("name", F.lit(" redux"))).alias("name"),
        F.when(F.col("show_min").isNull(), "2001-13-01").otherwise(F.date_format(F.date_add("date", 1), "yyyy-MM-dd")).alias("date"),
        F.lit(None).cast("double").alias("price_min"), (F.col("price_min") - 1).alias("price_max"), F.lit("21:30").alias("show_time"),
        F.lit("").alias("doors_time"), F.lit("jazz").alias("genre"),
        F.when(F.col("subgenre").isNull(), F.array(F.lit("name"), F.lit("genre"))).when(
            F.col("image_url").isNull(), F.array(F.lit("price_max"))).otherwise(F.array(F.lit("date"), F.lit("show_time"))).alias("fields_set"),
    )


PATCHED = f"""
  SELECT *, sha256(venue_slug || '|' || strftime(new_date, '%Y-%m-%d') || '|' || regexp_replace(lower(new_name), '[^a-z0-9]', '', 'g')) AS probe FROM (
    SELECT *, CASE WHEN subgenre IS NULL THEN CASE WHEN support_artists IS NULL THEN name || ' redux' END ELSE name END AS new_name,
      CASE WHEN subgenre IS NOT NULL AND image_url IS NOT NULL THEN CASE WHEN show_min IS NOT NULL THEN date + 1 END ELSE date END AS new_date FROM stored)"""
EDITS = f"""
  SELECT id AS event_id, CASE WHEN len(faults) > 0 THEN array_to_string(faults, '; ')
    WHEN row_number() OVER (PARTITION BY new_hash, len(faults) = 0 ORDER BY id) > 1 THEN 'already in this batch' ELSE '' END AS reasons
  FROM (SELECT p.id, CASE WHEN subgenre IS NOT NULL AND image_url IS NULL THEN p.hash ELSE probe END AS new_hash, list_filter([
      CASE WHEN NOT is_manually_created THEN 'not added by hand' END,
      CASE WHEN subgenre IS NOT NULL AND image_url IS NOT NULL AND show_min IS NULL THEN 'date malformed' END,
      CASE WHEN subgenre IS NOT NULL AND image_url IS NOT NULL AND new_date > '2000-12-31' THEN 'date too far ahead' END,
      CASE WHEN subgenre IS NULL AND new_name IS NULL THEN 'name missing' END,
      CASE WHEN (subgenre IS NULL OR image_url IS NOT NULL) AND holder <> p.id THEN 'already on the calendar' END,
      CASE WHEN (CASE WHEN subgenre IS NOT NULL AND image_url IS NULL THEN price_min - 1 ELSE price_max END) < price_min THEN 'highest price below lowest' END
    ], lambda x: x IS NOT NULL) AS faults
    FROM ({PATCHED}) p LEFT JOIN (SELECT hash, min(id) AS holder FROM stored GROUP BY 1) h ON probe = h.hash)"""


def _proposals(t) -> DataFrame:
    r = t.scraped()
    new = F.col("status") == "cancelled"
    return r.select(
        F.col("id").alias("seq"), F.when(~new, F.col("venue_id")).alias("venue_id"), F.concat(F.lit(" "), "name", F.lit(" ")).alias("name"),
        F.when(F.col("show_min").isNull(), "tomorrow").otherwise(F.date_format("date", "yyyy-MM-dd")).alias("date"), "price_min", "price_max",
        F.when(new, F.when(F.col("artist").isNull(), F.concat(F.lit("Supplier#"), F.lpad(F.col("venue_id").cast("string"), 9, "0")))
               .otherwise(F.concat(F.lit("Club "), F.col("order_no").cast("string")))).alias("new_venue_name"),
        F.when(new & F.col("ticket_url").isNotNull(), "Durham").alias("new_venue_city"),
        F.lit(None).cast("string").alias("new_venue_website"),
        F.when(F.col("image_url").isNull(), "www.tickets.example").otherwise(F.col("ticket_url")).alias("ticket_url"),
        F.lit("").alias("doors_time"), F.lit("20:00").alias("show_time"),
    )


PROPOSALS = """
  SELECT id AS seq, array_to_string(list_filter([CASE WHEN show_min IS NULL THEN 'date malformed' END,
    CASE WHEN show_min IS NOT NULL AND date < '1998-06-01' THEN 'date has passed' END, CASE WHEN show_min IS NOT NULL AND date > '2000-12-31' THEN 'date too far ahead' END,
    CASE WHEN price_max < price_min THEN 'highest price below lowest' END, CASE WHEN image_url IS NULL THEN 'ticket_url not absolute' END,
    CASE WHEN status = 'cancelled' AND ticket_url IS NULL THEN 'city missing' END,
    CASE WHEN status = 'cancelled' AND artist IS NULL THEN 'venue already listed' END], lambda x: x IS NOT NULL), '; ') AS reasons,
    CASE WHEN status <> 'cancelled' THEN venue_slug WHEN artist IS NULL THEN venue_slug ELSE 'club-' || order_no END AS venue_slug FROM scraped"""


def _venue_bodies(t) -> DataFrame:
    acct = F.col("c_acctbal")
    return t.table("customer").join(t.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("seq"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("Supplier#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")))
        .when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("Hall of "), "n_name")).otherwise(F.col("c_name")).alias("name"),
        F.when(acct < 0, " ").otherwise(F.col("n_name")).alias("city"), F.lit("").alias("size_category"), F.lit(None).cast("string").alias("website"),
        F.when(acct > 5000, "#ABCDEF").when(acct > 1000, F.lit(None).cast("string")).otherwise("red").alias("color"),
    )


VENUE_BODIES = """
  SELECT seq, CASE WHEN len(faults) > 0 THEN array_to_string(faults, '; ') WHEN row_number() OVER (PARTITION BY slug, len(faults) = 0 ORDER BY seq) > 1
    THEN 'already in this batch' ELSE '' END AS reasons, slug, color FROM (
    SELECT *, list_filter([CASE WHEN acct < 0 THEN 'city missing' END, CASE WHEN slug IN (SELECT slug FROM venues) THEN 'name already used' END,
      CASE WHEN acct <= 1000 THEN 'colour is not hex' END], lambda x: x IS NOT NULL) AS faults,
      CASE WHEN acct > 5000 THEN '#abcdef' WHEN acct > 1000 THEN '#6366f1' ELSE 'red' END AS color FROM (
      SELECT c_custkey AS seq, c_acctbal AS acct, trim(regexp_replace(lower(CASE c_mktsegment WHEN 'BUILDING' THEN 'Supplier#' || lpad(c_custkey::VARCHAR, 9, '0')
        WHEN 'MACHINERY' THEN 'Hall of ' || n_name ELSE c_name END), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM customer JOIN nation ON c_nationkey = n_nationkey))"""


def _reviews(t) -> DataFrame:
    return t.submissions().select(
        F.col("id").alias("submission_id"), (F.col("price_max").isNull()).alias("approve"), F.lit("reviewer").alias("reviewed_by"), F.col("id").alias("seq"))


REVIEWS = """
  SELECT id AS submission_id, CASE WHEN status <> 'pending' THEN 'refused' WHEN price_max IS NOT NULL THEN 'rejected'
      WHEN fault IS NULL THEN 'approved' ELSE 'refused' END AS outcome,
    CASE WHEN status <> 'pending' THEN 'already reviewed' WHEN price_max IS NULL THEN fault END AS reason FROM (
    SELECT *, CASE WHEN bad IS NOT NULL THEN bad WHEN row_number() OVER (PARTITION BY hash, status = 'pending', price_max IS NULL, bad IS NULL ORDER BY id) > 1
      THEN 'already in this batch' END AS fault FROM (
      SELECT *, CASE WHEN date NOT BETWEEN '2015-01-01' AND '2020-12-31' THEN 'date out of range'
        WHEN hash IN (SELECT hash FROM stored_later) THEN 'already on the calendar' END AS bad FROM submissions_later))"""

ENTRIES = [
    q("fold_decisions", "P10", lambda t: duplicates.fold_decisions(t.folded(), t.fold_requests()),
      f"SELECT request_id, survivor_id, reason IS NULL AS accepted, reason, crosses FROM ({FOLDS})"),
    q("folded_after_requests", "P10", lambda t: _folded_after_requests(t).select("id", "duplicate_of_id"),
      f"""SELECT f.id, coalesce(r.survivor_id, f.duplicate_of_id) AS duplicate_of_id FROM folded f LEFT JOIN (SELECT duplicate_id, survivor_id FROM fold_requests
      JOIN (SELECT request_id FROM ({FOLDS}) WHERE reason IS NULL) USING (request_id)) r ON f.id = r.duplicate_id"""),
    q("unfolded_by_request", "P11", lambda t: duplicates.unfold(t.folded(), t.favorites()).select("id", "duplicate_of_id"),
      "SELECT id, CASE WHEN id NOT IN (SELECT event_id FROM favorites) THEN duplicate_of_id END AS duplicate_of_id FROM folded"),
    q("applied_verdicts", "P12", lambda t: moderation.apply_verdicts(t.listings(), t.verdicts())
      .select("id", "is_live_music", "is_manual_override", "classification_reason", "approved_at"),
      """SELECT l.id, coalesce(v.is_live_music, l.is_live_music) AS is_live_music, CASE WHEN v.event_id IS NULL THEN l.is_manual_override ELSE v.is_live_music IS NOT NULL
      END AS is_manual_override, CASE WHEN v.is_live_music IS NOT NULL THEN 'manual' ELSE classification_reason END AS classification_reason,
      CASE WHEN v.event_id IS NULL THEN approved_at WHEN v.is_live_music IS NOT NULL THEN decided_at END AS approved_at
      FROM listings l LEFT JOIN verdicts v ON l.id = v.event_id"""),
    q("applied_approvals", "P13", lambda t: moderation.apply_approvals(t.listings(), t.approvals(), AS_OF).select("id", "approved_at"),
      f"""SELECT id, CASE WHEN by_series THEN coalesce(earlier, many_at) ELSE earlier END AS approved_at FROM (
      SELECT l.id, many_at, date >= DATE '1998-06-01' - 30 AND many_at IS NOT NULL AND coalesce(many_at > o.decided_at, true) AS by_series,
        CASE WHEN o.approve THEN o.decided_at WHEN o.approve IS NULL THEN l.approved_at END AS earlier
      FROM listings l LEFT JOIN (SELECT * FROM approvals WHERE NOT whole_series) o ON l.id = o.event_id
      LEFT JOIN (SELECT venue_id, {KEY} AS k, max(decided_at) AS many_at FROM approvals JOIN listings ON event_id = id WHERE whole_series GROUP BY 1, 2) m
        ON l.venue_id = m.venue_id AND {KEY.replace('name', 'l.name')} = m.k)"""),
    q("upserted_overrides", "P14", lambda t: moderation.upsert_overrides(t.overrides(), t.listings(), t.series_requests())
      .select("venue_id", "normalized_name", "display_name", "is_live_music", "note"),
      f"""SELECT coalesce(o.venue_id, r.venue_id) AS venue_id, coalesce(o.normalized_name, r.k) AS normalized_name, coalesce(r.name, o.display_name) AS display_name,
      coalesce(r.is_live_music, o.is_live_music) AS is_live_music, r.note FROM overrides o FULL JOIN (SELECT * FROM (
        SELECT l.venue_id, {KEY} AS k, l.name, s.is_live_music, s.note, row_number() OVER (PARTITION BY l.venue_id, {KEY} ORDER BY decided_at DESC, event_id DESC) AS place
        FROM series_requests s JOIN listings l ON s.event_id = l.id) WHERE place = 1) r ON o.venue_id = r.venue_id AND o.normalized_name = r.k"""),
    q("deleted_overrides", "P14", lambda t: moderation.delete_overrides(t.overrides(), t.overrides().where("is_live_music")).select("venue_id", "normalized_name"),
      "SELECT venue_id, normalized_name FROM overrides WHERE NOT is_live_music"),
    q("moderation_view", "P15 J5 J7 J8 A4 A5", lambda t: moderation.queue_view(
        t.folded(), t.venues(), t.overrides(), AS_OF, submissions=t.submissions(), view="all")
      .select("id", "name", "venue_name", "duplicate_of_name", "hidden_duplicate_count", "submitted_by", "series_key", "series_size", "series_override_is_live"),
      f"""SELECT f.id, f.name, v.name AS venue_name, s.name AS duplicate_of_name, coalesce(n.n, 0) AS hidden_duplicate_count, p.submitted_by,
      {KEY.replace('name', 'f.name')} AS series_key, z.n AS series_size, o.is_live_music AS series_override_is_live
      FROM folded f LEFT JOIN venues v ON f.venue_id = v.id LEFT JOIN listings s ON f.duplicate_of_id = s.id
      LEFT JOIN (SELECT duplicate_of_id, count(*) AS n FROM folded GROUP BY 1) n ON f.id = n.duplicate_of_id LEFT JOIN submissions p ON p.event_id = f.id
      LEFT JOIN (SELECT venue_id, {KEY} AS k, count(*) AS n FROM folded WHERE date >= DATE '1998-06-01' - 30 GROUP BY 1, 2) z
        ON f.venue_id = z.venue_id AND {KEY.replace('name', 'f.name')} = z.k
      LEFT JOIN overrides o ON f.venue_id = o.venue_id AND {KEY.replace('name', 'f.name')} = o.normalized_name
      WHERE f.date >= DATE '1998-06-01' - 30 AND f.approved_at IS NULL"""),
    q("checked_manual_events", "V1", lambda t: _joined(validation.check_manual_events(
        _bodies(later(t.scraped())), t.venues(), later(t.stored()), LATER_AS_OF)).select("seq", "reasons"), MANUAL),
    q("manual_event_rows", "V1", lambda t: validation.manual_event_rows(
        validation.check_manual_events(_bodies(later(t.scraped())), t.venues(), later(t.stored()), LATER_AS_OF).drop("clash_id"),
        later(t.stored()).withColumn("id", F.xxhash64("id")), NOW).select(
            "venue_id", "name", "date", "hash", "source", "is_manually_created", "is_manual_override", "classification_reason"),
      f"""SELECT venue_id, name, date, hash, 'manual' AS source, true AS is_manually_created, true AS is_manual_override, 'manual' AS classification_reason
      FROM scraped_later JOIN ({MANUAL}) ON id = seq WHERE reasons = ''"""),
    q("checked_event_edits", "V2", lambda t: _joined(validation.check_event_edits(_patches(t), t.stored(), t.venues(), AS_OF)).select("event_id", "reasons"), EDITS),
    q("edited_events", "V2", lambda t: validation.apply_event_edits(
        t.stored(), validation.check_event_edits(_patches(t), t.stored(), t.venues(), AS_OF)).select("id", "name", "date", "show_min", "genre", "hash"),
      f"""SELECT id, CASE WHEN fine THEN new_name ELSE name END AS name, CASE WHEN fine THEN new_date ELSE date END AS date,
      CASE WHEN fine AND subgenre IS NOT NULL AND image_url IS NOT NULL THEN 1290 ELSE show_min END AS show_min,
      CASE WHEN fine AND subgenre IS NULL THEN 'jazz' ELSE genre END AS genre, CASE WHEN fine AND (subgenre IS NULL OR image_url IS NOT NULL) THEN probe ELSE hash END AS hash
      FROM (SELECT p.*, reasons = '' AS fine FROM ({PATCHED}) p JOIN ({EDITS}) e ON p.id = e.event_id)"""),
    q("checked_event_deletes", "V3", lambda t: _joined(validation.check_event_deletes(
        t.scraped().select(F.col("id").alias("event_id")), t.stored())).drop("accepted"),
      """SELECT n.id AS event_id, CASE WHEN s.id IS NULL THEN 'no such event' WHEN NOT s.is_manually_created THEN 'not added by hand' ELSE '' END AS reasons,
      CASE WHEN s.is_manually_created THEN (SELECT count(*) FROM stored x WHERE x.duplicate_of_id = n.id) END AS restored_duplicates
      FROM (SELECT DISTINCT id FROM scraped) n LEFT JOIN stored s ON n.id = s.id"""),
    q("listings_after_deletes", "V3", lambda t: validation.apply_event_deletes(t.stored(), validation.check_event_deletes(
        t.scraped().select(F.col("id").alias("event_id")), t.stored())).select("id", "duplicate_of_id"),
      """SELECT id, CASE WHEN duplicate_of_id NOT IN (SELECT s.id FROM stored s JOIN scraped USING (id) WHERE s.is_manually_created) THEN duplicate_of_id END AS duplicate_of_id
      FROM stored WHERE id NOT IN (SELECT s.id FROM stored s JOIN scraped USING (id) WHERE s.is_manually_created)"""),
    q("checked_venue_deletes", "V3", lambda t: _joined(validation.check_venue_deletes(
        t.table("customer").select(F.col("c_custkey").alias("venue_id")), t.venues(), t.listings())).drop("accepted"),
      """SELECT c_custkey AS venue_id, coalesce(n, 0) AS event_count, CASE WHEN v.id IS NULL THEN 'no such venue' WHEN source_kind <> 'manual' THEN 'venue has a source'
      WHEN n > 0 THEN 'venue still has events' ELSE '' END AS reasons FROM customer LEFT JOIN venues v ON c_custkey = v.id
      LEFT JOIN (SELECT venue_id, count(*) AS n FROM listings GROUP BY 1) x ON c_custkey = x.venue_id"""),
    q("checked_submissions", "V4", lambda t: _joined(validation.check_submissions(_proposals(t), t.venues(), AS_OF)).select("seq", "reasons", "venue_slug"), PROPOSALS),
    q("admitted_submissions", "V5 A19 J16", lambda t: validation.admit_submissions(
        t.scraped().join(t.orders(), "order_no").select(
            F.col("id").alias("seq"), F.concat(F.lit("customer-"), F.col("user_id").cast("string")).alias("submitted_by"), F.col("hash").alias("show_key")),
        t.stored(), validation.show_keys(t.submissions().where(F.col("status") == "pending")))),
    q("reviewed_submissions", "V6", lambda t: validation.review_submissions(
        later(t.submissions()), _reviews(t), t.venues(), later(t.stored()), LATER_AS_OF).select("submission_id", "outcome", "reason"), REVIEWS),
    q("checked_manual_venues", "V7", lambda t: _joined(validation.check_manual_venues(_venue_bodies(t), t.venues())).select("seq", "reasons", "slug", "color"), VENUE_BODIES),
]
