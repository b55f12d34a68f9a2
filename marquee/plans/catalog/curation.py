"""Classification, linkage, duplicate review and archive merging."""

from __future__ import annotations

import datetime as dt
import os
import uuid

from pyspark.sql import Window, functions as F

from ...functions.text import archive_form, session_markers, similarity_form
from ...operators import archive, classify, display, duplicates, filters, linkage
from ...plans.refresh import refresh
from ...session import cut_lineage, scratch_root
from ...sources.sinks import current, publish
from ...streaming.refresh_stream import start_refresh
from .aggregates import STATIONS
from .entry import q
from .standin import AS_OF, KEY, NOW

KEYWORD = "CASE " + " ".join(
    f"WHEN regexp_matches(name, '(?i)\\b{k}\\b') THEN 'keyword: {k}'" for k in classify.KEYWORDS) + " END"
THEME = "nullif(lower(regexp_extract(name, '(?i)\\b(" + "|".join(classify.PARTY_THEMES) + ")\\s+part(?:y|ies)\\b', 1)), '')"
EXCEPT = ", ".join(f"'{w}'" for w in classify.NIGHT_EXCEPTIONS)
NIGHT = ("list_filter(list_transform(regexp_extract_all(name, '(?i)\\b(\\w+)\\s+nights?\\b', 1), lambda w: lower(w)), "
         f"lambda w: length(w) >= 2 AND w NOT IN ({EXCEPT}))[1]")
TOKEN = "CASE " + " ".join(
    f"WHEN contains(lower(concat_ws(' ', genre, subgenre)), '{g}') THEN 'genre: {g}'" for g in classify.GENRE_TOKENS) + " END"
RULE = f"coalesce({KEYWORD}, 'keyword: ' || {THEME} || ' party', 'keyword: ' || {NIGHT} || ' night', {TOKEN})"

EXEMPT = "supplier-000000007"


def _verdict_sql(source: str) -> str:
    return f"""
  SELECT l.id, coalesce(o.is_live_music, l.venue_slug = '{EXEMPT}' OR reason IS NULL) AS is_live_music,
    CASE WHEN o.is_live_music THEN 'series override: live music' WHEN NOT o.is_live_music THEN 'series override: non-live'
      WHEN l.venue_slug = '{EXEMPT}' THEN 'venue: always live music' ELSE reason END AS classification_reason
  FROM (SELECT r.*, {KEY} AS k, CASE WHEN s.n_dates IS NOT NULL THEN 'recurring: ' || s.n_dates || ' dates' ELSE {RULE} END AS reason
    FROM {source} r LEFT JOIN (SELECT * FROM ({STATIONS.replace('FROM listings', f'FROM {source}')}) WHERE n_occasions >= 3 AND series_key <> '') s
      ON r.venue_id = s.venue_id AND {KEY.replace('name', 'r.name')} = s.series_key) l
  LEFT JOIN overrides o ON l.venue_id = o.venue_id AND l.k = o.normalized_name WHERE NOT l.is_manual_override"""


RECENT = "(SELECT * FROM listings WHERE date >= DATE '1998-06-01' - 30)"
RECLASSIFIED = f"""
  SELECT l.id, l.date >= DATE '1998-06-01' - 30 AS seen, v.id IS NOT NULL AS judged, l.is_live_music AS was, l.classification_reason AS why_was,
    v.is_live_music AS now_live, v.classification_reason AS why_now, l.approved_at
  FROM listings l LEFT JOIN ({_verdict_sql(RECENT)}) v ON l.id = v.id"""

FORM = r"""regexp_replace(lower(regexp_replace(name, '[\[\(]\s*(?:cancell?ed|canceled|postponed|rescheduled|moved|new\s*date|sold\s*out|low\s*tix|low\s*tickets|free|\d{1,2}\s*\+|all\s*ages)\s*[\]\)]', ' ', 'gi')), '[^a-z0-9]', '', 'g')"""
MARKS = r"""list_sort(list_distinct(list_transform(regexp_extract_all(name, '(?i)\b(?:early|late|matinee|first\s*set|second\s*set|1st\s*set|2nd\s*set)\b'), lambda m: replace(lower(m), ' ', ''))))"""
SIMILAR = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '[\(\[\{].*?[\)\]\}]', ' ', 'g'), '\b(late|early|first|second|1st|2nd|matinee|encore|night|show|seating|set)\b|\b(box\s*seats?|balcony|orchestra|mezzanine|standing|ga|general\s+admission)\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"""

# The greedy pass itself, one night at a time: each row takes the first cluster holding a match.
LABELS = f"""
  SELECT x.id AS id, venue_id, date, x.founder AS founder FROM (
    SELECT venue_id, date, unnest(list_reduce(list(struct_pack(id := id, t := t, m := m, s := s) ORDER BY length(t), id),
      lambda acc, x: list_append(acc, struct_pack(id := x.id, t := x.t, m := x.m, s := x.s, o := len(acc), founder := coalesce(list_sort(list_transform(
        list_filter(acc, lambda y: length(y.t) >= 6 AND contains(x.t, y.t) AND NOT (x.m <> y.m AND coalesce(x.s <> y.s, false))),
        lambda y: struct_pack(o := acc[list_position(list_transform(acc, lambda z: z.id), y.founder)].o, f := y.founder)))[1].f, x.id))),
      []::STRUCT(id VARCHAR, t VARCHAR, m VARCHAR[], s INT, o BIGINT, founder VARCHAR)[])) AS x
    FROM (SELECT id, venue_id, date, {FORM} AS t, {MARKS} AS m, coalesce(show_min, doors_min) AS s FROM listings)
    GROUP BY venue_id, date HAVING count(*) > 1)
  QUALIFY count(*) OVER (PARTITION BY venue_id, date, x.founder) > 1"""
RANK = """is_manual_override DESC, (regexp_matches(name, '(?i)\\b(?:cancell?ed|canceled|postponed|rescheduled)\\b')
      OR replace(replace(lower(status), '_', ''), '-', '') IN ('cancelled', 'canceled', 'postponed')) DESC, is_live_music DESC,
      (image_url IS NOT NULL)::INT + (ticket_url IS NOT NULL)::INT + (price_min IS NOT NULL)::INT DESC, length(name) DESC, updated_at DESC, id DESC"""
FILLS = "external_id artist support_artists doors_min show_min ticket_url price_min price_max image_url genre subgenre age_restriction description".split()
MERGED = f"""
  SELECT venue_id, date, founder, first(id ORDER BY place) AS survivor_id, count(*) - 1 AS losers,
    {", ".join(f"first({f} ORDER BY place) FILTER (WHERE {f} IS NOT NULL) AS {f}" for f in FILLS)},
    {" + ".join(f"(first({f} ORDER BY place) IS NULL AND count({f}) > 0)::INT" for f in FILLS)} AS fields_filled
  FROM (SELECT l.*, c.founder, row_number() OVER (PARTITION BY l.venue_id, l.date, c.founder ORDER BY {RANK.replace(' id DESC', ' l.id DESC')}) AS place
    FROM listings l JOIN ({LABELS}) c ON l.id = c.id) GROUP BY 1, 2, 3"""


def _batch(t, *more):
    """The deduped batch with the columns that linking reads and ``more``, written once because the plan reads it several times."""
    return cut_lineage(linkage.dedupe_batch(t.scraped()).select(*dict.fromkeys([*LINKED, *more])), "batch")


LINKED = "venue_id external_id date hash pos".split()
STORED = "id venue_id external_id date hash duplicate_of_id is_manually_created updated_at".split()


def _sides(t):
    """Both sides of a link with the columns it reads, each written once because it is read several times."""
    return cut_lineage(t.stored(early=True).select(STORED), "stored"), _batch(t)


def _plan(t):
    return linkage.merge_plan(*_sides(t), AS_OF)


def _next(stored, batch, now):
    """The table after a deduped batch."""
    return linkage.apply_plan(stored, batch, linkage.merge_plan(stored, batch, AS_OF), now)


def _applied(t):
    shown = [c for c in APPLIED if c != "id"]
    return _next(cut_lineage(t.stored(early=True).select(*dict.fromkeys([*STORED, *shown])), "stored"), _batch(t, *shown), NOW)


def _labels(t):
    return archive.cluster_labels(t.listings())


NAMED = "id venue_id date name show_min doors_min".split()      # what clusters are found by
RANKED = "is_manual_override status is_live_music image_url ticket_url price_min updated_at".split()


def _archived(t, fields):
    """Listings with ``fields`` and what archive merging reads, written once, and their clusters."""
    rows = cut_lineage(t.listings().select(*dict.fromkeys([*NAMED, *RANKED, *fields])), "listings")
    return rows, archive.cluster_labels(rows)


def _merged(t):
    return archive.merged_survivors(*_archived(t, FILLS))


def _refreshed(t):
    shown = "name status price_min".split()
    judged = "genre subgenre is_live_music is_manual_override classification_reason approved_at".split()
    stored = cut_lineage(t.stored(early=True).select(*STORED, *shown, *judged), "stored")
    batch = t.scraped().select(*LINKED, *shown, "genre", "subgenre", "approved_at", "classification_reason")
    table = refresh(stored, batch, t.venues(), t.overrides(), AS_OF, NOW).table
    return table.select("id", "venue_id", "name", "date", "status", "price_min", "hash", "classification_reason", "is_live_music")


def _renamed_and_relisted(t):
    """Two refreshes: all listings with a source id, then each renamed and its old title listed anew under another id."""
    batch = linkage.dedupe_batch(t.scraped()).select(*LINKED, "name").where("external_id is not null and external_id <> ''")
    first = cut_lineage(batch, "batch")
    table = cut_lineage(_next(t.stored(early=True).select(*STORED, "name").limit(0), first, NOW), "table")
    renamed = first.withColumns({"name": F.concat("name", F.lit(" (new)")), "hash": F.md5(F.concat("hash", F.lit("|new"))), "pos": F.concat(F.lit("0|"), "pos")})
    again = first.withColumns({"external_id": F.concat("external_id", F.lit("-again")), "pos": F.concat(F.lit("1|"), "pos")})
    second = cut_lineage(renamed.unionByName(again), "batch")
    later = _next(table, second, NOW + dt.timedelta(hours=6))
    same = F.count(F.lit(1)).over(Window.partitionBy("id"))
    return later.select("venue_id", "name", "date", "external_id", "hash", same.alias("rows_with_id"))


def _streamed(t):
    """Stored rows as version 0, the batch landed as files, then the stream until all is consumed."""
    root = os.path.join(scratch_root(t.spark), f"stream-{uuid.uuid4().hex}")
    publish(t.stored(early=True), f"{root}/table", 0)
    landed = t.scraped()
    landed.write.option("compression", "zstd").parquet(f"{root}/landing")
    start_refresh(t.spark, f"{root}/landing", landed.schema, f"{root}/table", f"{root}/checkpoint", t.venues(), t.overrides(),
                  lambda: NOW).awaitTermination()
    return current(t.spark, f"{root}/table").select(*APPLIED)


APPLIED = "id venue_id name artist date show_min ticket_url price_min status hash".split()
APPLIED_SQL = f"""SELECT s.id, s.venue_id, s.name, s.artist, s.date, s.show_min, s.ticket_url, s.price_min, s.status, s.hash FROM stored s JOIN plan p ON s.id = p.id
      WHERE p.action IN ('keep', 'orphan')
      UNION ALL SELECT s.id, s.venue_id, n.name, coalesce(n.artist, s.artist), s.date, coalesce(n.show_min, s.show_min), coalesce(n.ticket_url, s.ticket_url),
        n.price_min, n.status, n.hash FROM stored s JOIN plan p ON s.id = p.id JOIN deduped n ON n.pos = p.pos WHERE p.action = 'update'
      UNION ALL SELECT md5(concat_ws('|', '{NOW.isoformat()}', n.pos, n.hash)), n.venue_id, n.name, n.artist, n.date, n.show_min, n.ticket_url, n.price_min, n.status, n.hash
        FROM deduped n JOIN plan p ON n.pos = p.pos WHERE p.action = 'insert'"""
NIGHTS = """SELECT venue_id, date, count(*) AS unfolded_rows, bool_and(approved_at IS NOT NULL) AS all_approved
  FROM folded WHERE duplicate_of_id IS NULL AND date >= '1998-06-01' GROUP BY 1, 2 HAVING count(*) > 1"""

ENTRIES = [
    q("rule_verdicts", "P5", lambda t: t.listings().select("id", classify.rule_reason("name", "genre", "subgenre").alias("reason")),
      f"SELECT id, {RULE} AS reason FROM listings"),
    q("layered_verdicts", "P6 J5 J6", lambda t: classify.classify(t.listings(), t.overrides(), t.venues(), exempt_slugs=[EXEMPT]),
      _verdict_sql("listings")),
    q("reclassify", "P6b", lambda t: classify.reclassify(t.listings(), AS_OF, t.overrides(), t.venues(), exempt_slugs=[EXEMPT])
      .select("id", "is_live_music", "classification_reason", "approved_at", "changed"),
      f"""SELECT id, CASE WHEN judged THEN now_live ELSE was END AS is_live_music, CASE WHEN judged THEN why_now ELSE why_was END AS classification_reason,
      CASE WHEN judged AND was <> now_live THEN NULL ELSE approved_at END AS approved_at,
      judged AND (was <> now_live OR why_was IS DISTINCT FROM why_now) AS changed FROM ({RECLASSIFIED})"""),
    q("reclassify_stats", "A17", lambda t: classify.reclassify_stats(
        classify.reclassify(t.listings(), AS_OF, t.overrides(), t.venues(), exempt_slugs=[EXEMPT])),
      f"""SELECT count(*) FILTER (WHERE seen) AS seen, count(*) FILTER (WHERE judged AND (was <> now_live OR why_was IS DISTINCT FROM why_now)) AS changed,
      count(*) FILTER (WHERE judged AND was <> now_live AND approved_at IS NOT NULL) AS unapproved FROM ({RECLASSIFIED})"""),
    q("deduped_batch", "P1", lambda t: linkage.dedupe_batch(t.scraped()).select("pos", "venue_id", "date", "external_id", "hash"),
      "SELECT pos, venue_id, date, external_id, hash FROM deduped"),
    q("linked_rows", "J10 W2", lambda t: linkage.link(t.stored(early=True), linkage.dedupe_batch(t.scraped())), "SELECT id, venue_id, pos, is_survivor FROM links"),
    q("merge_plan", "P2 P3 J11 U3", _plan, "SELECT venue_id, id, pos, action FROM plan"),
    q("run_lossiness", "A15", lambda t: linkage.venue_lossiness(*_sides(t), AS_OF),
      "SELECT venue_id, in_window, orphans, too_lossy FROM valve"),
    q("run_outcomes", "A16", lambda t: linkage.outcome_counts(_plan(t)),
      """SELECT venue_id, count(*) FILTER (WHERE action = 'insert') AS created, count(*) FILTER (WHERE action = 'update') AS updated,
      count(*) FILTER (WHERE action = 'superseded') AS merged, count(*) FILTER (WHERE action = 'expired') AS expired FROM plan GROUP BY 1"""),
    q("applied_plan", "P4 S15", lambda t: _applied(t).select(*APPLIED), APPLIED_SQL),
    q("renamed_and_relisted", "P4 S15", _renamed_and_relisted,
      """SELECT venue_id, name || ' (new)' AS name, date, external_id, md5(hash || '|new') AS hash, 1::BIGINT AS rows_with_id FROM deduped WHERE external_id <> ''
      UNION ALL SELECT venue_id, name, date, external_id || '-again', hash, 1::BIGINT FROM deduped WHERE external_id <> ''"""),
    q("streamed_refresh", "G1 S15", _streamed, APPLIED_SQL),
    q("refreshed_table", "P1 P2 P3 P4 P6b", _refreshed),
    q("crowded_nights", "A3", lambda t: duplicates.crowded_nights(t.folded()),
      "SELECT venue_id, date, count(*) AS rows FROM folded WHERE duplicate_of_id IS NULL GROUP BY 1, 2 HAVING count(*) > 1"),
    q("rows_of_crowded_nights", "J4", lambda t: duplicates.rows_of_nights(t.folded(), duplicates.crowded_nights(t.folded())).select("id", "venue_id", "date"),
      """SELECT id, venue_id, date FROM folded WHERE (venue_id, date) IN (SELECT (venue_id, date) FROM folded WHERE duplicate_of_id IS NULL
      GROUP BY venue_id, date HAVING count(*) > 1)"""),
    q("review_facts", "A9 P9", lambda t: duplicates.review_clusters(t.folded(), AS_OF).select("venue_id", "date", "unfolded_rows", "all_approved"), NIGHTS),
    q("review_scores", "A8 J14 T8", lambda t: duplicates.cluster_scores(filters.unfolded(t.folded()))),
    q("review_queue", "P9 O5 O6", lambda t: duplicates.review_queue(t.folded(), AS_OF).select("venue_id", "date", "score", "id", "name", "show_min")),
    q("review_totals", "P9 O5", lambda t: duplicates.review_totals(t.folded(), AS_OF),
      f"SELECT count(*) AS total, least(count(*), 200) AS shown FROM ({NIGHTS})"),
    q("title_forms", "T7 T9 T10", lambda t: t.listings().select(
        "id", similarity_form("name").alias("similar"), archive_form("name").alias("archived"), F.array_join(session_markers("name"), ",").alias("markers")),
      f"SELECT id, {SIMILAR} AS similar, {FORM} AS archived, array_to_string({MARKS}, ',') AS markers FROM listings"),
    q("archive_clusters", "P7 J15 T11", lambda t: _labels(t), LABELS),
    q("archive_survivors", "W4 P8 T12", _merged, MERGED),
    q("archive_table", "P8", lambda t: archive.merge_archive(*_archived(t, ["price_max", "artist"])).select("id", "ticket_url", "price_max", "artist"),
      f"""SELECT l.id, coalesce(m.ticket_url, l.ticket_url) AS ticket_url, coalesce(m.price_max, l.price_max) AS price_max, coalesce(m.artist, l.artist) AS artist
      FROM listings l LEFT JOIN ({LABELS}) c ON l.id = c.id LEFT JOIN ({MERGED}) m ON l.id = m.survivor_id WHERE c.id IS NULL OR m.survivor_id IS NOT NULL"""),
    q("archive_summary", "A23", lambda t: archive.merge_summary(*_archived(t, FILLS)),
      f"SELECT count(*) AS groups, sum(losers)::BIGINT AS rows_deleted, sum(fields_filled)::BIGINT AS fields_filled FROM ({MERGED})"),
    q("short_titles", "P7", lambda t: archive.short_titles(t.listings()),
      f"""SELECT a.venue_id, a.date, a.t AS title, sum(b.n)::BIGINT - 1 AS other_rows FROM (SELECT venue_id, date, {FORM} AS t, count(*) AS n FROM listings GROUP BY 1, 2, 3) a
      JOIN (SELECT venue_id, date, {FORM} AS t, count(*) AS n FROM listings GROUP BY 1, 2, 3) b ON a.venue_id = b.venue_id AND a.date = b.date AND contains(b.t, a.t)
      WHERE length(a.t) BETWEEN 1 AND 5 GROUP BY 1, 2, 3 HAVING sum(b.n) > 1"""),
]
