"""Sources and sinks, on payloads that Spark builds from the given tables.

The payload builders only serialise the listings into each source's shape, one page
per order; the parsers under test then have to recover them.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...operators import filters, visitor
from ...sources import cms, common, grids, jsonld, platform, registry, scripts, sinks, ticketing, university
from ...session import cut_lineage, scratch_root
from .entry import in_order, q
from .reads import CLOCK, FEED_PRICE
from .standin import AS_OF, HASH, Tables

SHOWN = ["name", "date", "venue_slug", "external_id", "artist", "show_min", "price_min", "status"]
BASE = """CASE WHEN image_url IS NULL THEN 'Add-Ons: ' || name WHEN price_max IS NOT NULL THEN name || ' - VIP' ELSE name END"""


def _day():
    return F.date_format("date", "yyyy-MM-dd")


def _hhmm(c: str):
    return F.concat(F.lpad(F.floor(F.col(c) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col(c) % 60).cast("string"), 2, "0"))


def _ticketing_pages(t) -> DataFrame:
    """One page per order, listed under the venue of its first line."""
    named = lambda c: F.struct(c.alias("name"))

    def event(x):
        name, price = x["name"], x["price_min"]
        raw = F.when(x["plain"], F.concat(F.lit("Add-Ons: "), name)).when(x["price_max"].isNotNull(), F.concat(name, F.lit(" - VIP"))).otherwise(name)
        return F.struct(
            x["id"].alias("id"), raw.alias("name"), x["ticket_url"].alias("url"),
            F.struct(F.struct(F.date_format(x["date"], "yyyy-MM-dd").alias("localDate"), F.concat(x["clock"], F.lit(":00")).alias("localTime")).alias("start"),
                     F.struct(F.when(x["status"] == "sold_out", "offsale").otherwise(x["status"]).alias("code")).alias("status")).alias("dates"),
            F.struct(F.when(x["artist"].isNotNull(), F.array(named(x["artist"]), named(x["genre"]))).alias("attractions")).alias("_embedded"),
            F.when(price.isNotNull(), F.array(F.struct(price.alias("min"), x["price_max"].alias("max")))).alias("priceRanges"),
            F.array(F.struct(named(F.lit("Undefined")).alias("genre"), named(x["genre"]).alias("subGenre"))).alias("classifications"),
            F.array(F.struct(F.lit("https://img.example/small").alias("url"), F.lit("16_9").alias("ratio"), F.lit(100).alias("width")),
                    F.struct(F.lit("https://img.example/square").alias("url"), F.lit("1_1").alias("ratio"), F.lit(900).alias("width")),
                    F.struct(F.lit("https://img.example/wide").alias("url"), F.lit("16_9").alias("ratio"), F.lit(640).alias("width"))).alias("images"),
            F.struct(x["adult"].alias("legalAgeEnforced")).alias("ageRestrictions"),
        )

    # What differs between events is collected; the events are made of it on their page.
    told = F.struct("id", "name", F.col("image_url").isNull().alias("plain"), "price_min", "price_max", "ticket_url", "date", _hhmm("show_min").alias("clock"),
                    "status", "artist", "genre", F.col("age_restriction").isNotNull().alias("adult"))
    pages = t.listings().groupBy("order_no").agg(F.min("venue_slug").alias("venue_slug"), F.collect_list(told).alias("told"))
    pages = pages.select("order_no", "venue_slug", F.array_sort(F.transform("told", event)).alias("events"))
    body = F.struct(F.struct("events").alias("_embedded"), F.struct(F.col("order_no").alias("number")).alias("page"))
    return pages.select("venue_slug", F.to_json(body).alias("payload"))


def _cms_feeds(t) -> DataFrame:
    price = F.when(F.col("price_min").isNotNull(), F.concat(F.lit("$"), F.floor("price_min").cast("string"))).otherwise(F.lit("at the door"))
    body = F.concat(F.lit("<div><p>"), "name", F.lit("</p><p>Tickets&nbsp;&nbsp;"), price, F.lit("<br>doors early</p></div>"))
    item = F.struct(
        F.col("name").alias("title"), F.concat(_day(), F.lit("T"), F.coalesce(_hhmm("show_min"), F.lit("00:00")), F.lit(":00Z")).alias("startDate"),
        F.when(F.col("description").isNotNull(), F.concat(F.lit("<p>"), "description", F.lit("</p>"))).alias("excerpt"), body.alias("body"),
        F.col("image_url").alias("assetUrl"), F.concat(F.lit("/events/"), "id").alias("fullUrl"),
    )
    feed = F.struct(F.array().cast("array<string>").alias("items"), F.array(item).alias("upcoming"))
    return t.listings().select("id", "venue_slug", F.lit("https://site.example/events?format=json").alias("site_url"), F.to_json(feed).alias("payload"))


def _university_feeds(t, number: int, rows: DataFrame) -> DataFrame:
    event = F.struct(
        F.col("name").alias("summary"), F.col("order_no").cast("string").alias("guid"), F.col("id").alias("recurrenceId"), F.upper("status").alias("status"),
        F.coalesce("ticket_url", F.lit(" ")).alias("link"), F.lit(str(number)).alias("description"),
        F.struct(F.col("venue_slug").alias("uid"), F.when(F.col("artist").isNull(), "None").otherwise(F.col("artist")).alias("address"),
                 F.col("genre").alias("subaddress")).alias("location"),
        F.struct(F.concat(F.date_format("date", "yyyyMMdd"), F.lit("T"), F.replace(F.coalesce(_hhmm("show_min"), F.lit("00:00")), F.lit(":"), F.lit("")), F.lit("00"))
                 .alias("unformatted"), F.when(F.col("show_min").isNull(), "true").otherwise("false").alias("allday")).alias("start"),
    )
    return rows.select("venue_slug", F.lit(number).alias("feed_no"), F.to_json(F.struct(F.array(F.struct(event.alias("event"))).alias("events"))).alias("payload"))


def _university_records(t) -> DataFrame:
    rows = t.listings()
    feeds = _university_feeds(t, 0, rows.where("is_live_music")).unionByName(_university_feeds(t, 1, rows.where(F.col("status") != "on_sale")))
    return university.united(university.feed_records(feeds))


def _platform_results(t) -> DataFrame:
    event = F.struct(
        "id", "name", F.concat(_day(), F.lit("T00:00:00")).alias("date"), F.concat(_hhmm("doors_min"), F.lit(":00")).alias("doorTime"),
        F.when(F.col("image_url").isNotNull(), F.concat(_hhmm("show_min"), F.lit(":00"))).alias("startTime"), F.col("support_artists").alias("support"),
        F.col("image_url").alias("highlightedImage"), F.col("ticket_url").alias("ticketsUrl"), F.when(F.col("age_restriction").isNotNull(), 21).alias("minimumAge"),
    )
    return t.listings().select("venue_slug", F.to_json(F.struct(F.struct(F.array(event).alias("publicEvents")).alias("data"))).alias("payload"))


def _jsonld_pages(t) -> DataFrame:
    """Each listing on its own page; the shape of the polymorphic fields follows its status."""
    status = F.col("status")
    start = F.when(F.col("show_min").isNull(), _day()).otherwise(F.concat(_day(), F.lit("T"), _hhmm("show_min"), F.lit(":00-04:00")))
    pick = lambda a, b, c: F.when(status == "on_sale", a).when(status == "sold_out", b).otherwise(c)
    js = lambda **f: F.to_json(F.struct(*[v.alias(k) for k, v in f.items()]))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    person, genre = js(name=F.col("artist")), js(name=F.col("genre"))
    dollars = F.floor("price_min").cast("string")
    offer = F.concat(F.lit('{"url":'), F.coalesce(quoted(F.col("ticket_url")), F.lit("null")), F.lit(',"price":'),
                     pick(F.coalesce(dollars, F.lit("null")), F.coalesce(quoted(F.concat(F.lit("$"), dollars)), F.lit("null")), F.lit("0")), F.lit("}"))
    image = F.coalesce(quoted(F.col("image_url")), F.lit('""'))
    doc = F.concat(
        F.lit('{"@type":'), pick(F.lit('"MusicEvent"'), F.lit('["Thing","Event"]'), F.lit('"Event"')), F.lit(',"name":'), quoted(F.col("name")),
        F.lit(',"startDate":'), quoted(start), F.lit(',"performer":'), pick(F.concat(F.lit("["), person, F.lit(","), genre, F.lit("]")), person, F.lit('"solo"')),
        F.lit(',"offers":'), pick(offer, F.concat(F.lit("["), offer, F.lit("]")), offer), F.lit(',"image":'),
        pick(image, F.concat(F.lit("["), image, F.lit("]")), F.concat(F.lit('{"url":'), image, F.lit("}"))), F.lit(',"description":"<p>About '), "name",
        F.lit('</p>","doorTime":"7:30 PM","eventStatus":'), pick(F.lit('"Scheduled"'), F.lit('"Scheduled"'), F.lit('"https://schema.org/EventCancelled"')),
        F.lit(',"url":"https://own.example/'), "id", F.lit('"}'),
    )
    block = F.when(F.col("artist").isNull(), F.concat(F.lit("["), doc, F.lit("]"))).otherwise(doc)
    html = F.concat(F.lit('<html><head><script>var a={};</script><script type="application/ld+json">'), block, F.lit("</script></head><p>x</p></html>"))
    return t.listings().select("id", "venue_slug", F.concat(F.lit("https://page.example/"), "id").alias("url"), html.alias("html"))


def _jsonld(t, dialect: str) -> DataFrame:
    return jsonld.jsonld_listings(_jsonld_pages(t), dialect, AS_OF, ("id",)).select(
        "id", "name", "date", "show_min", "doors_min", "artist", "support_artists", "price_min", "price_max", "ticket_url", "source_url", "image_url",
        "description", "status")


def _jsonld_sql(dialect: str) -> str:
    d = jsonld.DIALECTS[dialect]
    show = "nullif(show_min, 0)" if d.midnight_is_unknown else "show_min"
    low = "CASE status WHEN 'cancelled' THEN 0 ELSE floor(price_min) END" if d.prices else "NULL::DOUBLE"
    types = "true" if d.type_lists else "status <> 'sold_out'"
    page = "'https://page.example/' || id"
    words = {"html": "'About ' || name", "raw": "'<p>About ' || name || '</p>'", "none": "NULL::VARCHAR"}[d.description]
    return f"""SELECT id, name, date, {show} AS show_min, {"1170" if d.doors else "NULL::INT"} AS doors_min,
      {"CASE WHEN status = 'cancelled' OR artist IS NULL THEN name ELSE artist END" if d.performers else "name"} AS artist,
      {"CASE WHEN status = 'on_sale' THEN genre END" if d.performers else "NULL::VARCHAR"} AS support_artists,
      {low} AS price_min, {low} AS price_max,
      {f"coalesce(ticket_url, {page})" if d.ticket_from_offer else "'https://own.example/' || id"} AS ticket_url,
      {page if d.ticket_from_offer and not d.own_url_first else "'https://own.example/' || id"} AS source_url, image_url,
      {words} AS description,
      {f"CASE WHEN status = 'cancelled' THEN 'cancelled' WHEN {low} = 0 THEN 'free' ELSE 'on_sale' END" if d.prices else "'on_sale'"} AS status
      FROM listings WHERE {types}{" AND date >= '1998-06-01'" if d.drop_past else ""}"""


def _script_pages(t) -> DataFrame:
    quote = F.lit("'")
    block = F.concat(
        F.lit("{ title: '"), "name", F.lit("\\'s &amp; co', start: '"), _day(), F.coalesce(F.concat(F.lit(" "), _hhmm("show_min")), F.lit("")),
        F.lit("', end: 'later', url: 'https://cal.example/"), "id", quote,
        F.coalesce(F.concat(F.lit(", backgroundImage: '"), "image_url", quote), F.lit("")), F.lit(" }"),
    )
    pages = t.listings().groupBy("order_no").agg(F.min("venue_slug").alias("venue_slug"), F.array_join(F.array_sort(F.collect_list(block)), ", ").alias("_b"))
    return pages.select("order_no", "venue_slug", F.concat(F.lit("<script>cal({ "), F.lit("x: 1 }, events: ["), "_b", F.lit("]);</script>")).alias("html"))


def _grid_pages(t) -> DataFrame:
    link = F.concat(F.lit('<a class="c" href="/shows/'), "external_id", F.lit('/"><div>'),
                    F.coalesce(F.concat(F.lit('<img alt="f" data-src="'), "image_url", F.lit('">')), F.lit("")), F.lit("</div></a>"))
    pages = t.listings().groupBy("order_no").agg(F.array_sort(F.collect_list(F.struct("id", link.alias("link")))).alias("_l"))
    return pages.select("order_no", F.concat(F.lit('<a href="/about"><img src="https://no.example/"></a>'),
                                             F.array_join(F.transform("_l", lambda x: x["link"]), "")).alias("html"))


SERIALISED = ("id order_no venue_slug name artist support_artists date show_min doors_min price_min price_max ticket_url image_url genre subgenre status age_restriction "
              "description").split()


class Written(Tables):
    """The tables with the listings written once, for queries that read them once per source."""

    def __init__(self, t: Tables):
        super().__init__(t.spark, t.dir)
        self.rows = cut_lineage(t.listings().select(SERIALISED), "listings")

    def listings(self) -> DataFrame:
        return self.rows


def _landed(t) -> DataFrame:
    """Every kind of payload in one landing table."""
    cols = lambda kind, df, url=F.lit(None).cast("string"), feed=F.lit(0): df.select(
        F.lit(kind).alias("source_kind"), F.lit(1).cast("bigint").alias("venue_id"), "venue_slug", url.alias("url"), feed.alias("feed_no"),
        F.col("payload" if "payload" in df.columns else "html").alias("payload"))
    pages = _jsonld_pages(t)
    parts = [
        cols("ticketmaster", _ticketing_pages(t)), cols("squarespace", _cms_feeds(t), F.col("site_url")), cols("venuepilot", _platform_results(t)),
        cols("duke_bedework", _university_feeds(t, 0, t.listings())), cols("motorco", _script_pages(t), F.concat(F.lit("https://cal.example/"), F.col("order_no").cast("string"))), cols("koka_booth", pages, F.col("url")),
        cols("manual", pages, F.col("url")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _seeds(t) -> DataFrame:
    """Seeded venues: suppliers with money, in capitals, and a new one per nation."""
    rich = t.venues().where(F.col("balance") > 3000).select("slug", F.upper("name").alias("name"), "city", F.lit("large").alias("size_category"))
    new = t.table("nation").select(F.concat(F.lit("hall-"), F.lower("n_name")).alias("slug"), F.concat(F.lit("Hall "), "n_name").alias("name"),
                                   F.col("n_name").alias("city"), F.lit("small").alias("size_category"))
    return rich.unionByName(new)


ESC = r"regexp_replace(replace(replace(replace({x}, '\', '\\'), ';', '\;'), ',', '\,'), '\r\n|\r|\n', '\\n', 'g')"
CRLF = "chr(13) || chr(10)"
STAMP = ("strftime(date + (({m}) // 1440)::INT, '%Y%m%d') || 'T' || lpad((({m}) % 1440 // 60)::VARCHAR, 2, '0') || lpad((({m}) % 60)::VARCHAR, 2, '0') || '00'")
TITLE = "coalesce(nullif(artist, ''), name)"


def _entry_sql(lines: str) -> str:
    return f"concat_ws({CRLF}, {lines})"


FEED_ABOUT = f"""nullif(concat_ws(chr(10), CASE WHEN l.name <> {TITLE.replace('name', 'l.name')} THEN l.name END, 'w/ ' || support_artists,
  'Doors: ' || {CLOCK.format(m='doors_min')}, 'Show: ' || {CLOCK.format(m='show_min')}, {FEED_PRICE}, age_restriction, chr(10) || ticket_url), '')"""

FEED_SQL = f"""SELECT l.id, {_entry_sql("'BEGIN:VEVENT', 'UID:' || l.id || '@listings.example', 'DTSTAMP:19700101T000000Z', 'SUMMARY:' || "
        + ESC.format(x=TITLE.replace('name', 'l.name')) + ", CASE WHEN show_min IS NULL THEN 'DTSTART;VALUE=DATE:' || strftime(date, '%Y%m%d') ELSE 'DTSTART;TZID=America/New_York:' || "
        + STAMP.format(m='show_min') + " END, CASE WHEN show_min IS NULL THEN 'DTEND;VALUE=DATE:' || strftime(date + 1, '%Y%m%d') ELSE 'DTEND;TZID=America/New_York:' || "
        + STAMP.format(m='show_min + 180') + " END, 'LOCATION:' || " + ESC.format(x="(v.name || ', ' || v.city || ', NC')")
        + ", 'DESCRIPTION:' || " + ESC.format(x=FEED_ABOUT) + ", 'URL:' || ticket_url, 'END:VEVENT'")} AS entry
      FROM folded l JOIN venues v ON l.venue_id = v.id WHERE date >= '1998-06-01' AND duplicate_of_id IS NULL AND is_live_music"""
FAVOURITES_SQL = f"""SELECT user_id, event_id, {_entry_sql("'BEGIN:VEVENT', CASE WHEN nullif(show_min, 0) IS NULL THEN 'DTSTART;VALUE=DATE:' || strftime(date, '%Y%m%d') ELSE 'DTSTART:' || "
        + STAMP.format(m='show_min') + " END, CASE WHEN nullif(show_min, 0) IS NULL THEN 'DTEND;VALUE=DATE:' || strftime(date + 1, '%Y%m%d') ELSE 'DTEND:' || "
        + STAMP.format(m='show_min + 120') + " END, 'SUMMARY:' || " + ESC.format(x=TITLE.replace('name', 'l.name')) + ", 'LOCATION:' || "
        + ESC.format(x="(v.name || ', ' || v.city)") + ", 'DESCRIPTION:' || " + ESC.format(x="concat_ws(chr(10), v.name || ', ' || v.city, ticket_url)")
        + ", 'URL:' || ticket_url, 'UID:' || event_id || '@listings.example', 'END:VEVENT'")} AS entry
      FROM (SELECT DISTINCT user_id, event_id FROM favorites) f JOIN listings l ON l.id = f.event_id JOIN venues v ON l.venue_id = v.id"""

def _landed_pages(t) -> DataFrame:
    """The pages in the landing table, clustered by venue, and read back."""
    root = os.path.join(scratch_root(t.spark), f"landed-{uuid.uuid4().hex}")
    ticketing.land_pages(_ticketing_pages(t), root)
    return ticketing.landed_pages(t.spark, root)


ENTRIES = [
    q("ticketing_feed", "S2 S3 A10 T26", lambda t: ticketing.ticketing_listings(_landed_pages(t)).select(
        *SHOWN, "support_artists", "image_url", "subgenre", "genre", "age_restriction", "ticket_url", "price_max", "hash"),
      f"""SELECT name, date, slug AS venue_slug, id AS external_id, artist, show_min, price_min, status, CASE WHEN artist IS NOT NULL THEN genre END AS support_artists,
      'https://img.example/wide' AS image_url, genre AS subgenre, NULL::VARCHAR AS genre, age_restriction, ticket_url, CASE WHEN price_min IS NOT NULL THEN price_max END AS price_max,
      {HASH.replace('venue_slug', 'slug')} AS hash FROM (SELECT *, min(venue_slug) OVER (PARTITION BY order_no) AS slug,
        row_number() OVER (PARTITION BY order_no, lower(name), date ORDER BY length({BASE}), id) AS place FROM listings) WHERE place = 1"""),
    q("cms_feed", "S4 S5 S6", lambda t: cms.cms_listings(_cms_feeds(t), exclude_titles=["RED RING"], keep=("id",)).select(
        "id", "name", "date", "show_min", "price_min", "price_max", "status", "description", "ticket_url", "image_url"),
      """SELECT id, name, date, nullif(show_min, 0) AS show_min, p AS price_min, p AS price_max, CASE WHEN contains(lower(name), 'sold out') THEN 'sold_out'
      WHEN p = 0 THEN 'free' ELSE 'on_sale' END AS status, coalesce(description, about) AS description, 'https://site.example/events/' || id AS ticket_url, image_url FROM (
      SELECT *, CASE WHEN description IS NULL THEN floor(price_min) END AS p, 'Tickets ' || CASE WHEN price_min IS NULL THEN 'at the door'
        ELSE '$' || floor(price_min)::BIGINT END || chr(10) || 'doors early' AS about FROM listings WHERE lower(name) <> 'red ring')"""),
    q("university_feed", "S7 U1 A11 T21 T22 T23", lambda t: university.university_listings(_university_records(t)).select(
        *SHOWN, "description", "ticket_url", "source_url"),
      """SELECT name, date, venue_slug, order_no || '_' || id AS external_id, NULL::VARCHAR AS artist, show_min, NULL::DOUBLE AS price_min,
      CASE status WHEN 'cancelled' THEN 'cancelled' ELSE 'on_sale' END AS status, concat_ws(chr(10) || chr(10), artist || ', ' || genre, CASE WHEN is_live_music THEN '0' ELSE '1' END) AS description,
      ticket_url, 'https://calendar.duke.edu/show?fq=id:' || order_no AS source_url FROM listings WHERE is_live_music OR status <> 'on_sale'"""),
    q("routed_rooms", "U4", lambda t: university.routed(_university_records(t), rooms=["supplier-000000003", "supplier-000000004"])
      .select("feed_no", F.col("raw.recurrenceId").alias("id"))
      .unionByName(university.routed(_university_records(t), everything_else=True, excluded=["supplier-000000003"]).select("feed_no", F.col("raw.recurrenceId").alias("id"))),
      """SELECT CASE WHEN is_live_music THEN 0 ELSE 1 END AS feed_no, id FROM listings WHERE (is_live_music OR status <> 'on_sale') AND venue_id IN (3, 4)
      UNION ALL SELECT CASE WHEN is_live_music THEN 0 ELSE 1 END, id FROM listings WHERE (is_live_music OR status <> 'on_sale') AND venue_id <> 3"""),
    q("room_breakdown", "A12", lambda t: in_order(university.room_breakdown(_university_records(t)), "entries"),
      """SELECT *, row_number() OVER (PARTITION BY entries ORDER BY room)::INT AS place FROM (SELECT coalesce(artist, '(no location)') AS room, count(*) AS entries
      FROM listings WHERE is_live_music OR status <> 'on_sale' GROUP BY 1)"""),
    q("platform_rows", "S8 T17", lambda t: platform.platform_listings(_platform_results(t)).select(
        "external_id", "name", "date", "show_min", "doors_min", "support_artists", "image_url", "ticket_url", "age_restriction"),
      """SELECT id AS external_id, name, date, s AS show_min, CASE WHEN s IS DISTINCT FROM doors_min THEN doors_min END AS doors_min, support_artists, image_url, ticket_url, age_restriction
      FROM (SELECT *, coalesce(CASE WHEN image_url IS NOT NULL THEN show_min END, doors_min) AS s FROM listings)"""),
    *[q(f"jsonld_{name}", "S9 S10", lambda t, kind=kind: _jsonld(t, kind), _jsonld_sql(kind)) for name, kind in (
        ("venue_sites", "mec"), ("calendar_sites", "tribe_events"), ("organizer_pages", "tickpick_organizer"), ("amphitheatre_pages", "koka_booth"))],
    q("script_calendar", "S11 T28", lambda t: scripts.script_listings(_script_pages(t), AS_OF, ("order_no",)).select(
        "order_no", "name", "date", "show_min", "ticket_url", "image_url"),
      """SELECT order_no, name || '''s & co' AS name, date, nullif(show_min, 0) AS show_min, 'https://cal.example/' || id AS ticket_url, image_url FROM (
      SELECT *, row_number() OVER (PARTITION BY order_no, name, date, show_min ORDER BY '{ title: ''' || name || '\\''s &amp; co'', start: ''' || strftime(date, '%Y-%m-%d')
        || coalesce(' ' || lpad((show_min // 60)::VARCHAR, 2, '0') || ':00', '') || ''', end: ''later'', url: ''https://cal.example/' || id) AS place FROM listings
      WHERE date >= '1998-06-01') WHERE place = 1"""),
    q("grid_images", "S12", lambda t: grids.with_images(
        t.listings().select("id", "order_no", F.col("external_id").alias("slug")), grids.images_by_slug(_grid_pages(t), "/shows/", "order_no"), "order_no")
      .select("id", "slug", "image_url"),
      """SELECT l.id, l.external_id AS slug, i.image_url FROM listings l LEFT JOIN (SELECT external_id, arg_min(image_url, id) AS image_url FROM listings
      WHERE image_url IS NOT NULL GROUP BY 1) i ON l.external_id = i.external_id"""),
    q("leading_ages", "T27", lambda t: grids.with_leading_age(t.listings().select(
        "id", F.concat(F.coalesce(F.concat(F.lit("("), F.substring("age_restriction", 1, 3), F.lit(") ")), F.lit("")), "name").alias("name"))),
      "SELECT id, name, age_restriction FROM listings"),
    q("same_night_sets", "W6", lambda t: common.separate_same_night_sets(t.scraped().select("id", "venue_slug", "date", "name", "show_min", "hash")).select("id", "name", "hash"),
      f"""SELECT id, name, {HASH} AS hash FROM (SELECT s.id, s.venue_slug, s.date, s.name || CASE WHEN n > 1 AND n = timed AND n = kinds THEN ' (' || lower({CLOCK.format(m='show_min')}) || ')' ELSE '' END AS name
      FROM scraped s JOIN (SELECT hash, count(*) AS n, count(show_min) AS timed, count(DISTINCT show_min) AS kinds FROM scraped GROUP BY 1) g ON s.hash = g.hash)"""),
    q("first_by_hash", "W7", lambda t: common.first_by_hash(t.scraped(), [F.col("pos").asc()]).select("id", "hash"),
      "SELECT min(id) AS id, hash FROM scraped GROUP BY hash"),
    q("combined_lists", "U2", lambda t: common.combined(t.scraped().select("pos", "hash", "name"), t.hashed().select(F.col("id").alias("pos"), "hash", "name")),
      """SELECT pos, hash, name FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY src, pos) AS place FROM (
      SELECT pos, hash, name, 0 AS src FROM scraped UNION ALL SELECT id, hash, name, 1 FROM hashed)) WHERE place = 1"""),
    q("landed_by_source", "S20", lambda t: registry.parse_landed(_landed(Written(t)), AS_OF).groupBy("source").agg(F.count(F.lit(1)).alias("listings"), F.min("date").alias("first_day")),
      f"""SELECT source, count(*) AS listings, min(date) AS first_day FROM (
      SELECT 'ticketmaster' AS source, date FROM (SELECT DISTINCT order_no, lower(name), date FROM listings)
      UNION ALL SELECT unnest(['squarespace', 'venuepilot', 'duke_bedework']), date FROM listings
      UNION ALL SELECT 'motorco', date FROM (SELECT DISTINCT order_no, name, date, show_min FROM listings WHERE date >= '1998-06-01')
      UNION ALL SELECT 'koka_booth', date FROM listings WHERE status <> 'sold_out') GROUP BY 1"""),
    q("unreadable_sources", "S20", lambda t: registry.unreadable(_landed(t)).groupBy("source_kind").agg(F.count(F.lit(1)).alias("payloads")),
      "SELECT 'manual' AS source_kind, count(*) AS payloads FROM listings"),
    q("seeded_venues", "S14", lambda t: sinks.upserted_venues(t.venues(), _seeds(t), ["supplier-000000001"]).select("slug", "name", "city", "size_category", "source_kind"),
      """SELECT coalesce(v.slug, s.slug) AS slug, coalesce(s.name, v.name) AS name, coalesce(s.city, v.city) AS city, coalesce(s.size_category, v.size_category) AS size_category,
      v.source_kind FROM (SELECT * FROM venues WHERE slug <> 'supplier-000000001') v FULL JOIN (SELECT slug, upper(name) AS name, city, 'large' AS size_category FROM venues
      WHERE balance > 3000 UNION ALL SELECT 'hall-' || lower(n_name), 'Hall ' || n_name, n_name, 'small' FROM nation) s ON v.slug = s.slug"""),
    q("calendar_json", "S17", lambda t: sinks.calendar_json(filters.upcoming(t.listings(), AS_OF), t.venues()).select(
        "id", F.get_json_object("json", "$.title").alias("title"), F.get_json_object("json", "$.details.venue_city").alias("city"),
        F.get_json_object("json", "$.details.show_time").alias("show_time"), F.get_json_object("json", "$.start").alias("start")),
      f"""SELECT l.id, {TITLE.replace('name', 'l.name')} AS title, v.city, {CLOCK.format(m='show_min')} AS show_time, strftime(date, '%Y-%m-%d') AS start
      FROM listings l JOIN venues v ON l.venue_id = v.id WHERE date >= '1998-06-01'"""),
    q("subscription_feed", "S18 T33 T36", lambda t: sinks.feed_entries(t.folded(), t.venues(), AS_OF).select("id", "entry"),
      FEED_SQL),
    q("favourites_export", "S19 T36", lambda t: sinks.export_entries(visitor.saved_events(t.favorites(), t.listings(), t.venues())),
      FAVOURITES_SQL),
    q("subscription_file", "S18", lambda t: sinks.calendar_sections(sinks.feed_entries(t.folded(), t.venues(), AS_OF), "Listings").select("section", "id", "entry"),
      f"""SELECT 1 AS section, id, entry FROM ({FEED_SQL}) UNION ALL SELECT 2, NULL, 'END:VCALENDAR' UNION ALL SELECT 0, NULL, {_entry_sql(
        "'BEGIN:VCALENDAR', 'VERSION:2.0', 'PRODID:-//listings//calendar//EN', 'CALSCALE:GREGORIAN', 'METHOD:PUBLISH', 'X-WR-CALNAME:Listings', 'NAME:Listings', "
        "'REFRESH-INTERVAL;VALUE=DURATION:PT6H', 'X-PUBLISHED-TTL:PT6H'")}"""),
    q("favourites_files", "S19", lambda t: sinks.user_calendars(sinks.export_entries(visitor.saved_events(t.favorites(), t.listings(), t.venues()))),
      f"""SELECT user_id, {_entry_sql("'BEGIN:VCALENDAR', 'VERSION:2.0', 'PRODID:-//listings//favourites//EN', 'CALSCALE:GREGORIAN', 'METHOD:PUBLISH', "
        "string_agg(entry, chr(13) || chr(10) ORDER BY event_id), 'END:VCALENDAR'")} || chr(13) || chr(10) AS calendar FROM ({FAVOURITES_SQL}) GROUP BY 1"""),
]
