"""Writing tables and feeds."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.moneytime import feed_description
from ..functions.text import blank_to_null, first_nonblank, ical_text, ical_uri
from ..operators.display import calendar_rows
from ..operators.enrich import at_venues, with_venue
from ..operators.filters import live_only, unfolded, upcoming
from .versions import current, publish, versions  # noqa: F401 - the sinks of tables

ZONE = "America/New_York"
CRLF = "\r\n"


def upserted_venues(venues: DataFrame, seeds: DataFrame, discontinued: Sequence[str] = ()) -> DataFrame:
    """Venues after seeding by slug: every seeded field overwritten, new slugs added, discontinued ones gone."""
    given = [c for c in seeds.columns if c != "slug"]
    new = seeds.select("slug", F.lit(True).alias("_seeded"), *[F.col(c).alias(f"_seed_{c}") for c in given])
    rows = venues.where(~F.col("slug").isin(list(discontinued))) if discontinued else venues
    rows = rows.join(new, "slug", "full")
    out = []
    for f in venues.schema:
        if f.name in given:
            c = F.when(F.col("_seeded"), F.col(f"_seed_{f.name}")).otherwise(F.col(f.name))
        elif f.name == "id":
            c = F.coalesce(F.col("id"), F.xxhash64("slug"))
        else:
            c = F.col(f.name)
        out.append(c.cast(f.dataType).alias(f.name))
    return rows.select(*out)


def append_run_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


# --- feeds ---

def calendar_json(listings: DataFrame, venues: DataFrame) -> DataFrame:
    """One JSON document per tile, as ``(id, json)``."""
    rows = calendar_rows(listings, venues)
    return rows.select("id", F.to_json(F.struct(*rows.columns)).alias("json"))


def _stamp(day: Column, minutes: Column) -> Column:
    """Local ``yyyyMMddTHHmm00``; minutes may run past midnight."""
    date = F.date_add(day, F.floor(minutes / 1440).cast("int"))
    m = minutes % 1440
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    return F.concat(F.date_format(date, "yyyyMMdd"), F.lit("T"), two(m / 60), two(m % 60), F.lit("00"))


def _when(day: Column, minutes: Column, hours: int, zone: str | None) -> list[Column]:
    tz = f";TZID={zone}" if zone else ""
    plain = lambda d: F.date_format(d, "yyyyMMdd")
    timed = minutes.isNotNull()
    start = F.when(timed, F.concat(F.lit(f"DTSTART{tz}:"), _stamp(day, minutes))).otherwise(F.concat(F.lit("DTSTART;VALUE=DATE:"), plain(day)))
    end = F.when(timed, F.concat(F.lit(f"DTEND{tz}:"), _stamp(day, minutes + hours * 60))).otherwise(
        F.concat(F.lit("DTEND;VALUE=DATE:"), plain(F.date_add(day, 1)))
    )
    return [start, end]


def _line(name: str, value: Column) -> Column:
    return F.when(blank_to_null(value).isNotNull(), F.concat(F.lit(name + ":"), value))


def feed_entries(listings: DataFrame, venues: DataFrame, as_of: dt.date, *, slug: str | None = None,
                 include_non_music: bool = False, uid_domain: str = "listings.example", region: str = "NC",
                 stamp: str = "19700101T000000Z", zone: str = ZONE) -> DataFrame:
    """Subscription feed, one calendar entry per row as ``(id, date, entry)``.

    A timed show starts at local time and runs three hours; an untimed one fills its day.
    """
    rows = live_only(unfolded(upcoming(listings, as_of)), include_non_music)
    rows = with_venue(at_venues(rows, venues, slug=slug), venues)
    summary = first_nonblank("artist", "name")
    place = F.when(F.col("venue_name").isNotNull(), F.concat_ws(", ", "venue_name", "venue_city", F.lit(region)))
    about = feed_description(
        F.col("name"), summary, F.col("support_artists"), F.col("doors_min"), F.col("show_min"), F.col("price_min"),
        F.col("price_max"), F.col("age_restriction"), F.col("ticket_url"),
    )
    lines = F.concat_ws(
        CRLF, F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col("id").cast("string"), F.lit(f"@{uid_domain}")),
        F.lit(f"DTSTAMP:{stamp}"), _line("SUMMARY", ical_text(summary)), *_when(F.col("date"), F.col("show_min"), 3, zone),
        _line("LOCATION", ical_text(place)), _line("DESCRIPTION", ical_text(about)), _line("URL", ical_uri("ticket_url")),
        F.lit("END:VEVENT"),
    )
    return rows.select("id", "date", lines.alias("entry"))


def export_entries(saved: DataFrame, uid_domain: str = "listings.example") -> DataFrame:
    """A visitor's export as ``(user_id, event_id, entry)``: floating local time, two hours, midnight untimed.

    ``saved`` is the output of ``visitor.saved_events``.
    """
    minutes = F.nullif(F.col("show_min"), F.lit(0))
    place = F.concat_ws(", ", blank_to_null("venue_name"), blank_to_null("venue_city"))
    about = F.concat_ws("\n", blank_to_null(place), blank_to_null("ticket_url"))
    lines = F.concat_ws(
        CRLF, F.lit("BEGIN:VEVENT"), *_when(F.to_date("date"), minutes, 2, None),
        F.concat(F.lit("SUMMARY:"), ical_text("title")), _line("LOCATION", ical_text(place)),
        _line("DESCRIPTION", ical_text(about)), _line("URL", ical_uri("ticket_url")),
        F.concat(F.lit("UID:"), F.col("event_id").cast("string"), F.lit(f"@{uid_domain}")), F.lit("END:VEVENT"),
    )
    return saved.select("user_id", "event_id", lines.alias("entry"))


def calendar_sections(entries: DataFrame, name: str, product: str = "-//listings//calendar//EN", refresh_hours: int = 6) -> DataFrame:
    """A whole calendar file as ``(section, date, id, entry)``: the header once, the entries, the end once."""
    head = [
        "BEGIN:VCALENDAR", "VERSION:2.0", f"PRODID:{product}", "CALSCALE:GREGORIAN", "METHOD:PUBLISH", f"X-WR-CALNAME:{name}", f"NAME:{name}",
        f"REFRESH-INTERVAL;VALUE=DURATION:PT{refresh_hours}H", f"X-PUBLISHED-TTL:PT{refresh_hours}H",
    ]
    body = entries.select(F.lit(1).alias("section"), "date", F.col("id").cast("string").alias("id"), "entry")
    ends = entries.sparkSession.createDataFrame(
        [(0, None, None, CRLF.join(head)), (2, None, None, "END:VCALENDAR")], "section int, date date, id string, entry string"
    )
    return ends.unionByName(body)


def write_feed(entries: DataFrame, path: str, name: str) -> None:
    """One calendar as text: range-sorted parts that make a valid file when joined in the order of their names."""
    whole = calendar_sections(entries, name).orderBy("section", "date", "id")
    whole.select("entry").write.mode("overwrite").option("lineSep", CRLF).text(path)


def user_calendars(entries: DataFrame, product: str = "-//listings//favourites//EN") -> DataFrame:
    """A calendar per visitor as ``(user_id, calendar)``; as long as the visitor's favourites."""
    head = CRLF.join(["BEGIN:VCALENDAR", "VERSION:2.0", f"PRODID:{product}", "CALSCALE:GREGORIAN", "METHOD:PUBLISH"])
    each = entries.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "entry"))).alias("e"))
    lines = F.concat(F.array(F.lit(head)), F.transform("e", lambda x: x["entry"]), F.array(F.lit("END:VCALENDAR")))
    return each.select("user_id", F.concat(F.array_join(lines, CRLF), F.lit(CRLF)).alias("calendar"))
