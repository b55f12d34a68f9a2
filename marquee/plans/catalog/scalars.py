"""Text, price, time and date rules over whole columns of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import arrow, moneytime as m, text
from .entry import q
from .standin import AS_OF

def _stub(t):
    """Line items with the strings a venue page would show for them."""
    li = t.table("lineitem")
    hour = F.col("l_quantity").cast("int") % 12 + 1
    dollars = F.concat(F.lit("$"), F.floor("l_extendedprice").cast("string"))
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").cast("date").alias("date"), "l_quantity", "l_extendedprice",
        F.when(F.col("l_returnflag") == "A", "Free entry").when(F.col("l_returnflag") == "N", F.concat(dollars, F.lit(" - "), dollars, F.lit(".50")))
        .otherwise(F.concat(F.lit("from "), dollars, F.lit(" adv"))).alias("price_text"),
        # odd lines as pages write them, with no-break spaces and a show time that is read
        F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit("Doors:\u00a0"), hour.cast("string"), F.lit("\u00a0PM / Show:\u00a0"), hour.cast("string"), F.lit(":30\u00a0PM")))
        .otherwise(F.concat(F.lit("Doors: "), hour.cast("string"), F.lit(" PM / Show: "), hour.cast("string"), F.lit(":30 p.m."))).alias("times_text"),
        F.concat(hour.cast("string"), F.lit(":"), F.lpad((F.col("l_linenumber") * 8).cast("string"), 2, "0"), F.lit("\u00a0am")).alias("clock_text"),
    )


KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "date"]
STUB = f"""(SELECT *, l_shipdate::DATE AS date, l_quantity::INT % 12 + 1 AS h FROM lineitem)"""

ENTRIES = [
    q("clean_titles", "T1", lambda t: t.table("documents").select("doc_id", arrow.clean_title("text").alias("title"))),
    q("page_text", "T3", lambda t: arrow.html_text_table(t.table("pages"), "page_id")),
    q("page_addresses", "T2 F16", lambda t: t.table("pages").select("page_id", text.http_url("url").alias("address")),
      r"SELECT page_id, CASE WHEN regexp_matches(trim(url), '^(?i)https?://') THEN trim(url) END AS address FROM pages"),
    q("identity_hashes", "T4", lambda t: t.hashed().select("id", "hash"), "SELECT id, hash FROM hashed"),
    q("grouping_keys", "T5 T6", lambda t: t.table("documents").select(
        "doc_id", text.series_key("text").alias("series_key"), text.display_label("text", "lang").alias("label")),
      """SELECT doc_id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS series_key,
      regexp_replace(lower(coalesce(nullif(text, ''), lang)), '[^a-z0-9]', '', 'g') AS label FROM documents"""),
    q("similarity_forms", "T7", lambda t: t.table("benchmark").select("item_id", text.similarity_form("text").alias("form")),
      r"""SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[À-ɏ]', '_', 'g'), '[\(\[\{].*?[\)\]\}]', ' ', 'g'),
      '\b(late|early|first|second|1st|2nd|matinee|encore|night|show|seating|set)\b|\b(box\s*seats?|balcony|orchestra|mezzanine|standing|ga|general\s+admission)\b', ' ', 'g'),
      '[^a-z0-9]+', ' ', 'g')) AS form FROM benchmark"""),
    q("prices", "T13 T14", lambda t: _stub(t).select(*KEYS, m.parse_price("price_text").alias("price"), m.price_range("price_text")["lo"].alias("lo"),
                                                      m.price_range("price_text")["hi"].alias("hi")),
      f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, date, CASE WHEN l_returnflag <> 'A' THEN floor(l_extendedprice) END AS price,
      CASE WHEN l_returnflag = 'A' THEN 0 ELSE floor(l_extendedprice) END AS lo,
      CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN floor(l_extendedprice) + 0.5 ELSE floor(l_extendedprice) END AS hi FROM {STUB}"""),
    q("clock_times", "T15 T16 T17", lambda t: _stub(t).select(
        *KEYS, m.labelled_times("times_text")["doors_min"].alias("doors_min"), m.labelled_times("times_text")["show_min"].alias("show_min"),
        m.parse_clock("clock_text").alias("clock_min"), m.parse_hms(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(":15:00"))).alias("hms_min")),
      f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, date, (CASE h WHEN 12 THEN 12 ELSE h + 12 END) * 60 AS doors_min,
      CASE WHEN l_linenumber % 2 = 1 THEN (CASE h WHEN 12 THEN 12 ELSE h + 12 END) * 60 + 30 END AS show_min,
      CASE WHEN l_linenumber * 8 < 60 THEN h % 12 * 60 + l_linenumber * 8 END AS clock_min, CASE WHEN l_quantity < 24 THEN l_quantity::INT * 60 + 15 END AS hms_min FROM {STUB}"""),
    q("written_dates", "T18", lambda t: _stub(t).select(
        *KEYS, m.parse_date_text(F.translate(F.date_format("date", "EEEE, MMMM d, yyyy"), " ", "\u00a0"), AS_OF).alias("long_date"), m.parse_date_text(F.date_format("date", "MM/dd/yyyy"), AS_OF).alias("us_date"),
        m.parse_date_text(F.date_format("date", "EEE MMM d"), AS_OF).alias("short_date"), m.parse_date_text(F.concat(F.date_format("date", "MMM d"), F.lit("th, 2026")), AS_OF).alias("ordinal_date")),
      f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, date, date AS long_date, date AS us_date,
      try_cast(strftime(date, '1998-%m-%d') AS DATE) AS short_date, try_cast(strftime(date, '2026-%m-%d') AS DATE) AS ordinal_date FROM {STUB}"""),
    q("inferred_years", "T19 T20", lambda t: _stub(t).select(
        *KEYS, m.infer_year(F.date_format("date", "d"), F.date_format("date", "MMM"), AS_OF).alias("inferred"),
        m.infer_year_by_weekday(F.date_format("date", "MMM"), F.date_format("date", "d"), F.translate(F.date_format("date", "EEEE M/d"), " ", "\u00a0"), AS_OF).alias("pinned")),
      f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, date, CASE WHEN this_year < DATE '1998-06-01' - 7 THEN next_year ELSE this_year END AS inferred,
      CASE WHEN dayofweek(this_year) = dayofweek(date) THEN this_year WHEN dayofweek(next_year) = dayofweek(date) THEN next_year
        WHEN this_year >= DATE '1998-06-01' - 7 THEN this_year ELSE next_year END AS pinned
      FROM (SELECT *, try_cast(strftime(date, '1998-%m-%d') AS DATE) AS this_year, try_cast(strftime(date, '1999-%m-%d') AS DATE) AS next_year FROM {STUB})"""),
    q("local_stamps", "T21 T24", lambda t: t.table("events").select(
        "event_id", m.local_stamp(F.date_format("ts", "yyyyMMdd'T'HHmmss")).cast("date").alias("day"),
        m.midnight_to_null(m.minutes_of(m.local_stamp(F.date_format("ts", "yyyyMMdd'T'HHmmss")))).alias("minutes")),
      "SELECT event_id, ts::DATE AS day, nullif((hour(ts) * 60 + minute(ts))::INT, 0) AS minutes FROM events"),
    q("source_statuses", "T25", lambda t: t.listings().select(
        "id", m.button_status(F.concat("status", F.lit(" "), "genre"), F.col("price_min"), F.col("price_max")).alias("button"),
        m.title_status(F.col("name"), F.col("price_min")).alias("title"), m.ticketing_status(F.when(F.col("status") == "sold_out", "offsale").otherwise(F.col("status"))).alias("code"),
        m.university_status(F.upper("status")).alias("university")),
      """SELECT id, CASE WHEN price_min = 0 AND coalesce(price_max, 0) = 0 THEN 'free' ELSE 'on_sale' END AS button,
      CASE WHEN contains(lower(name), 'sold out') THEN 'sold_out' WHEN price_min = 0 THEN 'free' ELSE 'on_sale' END AS title, status AS code,
      CASE status WHEN 'cancelled' THEN 'cancelled' ELSE 'on_sale' END AS university FROM listings"""),
    q("packaged_titles", "T26 T27 T28", lambda t: t.listings().select(
        "id", text.package_base_name(F.concat(F.lit("Add-Ons: "), "name", F.lit(" Boxes 2/27 - VIP"))).alias("base"),
        text.leading_age(F.concat(F.lit("(18+) "), "name")).alias("age"), text.without_leading_age(F.concat(F.lit("(18+) "), "name")).alias("bare"),
        text.unescape_script_text(F.concat("name", F.lit("\\'s &#8217;&amp;"))).alias("script")),
      "SELECT id, name AS base, '18+' AS age, name AS bare, name || '''s ''&' AS script FROM listings"),
    q("slugs", "T29", lambda t: t.table("documents").select("doc_id", text.slugify("text").alias("slug")),
      "SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-')[1:100] AS slug FROM documents"),
    q("redacted_text", "T34", lambda t: t.table("documents").select("doc_id", text.redact_credentials(F.replace("text", F.lit(' = "'), F.lit("="))).alias("text")),
      r"""SELECT doc_id, regexp_replace(replace(text, ' = "', '='), '(^|[^\w-])((?:[\w-]*(?:api[-_]?key|access[-_]?token|token|secret|password|signature)|sig)=)([^&\s"''<>]+)',
      '\1\2<redacted>', 'gi') AS text FROM documents"""),
    q("error_texts", "T35", lambda t: t.table("events").where(F.col("event_type") == "error").select(
        "event_id", text.describe_error(F.lit("ReadTimeout"), F.concat(F.lit("GET /f?apikey="), F.col("user_id").cast("string"), F.lit("&p="), F.col("props"))).alias("error")),
      """SELECT event_id, 'ReadTimeout: GET /f?apikey=<redacted>&p=' || props AS error FROM events WHERE event_type = 'error'"""),
    q("calendar_escapes", "T36", lambda t: t.table("documents").select("doc_id", text.ical_text("text").alias("escaped"), text.ical_uri("text").alias("uri")),
      r"""SELECT doc_id, regexp_replace(replace(replace(replace(text, '\', '\\'), ';', '\;'), ',', '\,'), '\r\n|\r|\n', '\\n', 'g') AS escaped,
      regexp_replace(text, '[\x00-\x1F\x7F]', '', 'g') AS uri FROM documents"""),
]
