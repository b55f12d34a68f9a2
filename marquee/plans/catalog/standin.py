"""The given tables seen as listings, venues, people and decisions.

Each view exists twice, as DataFrame code and as SQL, and always covers whole tables.
A listing is a line item, its venue the supplier, its title the part's name with the
words that the part's type implies; a person is a customer, and what people decide
follows from the priority and status of their orders.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ...functions.text import identity_hash, series_key, slugify

AS_OF = dt.date(1998, 6, 1)
NOW = dt.datetime(1998, 6, 1, 12, 0, 0)
LOG_NOW = dt.datetime(2024, 1, 31, 6, 0, 0)


LATER_AS_OF = dt.date(2018, 6, 1)


def later(rows: DataFrame) -> DataFrame:
    """Twenty years on, for the rules that refuse dates before 2015."""
    rows = rows.withColumn("date", F.add_months("date", 240))
    return rows.withColumn("hash", identity_hash("venue_slug", "date", "name"))


class Tables:
    """The given tables and the views over them. Nothing is cached or collected."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def venues(self) -> DataFrame:
        acct = F.col("s_acctbal")
        return (
            self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), slugify("s_name").alias("slug"),
                F.col("n_name").alias("city"), F.col("r_name").alias("market"),
                F.when(acct < 2000, "small").when(acct < 6000, "medium").otherwise("large").alias("size_category"),
                F.when(acct < 0, "manual").when(acct < 3000, "ticketmaster").when(acct < 6000, "squarespace")
                .otherwise("mec").alias("source_kind"),
                F.concat(F.lit("#0000"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("color"), acct.alias("balance"),
            )
        )

    def _lines(self) -> DataFrame:
        """Line items with their part: what listings are made of."""
        return self.table("lineitem").join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))

    @staticmethod
    def _listing() -> list[Column]:
        """The columns of a listing, made of those of a line item and its part. The two ids come first."""
        kind, part = F.col("p_type"), F.col("p_name")
        name = (
            F.when(kind == "PROMO", F.concat(part, F.lit(" release party")))
            .when(kind == "ECONOMY", F.concat(F.lit("[LATE] "), part))
            .when(kind == "MEDIUM", F.concat(part, F.lit(" w/ "), F.col("p_brand")))
            .when(kind == "LARGE", F.concat(part, F.lit(" night")))
            .when(kind == "SMALL", F.concat(part, F.lit(" (Sold Out)"))).otherwise(part)
        )
        day, hour = F.col("l_shipdate").cast("date"), F.col("l_quantity").cast("int") % 24
        show = F.when(F.col("l_quantity") >= 5, hour * 60)
        text = lambda c: F.col(c).cast("string")
        return [
            F.concat_ws("-", text("l_orderkey"), text("l_linenumber"), text("l_partkey"), text("l_suppkey"), F.date_format(day, "yyyyMMdd")).alias("id"),
            F.concat_ws("-", text("l_orderkey"), text("l_linenumber")).alias("external_id"),
            F.col("l_orderkey").alias("order_no"), F.col("l_suppkey").alias("venue_id"),
            F.concat(F.lit("supplier-"), F.lpad(text("l_suppkey"), 9, "0")).alias("venue_slug"), name.alias("name"),
            F.when(F.col("p_size") > 25, F.col("p_brand")).alias("artist"),
            F.when(F.col("p_size") <= 5, F.concat_ws(", ", "p_brand", "p_type")).alias("support_artists"), day.alias("date"),
            show.alias("show_min"), F.when((F.col("l_tax") >= 0.05) & (show >= 60), show - 60).alias("doors_min"),
            F.when(F.col("l_tax") >= 0.02, F.concat(F.lit("https://tickets.example/"), text("l_orderkey"))).alias("ticket_url"),
            F.when(F.col("l_discount") >= 0.095, F.lit(None).cast("double")).when(F.col("l_discount") < 0.005, 0.0)
            .otherwise(F.col("l_extendedprice")).alias("price_min"),
            F.when(F.col("l_discount") >= 0.045, F.col("l_extendedprice") * 1.5).alias("price_max"),
            F.when(F.col("l_discount") >= 0.025, F.concat(F.lit("https://img.example/"), text("l_partkey"))).alias("image_url"),
            F.lower(kind).alias("genre"), F.when(F.col("p_size") > 40, "comedy").alias("subgenre"),
            F.when(F.col("l_returnflag") == "R", "sold_out").when(F.col("l_returnflag") == "A", "cancelled").otherwise("on_sale").alias("status"),
            F.when(F.col("l_quantity") >= 40, "21+").alias("age_restriction"),
            F.when(F.col("p_size") > 10, F.concat(part, F.lit(" by "), F.col("p_brand"))).alias("description"),
            F.lit("feed").alias("source"), F.lit(None).cast("string").alias("source_url"),
            (F.col("l_linestatus") == "O").alias("is_live_music"), (F.col("l_tax") >= 0.075).alias("is_manual_override"),
            (F.col("l_quantity") >= 48).alias("is_manually_created"), F.lit(None).cast("string").alias("classification_reason"),
            F.when(F.col("l_discount") >= 0.065, day).alias("approved_at"), F.date_sub(day, F.col("l_linenumber")).alias("updated_at"),
        ]

    def listings(self) -> DataFrame:
        return self._lines().select(*self._listing())

    def folded(self, early: bool = False) -> DataFrame:
        """Listings with ``duplicate_of_id``: a repeated source id is folded into its first row.

        The line items themselves travel to the rows of their source id; what a listing says is
        longer and made of them after that. ``early`` is for those who read ``duplicate_of_id``:
        the items travel before their id is made as well, but then whether it is read or not.
        """
        (first, source), rest = self._listing()[:2], self._listing()[2:]
        rows = self._lines().select("*", source)
        rows = (rows.repartition("external_id") if early else rows).select("*", first)
        rows = rows.withColumn("_first", F.min("id").over(Window.partitionBy("external_id")))
        return rows.select("id", "external_id", *rest, F.when(F.col("_first") != F.col("id"), F.col("_first")).alias("duplicate_of_id"))

    def hashed(self, early: bool = False) -> DataFrame:
        return self.folded(early).withColumn("hash", identity_hash("venue_slug", "date", "name"))

    def stored(self, early: bool = False) -> DataFrame:
        """The stored side of a refresh: what is sold out or called off."""
        return self.hashed(early).where(F.col("status") != "on_sale")

    def scraped(self) -> DataFrame:
        """The new batch: what is live, untaxed shows renamed. ``pos`` is the input order."""
        rows = self.listings().where("is_live_music")
        renamed = F.when(F.col("ticket_url").isNull(), F.concat("name", F.lit(" (new date)"))).otherwise(F.col("name"))
        return rows.withColumn("name", renamed).withColumn("hash", identity_hash("venue_slug", "date", "name")).withColumn("pos", F.col("id"))

    def overrides(self) -> DataFrame:
        """Series overrides at well-funded venues: live when most of the series' rows are."""
        rich = self.venues().where(F.col("balance") > 9000).select(F.col("id").alias("venue_id"))
        rows = self.listings().where(F.col("status") == "cancelled").join(rich, "venue_id", "left_semi")
        return rows.groupBy("venue_id", series_key("name").alias("normalized_name")).agg(
            (F.count_if("is_live_music") * 2 > F.count(F.lit(1))).alias("is_live_music"), F.max("date").alias("created_at"),
            F.min("name").alias("display_name"), F.min("id").alias("id"), F.lit(None).cast("string").alias("note"),
        )

    def orders(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("order_no"), F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("order_status"),
            F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").cast("date").alias("ordered"),
        )

    def _ordered(self, priority: str) -> DataFrame:
        return self.listings().join(self.orders().where(F.col("priority") == priority), "order_no")

    def series_requests(self) -> DataFrame:
        return self._ordered("3-MEDIUM").select(
            F.col("id").alias("event_id"), (F.col("order_status") == "O").alias("is_live_music"), F.col("priority").alias("note"),
            F.col("ordered").alias("decided_at"),
        )

    def verdicts(self) -> DataFrame:
        s = F.col("order_status")
        return self._ordered("1-URGENT").select(
            F.col("id").alias("event_id"), F.when(s == "F", False).when(s == "O", True).alias("is_live_music"),
            F.col("ordered").alias("decided_at"),
        )

    def approvals(self) -> DataFrame:
        s = F.col("order_status")
        return self._ordered("2-HIGH").select(
            F.col("id").alias("event_id"), (s == "P").alias("whole_series"), (s != "F").alias("approve"), F.col("ordered").alias("decided_at")
        )

    def fold_requests(self) -> DataFrame:
        """Per low-priority order: its other lines fold into its first line."""
        rows = self._ordered("5-LOW").select("order_no", "id")
        first = rows.groupBy("order_no").agg(F.min("id").alias("survivor_id"))
        return rows.join(first, "order_no").where(F.col("id") != F.col("survivor_id")).select(
            F.col("order_no").alias("request_id"), "survivor_id", F.col("id").alias("duplicate_id")
        )

    def favorites(self) -> DataFrame:
        return self._ordered("1-URGENT").select("user_id", F.col("id").alias("event_id"))

    def hidden(self) -> DataFrame:
        return self._ordered("5-LOW").select("user_id", F.col("id").alias("event_id"))

    def hidden_venues(self) -> DataFrame:
        return self._ordered("4-NOT SPECIFIED").where(F.col("status") == "sold_out").select("user_id", "venue_slug").distinct()

    def artist_entries(self) -> DataFrame:
        """Three lists per customer: brands bought urgently, brands of high priority, parts of medium priority."""
        part = self.table("lineitem").join(self.table("part"), F.col("l_partkey") == F.col("p_partkey")).join(
            self.orders(), F.col("l_orderkey") == F.col("order_no"))
        number = F.when(F.col("priority") == "1-URGENT", 1).when(F.col("priority") == "2-HIGH", 2).when(F.col("priority") == "3-MEDIUM", 3)
        return part.select(
            "user_id", F.when(number < 3, F.col("p_brand")).otherwise(F.col("p_name")).alias("artist"), number.alias("list_no"),
            F.col("order_no").alias("pos"),
        ).where(F.col("list_no").isNotNull())

    def submissions(self) -> DataFrame:
        """Shows proposed by customers with part-delivered orders."""
        s = F.col("status")
        return self.listings().join(self.orders().where(F.col("order_status") == "P"), "order_no").select(
            "id", F.concat(F.lit("customer-"), F.col("user_id").cast("string")).alias("submitted_by"), F.col("ordered").alias("submitted_at"),
            F.when(s == "on_sale", "pending").when(s == "sold_out", "approved").otherwise("rejected").alias("status"),
            "name", "date", "venue_id", "venue_slug", F.when(s == "sold_out", F.col("id")).alias("event_id"),
            "price_min", "price_max", "doors_min", "show_min", *[F.lit(None).cast("string").alias(f"new_venue_{c}") for c in ("name", "city", "website")],
        )

    def run_log(self) -> DataFrame:
        kind = F.col("event_type")
        return self.table("events").select(
            F.col("user_id").alias("venue_id"),
            F.when(kind == "error", "failed").when(kind == "signup", "running").otherwise("success").alias("status"),
            F.when(kind != "signup", F.col("ts")).alias("finished_at"), F.col("value").alias("duration_seconds"),
        )


# The same views in SQL.
HASH = ("sha256(venue_slug || '|' || strftime(date, '%Y-%m-%d') || '|' || "
        "regexp_replace(lower(regexp_replace(name, '\\b(box|boxes)\\b', '', 'gi')), '[^a-z0-9]', '', 'g'))")
KEY = "regexp_replace(lower(name), '[^a-z]', '', 'g')"

VIEWS = {
    "venues": """
  SELECT s_suppkey AS id, s_name AS name, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-')[1:100] AS slug,
    n_name AS city, r_name AS market,
    CASE WHEN s_acctbal < 2000 THEN 'small' WHEN s_acctbal < 6000 THEN 'medium' ELSE 'large' END AS size_category,
    CASE WHEN s_acctbal < 0 THEN 'manual' WHEN s_acctbal < 3000 THEN 'ticketmaster' WHEN s_acctbal < 6000 THEN 'squarespace'
      ELSE 'mec' END AS source_kind,
    '#0000' || lpad(n_nationkey::VARCHAR, 2, '0') AS color, s_acctbal AS balance
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "listings": """
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS id,
    concat_ws('-', l_orderkey, l_linenumber) AS external_id, l_orderkey AS order_no, l_suppkey AS venue_id,
    'supplier-' || lpad(l_suppkey::VARCHAR, 9, '0') AS venue_slug,
    CASE p_type WHEN 'PROMO' THEN p_name || ' release party' WHEN 'ECONOMY' THEN '[LATE] ' || p_name
      WHEN 'MEDIUM' THEN p_name || ' w/ ' || p_brand WHEN 'LARGE' THEN p_name || ' night'
      WHEN 'SMALL' THEN p_name || ' (Sold Out)' ELSE p_name END AS name,
    CASE WHEN p_size > 25 THEN p_brand END AS artist,
    CASE WHEN p_size <= 5 THEN p_brand || ', ' || p_type END AS support_artists, l_shipdate::DATE AS date,
    CASE WHEN l_quantity >= 5 THEN (l_quantity::INT % 24) * 60 END AS show_min,
    CASE WHEN l_tax >= 0.05 AND l_quantity >= 5 AND (l_quantity::INT % 24) * 60 >= 60 THEN (l_quantity::INT % 24) * 60 - 60 END AS doors_min,
    CASE WHEN l_tax >= 0.02 THEN 'https://tickets.example/' || l_orderkey END AS ticket_url,
    CASE WHEN l_discount >= 0.095 THEN NULL WHEN l_discount < 0.005 THEN 0.0::DOUBLE ELSE l_extendedprice END AS price_min,
    CASE WHEN l_discount >= 0.045 THEN l_extendedprice * 1.5::DOUBLE END AS price_max,
    CASE WHEN l_discount >= 0.025 THEN 'https://img.example/' || l_partkey END AS image_url,
    lower(p_type) AS genre, CASE WHEN p_size > 40 THEN 'comedy' END AS subgenre,
    CASE l_returnflag WHEN 'R' THEN 'sold_out' WHEN 'A' THEN 'cancelled' ELSE 'on_sale' END AS status,
    CASE WHEN l_quantity >= 40 THEN '21+' END AS age_restriction,
    CASE WHEN p_size > 10 THEN p_name || ' by ' || p_brand END AS description, 'feed' AS source,
    l_linestatus = 'O' AS is_live_music, l_tax >= 0.075 AS is_manual_override, l_quantity >= 48 AS is_manually_created,
    NULL::VARCHAR AS classification_reason, CASE WHEN l_discount >= 0.065 THEN l_shipdate::DATE END AS approved_at,
    l_shipdate::DATE - l_linenumber AS updated_at
  FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "folded": """
  SELECT *, CASE WHEN min(id) OVER (PARTITION BY external_id) <> id THEN min(id) OVER (PARTITION BY external_id) END AS duplicate_of_id
  FROM listings""",
    "hashed": f"SELECT *, {HASH} AS hash FROM folded",
    "stored": "SELECT * FROM hashed WHERE status <> 'on_sale'",
    "scraped": f"""
  SELECT *, {HASH} AS hash, id AS pos FROM (
    SELECT * REPLACE (CASE WHEN ticket_url IS NULL THEN name || ' (new date)' ELSE name END AS name) FROM listings WHERE is_live_music)""",
    "deduped": """
  SELECT scraped.* FROM scraped JOIN (
    SELECT unnest(list_reduce(list(struct_pack(p := pos, e := external_id, h := hash) ORDER BY pos),
      lambda acc, x: CASE WHEN list_contains(acc.es, x.e) OR list_contains(acc.hs, x.h) THEN acc
        ELSE struct_pack(es := list_append(acc.es, x.e), hs := list_append(acc.hs, x.h), kept := list_append(acc.kept, x.p)) END,
      {'es': []::VARCHAR[], 'hs': []::VARCHAR[], 'kept': []::VARCHAR[]}).kept) AS pos
    FROM scraped GROUP BY venue_id, date) USING (pos)""",
    "claims": """
  SELECT id, venue_id, min(pos) AS pos FROM (
    SELECT s.id, s.venue_id, n.pos FROM stored s JOIN deduped n ON s.venue_id = n.venue_id AND s.date = n.date AND s.external_id = n.external_id
    UNION ALL
    SELECT s.id, s.venue_id, n.pos FROM stored s JOIN deduped n ON s.venue_id = n.venue_id AND s.hash = n.hash) GROUP BY ALL""",
    "links": """
  SELECT id, venue_id, pos, row_number() OVER (PARTITION BY pos ORDER BY folded_row, NOT manual_row, NOT same_hash, updated_at DESC, id) = 1 AS is_survivor
  FROM (SELECT c.id, c.venue_id, c.pos, s.duplicate_of_id IS NOT NULL AS folded_row, s.is_manually_created AS manual_row,
      s.hash = n.hash AS same_hash, s.updated_at FROM claims c JOIN stored s ON c.id = s.id JOIN deduped n ON c.pos = n.pos)""",
    "plan_rows": """
  SELECT s.id, s.venue_id, l.pos, l.is_survivor, s.is_manually_created OR s.duplicate_of_id IS NOT NULL AS protected_row,
    coalesce(s.date BETWEEN DATE '1998-06-01' AND h.horizon, false) AS in_window
  FROM stored s LEFT JOIN links l ON s.id = l.id
  LEFT JOIN (SELECT venue_id, max(date) AS horizon FROM deduped GROUP BY 1) h ON s.venue_id = h.venue_id""",
    "valve": """
  SELECT *, orphans > 4 AND orphans > in_window * 0.5 AS too_lossy FROM (
    SELECT venue_id, count(*) FILTER (WHERE in_window) AS in_window,
      count(*) FILTER (WHERE in_window AND pos IS NULL AND NOT protected_row) AS orphans FROM plan_rows GROUP BY 1)""",
    "plan": """
  SELECT p.venue_id, p.id, p.pos, CASE WHEN p.is_survivor THEN 'update' WHEN p.pos IS NOT NULL AND NOT p.protected_row THEN 'superseded'
      WHEN p.in_window AND p.pos IS NULL AND NOT p.protected_row THEN CASE WHEN v.too_lossy THEN 'orphan' ELSE 'expired' END
      ELSE 'keep' END AS action FROM plan_rows p JOIN valve v USING (venue_id)
  UNION ALL SELECT venue_id, NULL, pos, 'insert' FROM deduped WHERE pos NOT IN (SELECT pos FROM links WHERE is_survivor)""",
    "overrides": f"""
  SELECT venue_id, {KEY} AS normalized_name, count(*) FILTER (WHERE is_live_music) * 2 > count(*) AS is_live_music,
    max(date) AS created_at, min(name) AS display_name, min(id) AS id, NULL::VARCHAR AS note
  FROM listings WHERE status = 'cancelled' AND venue_id IN (SELECT id FROM venues WHERE balance > 9000) GROUP BY 1, 2""",
    "orders_by": """
  SELECT o_orderkey AS order_no, o_custkey AS user_id, o_orderstatus AS order_status, o_orderpriority AS priority,
    o_orderdate::DATE AS ordered FROM orders""",
    "series_requests": """
  SELECT id AS event_id, order_status = 'O' AS is_live_music, priority AS note, ordered AS decided_at
  FROM listings JOIN orders_by USING (order_no) WHERE priority = '3-MEDIUM'""",
    "verdicts": """
  SELECT id AS event_id, CASE order_status WHEN 'F' THEN false WHEN 'O' THEN true END AS is_live_music, ordered AS decided_at
  FROM listings JOIN orders_by USING (order_no) WHERE priority = '1-URGENT'""",
    "approvals": """
  SELECT id AS event_id, order_status = 'P' AS whole_series, order_status <> 'F' AS approve, ordered AS decided_at
  FROM listings JOIN orders_by USING (order_no) WHERE priority = '2-HIGH'""",
    "fold_requests": """
  SELECT order_no AS request_id, survivor_id, id AS duplicate_id FROM (
    SELECT order_no, id, min(id) OVER (PARTITION BY order_no) AS survivor_id
    FROM listings JOIN orders_by USING (order_no) WHERE priority = '5-LOW') WHERE id <> survivor_id""",
    "favorites": "SELECT user_id, id AS event_id FROM listings JOIN orders_by USING (order_no) WHERE priority = '1-URGENT'",
    "hidden": "SELECT user_id, id AS event_id FROM listings JOIN orders_by USING (order_no) WHERE priority = '5-LOW'",
    "hidden_venues": """
  SELECT DISTINCT user_id, venue_slug FROM listings JOIN orders_by USING (order_no)
  WHERE priority = '4-NOT SPECIFIED' AND status = 'sold_out'""",
    "artist_entries": """
  SELECT * FROM (SELECT user_id, CASE WHEN priority IN ('1-URGENT', '2-HIGH') THEN p_brand ELSE p_name END AS artist,
    CASE priority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 END AS list_no, order_no AS pos
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders_by ON l_orderkey = order_no) WHERE list_no IS NOT NULL""",
    "submissions": """
  SELECT id, 'customer-' || user_id AS submitted_by, ordered AS submitted_at,
    CASE status WHEN 'on_sale' THEN 'pending' WHEN 'sold_out' THEN 'approved' ELSE 'rejected' END AS status,
    name, date, venue_id, venue_slug, CASE WHEN status = 'sold_out' THEN id END AS event_id, price_min, price_max, doors_min, show_min
  FROM listings JOIN orders_by USING (order_no) WHERE order_status = 'P'""",
    "stored_later": f"SELECT *, {HASH} AS hash FROM (SELECT * EXCLUDE (hash) REPLACE ((date + INTERVAL 240 MONTH)::DATE AS date) FROM stored)",
    "scraped_later": f"SELECT *, {HASH} AS hash FROM (SELECT * EXCLUDE (hash) REPLACE ((date + INTERVAL 240 MONTH)::DATE AS date) FROM scraped)",
    "submissions_later": f"SELECT *, {HASH} AS hash FROM (SELECT * REPLACE ((date + INTERVAL 240 MONTH)::DATE AS date) FROM submissions)",
    "run_log": """
  SELECT user_id AS venue_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'running' ELSE 'success' END AS status,
    CASE WHEN event_type <> 'signup' THEN ts END AS finished_at, value AS duration_seconds FROM events""",
}


def _needs(text: str, found: list[str]) -> None:
    for name in VIEWS:
        if name not in found and re.search(rf"\b{name}\b", text):
            _needs(VIEWS[name], found)
            if name not in found:
                found.append(name)


def sql_with(body: str) -> str:
    """``body`` preceded by the views it mentions, in order of need."""
    found: list[str] = []
    _needs(body, found)
    order = [n for n in VIEWS if n in found]
    if not order:
        return body.strip()
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order) + "\n" + body.strip()
