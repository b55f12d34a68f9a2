"""Which parser reads which kind of source."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cms, jsonld, platform, scripts, ticketing, university


def _university(landed: DataFrame, as_of: dt.date) -> DataFrame:
    feeds = landed.withColumn("feed_no", F.coalesce("feed_no", F.lit(0)))
    return university.university_listings(university.united(university.feed_records(feeds)), keep=("venue_id",))


def _pages(landed: DataFrame) -> DataFrame:
    return landed.select("venue_id", "venue_slug", "url", F.col("payload").alias("html"))


PARSERS: dict[str, Callable[[DataFrame, dt.date], DataFrame]] = {
    "ticketmaster": lambda d, as_of: ticketing.ticketing_listings(d.select("venue_id", "venue_slug", "payload"), ("venue_id",)),
    "squarespace": lambda d, as_of: cms.cms_listings(
        d.select("venue_id", "venue_slug", F.col("url").alias("site_url"), "payload"), keep=("venue_id",)),
    "duke_bedework": _university,
    "venuepilot": lambda d, as_of: platform.platform_listings(d.select("venue_id", "venue_slug", "payload"), ("venue_id",)),
    "motorco": lambda d, as_of: scripts.script_listings(_pages(d), as_of, ("venue_id",)),
    **{
        kind: partial(lambda kind, d, as_of: jsonld.jsonld_listings(_pages(d), kind, as_of, ("venue_id",)), kind)
        for kind in jsonld.DIALECTS
    },
}


def parse_landed(landed: DataFrame, as_of: dt.date) -> DataFrame:
    """Every landed payload through its parser.

    ``landed``: source_kind, venue_id, venue_slug, url, feed_no, payload. Kinds without a
    parser, the hand-kept one among them, yield nothing; see :func:`unreadable`.
    """
    parts = [parse(landed.where(F.col("source_kind") == kind), as_of) for kind, parse in PARSERS.items()]
    return reduce(DataFrame.unionByName, parts)


def unreadable(landed: DataFrame) -> DataFrame:
    return landed.where(~F.col("source_kind").isin(list(PARSERS)))
