"""Row selections. Each is a plain predicate, so it reaches the scan."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import MANUAL_KIND

# Fixed value: how far behind today verdicts are still revised.
PAST_DAYS = 30


def _bound(text: str | None) -> dt.date | None:
    """The date in the first ten characters; None when it is missing or malformed."""
    try:
        return dt.date.fromisoformat(text[:10]) if text else None
    except ValueError:
        return None


def date_window(df: DataFrame, start: str | None = None, end: str | None = None, column: str = "date") -> DataFrame:
    """Inclusive range. A malformed bound is ignored."""
    lo, hi = _bound(start), _bound(end)
    if lo:
        df = df.where(F.col(column) >= F.lit(lo))
    if hi:
        df = df.where(F.col(column) <= F.lit(hi))
    return df


def listed_in(column: str, csv: str) -> Column:
    """Membership in a comma-separated list; spaces around the parts are ignored."""
    return F.col(column).isin([p.strip() for p in csv.split(",")])


def unfolded(df: DataFrame) -> DataFrame:
    """Without the rows folded into another one. There is no way to opt in."""
    return df.where(F.col("duplicate_of_id").isNull())


def title_search(term: str) -> Column:
    """Case-insensitive match on name or artist; ``%`` and ``_`` in the term stay wildcards."""
    return F.col("name").ilike(f"%{term}%") | F.col("artist").ilike(f"%{term}%")


def live_only(df: DataFrame, include_non_music: bool = False) -> DataFrame:
    return df if include_non_music else df.where(F.col("is_live_music"))


def upcoming(df: DataFrame, as_of: dt.date) -> DataFrame:
    return df.where(F.col("date") >= F.lit(as_of))


def revision_floor(as_of: dt.date) -> dt.date:
    return as_of - dt.timedelta(days=PAST_DAYS)


def list_filter(df: DataFrame, *, start: str | None = None, end: str | None = None, search: str | None = None,
                genre: str | None = None, status: str | None = None, include_non_music: bool = False) -> DataFrame:
    """The selection behind the paged list."""
    df = date_window(unfolded(df), start, end)
    if search:
        df = df.where(title_search(search))
    if genre:
        df = df.where(F.col("genre").ilike(f"%{genre}%"))
    if status:
        df = df.where(F.col("status") == status)
    return live_only(df, include_non_music)


def moderation_base(df: DataFrame, as_of: dt.date, view: str = "non_live", search: str | None = None,
                    future_only: bool = False, manual_only: bool = False) -> DataFrame:
    """The moderation queue before the approval filter. ``view``: non_live, live or all."""
    df = df.where(F.col("date") >= F.lit(as_of if future_only else revision_floor(as_of)))
    if view == "non_live":
        df = df.where(~F.col("is_live_music"))
    elif view == "live":
        df = df.where(F.col("is_live_music"))
    elif view != "all":
        raise ValueError(f"view must be non_live, live or all, not {view!r}")
    if search:
        df = df.where(title_search(search))
    if manual_only:
        df = df.where(F.col("is_manually_created"))
    return df


def moderation_queue(df: DataFrame, as_of: dt.date, show_approved: bool = False, **base) -> DataFrame:
    df = moderation_base(df, as_of, **base)
    return df if show_approved else df.where(F.col("approved_at").isNull())


def refreshable_venues(venues: DataFrame, kinds: Sequence[str] | None = None,
                       exclude: Sequence[str] | None = None) -> DataFrame:
    """Venues with a source. Hand-kept venues never qualify, even when named."""
    venues = venues.where(F.col("source_kind") != MANUAL_KIND)
    if kinds:
        venues = venues.where(F.col("source_kind").isin(list(kinds)))
    if exclude:
        venues = venues.where(~F.col("source_kind").isin(list(exclude)))
    return venues


def by_id(df: DataFrame, event_id) -> DataFrame:
    """One listing by id; a folded row counts as not found."""
    return unfolded(df.where(F.col("id") == F.lit(event_id)))


def venue_text_keeps(column: str, needle: str | None = None, banned: str | None = None) -> Column:
    """Whether a row's venue text holds ``needle`` and not ``banned``; no text means no."""
    from ..functions.text import fold_apostrophes

    text = F.lower(fold_apostrophes(column))
    keep = F.col(column).isNotNull()
    if needle:
        keep = keep & text.contains(needle.lower())
    if banned:
        keep = keep & ~text.contains(banned.lower())
    return F.coalesce(keep, F.lit(False))


def page(df: DataFrame, page_no: int = 1, per_page: int = 50) -> DataFrame:
    """One page by date; ``id`` settles ties.

    The rows of each day are counted first (one number per calendar day reaches the driver), so only
    the days a page touches are read again, by a filter on the date that the scan takes, and sorted.
    """
    if page_no < 1 or not 1 <= per_page <= 200:
        raise ValueError("page_no starts at 1 and per_page is 1 to 200")
    first, last = (page_no - 1) * per_page, page_no * per_page
    before, skip, days = 0, 0, []
    for day, n in df.groupBy("date").agg(F.count(F.lit(1))).orderBy("date").collect():
        if before < last and before + n > first:
            skip = skip if days else first - before
            days.append(day)
        before += n
    if not days:
        return df.limit(0)
    dated = [d for d in days if d is not None]
    touched = F.col("date").between(F.lit(dated[0]), F.lit(dated[-1])) if dated else F.lit(False)
    if None in days:
        touched = touched | F.col("date").isNull()
    return df.where(touched).orderBy("date", "id").offset(skip).limit(per_page)


def page_totals(df: DataFrame, per_page: int = 50) -> DataFrame:
    """One row: ``total`` and ``pages``."""
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.ceil(F.col("total") / F.lit(per_page)).cast("bigint").alias("pages")
    )


def capped(df: DataFrame, limit: int, *order: Column | str) -> DataFrame:
    """The first ``limit`` rows (1 to 5000) in a given order; count them all with :func:`page_totals`."""
    if not 1 <= limit <= 5000:
        raise ValueError("limit is 1 to 5000")
    return df.orderBy(*order).limit(limit)
