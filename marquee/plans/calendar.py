"""Reads that combine several operators: the calendar and the paged list."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.display import best_per_show, calendar_rows
from ..operators.enrich import at_venues, response_rows
from ..operators.filters import date_window, list_filter, page, page_totals, unfolded


def calendar(listings: DataFrame, venues: DataFrame, *, start: str | None = None, end: str | None = None,
             city: str | None = None, size: str | None = None, slug: str | None = None) -> DataFrame:
    """Calendar tiles: window, venue choice, one row per show, by date."""
    rows = at_venues(date_window(unfolded(listings), start, end), venues, city, size, slug)
    return calendar_rows(best_per_show(rows), venues).orderBy("start", "id")


def listing_page(listings: DataFrame, venues: DataFrame, page_no: int = 1, per_page: int = 50, **choices) -> tuple[DataFrame, DataFrame]:
    """One page of the list, and its totals. The page is cut before the venue join."""
    rows = list_filter(listings, **choices)
    return response_rows(page(rows, page_no, per_page), venues).orderBy("date", "id"), page_totals(rows, per_page)
