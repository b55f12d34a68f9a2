"""The refresh: a new batch becomes the next stored table."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.classify import reclassify_written
from ..operators.linkage import apply_plan, dedupe_batch, merge_plan, outcome_counts
from ..session import cut_lineage


@dataclass
class Refreshed:
    table: DataFrame       # the next stored table, verdicts included
    plan: DataFrame        # one row per stored or new row with its action
    outcomes: DataFrame    # created, updated, merged, expired per venue


def refresh(stored: DataFrame, scraped: DataFrame, venues: DataFrame, overrides: DataFrame | None,
            as_of: dt.date, now: dt.datetime) -> Refreshed:
    """Dedupe the batch, plan, apply, reclassify. An empty batch changes nothing but verdicts.

    The deduped batch and the next table are read several times, so each is written once.
    """
    batch = cut_lineage(dedupe_batch(scraped), "batch")
    plan = merge_plan(stored, batch, as_of)
    table = cut_lineage(apply_plan(stored, batch, plan, now), "applied")
    judged = reclassify_written(table, as_of, overrides, venues).select(*stored.columns)
    return Refreshed(judged, plan, outcome_counts(plan))
