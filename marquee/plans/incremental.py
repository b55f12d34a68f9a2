"""The refresh of a table in buckets: it reads and writes the buckets that a batch touches.

Linking, survivorship and the safety valve look at one venue at a time, so the buckets of the
batch's venues are enough for them. Verdicts also change elsewhere: a date that falls behind the
revision floor may end a series, and a person may override one. For that a narrow table is kept
next to the stored one: the dates of every series, in the same buckets. From it the series whose
dates, floor or override changed are known without a look at the listings; only their rows are
judged anew, and only buckets in which a verdict did change are written. The result is the table
that :func:`marquee.plans.refresh.refresh` gives.

Beside ``v=<n>`` of the stored table, its root holds ``series`` (the dates) and ``judged`` (the
floor, overrides and exempt venues of the last refresh) under the same version number. Where one
is missing, because another writer made the version, everything is judged and counted anew.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import series_key
from ..operators.classify import ALWAYS_LIVE_VENUES, reclassify, reclassify_written
from ..operators.filters import revision_floor
from ..operators.linkage import apply_plan, dedupe_batch, merge_plan, outcome_counts
from ..operators.series import RECURRENCE_THRESHOLD, occasions
from ..session import cut_lineage
from ..sources.versions import BUCKETS, Buckets, newest, publish, versions
from .refresh import Refreshed

SERIES = ["venue_id", "series_key"]
VERDICT = ["is_live_music", "classification_reason", "approved_at"]


def series_days(rows: DataFrame) -> DataFrame:
    """venue_id, series_key and date of every series, once each."""
    return rows.select("venue_id", series_key("name").alias("series_key"), "date").distinct()


def _layers(venues: DataFrame, overrides: DataFrame | None, floor: dt.date, exempt_slugs: Sequence[str]) -> DataFrame:
    """What verdicts depend on beside the listings: the floor, exempt venues and overrides."""
    spark = venues.sparkSession
    kind = "kind string, venue_id {0}, series_key string, live boolean, floor date".format(venues.schema["id"].dataType.simpleString())
    rows = spark.createDataFrame([("floor", None, None, None, floor)], kind)
    exempt = venues.where(F.col("slug").isin(list(exempt_slugs))).select("id")
    rows = rows.unionByName(exempt.select(F.lit("exempt").alias("kind"), F.col("id").alias("venue_id")), allowMissingColumns=True)
    if overrides is not None:
        rows = rows.unionByName(
            overrides.select(F.lit("override").alias("kind"), "venue_id", F.col("normalized_name").alias("series_key"), F.col("is_live_music").alias("live")),
            allowMissingColumns=True,
        )
    return rows


def _moved(old: DataFrame, new: DataFrame, kind: str) -> DataFrame:
    """The lines of one kind that only one of two sets of layers has."""
    some = [x.where(F.col("kind") == kind).select("venue_id", "series_key", "live") for x in (old, new)]
    return some[0].exceptAll(some[1]).unionByName(some[1].exceptAll(some[0]))


def _doubtful(days: DataFrame, old: DataFrame, new: DataFrame, floor: dt.date) -> DataFrame:
    """Series, in whatever bucket, whose verdict may differ though their rows do not."""
    before = old.where("kind = 'floor'").first().floor
    low, high = sorted((before, floor))
    left = days.where((F.col("date") >= low) & (F.col("date") < high)).select(SERIES)
    forced = _moved(old, new, "override").select(SERIES)
    exempt = _moved(old, new, "exempt").select("venue_id").distinct()
    return left.unionByName(forced).unionByName(days.join(exempt, "venue_id", "left_semi").select(SERIES)).distinct()


def _recurring(days: DataFrame, floor: dt.date, threshold: int) -> DataFrame:
    return occasions(days.where(F.col("date") >= floor)).where((F.col("n_occasions") >= threshold) & (F.col("series_key") != ""))


def refresh_buckets(spark: SparkSession, root: str, version: int, scraped: DataFrame, venues: DataFrame, overrides: DataFrame | None,
                    as_of: dt.date, now: dt.datetime, *, buckets: int = BUCKETS, exempt_slugs: Sequence[str] = ALWAYS_LIVE_VENUES,
                    threshold: int = RECURRENCE_THRESHOLD) -> Refreshed:
    """Make ``version`` of the table under ``root`` from the newest version before it and a batch.

    ``table`` of the result is the new version, ``plan`` and ``outcomes`` cover the batch's buckets.
    A version made again from the same batch and ``now`` has the same rows.
    """
    base = newest(spark, root, version)
    if base is None:
        raise FileNotFoundError(f"no complete version under {root}")
    events, series = Buckets(spark, root, buckets=buckets), Buckets(spark, f"{root}/series", buckets=buckets)
    known = base in versions(spark, series.root) and base in versions(spark, f"{root}/judged") and events.kept_by(base) and series.kept_by(base)
    floor = revision_floor(as_of)
    layers = cut_lineage(_layers(venues, overrides, floor, exempt_slugs), "layers")
    judge = lambda rows, found: reclassify(rows, as_of, overrides, venues, exempt_slugs=exempt_slugs, threshold=threshold, series=found)

    touched = events.of(scraped) if known else set(range(buckets))
    stored = events.read(base, touched if known else None)
    batch = cut_lineage(dedupe_batch(scraped), "batch")
    plan = merge_plan(stored, batch, as_of)
    table = cut_lineage(apply_plan(stored, batch, plan, now), "applied")
    days = cut_lineage(series_days(table), "days")
    fresh = reclassify_written(
        table, as_of, overrides, venues, exempt_slugs=exempt_slugs, threshold=threshold, series=_recurring(days, floor, threshold)).select(*stored.columns)

    moved: set[int] = set()
    if known:
        rest = set(range(buckets)) - touched
        others = series.read(base, rest)
        doubtful = cut_lineage(_doubtful(others, spark.read.parquet(f"{root}/judged/v={base}"), layers, floor), "doubtful")
        near = events.of(doubtful) & rest
        if near:
            found = _recurring(series.read(base, near).join(doubtful, SERIES, "left_semi"), floor, threshold)
            rows = events.read(base, near)
            some = rows.withColumn("series_key", series_key("name")).join(doubtful, SERIES, "left_semi").drop("series_key")
            changed = cut_lineage(judge(some, found).where("changed").select("id", "venue_id", *(F.col(c).alias(f"_new_{c}") for c in VERDICT)), "verdicts")
            moved = events.of(changed)
        if moved:
            rows = events.read(base, moved).join(changed.drop("venue_id").withColumn("_changed", F.lit(True)), "id", "left")
            rows = rows.withColumns({c: F.when(F.col("_changed"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in VERDICT})
            fresh = fresh.unionByName(rows.select(*stored.columns))
    series.replace(days, version, touched, base if known else None)
    publish(layers, f"{root}/judged", version)
    events.replace(fresh, version, touched | moved, base)
    return Refreshed(events.read(version), plan, outcome_counts(plan))
