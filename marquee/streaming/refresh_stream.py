"""Incremental refresh: landed batches through Structured Streaming."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.linkage import newest_scrape_per_venue
from ..operators.runlog import run_log_rows
from ..plans.incremental import refresh_buckets
from ..session import cut_lineage
from ..sources.versions import newest, publish, recorded


def start_refresh(spark: SparkSession, landing: str, schema: StructType, root: str, checkpoint: str,
                  venues: DataFrame, overrides: DataFrame | None, clock: Callable[[], dt.datetime],
                  on_batch: Callable[[int, DataFrame], None] | None = None, log: str | None = None) -> StreamingQuery:
    """Consume what has landed, then stop. Each batch writes one version of the table.

    Version ``n + 1`` is made from the newest version before it, by buckets (``plans/incremental``).
    What a batch depends on beside its rows is recorded under ``root`` before it is applied: its time
    (``clock/b=<id>``) and, with the version before, the newest scrape seen of each venue
    (``scrapes``). So a batch that is run again after a failure gives the same rows, ids and times
    included. Of several scrapes of a venue (column ``scrape``) the newest counts; one older than
    a scrape of that venue that was applied before is late and is dropped. ``log`` is the run log's
    folder, with a folder for each batch.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        version = batch_id + 1
        now = dt.datetime.fromisoformat(recorded(spark, f"{root}/clock/b={batch_id}", clock().isoformat()))
        if "scrape" in batch.columns:
            batch = on_time(spark, f"{root}/scrapes", batch, version)
        # What has landed is files already; only what is chosen from several scrapes is written.
        rows = cut_lineage(newest_scrape_per_venue(batch), "landed") if "scrape" in batch.columns else batch
        done = refresh_buckets(spark, root, version, rows, venues, overrides, now.date(), now)
        if log:
            seen = venues.join(rows.select(F.col("venue_id").alias("id")).distinct(), "id", "left_semi")
            run_log_rows(seen, rows, done.outcomes, None, now, clock()).write.mode("overwrite").parquet(f"{log}/batch={batch_id}")
        if on_batch:
            on_batch(batch_id, done.outcomes)

    return (
        spark.readStream.schema(schema).parquet(landing)
        .writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(one).start()
    )


def on_time(spark: SparkSession, root: str, batch: DataFrame, version: int) -> DataFrame:
    """The rows of ``batch`` that are not older than the newest scrape of their venue before ``version``.

    The newest scrape of each venue, one row per venue, is kept under ``root`` by version.
    """
    landed = batch.groupBy("venue_id").agg(F.max("scrape").alias("scrape"))
    base = newest(spark, root, version)
    if base is not None:
        last = spark.read.parquet(f"{root}/v={base}")
        known = last.select("venue_id", F.col("scrape").alias("_last"))
        batch = batch.join(known, "venue_id", "left").where(F.col("_last").isNull() | (F.col("scrape") >= F.col("_last"))).drop("_last")
        landed = landed.unionByName(last).groupBy("venue_id").agg(F.max("scrape").alias("scrape"))
    publish(landed, root, version)
    return batch
