"""One registered query."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .standin import Tables, sql_with


@dataclass(frozen=True)
class Entry:
    name: str
    rows: str                                  # inventory rows it covers
    run: Callable[[Tables], DataFrame]
    sql: str | None = None


def in_order(df: DataFrame, per: str) -> DataFrame:
    """A sorted frame with ``place``, the row's place among those of its ``per``: shows the order in a set of rows."""
    w = Window.partitionBy(per).orderBy("_row")
    return df.withColumn("_row", F.monotonically_increasing_id()).withColumn("place", F.row_number().over(w)).drop("_row")


def q(name: str, rows: str, run: Callable[[Tables], DataFrame], sql: str | None = None) -> Entry:
    return Entry(name, rows, run, sql_with(sql) if sql else None)
