"""Versions of a table: a change writes new files and a new version, never into old ones.

A version is the folder ``v=<n>`` with a success mark. It holds either the rows themselves
(:func:`publish`) or a manifest (:class:`Buckets`): one line for each bucket of the table
with the folder that has the bucket's rows. Two versions share the folders of every bucket
that did not change, so a change costs what its buckets hold, not what the table holds.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import short_key, whole_key

BUCKETS = 64
SHORT = "id external_id duplicate_of_id hash".split()   # digits or hex for the most part, so they travel packed
MANIFEST = "bucket int, folder string, buckets int, columns string"
_MANIFEST_COLUMNS = ["bucket", "folder", "buckets", "columns"]


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions of a table, oldest first. An unfinished write has no success mark."""
    fs, p, path = _fs(spark, root)
    if not fs.exists(p):
        return []
    names = [(s.getPath().getName(), s.getPath()) for s in fs.listStatus(p)]
    return sorted(int(n[2:]) for n, at in names if n.startswith("v=") and fs.exists(path(at, "_SUCCESS")))


def publish(df: DataFrame, root: str, version: int, partition_by: Sequence[str] = ()) -> None:
    """Write one version; repeating a version replaces it with the same rows."""
    w = df.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{root}/v={version}")


def newest(spark: SparkSession, root: str, before: int | None = None) -> int | None:
    """The newest complete version, or the newest one older than ``before``."""
    known = [v for v in versions(spark, root) if before is None or v < before]
    return known[-1] if known else None


def current(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """The rows of the newest complete version, or of the newest one older than ``before``."""
    version = newest(spark, root, before)
    if version is None:
        raise FileNotFoundError(f"no complete version under {root}")
    return Buckets(spark, root).read(version)


def recorded(spark: SparkSession, path: str, value: str) -> str:
    """What was recorded under ``path``; ``value`` if nothing was, which is recorded first."""
    fs, p, at = _fs(spark, path)
    if not fs.exists(at(p, "_SUCCESS")):
        spark.createDataFrame([(value,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return spark.read.text(path).first()[0]


@dataclass(frozen=True)
class Manifest:
    folders: dict[int, str]     # of every bucket that has rows
    buckets: int                # how many there are
    schema: T.StructType


@dataclass(frozen=True)
class Buckets:
    """A table whose rows are filed by the hash of ``by``. There are as many manifest lines as buckets."""

    spark: SparkSession
    root: str
    by: str = "venue_id"
    buckets: int = BUCKETS

    def number(self) -> Column:
        return F.pmod(F.xxhash64(self.by), F.lit(self.buckets)).cast("int")

    def of(self, rows: DataFrame) -> set[int]:
        """The buckets that ``rows`` fall into."""
        return {r[0] for r in rows.select(self.number().alias("bucket")).distinct().collect()}

    def manifest(self, version: int) -> Manifest | None:
        """None where the version holds rows."""
        lines = self.spark.read.parquet(f"{self.root}/v={version}")
        if lines.columns != _MANIFEST_COLUMNS:
            return None
        rows = lines.collect()
        return Manifest(
            {r.bucket: r.folder for r in rows if r.folder is not None}, rows[0].buckets, T.StructType.fromJson(json.loads(rows[0].columns)),
        )

    def kept_by(self, version: int | None) -> Manifest | None:
        """The manifest of a version whose buckets are cut like these; None where all have to be written."""
        found = None if version is None else self.manifest(version)
        return found if found and found.buckets == self.buckets else None

    def read(self, version: int, only: Iterable[int] | None = None) -> DataFrame:
        """The rows of a version; ``only`` those of some buckets, whose files alone are then listed and read."""
        found = self.manifest(version)
        if found is None or (only is not None and found.buckets != self.buckets):
            rows = self.spark.read.parquet(f"{self.root}/v={version}") if found is None else self.read(version)
            return rows if only is None else rows.where(self.number().isin(*only) if only else F.lit(False))
        folders = [f"{self.root}/{at}" for b, at in sorted(found.folders.items()) if only is None or b in only]
        return self.spark.read.schema(found.schema).parquet(*folders) if folders else self.spark.createDataFrame([], found.schema)

    def replace(self, rows: DataFrame, version: int, changed: Iterable[int], base: int | None) -> None:
        """Write ``version``: the buckets ``changed`` hold ``rows`` and nothing else, all others what ``base`` has in them.

        The files go to a folder that no other attempt uses and the manifest comes last, so a
        version is there whole or not at all, and one that is written again leaves its readers alone.
        """
        kept = self.kept_by(base)
        changed = set(changed) if kept else set(range(self.buckets))
        made = f"data/{version}-{uuid.uuid4().hex[:12]}"
        folders = {b: at for b, at in kept.folders.items() if b not in changed} if kept else {}
        if changed:
            # a rebalanced shuffle splits a bucket that a hot key fills and joins small ones
            short = {f.name: f.dataType for f in rows.schema if f.name in SHORT and f.name != self.by}
            moved = rows.withColumns({"_bucket": self.number(), **{c: short_key(c, kind) for c, kind in short.items()}}).hint("rebalance", "_bucket")
            moved = moved.withColumns({c: whole_key(c, kind) for c, kind in short.items()})
            moved.write.partitionBy("_bucket").option("compression", "zstd").parquet(f"{self.root}/{made}")
            fs, p, _ = _fs(self.spark, f"{self.root}/{made}")
            names = [s.getPath().getName() for s in fs.listStatus(p)]
            folders |= {int(n.split("=")[1]): f"{made}/{n}" for n in names if n.startswith("_bucket=")}
        lines = [(b, folders.get(b), self.buckets, rows.schema.json()) for b in range(self.buckets)]
        self.spark.createDataFrame(lines, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/v={version}")
