"""Helpers that several operators share."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marquee.session import cut_lineage, scratch_root

__all__ = ["SPACE", "cut_lineage", "digits53", "scratch_root", "table", "text_of", "until", "words"]

SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def text_of(name: str = "text") -> Column:
    """The text; a null one counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def until(text: Column, mark: Column, count: int) -> Column:
    """``substring_index`` with a column for the mark: what is before the first one (1) or after the last (-1)."""
    return F.call_function("substring_index", text, mark, F.lit(count))


def words(text: Column) -> Column:
    """The maximal runs of characters other than the six ASCII blanks."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE + "+"))


def digits53(*parts: Column | str) -> Column:
    """A number in [0, 2^52) that DuckDB computes alike: the first 13 hex digits of an MD5."""
    cols = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 13), 16, 10).cast("long")
