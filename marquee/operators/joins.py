"""Join helpers shared by the operators.

No side is broadcast by hint. Spark broadcasts a side when its planned or measured
size is under ``spark.sql.autoBroadcastJoinThreshold``, so the decision is checked
against the data; beyond that it shuffles, and adaptive execution splits hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPREAD = 1024


def sparse_left_join(left: DataFrame, right: DataFrame, key: str, right_key: str, spread_by: str) -> DataFrame:
    """Left join on a key that is null in most rows of ``left``.

    A plain shuffle would send every null key to one partition. A second key spreads
    those rows; it is zero wherever the real key is present, so matches are unchanged.
    """
    l = left.withColumn(
        "_spread", F.when(F.col(key).isNull(), F.pmod(F.xxhash64(spread_by), F.lit(SPREAD))).otherwise(F.lit(0))
    )
    # pmod by one is always zero, but not a literal that the optimizer would drop from the key.
    r = right.withColumn("_zero", F.pmod(F.xxhash64(right_key), F.lit(1)))
    return l.join(r, (l[key] == r[right_key]) & (l["_spread"] == r["_zero"]), "left").drop("_spread", "_zero", right_key)


def prefixed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return df.select([F.col(c).alias(prefix + c) for c in keep])


def is_true(c: Column | str) -> Column:
    """Null counts as false."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit(False))
