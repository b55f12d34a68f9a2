"""Sharding by sampled splitters: near equal bytes per shard, equal texts side by side.

Records are ordered by a key (hash of the text, then hash of the id), so equal texts are
neighbours. Splitters come from a sample drawn with chances in proportion to size; they cut
the key space into ranges between texts, and a range that turns out overfull is cut again. Exact
totals per range then place every record by its running size: a shard is one slice of the order.

A group of equal texts stays whole in one shard wherever it is no larger than a shard's share. The
groups above 1/64 of a share (64 for each shard at most) are dealt first, the largest to the
emptiest shard; the slices of all others then level the shards. A text on more than FULL rows (and
1/4096 of all), and each group dealt first, is a range of its own, cut by id.

Defined results: a null text has size 16; repeated rows are records of their own; null ids
sort as one value; an empty table gives no rows. Columns beside doc_id and text are not read.
"""

from __future__ import annotations

import heapq
import json
import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .common import cut_lineage

OVERHEAD = 16
RANGES = 1024               # splitters + 1; a power of two, for the search below
PER_RANGE = 16              # sampled records for each range: at most 16,384 reach the driver
FULL = 200_000              # records of a range above which it is cut again
CROWDED = 4096              # texts on more rows than this share of all have ranges of their own
GRAIN = 64                  # a group above 1/64 of a share is dealt first: so there are at most 64 a shard


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, the two halves of the ordering key, and a number that tells rows of one id apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("shard"), F.col("doc_id")).alias("k2"), F.monotonically_increasing_id().alias("k3"),
    )


def splitters(rows: DataFrame, ranges: int = RANGES) -> list[int]:
    """``ranges - 1`` boundaries: quantiles of the largest size-weighted random keys.

    The draw is a weighted sample without replacement: the rows with the smallest
    ``-ln(u) / size``. Its length, ``16 * ranges``, does not depend on the data.
    """
    u = (F.pmod(F.xxhash64(F.lit("draw"), "k1", "k2"), F.lit(1 << 40)) + F.lit(0.5)) / F.lit(float(1 << 40))
    drawn = rows.select("k1", "k2", (-F.ln(u) / F.col("size")).alias("e")).orderBy("e", "k1", "k2").limit(PER_RANGE * ranges)
    keys = sorted(r.k1 for r in drawn.collect())
    return [keys[min(len(keys) - 1, i * len(keys) // ranges)] for i in range(1, ranges)] if keys else []


def at_or_below(bounds: list[int], value: Column) -> Column:
    """How many of the sorted ``bounds`` are at or below the value: a binary search in an array."""
    if not bounds:
        return F.lit(0)
    wide = 1 << len(bounds).bit_length()
    # one text literal, which the optimizer folds into an array
    edges = F.split(F.lit(",".join(map(str, bounds + [2**63 - 1] * (wide - 1 - len(bounds))))), ",").cast("array<bigint>")
    steps = F.array(*(F.lit(wide >> i) for i in range(1, wide.bit_length())))
    found = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(edges, at + step - 1) <= value, step).otherwise(F.lit(0)))
    return F.least(found, F.lit(len(bounds)))


def _dealt(large: list[tuple[int, int, int]], shards: int) -> dict[tuple[int, int], int]:
    """``large``: (bytes, k1, text_crc32). The largest group goes to the emptiest shard: the shard of each (k1, text_crc32)."""
    loads = [(0, s) for s in range(shards)]
    out = {}
    for size, k1, crc in sorted(large, key=lambda g: (-g[0], g[1], g[2])):
        load, shard = loads[0]
        heapq.heapreplace(loads, (load + size, shard))
        out[k1, crc] = shard
    return out


def _room(loads: list[int], rest: int) -> list[int]:
    """What each shard takes of ``rest`` bytes so that the least are filled up to one level."""
    order = sorted(range(len(loads)), key=loads.__getitem__)
    filled, below = 0, 0
    for filled, s in enumerate(order, 1):
        below += loads[s]
        if filled == len(order) or (below + rest) <= loads[order[filled]] * filled:
            break
    level = (below + rest) / filled
    room = [0] * len(loads)
    for s in order[:filled]:
        room[s] = max(0, round(level - loads[s]))
    return room


def _own_ranges(spark: SparkSession, own: list[tuple[int, int, int | None, int]]) -> DataFrame:
    """The groups with a range of their own (fewer than GRAIN * shards + CROWDED) as rows of a literal."""
    names = ("k1", "text_crc32", "home", "pieces")
    rows = F.from_json(F.lit(json.dumps([dict(zip(names, g)) for g in own])), "array<struct<k1: bigint, text_crc32: bigint, home: int, pieces: bigint>>")
    return spark.range(1).select(F.inline(rows))


def _placed(rows: DataFrame, own: DataFrame, bounds: list[int], full: int) -> DataFrame:
    """Rows with ``home`` (the shard of a group dealt first), ``own`` (a range of its own), ``range`` and ``part`` in the order of keys."""
    # a row of a crowded text is dealt by its id; rows without one by their number
    piece = F.pmod(F.xxhash64("k2", F.when(F.col("doc_id").isNull(), F.col("k3"))), F.col("pieces"))
    marked = rows.join(F.broadcast(own), ["k1", "text_crc32"], "left").select(
        *rows.columns, "home", F.col("pieces").isNotNull().alias("own"), F.coalesce(piece, F.lit(0)).alias("part"),
        F.when(F.col("pieces").isNull(), at_or_below(bounds, F.col("k1")).cast("long")).otherwise(F.col("k1")).alias("range"),
    )
    facts = marked.where(~F.col("own")).groupBy("range").agg(F.count("*").alias("n"), F.min("k1").alias("lo"), F.max("k1").alias("hi"))
    facts = facts.where(F.col("n") > full).select(F.lit(False).alias("own"), "range", F.ceil(F.col("n") / F.lit(full)).alias("cuts"), "lo", "hi")
    # no text of an overfull range is crowded: an even cut of the interval of their hashes
    spread = (F.col("k1").cast("double") - F.col("lo").cast("double")) / (F.col("hi").cast("double") - F.col("lo").cast("double") + 1.0)
    return marked.join(facts, ["own", "range"], "left").withColumn(
        "part", F.coalesce(F.floor(spread * F.col("cuts")), F.col("part")).cast("long")).drop("cuts", "lo", "hi")


def by_bytes(docs: DataFrame, shards: int, ranges: int = RANGES, full: int = FULL) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 within the shard)."""
    rows = cut_lineage(sized(docs), "shard-keys")
    spark = rows.sparkSession
    groups = cut_lineage(rows.groupBy("k1", "text_crc32").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-groups")
    total, n = (x or 0 for x in groups.agg(F.sum("bytes"), F.sum("n")).first())
    crowd = max(full, n // CROWDED)
    large = (F.col("bytes") * F.lit(shards * GRAIN) > total) & ((F.col("bytes") * F.lit(shards) <= total) | (F.col("n") == 1))
    apart = groups.select("k1", "text_crc32", "bytes", "n", large.alias("large")).where(F.col("large") | (F.col("n") > crowd)).collect()
    homes = _dealt([(g.bytes, g.k1, g.text_crc32) for g in apart if g.large], shards)
    loads = [0] * shards
    for g in apart:
        if g.large:
            loads[homes[g.k1, g.text_crc32]] += g.bytes
    own = _own_ranges(spark, [(g.k1, g.text_crc32, homes.get((g.k1, g.text_crc32)), math.ceil(g.n / crowd)) for g in apart])
    placed = _placed(rows, own, splitters(rows, ranges), full)

    # groups dealt first come last in the order, so that the others have the first bytes
    key = ["dealt", "own", "range", "part"]
    placed = placed.withColumn("dealt", F.col("home").isNotNull())
    totals = placed.groupBy(*key).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    run = Window.partitionBy(*key[:-1])
    offsets = totals.select(
        *key, "bytes", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
    ).select(*key, "bytes_before", "n_before", F.min("bytes_before").over(run).alias("run_at"), F.sum("bytes").over(run).alias("run_bytes"))
    inside = Window.partitionBy(*key).orderBy("k1", "text_crc32", "k2", "size", "doc_id", "k3")
    group = Window.partitionBy(*key, "k1", "text_crc32")
    ranked = placed.join(offsets, key).withColumns({
        "at": F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"),
        "place": F.col("n_before") + F.row_number().over(inside) - 1,
    }).withColumns({"group_at": F.min("at").over(group), "group_bytes": F.sum("size").over(group)})
    # a slice takes a group by its middle; one that is larger than a share is cut between its rows
    by = lambda at, size: (F.col(size) * F.lit(shards) <= F.lit(total), F.col(at) * 2 + F.col(size))
    middle = F.when(F.col("own") & by("run_at", "run_bytes")[0], by("run_at", "run_bytes")[1]).when(
        ~F.col("own") & by("group_at", "group_bytes")[0], by("group_at", "group_bytes")[1]).otherwise(F.col("at") * 2 + F.col("size"))
    edges = [2 * e for e in accumulate(_room(loads, total - sum(loads)))][:-1]
    sharded = cut_lineage(ranked.select(
        "doc_id", "size", "text_crc32", "place", F.when(F.col("dealt"), F.col("range")).alias("segment"),
        F.coalesce("home", at_or_below(edges, middle)).cast("int").alias("shard"),
    ), "sharded")
    parts = sharded.groupBy("shard", "segment").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    firsts = parts.select(F.col("shard").alias("s"), F.col("segment").alias("g"), (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    return sharded.join(firsts, (F.col("shard") == F.col("s")) & F.col("segment").eqNullSafe(F.col("g"))).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") + F.col("shift")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, plan: DataFrame, path: str, ids: Column | str = "doc_id") -> None:
    """Write the documents, one folder per shard, each file in slot order."""
    (docs.join(plan.select("doc_id", "shard", "slot"), ids).repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))
