"""Approximate nearest neighbours by cosine, over shifted space-filling curves.

Unit vectors are projected to AXES random axes, squashed to the unit cube, shifted and laid on
a Hilbert curve; CURVES curves have axes and shifts of their own. Each curve is a global order
of all vectors, range-partitioned and numbered by Spark. A query meets, on every curve, the
vectors whose numbers are within WINDOW of its own; the windows' best are merged and ranked by
the exact cosine of the original vectors in double precision.

The window is measured, not guessed: for PROBES queries (those of least hash) the true nearest
are found among all vectors, and the window is the distance on the nearest curve within which
a share AIM of them lies. Vectors with structure need narrow windows, unordered noise wide
ones; nothing depends on the number of rows. A window is worked off in tiles of at most BLOCK
vectors and the queries of at most SPAN successive numbers.

Equal vectors are indexed once, with their k + 1 smallest ids, so any number of copies is exact.

Defined results: vectors that are null, empty, zero or hold null or non-finite components
neither ask nor answer, nor do null ids; a row that occurs repeatedly counts once; a shorter
vector is padded with zeros; ties go to the smaller id; fewer than k others give them all;
other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut_lineage

CURVES = 8
AXES = 8
BITS = 7                    # AXES * BITS bits make a key
FIT = 4096                  # vectors whose spread sets the squashing of the axes
PROBES = 256
AIM = 0.97
LEAST = 256                 # least window
BLOCK = 4096
SPAN = 1 << 16
SLACK = 1e-9                # approximate scores this close to the last kept one are ranked exactly


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows of doubles, padded to ``width``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; equal rows give equal numbers wherever they stand."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
    odd = ~np.isfinite(out)
    if odd.any():
        out[odd] = (_unit(x[odd]) * _unit(y[odd])).sum(axis=1)
    return np.clip(out, -1.0, 1.0)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of cells (rows of whole numbers under 2^bits)."""
    one = np.uint64(1)
    x = cells.astype(np.uint64).T.copy()
    last = len(x) - 1
    for b in range(bits - 1, 0, -1):            # undo the turns of each cube, the largest first
        bit = one << np.uint64(b)
        for i in range(last + 1):
            on = (x[i] & bit) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & (bit - one))
            x[0] ^= np.where(on, bit - one, swap)
            x[i] ^= swap
    for i in range(1, last + 1):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        bit = one << np.uint64(b)
        flip ^= np.where((x[last] & bit) != 0, bit - one, np.uint64(0))
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(last + 1):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key


def _best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of all entries that may be among the k largest of their row."""
    if score.shape[1] > k:
        least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
    else:
        least = np.full(len(score), -np.inf)
    return np.nonzero(score >= least[:, None] - SLACK)


def distinct_vectors(rows: DataFrame, k: int, every: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """vectors (vid, v, asks), members (vid, vec_id: the k + 1 least of each vid) and queries (vid, vec_id)."""
    kind = "double" if "double" in rows.schema["embedding"].dataType.simpleString() else "float"
    v = F.col("embedding").cast(f"array<{kind}>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & fine)
    least = Window.partitionBy("v").orderBy("vec_id")
    first = good.groupBy("v").agg(F.min("vec_id").alias("vid"), F.max(F.col("vec_id") % every == 0).alias("asks"))
    # two different vectors may share an id: the place of the id is then not enough to name them
    vectors = cut_lineage(first.withColumn("vid", F.struct("vid", F.xxhash64("v").alias("h"))).select(F.concat_ws(":", "vid.vid", "vid.h").alias("vid"), "v", "asks"), "vectors")
    few = good.dropDuplicates(["vec_id", "v"]).withColumn("n", F.row_number().over(least)).where(F.col("n") <= k + 1).select("vec_id", "v")
    members = cut_lineage(few.join(vectors, "v").select("vid", "vec_id"), "vector-members")
    queries = good.where(F.col("vec_id") % every == 0).distinct().join(vectors, "v").select("vid", "vec_id")
    return vectors, members, cut_lineage(queries, "vector-queries")


def curves(vectors: DataFrame, width: int) -> DataFrame:
    """curve, rank, vid, asks, v: every vector on every curve, numbered from 0."""
    spark = vectors.sparkSession
    some = vectors.orderBy(F.xxhash64("vid")).limit(FIT).select("v").toArrow()
    units = _unit(_matrix(some.column("v"), width)) if some.num_rows else np.ones((1, width))
    rng = np.random.default_rng(11)
    axes = [np.linalg.qr(rng.normal(size=(width, width)))[0][:, np.arange(AXES) % width] for _ in range(CURVES)]
    shifts = [rng.uniform(0, 1, AXES) for _ in range(CURVES)]
    spread = [((units @ a).mean(axis=0), (units @ a).std(axis=0) + 1e-9) for a in axes]

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _unit(_matrix(b.column("v"), width))
            for c in range(CURVES):
                y = (x @ axes[c] - spread[c][0]) / spread[c][1]
                cube = (1 / (1 + np.exp(-1.7 * np.clip(y, -20, 20))) + shifts[c]) / 2
                key = hilbert(np.minimum((cube * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, c, np.int32)), pa.array(key.view(np.int64)), b.column("vid"), b.column("asks"), b.column("v")], names=["curve", "key", "vid", "asks", "v"])

    kind = vectors.schema["v"].dataType.simpleString()
    keyed = vectors.select("vid", "asks", "v").mapInArrow(laid, f"curve int, key long, vid string, asks boolean, v {kind}")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = keyed.repartitionByRange(n, "curve", "key", "vid").sortWithinPartitions("curve", "key", "vid")
    rows = cut_lineage(placed.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "curves")
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("curve", "part").agg(F.count("*").alias("n"), F.min("row").alias("low"))
    parts = parts.select("curve", "part", "low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # within a part of a curve the numbers of rows are successive
    return rows.join(parts, ["curve", "part"]).select("curve", (F.col("before") + F.col("row") - F.col("low")).alias("rank"), "vid", "asks", "v")


def window(ranked: DataFrame, vectors: DataFrame, width: int, k: int) -> int:
    """The distance on the nearest curve within which a share AIM of the true neighbours of PROBES queries lies."""
    spark = ranked.sparkSession
    probes = vectors.where("asks").orderBy(F.xxhash64("vid"), "vid").limit(PROBES).select("vid", "v").toArrow()
    if not probes.num_rows:
        return LEAST
    names, asked = probes.column("vid").to_pylist(), _unit(_matrix(probes.column("v"), width))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(i, BLOCK) for i in range(0, batch.num_rows, BLOCK)):
                score = asked @ _unit(_matrix(b.column("v"), width)).T
                row, col = _best(score, k + 1)
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in row], pa.string()), b.column("vid").take(pa.array(col)), pa.array(score[row, col])], names=["q", "vid", "score"])

    near = vectors.select("vid", "v").mapInArrow(nearest, "q string, vid string, score double").where("q <> vid")
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vid"))).where(F.col("n") <= k).select("q", "vid")
    at = ranked.select("curve", "rank", "vid")
    both = near.join(at, "vid").withColumnRenamed("rank", "r").join(at.select("curve", "rank", F.col("vid").alias("q")), ["curve", "q"])
    gap = both.groupBy("q", "vid").agg(F.min(F.abs(F.col("r") - F.col("rank"))).alias("gap")).agg(F.percentile("gap", AIM)).first()[0]
    return max(LEAST, int(np.ceil(gap or 0)))


def nearest(rows: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the ``k`` nearest found for each row whose vec_id ``every`` divides."""
    vectors, members, queries = distinct_vectors(rows, k, every)
    width = vectors.agg(F.max(F.size("v"))).first()[0] or 1
    ranked = cut_lineage(curves(vectors, width), "curve-ranks")
    reach = window(ranked, vectors, width, k)
    span, block = F.expr(f"rank div {SPAN}"), F.expr(f"rank div {BLOCK}")
    asks = ranked.where("asks").select("curve", span.alias("span"), F.col("rank").alias("at"), F.col("vid").alias("q"), F.col("v").alias("qv"))
    last = ranked.agg(F.max("rank")).first()[0] or 0
    asks = asks.withColumn("block", F.explode(F.sequence(F.expr(f"greatest(at - {reach}, 0) div {BLOCK}"), F.expr(f"least(at + {reach}, {last}) div {BLOCK}"))))
    spans = F.sequence(F.expr(f"greatest(block * {BLOCK} - {reach}, 0) div {SPAN}"), F.expr(f"least((block + 1) * {BLOCK} + {reach}, {last}) div {SPAN}"))
    held = ranked.select("curve", block.alias("block"), "vid", "v").withColumn("span", F.explode(spans))

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            q, x = _matrix(left.column("qv"), width), _matrix(right.column("v"), width)
            names = left.column("q").to_numpy(), right.column("vid").to_numpy()
            ux = _unit(x).T
            for i in range(0, len(q), 512):
                row, col = _best(_unit(q[i : i + 512]) @ ux, k + 1)
                parts.append((names[0][i + row], names[1][col], cosines(q[i + row], x[col])))
        cols = [np.concatenate(c) for c in zip(*parts)] if parts else [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.float64()))], names=["q", "vid", "score"])

    keys = ["curve", "span", "block"]
    found = asks.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(tile, "q string, vid string, score double")
    # a vector's best k + 1 distinct ones, itself included, hold the best k rows of each of its queries
    found = found.groupBy("q", "vid").agg(F.max("score").alias("score"))
    found = found.join(members, "vid").withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1)
    answers = queries.select(F.col("vid").alias("q"), F.col("vec_id").alias("query_id")).join(found, "q").where("query_id <> vec_id")
    place = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
