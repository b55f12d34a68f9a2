"""Mixing sources to target weights by exponential keys (Efraimidis and Spirakis).

A document's key is ``-ln(u) / w``: ``u`` a fixed random number of the document, ``w`` its
quality weight. A source takes as many complete epochs as its target holds; what is left is
selected in key order until the budget is spent. Keys are folded into 4,096 buckets per
source; prefix sums over bucket totals find the bucket in which the budget ends, and only
the rows of that bucket are sorted, so no source is ordered in one task.

Defined results: a null text has size 0 and takes 0; a null source is a source of its own,
last in order; a null id draws as the text "null"; rows that agree in key and id rank by
size; an empty table gives no rows. Reruns agree, as nothing depends on row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import cut_lineage, digits53, text_of, words

WEIGHTS = (3, 1, 2)
SHARE = 1.5                 # of all sizes
MOST = 2                    # times its size, for a source and for a document
BUCKETS = 4096
SEED = "mix-1"


def sized(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, source, size (words), key and bucket; with ``carry`` also ``row``, the whole row."""
    whole = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []
    kept = ["row"] if carry else []
    kinds = F.size(F.array_distinct("w"))
    u = (digits53(F.lit(SEED), F.col("doc_id")) + F.lit(0.5)) / F.lit(float(1 << 52))
    out = docs.select("doc_id", "source", words(text_of()).alias("w"), *whole).select("doc_id", "source", F.size("w").cast("long").alias("size"), kinds.alias("kinds"), *kept)
    # half the key, as weights are 0.5 to 1: then no bucket holds more than twice its even share
    # quality weight in [0.5, 1]: the share of words that are not repetitions
    weight = F.lit(0.5) + F.lit(0.5) * F.col("kinds") / F.greatest(F.col("size"), F.lit(1))
    out = out.select("doc_id", "source", "size", (-F.ln(u) / weight).alias("key"), *kept)
    return out.withColumn("bucket", F.least(F.lit(BUCKETS - 1), F.floor((1 - F.exp(-F.col("key") / 2)) * BUCKETS)).cast("int"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size and target from the size of each source (one row a source).

    ``target = min(most * size, level * weight)``, with the level at which targets sum to
    ``share`` of all sizes. Sources stop in order of size/weight, so the level follows from
    prefix sums in that order: no loop, however many sources there are.
    """
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("weight", F.get(cycle, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))))
    s = s.withColumns({"cap": F.lit(float(most)) * F.col("source_size"), "ratio": F.lit(float(most)) * F.col("source_size") / F.col("weight")})
    by = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after, everything = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(F.lit(0))
    total = F.lit(share) * F.sum("source_size").over(everything)
    # the level if exactly the sources before this one are stopped
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # the first level that its own source stays under is the one that holds
    holds = F.when(level <= F.col("ratio"), F.struct(F.row_number().over(by).alias("place"), level.alias("level")))
    s = s.withColumn("held", holds)
    s = s.withColumn("level", F.min("held").over(everything)["level"])
    return s.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _goals(rows: DataFrame) -> DataFrame:
    """A row a source: size, target, complete epochs, budget of the rest, and the bucket in which it ends."""
    per = cut_lineage(rows.groupBy("source", "bucket").agg(F.sum("size").alias("bytes")), "mix-buckets")
    goal = targets(per.groupBy("source").agg(F.sum("bytes").alias("source_size")))
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    goal = cut_lineage(goal.withColumnRenamed("source", "at_source"), "mix-goals")
    sums = per.join(goal, F.col("source").eqNullSafe(F.col("at_source"))).select("source", "bucket", "budget", "bytes", F.sum("bytes").over(run).alias("upto"))
    ends = sums.where("upto > budget").groupBy(F.col("source").alias("end_source")).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("bytes")).alias("spent"))).alias("end"))
    goal = goal.join(ends, F.col("at_source").eqNullSafe(F.col("end_source")), "left")
    return cut_lineage(goal.select("at_source", "source_size", "target", "epochs", "budget", F.col("end.bucket").alias("end_bucket"), F.col("end.spent").alias("spent")), "mix-ends")


def _taken(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """``rows`` with source_size, target and copies."""
    both = rows.join(goal, rows["source"].eqNullSafe(F.col("at_source"))).drop("at_source")
    inside = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    middle = both.where("bucket = end_bucket").withColumn("before", F.col("spent") + F.sum("size").over(inside) - F.col("size"))
    # the document in which the budget ends stays if that comes nearer to the target
    middle = middle.withColumn("extra", (F.col("before") + F.col("size") / 2 <= F.col("budget")).cast("long")).drop("before")
    outer = both.where("end_bucket IS NULL OR bucket <> end_bucket").withColumn("extra", F.coalesce(F.col("bucket") < F.col("end_bucket"), F.lit(False)).cast("long"))
    return middle.unionByName(outer).withColumn("copies", (F.col("epochs") + F.col("extra")).cast("long"))


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words taken, repeats counted) and copies."""
    rows = cut_lineage(sized(docs), "mix-keys")
    out = _taken(rows, _goals(rows))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def resampled(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it. The keys are derived anew, so texts are not written on the way."""
    out = _taken(sized(docs, carry=True), _goals(sized(docs)))
    return out.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


#: DuckDB: the relation ``mixed`` over ``{src}`` (doc_id, text, source).
MIXED_CTES = r"""
w AS (SELECT *, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM {src}),
sized AS (
  SELECT w.* EXCLUDE (ws), len(ws)::BIGINT AS size,
    -ln((('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
      / (0.5::DOUBLE + 0.5::DOUBLE * len(list_distinct(ws)) / greatest(len(ws), 1)) AS key
  FROM w
),
src1 AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
src2 AS (SELECT *, ([3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM src1),
src3 AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio FROM src2),
src4 AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM src3
),
src5 AS (SELECT *, first_value(CASE WHEN lev <= ratio THEN lev END IGNORE NULLS) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS level FROM src4),
goal AS (SELECT source AS gs, source_size, least(cap, coalesce(level * weight, cap)) AS target FROM src5),
goal2 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM goal),
ranked AS (
  SELECT s.*, g.source_size, g.target, g.epochs, g.target - g.epochs * g.source_size AS budget,
    sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM sized s JOIN goal2 g ON s.source IS NOT DISTINCT FROM g.gs
),
mixed AS (SELECT *, (size * (epochs + (before + size / 2.0 <= budget)::INT))::BIGINT AS taken, (epochs + (before + size / 2.0 <= budget)::INT)::BIGINT AS copies FROM ranked)
"""
