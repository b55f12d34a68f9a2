"""What linking and applying a batch writes and reads, on rows of their own."""

import datetime as dt

from marquee.operators import linkage
from marquee.plans.catalog.standin import Tables

DAY = dt.date(2026, 3, 1)
NOW = dt.datetime(2026, 3, 1, 6)
STORED = ("id long, venue_id long, external_id string, date date, name string, hash string, is_manually_created boolean, "
          "duplicate_of_id long, updated_at timestamp")
BATCH = "pos long, venue_id long, external_id string, date date, name string, hash string"


def _batch(spark, n):
    """Rows that share nothing, but for the last two of one hash."""
    rows = [(i, i % 3, f"x{i}", DAY, f"new {i}", f"h{i}") for i in range(n)]
    return spark.createDataFrame([*rows, (n, 0, f"x{n}", DAY, "again", "h0")], BATCH)


def test_only_rows_that_share_a_key_are_judged(spark, monkeypatch):
    written, cut = {}, linkage.cut_lineage

    def noted(df, label):
        out = cut(df, label)
        written[label] = out.count()
        return out

    monkeypatch.setattr(linkage, "cut_lineage", noted)
    assert sorted(r.pos for r in linkage.dedupe_batch(_batch(spark, 60)).collect()) == list(range(60))
    assert written["keys"] == 2


def test_the_stored_table_is_read_once_by_the_apply(spark, tmp_path):
    stored = [(i, i % 3, f"x{i}", DAY, f"old {i}", f"h{i}", i >= 60, None, NOW) for i in range(0, 90, 2)]
    spark.createDataFrame(stored, STORED).write.parquet(str(tmp_path / "held"))
    held, batch = spark.read.parquet(str(tmp_path / "held")), _batch(spark, 60).where("pos < 60")
    plan = linkage.merge_plan(held, batch, DAY)
    plan.write.parquet(str(tmp_path / "steps"))
    after = linkage.apply_plan(held, batch, spark.read.parquet(str(tmp_path / "steps")), NOW)
    assert sorted(r.name for r in after.collect()) == sorted([f"new {i}" for i in range(60)] + [f"old {i}" for i in range(60, 90, 2)])
    leaves = after._jdf.queryExecution().optimizedPlan().collectLeaves().toString()
    assert leaves.count("updated_at#") == 1


def test_the_folded_view_shuffles_its_rows_once(spark, tmp_path):
    at = dt.datetime(2026, 3, 1)
    lines = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    rows = [(o, p, 1, 1, 9.0, 1.0, 0.0, 0.0, "R", "O", at) for o, p in ((1, 7), (1, 8), (1, 9), (2, 8), (3, 5))]
    spark.createDataFrame(rows, lines).write.parquet(str(tmp_path / "lineitem.parquet"))
    parts = [(p, f"part {p}", "b", "PROMO", 3, 1.0) for p in (8, 9)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    folded = Tables(spark, str(tmp_path)).folded().select("id", "duplicate_of_id")
    plan = folded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(external_id") == 1 and plan.count("Scan parquet") == 2
    # a line without a part is no listing and no first one
    assert {(r.id, r.duplicate_of_id) for r in folded.collect()} == {
        ("1-1-8-1-20260301", None), ("1-1-9-1-20260301", "1-1-8-1-20260301"), ("2-1-8-1-20260301", None)}
