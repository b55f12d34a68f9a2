"""Steps that have to grow no faster than their input: what is read once, what stays out of a shuffle."""

import datetime as dt

import pytest

from marquee.operators import duplicates
from marquee.plans.catalog import entries
from marquee.plans.catalog.standin import Tables

from tests import models

D = dt.date(2026, 4, 1)
NIGHT_ROWS = "id long, venue_id long, date date, name string, approved_at date, duplicate_of_id long"


def _nights(spark):
    titles = {1: ["the briefs", "the brief"], 2: ["alone"], 3: ["same", "Same!"], 4: ["abc one", "abc two", "xyz"], 5: ["!!!", "?"], 6: ["aaa", "bbb"]}
    rows = [(v * 10 + i, v, D, t, D if i else None, None) for v, names in titles.items() for i, t in enumerate(names)]
    return titles, spark.createDataFrame(rows, NIGHT_ROWS)


def test_small_nights_are_scored_without_rounds(spark, monkeypatch):
    """review_scores: a night of few titles is one tile, so the rounds of best_pairs never begin."""
    monkeypatch.setattr(duplicates, "best_pairs", lambda *a: pytest.fail("no night is larger than a block"))
    titles, df = _nights(spark)
    got = {r.venue_id: r.score for r in duplicates.cluster_scores(df).collect()}
    want = {1: models.best_similarity(titles[1]), 2: 0.0, 3: 1.0, 4: models.best_similarity(titles[4]), 5: 0.0, 6: 0.0}
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-12 for v in want)


def test_review_facts_reads_its_listings_once(spark, monkeypatch):
    """review_facts: what is asked of a row is written first; all that follows reads that table."""
    written, cut = [], duplicates.cut_lineage
    monkeypatch.setattr(duplicates, "cut_lineage", lambda df, label: (written.append(label), cut(df, label))[1])
    _, df = _nights(spark)
    got = duplicates.review_clusters(df, D)
    assert written[0] == "near" and "night-forms" in written
    assert "LogicalRDD" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = {r.venue_id: (r.unfolded_rows, r.all_approved) for r in got.collect()}
    assert rows == {1: (2, False), 3: (2, False), 4: (3, False), 5: (2, False), 6: (2, False)}


LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"


def _tables(spark, at):
    day = dt.datetime(1998, 3, 1)
    lines = [(o, p, 1, n, 48.0, 9.0, 0.05, 0.03, "R", "O", day) for o, p, n in ((1, 7, 1), (1, 8, 1), (1, 9, 2), (2, 8, 1), (2, 9, 2))]
    for name, rows, schema in (
        ("lineitem", lines, LINES),
        ("part", [(p, f"part {p}", "b", "PROMO", 3, 1.0) for p in (7, 8, 9)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        ("orders", [(o, 1, "F", "5-LOW", day) for o in (1, 2)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate timestamp"),
        ("supplier", [(1, "Supplier 1", 1, 100.0)], "s_suppkey long, s_name string, s_nationkey long, s_acctbal double"),
        ("nation", [(1, "N", 1)], "n_nationkey long, n_name string, n_regionkey long"), ("region", [(1, "R")], "r_regionkey long, r_name string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    return Tables(spark, str(at))


def test_folds_read_the_line_items_once(spark, tmp_path):
    """folded_after_requests: rows and requests are written once; what is left to do does not read the line items again."""
    got = entries()["folded_after_requests"].run(_tables(spark, tmp_path))
    assert "lineitem.parquet" not in got._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in got.collect()} == {
        ("1-1-7-1-19980301", None), ("1-1-8-1-19980301", "1-1-7-1-19980301"), ("1-2-9-1-19980301", "1-1-7-1-19980301"),
        ("2-1-8-1-19980301", None), ("2-2-9-1-19980301", "2-1-8-1-19980301")}
