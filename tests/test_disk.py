"""What travels or is written: each row as rarely and as narrow as the answer allows."""

import datetime as dt

import pytest

from marquee.functions.text import packed, unpacked
from marquee.operators import archive, classify, linkage, validation
from marquee.plans.refresh import refresh
from marquee.sources import ticketing
from marquee.streaming import refresh_stream

from pyspark.sql import functions as F

DAY = dt.date(2026, 3, 1)
NOW = dt.datetime(2026, 3, 1, 6)
STORED = ("id string, venue_id long, external_id string, date date, name string, hash string, genre string, subgenre string, is_live_music boolean, "
          "is_manual_override boolean, is_manually_created boolean, duplicate_of_id string, classification_reason string, approved_at timestamp, updated_at timestamp")
BATCH = "pos string, venue_id long, external_id string, date date, name string, hash string"
TEXTS = ["", "a", "ab", "AB", "0f", "1-2", "12-3", "-", "--", "123", "deadbeef", "DEADbeef", "7-2-31-4-19980301", None, "é", "00", "a0", "1a", "x-1", " 12", "１２", "12\n"]


def _stored(spark, ids):
    return spark.createDataFrame([(i, n % 3, f"x{n}", DAY, f"old {n}", f"h{n}", "rock", None, True, False, False, None, None, None, NOW) for n, i in enumerate(ids)], STORED)


def _batch(spark, n):
    return spark.createDataFrame([(f"{i}-1", i % 3, f"x{i}", DAY, f"trivia {i}", f"h{i}") for i in range(n)], BATCH)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_packed_texts_come_back(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", packed("t").alias("p"))
    got = rows.select("t", "p", unpacked("p").alias("back")).collect()
    assert all(r.t == r.back for r in got) and len({bytes(r.p) for r in got if r.p is not None}) == len(TEXTS) - 1
    assert len(rows.where("t = '7-2-31-4-19980301'").first().p) == 10


def test_a_refresh_puts_verdicts_in_place(spark):
    """F1 refreshed_table: the table does not travel by its ids to take the verdicts."""
    venues = spark.createDataFrame([(v, f"venue-{v}") for v in range(3)], "id long, slug string")
    table = refresh(_stored(spark, [f"1-{i}" for i in range(6)]), _batch(spark, 9), venues, None, DAY, NOW).table
    assert "(id#" not in "".join(line for line in _plan(table).splitlines() if "Join" in line)
    got = {r.name: (r.is_live_music, r.classification_reason) for r in table.collect()}
    assert got == {f"trivia {i}": (False, "keyword: trivia") for i in range(9)}


@pytest.mark.parametrize("ids", [["a", "b", "c", "d", "e", "f"], ["a", "a", "b", None, None, "c"]])
def test_in_place_equals_by_id(spark, tmp_path, ids):
    """rows that share an id, or have none, get what they got by way of their ids."""
    table = _stored(spark, ids).withColumn("name", F.when(F.col("external_id") == "x1", "open mic").otherwise(F.col("name")))
    table = table.withColumn("date", F.when(F.col("external_id") == "x0", dt.date(2020, 1, 1)).otherwise(F.col("date")))
    some = ["id", "name", "seen", "changed", "is_live_music", "classification_reason"]
    want = classify.reclassify(table, DAY).select(some).collect()
    assert sorted(map(repr, classify.reclassify_written(table, DAY).select(some).collect())) == sorted(map(repr, want))


def test_the_batch_travels_once_through_the_apply(spark, tmp_path):
    """F3 F4 applied_plan, renamed_and_relisted: a batch row meets its plan once, new or not."""
    held = _stored(spark, [f"1-{i}" for i in range(0, 8)])
    _batch(spark, 12).write.parquet(str(tmp_path / "batch"))
    batch = spark.read.parquet(str(tmp_path / "batch"))
    linkage.merge_plan(held, batch, DAY).write.parquet(str(tmp_path / "plan"))
    after = linkage.apply_plan(held, batch, spark.read.parquet(str(tmp_path / "plan")), NOW)
    leaves = after._jdf.queryExecution().optimizedPlan().collectLeaves().toString()
    assert leaves.count("external_id#") == 2      # once stored, once new
    got = {r.name: r.id for r in after.collect()}
    assert len(got) == 12 and [got[f"trivia {i}"] for i in range(8)] == [f"1-{i}" for i in range(8)]
    assert all(len(got[f"trivia {i}"]) == 32 for i in range(8, 12))


def test_rows_do_not_travel_to_their_venue(spark, monkeypatch):
    """F12 F14 run_outcomes, run_lossiness: what is known per venue is written, so its size is known and the rows stay."""
    labels, cut = [], linkage.cut_lineage
    monkeypatch.setattr(linkage, "cut_lineage", lambda df, label: (labels.append(label), cut(df, label))[1])
    held, batch = _stored(spark, [f"1-{i}" for i in range(6)]), _batch(spark, 9)
    linkage.merge_plan(held, batch, DAY)
    assert {"horizon", "valve"} <= set(labels)
    plan = linkage.venue_lossiness(held, batch, DAY)
    assert plan.count() == 3
    joins = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [venue_id" in joins and "SortMergeJoin [venue_id" not in joins


def test_linked_ids_travel_packed(spark):
    """F13 linked_rows: the ids and places of both sides meet as bytes."""
    got = linkage.link(_stored(spark, [f"1-{i}" for i in range(6)]), _batch(spark, 9))
    assert sorted((r.id, r.pos, r.is_survivor) for r in got.collect()) == [(f"1-{i}", f"{i}-1", True) for i in range(6)]
    assert got.select("id")._jdf.queryExecution().optimizedPlan().toString().count("hex(") > 0


def test_what_has_landed_is_not_written_again(spark, tmp_path, monkeypatch):
    """F2 streamed_refresh: without scrapes to choose from, the landed files are read as they are."""
    monkeypatch.setattr(refresh_stream, "cut_lineage", lambda df, label: pytest.fail(f"{label} is written again"))
    root = str(tmp_path)
    venues = spark.createDataFrame([(v, f"venue-{v}") for v in range(3)], "id long, slug string")
    refresh_stream.publish(_stored(spark, [f"1-{i}" for i in range(6)]), f"{root}/table", 0)
    batch = _batch(spark, 9)
    batch.write.parquet(f"{root}/landing")
    refresh_stream.start_refresh(spark, f"{root}/landing", batch.schema, f"{root}/table", f"{root}/checkpoint", venues, None, lambda: NOW).awaitTermination()
    assert sorted(r.name for r in spark.read.parquet(f"{root}/table/data").collect()) == sorted(f"trivia {i}" for i in range(9))


LISTINGS = ("id string, venue_id long, date date, name string, show_min int, doors_min int, status string, is_manual_override boolean, is_live_music boolean, "
            "image_url string, ticket_url string, price_min double, artist string, updated_at timestamp")


@pytest.mark.parametrize("few", [1 << 20, 0])
def test_rows_of_no_cluster_stay(spark, monkeypatch, few):
    """F8 F9 F10 archive_summary, archive_survivors, archive_table: only rows that may be in a cluster travel to it."""
    monkeypatch.setattr(archive, "FEW", few, raising=False)
    titles = ["the band", "the band", "the band live", "alone here", "short", "the band"]
    rows = spark.createDataFrame([(f"1-{i}", 1, DAY if i < 5 else dt.date(2026, 3, 9), t, None, None, "on_sale", False, i == 1, None, f"t{i}" if i == 2 else None, None, None, NOW)
                                  for i, t in enumerate(titles)] + [(None, 1, DAY, "nobody knows", None, None, "on_sale", False, True, None, None, None, None, NOW)], LISTINGS)
    labels = archive.cluster_labels(rows)
    after = archive.merge_archive(rows, labels)
    assert sorted((r.id or "", r.ticket_url) for r in after.collect()) == [("", None), ("1-1", "t2"), ("1-3", None), ("1-4", None), ("1-5", None)]
    assert tuple(archive.merge_summary(rows, labels).first()) == (1, 2, 1)
    assert ("left_anti" in _plan(after).lower().replace("leftanti", "left_anti")) == (few > 0)


def test_edits_do_not_travel_to_the_venues(spark):
    """F11 F15 edited_events, checked_event_edits: the venues' size is known, and the first edit of a hash is found where its rows are."""
    held = _stored(spark, [f"1-{i}" for i in range(4)]).withColumns({"is_manually_created": F.lit(True), "price_min": F.lit(1.0), "price_max": F.lit(2.0)})
    venues = spark.createDataFrame([(v, f"venue-{v}") for v in range(3)], "id long, slug string")
    edits = [(f"e{i}", f"1-{i}", None, name, None, None, None, ["name"]) for i, name in ((0, "one"), (3, "one"), (1, "two"))]
    patches = spark.createDataFrame(edits, "seq string, event_id string, venue_id long, name string, date string, price_min double, price_max double, fields_set array<string>")
    patches = patches.withColumns({"doors_time": F.lit(None).cast("string"), "show_time": F.lit(None).cast("string")})
    checked = validation.check_event_edits(patches, held, venues, DAY)
    assert {r.event_id: list(r.reasons) for r in checked.collect()} == {"1-0": [], "1-1": [], "1-3": ["already in this batch"]}
    joins = checked._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [_venue" not in joins and "_first" not in "".join(x for x in joins.splitlines() if "Join" in x)
    assert {r.id: r.name for r in validation.apply_event_edits(held, checked).collect()} == {"1-0": "one", "1-1": "two", "1-2": "old 2", "1-3": "old 3"}


def test_admission_keys_travel_packed(spark):
    """F5 admitted_submissions: show keys go through the rounds as bytes, and of a submitter's rows only the answer goes on."""
    key = [f"{i:064x}" for i in range(30)]
    checked = spark.createDataFrame([(f"s{i:02}", f"who{i % 2}", key[i % 29]) for i in range(30)], "seq string, submitted_by string, show_key string")
    listed = spark.createDataFrame([(key[3],)], "hash string")
    pending = spark.createDataFrame([("who0", key[5])], "submitted_by string, show_key string")
    got = validation.admit_submissions(checked, listed, pending, cap=3)
    joins = [x for x in _plan(got).splitlines() if "Join" in x]
    assert not any("_took" in x for x in joins)
    assert [(r.seq, r.show_key) for r in got.where("admitted").orderBy("seq").collect()] == [(f"s{i:02}", key[i]) for i in (0, 1, 2, 7, 9)]
    assert {r.seq: r.reason for r in got.collect() if r.seq in ("s03", "s05")} == {"s03": "already listed", "s05": "already pending"}


def test_of_an_event_one_name_travels(spark):
    """F6 F7 landed_by_source, ticketing_feed: beside what is asked for, only the shown name, the key and the day go to a show's variants."""
    day = F.struct(F.struct(F.lit("2026-03-01").alias("localDate")).alias("start"))
    raw = spark.createDataFrame([("v", 0, i, n) for i, n in enumerate(["Band - VIP", "Band", "band", ""])], "venue_slug string, page_no long, pos int, n string")
    raw = raw.select("venue_slug", "page_no", "pos", F.struct(F.col("n").alias("name"), day.alias("dates")).alias("ev"))
    got = ticketing.one_per_show(raw, whole=False)
    assert sorted((r.pos, r.ev.name) for r in got.collect()) == [(1, "Band"), (3, "")]
    assert "_base" not in "".join(x for x in _plan(got).splitlines() if "Window" in x) and got.schema["ev"].dataType.names == ["name"]
    assert [r.ev.dates.start.localDate for r in ticketing.one_per_show(raw).collect()] == ["2026-03-01"] * 2


def test_landing_reads_the_line_items_once(spark, monkeypatch):
    """F6 landed_by_source: six sources are made of listings that are written once."""
    from marquee.plans.catalog import entries
    from marquee.plans.catalog.standin import Tables

    rows = [("1-1", 1, "v", "Band", None, None, DAY, 60, None, 5.0, None, None, "i", "rock", None, "on_sale", None, None)]
    kinds = ("id string, order_no long, venue_slug string, name string, artist string, support_artists string, date date, show_min int, doors_min int, price_min double, price_max double, ticket_url string, "
             "image_url string, genre string, subgenre string, status string, age_restriction string, description string")
    reads = []
    monkeypatch.setattr(Tables, "listings", lambda t: (reads.append(1), spark.createDataFrame(rows, kinds))[1])
    got = entries()["landed_by_source"].run(Tables(spark, "nowhere"))
    assert len(reads) == 1
    assert {r.source: r.listings for r in got.collect()} == {k: 1 for k in ("ticketmaster", "squarespace", "venuepilot", "duke_bedework", "motorco", "koka_booth")}
