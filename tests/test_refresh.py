"""The refresh, its stream, versions and feeds."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.functions.text import identity_hash
from marquee.operators import visitor
from marquee.plans.refresh import refresh
from marquee.schema import EVENTS, SCRAPED
from marquee.sources import sinks
from marquee.streaming.refresh_stream import start_refresh

D = dt.date
NOW = dt.datetime(2026, 3, 10, 12)
LANDED = T.StructType([T.StructField("pos", T.LongType()), T.StructField("venue_id", T.LongType()), *SCRAPED.fields])


def venues(spark):
    return spark.createDataFrame([(1, "The Hall", "hall", "Durham", "#111111", "mec"), (2, "Barn", "barn", "Cary", "#222222", "mec")],
                                 "id long, name string, slug string, city string, color string, source_kind string")


def stored(spark, *rows):
    base = dict(venue_id=1, source="mec", status="on_sale", is_live_music=True, is_manual_override=False, is_manually_created=False,
                updated_at=dt.datetime(2026, 1, 1), created_at=dt.datetime(2026, 1, 1), date=D(2026, 4, 1))
    df = spark.createDataFrame([[{**base, "id": i + 1, **r}.get(f) for f in EVENTS.names] for i, r in enumerate(rows)], EVENTS)
    return df.withColumn("hash", identity_hash(F.lit("hall"), "date", "name"))


def batch(spark, *rows):
    base = dict(venue_id=1, venue_slug="hall", source="mec", status="on_sale", date=D(2026, 4, 1))
    df = spark.createDataFrame([[{**base, "pos": i, **r}.get(f) for f in LANDED.names] for i, r in enumerate(rows)], LANDED)
    return df.withColumn("hash", identity_hash("venue_slug", "date", "name"))


def test_refresh_updates_inserts_and_expires(spark):
    s = stored(spark, dict(name="Old title", external_id="e1", artist="Keep", price_min=5.0), dict(name="Dropped"), dict(name="By hand", is_manually_created=True),
               dict(name="Past", date=D(2026, 3, 1)), dict(name="Elsewhere", venue_id=2))
    b = batch(spark, dict(name="New title", external_id="e1", artist="", status="sold_out"), dict(name="Karaoke", pos=7), dict(name="KARAOKE!", pos=8))
    done = refresh(s, b, venues(spark), None, NOW.date(), NOW)
    rows = {r.name: r for r in done.table.collect()}
    assert set(rows) == {"New title", "By hand", "Past", "Elsewhere", "Karaoke"}
    new = rows["New title"]
    assert (new.id, new.artist, new.status, new.price_min, new.updated_at) == (1, "Keep", "sold_out", None, NOW)
    assert (rows["Karaoke"].is_live_music, rows["Karaoke"].classification_reason) == (False, "keyword: karaoke")
    assert rows["By hand"].updated_at == dt.datetime(2026, 1, 1)
    assert {r.venue_id: (r.created, r.updated, r.merged, r.expired) for r in done.outcomes.collect()} == {1: (1, 1, 0, 1), 2: (0, 0, 0, 0)}


def test_half_broken_source_deletes_nothing(spark):
    s = stored(spark, *[dict(name=f"Show {i}x", date=D(2026, 4, 1 + i)) for i in range(10)])
    b = batch(spark, dict(name="Show 9x", date=D(2026, 4, 10)))
    done = refresh(s, b, venues(spark), None, NOW.date(), NOW)
    assert done.table.count() == 10 and done.outcomes.first().expired == 0
    assert {r.action for r in done.plan.collect()} == {"update", "orphan"}


def test_empty_batch_is_a_no_op(spark):
    s = stored(spark, dict(name="A"), dict(name="B"))
    done = refresh(s, batch(spark, dict(name="x")).limit(0), venues(spark), None, NOW.date(), NOW)
    assert sorted(r.name for r in done.table.collect()) == ["A", "B"] and {r.action for r in done.plan.collect()} == {"keep"}


def test_same_answer_for_any_partitioning(spark):
    s = stored(spark, *[dict(name=f"Show {i % 7}", external_id=f"e{i % 5}", date=D(2026, 4, 1 + i % 3)) for i in range(25)])
    b = batch(spark, *[dict(name=f"Show {i % 6}", external_id=f"e{i % 4}", date=D(2026, 4, 1 + i % 3)) for i in range(25)])
    run = lambda s, b: sorted(map(str, refresh(s, b, venues(spark), None, NOW.date(), NOW).table.drop("updated_at", "created_at").collect()))
    assert run(s, b) == run(s.repartition(5, "name"), b.repartition(3).orderBy(F.desc("pos")))


def test_stream_writes_one_version_per_batch(spark, tmp_path):
    root, landing = str(tmp_path / "events"), str(tmp_path / "landing")
    sinks.publish(stored(spark, dict(name="Old", external_id="e1")), root, 0)
    b = batch(spark, dict(name="New", external_id="e1"), dict(name="Extra"))
    b.coalesce(1).write.parquet(landing)
    seen = []
    go = lambda: start_refresh(spark, landing, b.schema, root, str(tmp_path / "ck"), venues(spark), None, lambda: NOW,
                               lambda n, counts: seen.append((n, counts.first().created))).awaitTermination()
    go()
    assert sinks.versions(spark, root) == [0, 1] and seen == [(0, 1)]
    assert sorted(r.name for r in sinks.current(spark, root).collect()) == ["Extra", "New"]
    go()  # nothing new has landed
    assert sinks.versions(spark, root) == [0, 1]
    batch(spark, dict(name="New", external_id="e1"), dict(name="Third")).coalesce(1).write.mode("append").parquet(landing)
    go()
    assert sinks.versions(spark, root) == [0, 1, 2]
    assert sorted(r.name for r in sinks.current(spark, root).collect()) == ["New", "Third"]


def test_two_scrapes_of_a_venue_give_the_newest_ones_answer(spark, tmp_path):
    root, landing = str(tmp_path / "table"), str(tmp_path / "landing")
    sinks.publish(stored(spark, dict(name="Gone", external_id="g")), root, 0)
    old = batch(spark, dict(name="Alpha", external_id="a"), dict(name="Gone", external_id="g")).withColumn("scrape", F.lit(1).cast("long"))
    new = batch(spark, dict(name="Alpha", external_id="a"), dict(name="Beta", external_id="b")).withColumn("scrape", F.lit(2).cast("long"))
    barn = batch(spark, dict(name="Barn dance", venue_id=2, venue_slug="barn")).withColumn("scrape", F.lit(1).cast("long"))
    old.unionByName(new).unionByName(barn).write.parquet(landing)
    start_refresh(spark, landing, old.schema, root, str(tmp_path / "check"), venues(spark), None, lambda: NOW, log=str(tmp_path / "log")).awaitTermination()
    table = sinks.current(spark, root)
    assert sorted(r.name for r in table.collect()) == ["Alpha", "Barn dance", "Beta"]
    assert table.select("id").distinct().count() == 3
    log = {r.venue_id: (r.status, r.events_found, r.events_created) for r in spark.read.parquet(str(tmp_path / "log")).collect()}
    assert log == {1: ("success", 2, 2), 2: ("success", 1, 1)}


def test_a_renamed_row_does_not_lend_its_id(spark):
    table = stored(spark).limit(0)
    for hour, rows in enumerate(([dict(name="Alpha", external_id="x1")], [dict(name="Beta", external_id="x1"), dict(name="Alpha", external_id="x2")],
                                 [dict(name="Beta", external_id="x1"), dict(name="Alpha", external_id="x2")])):
        table = refresh(table, batch(spark, *rows), venues(spark), None, NOW.date(), NOW + dt.timedelta(hours=hour)).table
    got = table.collect()
    assert sorted(r.name for r in got) == ["Alpha", "Beta"] and len({r.id for r in got}) == 2


def test_versions_ignore_unfinished_writes(spark, tmp_path):
    root = str(tmp_path / "t")
    sinks.publish(spark.range(3), root, 1)
    (tmp_path / "t" / "v=2").mkdir()
    assert sinks.versions(spark, root) == [1] and sinks.current(spark, root).count() == 3


def test_seeding_venues(spark):
    seeds = spark.createDataFrame([("hall", "Hall (new)", "Durham"), ("tent", "Tent", "Apex")], "slug string, name string, city string")
    rows = {r.slug: r for r in sinks.upserted_venues(venues(spark), seeds, ["barn"]).collect()}
    assert set(rows) == {"hall", "tent"} and (rows["hall"].id, rows["hall"].name, rows["hall"].color) == (1, "Hall (new)", "#111111")
    assert rows["tent"].id is not None


def test_feed_runs_three_hours_and_export_two(spark):
    s = stored(spark, dict(name="Fest; day, one", artist="Band", show_min=1410, price_min=10.0, price_max=15.0, ticket_url="https://t/1", doors_min=1380, support_artists="Opener"),
               dict(name="Allday"), dict(name="Midnight", show_min=0))
    entries = {r.id: r.entry.split("\r\n") for r in sinks.feed_entries(s, venues(spark), D(2026, 3, 10)).collect()}
    e = entries[1]
    assert "DTSTART;TZID=America/New_York:20260401T233000" in e and "DTEND;TZID=America/New_York:20260402T023000" in e
    assert "DESCRIPTION:Fest\\; day\\, one\\nw/ Opener\\nDoors: 11:00 PM\\nShow: 11:30 PM\\n$10–$15\\n\\nhttps://t/1" in e
    assert "LOCATION:The Hall\\, Durham\\, NC" in e and "URL:https://t/1" in e and e[0] == "BEGIN:VEVENT" and e[-1] == "END:VEVENT"
    assert "DTSTART;VALUE=DATE:20260401" in entries[2] and "DTEND;VALUE=DATE:20260402" in entries[2]
    assert "DTSTART;TZID=America/New_York:20260401T000000" in entries[3]
    fav = spark.createDataFrame([(1, 1), (1, 3)], "user_id long, event_id long")
    out = {r.event_id: r.entry.split("\r\n") for r in sinks.export_entries(visitor.saved_events(fav, s, venues(spark))).collect()}
    assert "DTSTART:20260401T233000" in out[1] and "DTEND:20260402T013000" in out[1]
    assert "DTSTART;VALUE=DATE:20260401" in out[3]  # midnight is shown as untimed here


def test_calendar_files_have_one_envelope(spark, tmp_path):
    rows = stored(spark, dict(name="A"), dict(name="B", date=D(2026, 4, 2)), dict(name="C", date=D(2026, 4, 3)))
    sinks.write_feed(sinks.feed_entries(rows, venues(spark), NOW.date()), str(tmp_path / "feed"), "Hall")
    text = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "feed").glob("part-*")))
    lines = text.split("\r\n")
    assert (lines[0], lines[-2], lines[-1]) == ("BEGIN:VCALENDAR", "END:VCALENDAR", "")
    assert lines.count("BEGIN:VCALENDAR") == 1 and [x for x in lines if x.startswith("SUMMARY")] == ["SUMMARY:A", "SUMMARY:B", "SUMMARY:C"]


def test_calendar_json(spark):
    s = stored(spark, dict(name="A", show_min=1200))
    row = sinks.calendar_json(s, venues(spark)).select(
        F.get_json_object("json", "$.details.show_time").alias("t"), F.get_json_object("json", "$.background_color").alias("c")).first()
    assert tuple(row) == ("8:00 PM", "#111111")
