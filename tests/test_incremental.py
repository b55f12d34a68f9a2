"""Tables in buckets, the refresh that touches some of them, and batches that run again."""

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.functions.text import identity_hash
from marquee.plans.incremental import refresh_buckets
from marquee.plans.refresh import refresh
from marquee.schema import EVENTS, SCRAPED, SERIES_OVERRIDES
from marquee.sources.versions import Buckets, current, publish, recorded, versions
from marquee.streaming.refresh_stream import on_time, start_refresh

D, NOW = dt.date, dt.datetime(2026, 3, 10, 12)
LANDED = T.StructType([T.StructField("pos", T.LongType()), T.StructField("venue_id", T.LongType()), *SCRAPED.fields])
BUCKETS = 8


def venues(spark, exempt=()):
    rows = [(i, f"V{i}", "dpac" if i in exempt else f"v{i}", "Durham", "#111111", "mec") for i in range(1, 31)]
    return spark.createDataFrame(rows, "id long, name string, slug string, city string, color string, source_kind string")


def frame(spark, schema, base, rows):
    df = spark.createDataFrame([[{**base, **r}.get(f) for f in schema.names] for r in rows], schema)
    slug = F.concat(F.lit("v"), "venue_id")
    return df.withColumn("hash", identity_hash(slug, "date", "name"))


def stored(spark, rows):
    base = dict(source="mec", status="on_sale", is_live_music=True, is_manual_override=False, is_manually_created=False,
                updated_at=dt.datetime(2026, 1, 1), created_at=dt.datetime(2026, 1, 1))
    return frame(spark, EVENTS, base, [{"id": i + 1, **r} for i, r in enumerate(rows)])


def landed(spark, rows):
    return frame(spark, LANDED, dict(source="mec", status="on_sale"), [{"pos": i, **r} for i, r in enumerate(rows)])


def overrides(spark, rows):
    return spark.createDataFrame([[{**dict(id=i), **r}.get(f) for f in SERIES_OVERRIDES.names] for i, r in enumerate(rows)], SERIES_OVERRIDES)


TITLES = ["Jazz Jam", "Trivia", "The Lumps", "Soul Session", "Open Mic", "Weekly Waltz", "One Off", "", "Country Night"]


def random_rows(r, n, some, first=D(2026, 1, 20), days=120):
    rows = []
    for i in range(n):
        rows.append(dict(venue_id=r.choice(some), name=r.choice(TITLES), date=first + dt.timedelta(days=r.randrange(days)),
                         external_id=r.choice([None, "", f"e{r.randrange(40)}"]), genre=r.choice([None, "Comedy", "Rock"])))
    return rows


def lines(df):
    return sorted(map(str, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))


def files(df):
    return {r[0] for r in df.select(F.input_file_name()).distinct().collect()}


def test_three_batches_equal_the_whole_refresh(spark, tmp_path):
    r = random.Random(4)
    root = str(tmp_path / "events")
    rows = random_rows(r, 500, list(range(1, 31)))
    for row in r.sample(rows, 60):
        row.update(approved_at=dt.datetime(2026, 2, 1), is_manual_override=r.random() < 0.3, is_manually_created=r.random() < 0.3)
    whole = stored(spark, rows).cache()
    publish(whole, root, 0)
    steps = [
        (random_rows(r, 60, [3, 4]), NOW, [], ()),
        (random_rows(r, 60, [4, 9]), NOW + dt.timedelta(days=1), [dict(venue_id=7, normalized_name="jazz jam", is_live_music=False)], (12,)),
        (random_rows(r, 40, [20]), NOW + dt.timedelta(days=9), [dict(venue_id=8, normalized_name="trivia", is_live_music=True)], ()),
        ([], NOW + dt.timedelta(days=4), [dict(venue_id=8, normalized_name="trivia", is_live_music=True)], (12, 13)),
    ]
    judged_elsewhere = 0
    for n, (new, now, forced, exempt) in enumerate(steps, 1):
        some = landed(spark, new)
        args = (venues(spark, exempt), overrides(spark, forced), now.date(), now)
        want = refresh(whole, some, *args)
        done = refresh_buckets(spark, root, n, some, *args, buckets=BUCKETS)
        assert lines(done.table) == lines(want.table)
        assert lines(current(spark, root)) == lines(want.table)
        touched = {x["venue_id"] for x in new}
        ours = {x.venue_id: tuple(x) for x in done.outcomes.collect()}
        assert all(ours[x.venue_id] == tuple(x) for x in want.outcomes.collect() if x.venue_id in touched)
        old = {x.id: x for x in whole.collect()}
        judged_elsewhere += sum(x.id in old and x.venue_id not in touched and x.classification_reason != old[x.id].classification_reason for x in want.table.collect())
        whole = want.table.cache()
    assert judged_elsewhere > 0         # floors, overrides and exempt venues did change verdicts outside the batches


def test_a_batch_writes_only_its_buckets(spark, tmp_path):
    root = str(tmp_path / "events")
    rows = [dict(venue_id=1 + i % 30, name=f"Show {i}", external_id=f"e{i}", date=D(2026, 4, 1)) for i in range(600)]
    publish(stored(spark, rows), root, 0)
    args = (venues(spark), None, NOW.date(), NOW)
    refresh_buckets(spark, root, 1, landed(spark, []), *args, buckets=BUCKETS)
    before = Buckets(spark, root, buckets=BUCKETS)
    old = before.manifest(1).folders
    some = landed(spark, [dict(venue_id=5, name=f"New {i}", date=D(2026, 4, 2)) for i in range(3)])
    refresh_buckets(spark, root, 2, some, *args, buckets=BUCKETS)
    new = before.manifest(2).folders
    touched = before.of(some)
    assert len(touched) == 1 and {b for b in new if new[b] != old[b]} == touched
    kept = before.read(2, set(range(BUCKETS)) - touched)
    assert files(kept) <= files(before.read(1)) and not files(before.read(2, touched)) & files(before.read(1))
    written = sum(p.stat().st_size for at in {new[b] for b in touched} for p in Path(root, at).glob("*.parquet"))
    whole = sum(p.stat().st_size for at in old.values() for p in Path(root, at).glob("*.parquet"))
    assert written < whole / 3
    assert lines(before.read(1)) == lines(stored(spark, rows).select(*before.read(1).columns))     # a version stays as it was


def test_buckets_come_and_go(spark, tmp_path):
    t = Buckets(spark, str(tmp_path / "t"), "k", 4)
    rows = spark.range(20).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    t.replace(rows, 0, range(4), None)
    assert lines(t.read(0)) == lines(rows) and lines(t.read(0, {1})) == lines(rows.where(t.number() == 1))
    t.replace(rows.limit(0), 1, {1, 2}, 0)
    assert set(t.manifest(1).folders) == {0, 3} and lines(t.read(1)) == lines(rows.where(~t.number().isin(1, 2)))
    t.replace(rows.limit(0), 2, range(4), 1)
    assert t.read(2).count() == 0 and t.read(2).columns == ["k", "x"]
    t.replace(rows.where(t.number() == 2), 3, {2}, 2)
    assert lines(t.read(3)) == lines(rows.where(t.number() == 2)) and versions(spark, t.root) == [0, 1, 2, 3]
    other = Buckets(spark, t.root, "k", 5)      # other buckets than the base's: all are written
    other.replace(rows, 4, {0}, 3)
    assert lines(other.read(4)) == lines(rows) and lines(other.read(3, {0})) == lines(rows.where((t.number() == 2) & (other.number() == 0)))


def test_a_hot_key_is_written_by_several_tasks(spark, tmp_path):
    t = Buckets(spark, str(tmp_path / "t"), "k", 4)
    rows = spark.range(0, 400_000, 1, 8).select(F.lit(7).cast("long").alias("k"), F.md5(F.col("id").cast("string")).alias("x"))
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        t.replace(rows, 0, range(4), None)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    assert t.read(0).count() == 400_000 and len(files(t.read(0))) > 1


def test_a_batch_that_runs_again_gives_equal_rows(spark, tmp_path):
    """The stream fails after the table was written and before the batch is committed; the second run has another clock."""
    root, landing = str(tmp_path / "events"), str(tmp_path / "landing")
    publish(stored(spark, [dict(venue_id=1, name="Old", external_id="x", date=D(2026, 4, 1)), dict(venue_id=2, name="Far", date=D(2026, 4, 1))]), root, 0)
    some = landed(spark, [dict(venue_id=1, name="New", external_id="x", date=D(2026, 4, 1)), dict(venue_id=1, name="Extra", date=D(2026, 4, 3))])
    some.coalesce(1).write.parquet(landing)
    hours = iter(range(100))

    def go(on_batch=None):
        start_refresh(spark, landing, some.schema, root, str(tmp_path / "ck"), venues(spark), None, lambda: NOW + dt.timedelta(hours=next(hours)),
                      on_batch, str(tmp_path / "log")).awaitTermination()

    def killed(batch_id, outcomes):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        go(killed)
    first = lines(current(spark, root))
    assert versions(spark, root) == [0, 1]
    go()
    assert lines(current(spark, root)) == first and versions(spark, root) == [0, 1]
    assert {r.updated_at for r in current(spark, root).collect()} == {NOW, dt.datetime(2026, 1, 1)}
    assert spark.read.parquet(str(tmp_path / "log")).count() == 1       # the log of a batch is replaced, not added to


def test_a_late_scrape_is_dropped(spark, tmp_path):
    rows = landed(spark, [dict(venue_id=1, name="A", date=D(2026, 4, 1)), dict(venue_id=2, name="B", date=D(2026, 4, 1))])
    root = str(tmp_path / "scrapes")
    at = lambda n, only=None: rows.where("true" if only is None else f"venue_id = {only}").withColumn("scrape", F.lit(n).cast("long"))     # noqa: E731
    names = lambda df: sorted(r.name for r in df.collect())     # noqa: E731
    assert names(on_time(spark, root, at(5), 1)) == ["A", "B"]
    assert names(on_time(spark, root, at(7, 2), 2)) == ["B"]
    assert names(on_time(spark, root, at(6), 3)) == ["A"]
    assert names(on_time(spark, root, at(6), 3)) == ["A"]       # run again
    assert names(on_time(spark, root, at(7), 4)) == ["A", "B"]


def test_recorded_values_stay(spark, tmp_path):
    assert [recorded(spark, str(tmp_path / "c"), x) for x in ("one", "two")] == ["one", "one"]
