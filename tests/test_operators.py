"""Classification, display, visitors, moderation and validation."""

import datetime as dt
import random

from pyspark.sql import functions as F

from marquee.operators import classify, display, duplicates, enrich, filters, moderation, runlog, series, validation, visitor
from tests import models

D = dt.date
AS_OF = D(2026, 3, 10)
EVENT = ("id long, venue_id long, name string, artist string, date date, show_min int, doors_min int, genre string, subgenre string, status string, "
         "image_url string, ticket_url string, price_min double, price_max double, is_live_music boolean, is_manual_override boolean, "
         "is_manually_created boolean, duplicate_of_id long, classification_reason string, approved_at timestamp, updated_at timestamp, "
         "description string, age_restriction string, support_artists string, hash string")
FIELDS = [f.split()[0] for f in EVENT.split(", ")]


def events(spark, *rows):
    base = dict(venue_id=1, name="Show", date=AS_OF, status="on_sale", is_live_music=True, is_manual_override=False, is_manually_created=False)
    out = [[{**base, "id": i + 1, **r}.get(f) for f in FIELDS] for i, r in enumerate(rows)]
    return spark.createDataFrame(out, EVENT)


def venues(spark):
    return spark.createDataFrame(
        [(1, "The Hall", "the-hall", "Durham", "small", "mec", "#111111"), (2, "DPAC", "dpac", "Durham", "large", "ticketmaster", "#222222"),
         (3, "Promoter", "promoter", "Raleigh", "small", "manual", "#333333")],
        "id long, name string, slug string, city string, size_category string, source_kind string, color string")


# --- rules ---

def test_rule_reasons(spark):
    cases = {
        "Trivia with Bob": "keyword: trivia", "Classic yoga comedy": "keyword: comedy", "Open Mic": "keyword: open mic", "Stand-Up!": "keyword: stand-up",
        "Bloc Party": None, "Album Release Party": "keyword: release party", "Dance parties": "keyword: dance party", "Saturday Night: Emo Night": "keyword: emo night",
        "A Hard Day's Night": None, "Last Night": None, "Goth Nights": "keyword: goth night", "Über Night": "keyword: über night", "Marketing": None,
        "Release party night": "keyword: release party", None: None,
    }
    df = spark.createDataFrame([(n, None, None) for n in cases], "name string, genre string, subgenre string")
    got = {r.name: r.y for r in df.select("name", classify.rule_reason("name", "genre", "subgenre").alias("y")).collect()}
    assert got == cases
    df = spark.createDataFrame([("X", "Rock", "Film score"), ("Y", "", "Spoken Word"), ("Z", "Dance/Electronic", None)], "name string, genre string, subgenre string")
    assert [r.y for r in df.select(classify.rule_reason("name", "genre", "subgenre").alias("y")).collect()] == ["genre: film", "genre: spoken word", None]


def test_recurrence_counts_occasions_but_reports_dates(spark):
    run = [dict(name="Residency", date=AS_OF + dt.timedelta(days=i)) for i in (0, 1, 2, 3)]
    weekly = [dict(name=f"Jam {i}", date=AS_OF + dt.timedelta(days=7 * i)) for i in range(3)] + [dict(name="JAM!", date=AS_OF + dt.timedelta(days=1))]
    blank = [dict(name="2/14", date=AS_OF + dt.timedelta(days=7 * i)) for i in range(4)]
    df = events(spark, *run, *weekly, *blank)
    got = {r.series_key: (r.n_dates, r.n_occasions) for r in series.series_dates(df).collect()}
    assert got == {"residency": (4, 1), "jam": (4, 3), "": (4, 4)}
    assert {r.id: r.n_dates for r in series.recurring_rows(df).collect()} == {5: 4, 6: 4, 7: 4, 8: 4}


def test_layers_and_reclassify(spark):
    df = events(
        spark, dict(name="Trivia", is_manual_override=True), dict(name="Bingo"), dict(name="Comedy", venue_id=2), dict(name="Quiz", venue_id=2),
        dict(name="Yoga", approved_at=dt.datetime(2026, 1, 1)), dict(name="Yoga 2", is_live_music=False, classification_reason="old", approved_at=dt.datetime(2026, 1, 1)),
        dict(name="Karaoke", date=D(2025, 1, 1)))
    overrides = spark.createDataFrame([(1, "bingo", True), (2, "quiz", False)], "venue_id long, normalized_name string, is_live_music boolean")
    got = {r.id: (r.is_live_music, r.classification_reason) for r in classify.classify(df, overrides, venues(spark)).collect()}
    assert got == {
        2: (True, "series override: live music"), 3: (True, "venue: always live music"), 4: (False, "series override: non-live"),
        5: (False, "keyword: yoga"), 6: (False, "keyword: yoga"), 7: (False, "keyword: karaoke")}
    after = classify.reclassify(df, AS_OF, overrides, venues(spark))
    rows = {r.id: r for r in after.collect()}
    assert rows[5].approved_at is None and rows[5].approval_cleared and rows[6].approved_at is not None and rows[6].changed
    assert rows[7].is_live_music and not rows[7].seen and rows[1].is_live_music and not rows[1].changed
    assert tuple(classify.reclassify_stats(after).first()) == (6, 5, 1)


# --- display ---

def test_best_per_show_order(spark):
    df = events(
        spark, dict(name="A!", image_url="x", ticket_url="y", price_min=1.0, is_live_music=False), dict(name="a"), dict(name="B", is_manual_override=True, is_live_music=False),
        dict(name="b", image_url="x"), dict(name="C", updated_at=dt.datetime(2026, 1, 1)), dict(name="c"), dict(name="!!"), dict(name="??"), dict(name="D"), dict(name="d", image_url=""))
    assert sorted(r.id for r in display.best_per_show(df).collect()) == [2, 3, 5, 8, 10]
    assert sorted(r.id for r in display.best_per_show(df, keep_unlabelled=True).collect()) == [2, 3, 5, 7, 8, 10]


def test_first_per_is_cut_before_the_shuffle(spark):
    plan = display.first_per(events(spark, {}), ["venue_id"], [F.col("id").asc()])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_one_tile_per_day_prefers_on_sale(spark):
    df = events(spark, dict(venue_id=2, status="sold_out"), dict(venue_id=2), dict(venue_id=2), dict(), dict(), dict(venue_id=2, date=D(2026, 4, 1), status="sold_out"))
    rows = enrich.with_venue(df, venues(spark))
    assert sorted(r.id for r in display.one_tile_per_day(rows, [F.col("id").asc()]).collect()) == [2, 4, 5, 6]


def test_public_venues_drop_empty_hand_kept_ones(spark):
    df = events(spark, dict(), dict(duplicate_of_id=1), dict(date=D(2020, 1, 1)))
    assert [(r.id, r.upcoming) for r in enrich.public_venues(venues(spark), df, AS_OF).collect()] == [(2, 0), (1, 1)]


def test_malformed_bounds_are_ignored(spark):
    df = events(spark, dict(), dict(date=D(2030, 1, 1)))
    assert filters.date_window(df, "nonsense", "2026-12-31T10:00").count() == 1
    assert filters.date_window(df, "2026-13-40", None).count() == 2


def test_search_wildcards_stay_wildcards(spark):
    df = events(spark, dict(name="abc"), dict(name="x", artist="A%C"))
    assert df.where(filters.title_search("A_C")).count() == 2 and df.where(filters.title_search("%")).count() == 2


# --- visitors ---

def test_visitor_rules(spark):
    df = events(spark, dict(name="Live"), dict(name="Quiz", is_live_music=False), dict(name="Unknown", is_live_music=None), dict(name="Hidden"), dict(name="Away", venue_id=3))
    ids = lambda *i: spark.createDataFrame([(x,) for x in i], "event_id long")
    slugs = spark.createDataFrame([("promoter",)], "venue_slug string")
    see = lambda **k: sorted(r.id for r in visitor.visitor_view(df, venues(spark), hidden=ids(4), hidden_venues=slugs, favorites=ids(2, 5), **k).collect())
    assert see() == [1, 3]
    assert see(include_non_music=True) == [1, 2, 3]
    assert see(favorites_only=True) == [2]
    assert see(city="Raleigh") == []
    assert see(search="the HALL", include_non_music=True) == [1, 2, 3] and see(search="%") == []
    artists = spark.createDataFrame([("away",)], "artist string")
    assert see(for_you=True, artists=artists) == [5]


def test_taste_matches_both_ways(spark):
    df = events(spark, dict(name="An Evening with Waxahatchee"), dict(name="Wax"), dict(name="!!!"), dict(name="Other", artist="U2"))
    match = lambda *a: sorted(r.id for r in visitor.taste_matches(df, spark.createDataFrame([(x,) for x in a], "artist string")).collect())
    assert match("waxahatchee") == [1, 2, 3] and match("u2") == [4] and match("abc") == []
    users = spark.createDataFrame([(1, "waxahatchee"), (2, "u2")], "user_id long, artist string")
    assert sorted(tuple(r) for r in visitor.taste_pairs(df, users).collect()) == [(1, 1), (1, 2), (2, 4)]
    assert [r.user_id for r in visitor.visitors_with_long_artists(users).collect()] == [1]


def test_histogram_scale_has_a_floor(spark):
    df = events(spark, dict(), dict(date=AS_OF + dt.timedelta(days=1)), dict(date=AS_OF + dt.timedelta(days=1)), dict(date=D(2030, 1, 1)))
    rows = visitor.night_histogram(df, AS_OF, spark.createDataFrame([(2,)], "event_id long")).collect()
    assert len(rows) == 14 and [(r.shows, r.saved, r.lit, r.saved_lit) for r in rows[:3]] == [(1, 0, 1, 0), (2, 1, 3, 2), (0, 0, 0, 0)]


def test_poster_drops_malformed_dates(spark):
    saved = spark.createDataFrame([(1, 1, "B", "2026-04-01"), (1, 2, "A", "2026-04-01"), (1, 3, "C", "soon"), (1, 4, "D", "2020-01-01"), (1, 5, "E", None)],
                                  "user_id long, event_id long, title string, date string")
    assert [r.event_id for r in visitor.poster_events(saved, AS_OF, 2).orderBy("place").collect()] == [2, 1]


# --- duplicates ---

def test_review_order_and_members(spark):
    df = events(
        spark, dict(name="Sub Rosa", show_min=1320), dict(name="[LATE] Sub Rosa", doors_min=1140), dict(name="Folded", duplicate_of_id=1),
        dict(name="Alpha", venue_id=2, approved_at=dt.datetime(2026, 1, 1)), dict(name="Zz", venue_id=2, approved_at=dt.datetime(2026, 1, 1)), dict(name="Alone", venue_id=3))
    rows = duplicates.review_queue(df, AS_OF).collect()
    assert [(r.venue_id, r.id) for r in rows] == [(1, 2), (1, 1), (1, 3), (2, 4), (2, 5)]
    assert rows[0].score == 1.0 and rows[0].unfolded_rows == 2 and rows[3].all_approved


def test_fold_requests(spark):
    df = events(spark, dict(), dict(), dict(), dict(duplicate_of_id=3), dict(venue_id=2), dict(), dict())
    req = [(1, 1, 2), (2, 1, 1), (3, 4, 1), (4, 1, 3), (5, 1, 99), (6, 6, 5), (7, 2, 7), (8, 7, 6), (9, 1, None)]
    d = duplicates.fold_decisions(df, spark.createDataFrame(req, "request_id long, survivor_id long, duplicate_id long"))
    got = {r.request_id: (r.reason, r.crosses) for r in d.collect()}
    assert got[1] == (None, False) and got[2][0] == "self" and got[3][0] == "survivor is folded" and got[4][0] == "duplicate has dependents"
    assert got[5][0] == "missing row" and got[6] == (None, True) and got[7][0] == "clashes with an earlier request"
    assert got[8][0] == "clashes with an earlier request" and got[9][0] == "nothing to fold"
    after = duplicates.apply_folds(df, spark.createDataFrame(req, "request_id long, survivor_id long, duplicate_id long"), d)
    assert {r.id: r.duplicate_of_id for r in after.collect()} == {1: None, 2: 1, 3: None, 4: 3, 5: 6, 6: None, 7: None}
    back = duplicates.unfold(after, spark.createDataFrame([(2,)], "event_id long"))
    assert back.where("id = 2").first().duplicate_of_id is None


# --- moderation ---

def ts(day):
    return dt.datetime(2026, 3, day)


def test_verdicts_and_clearing(spark):
    df = events(spark, dict(), dict(is_manual_override=True, approved_at=ts(1)), dict())
    v = spark.createDataFrame([(1, False, ts(2)), (2, None, ts(2)), (3, False, ts(2)), (3, None, ts(3))], "event_id long, is_live_music boolean, decided_at timestamp")
    rows = {r.id: r for r in moderation.apply_verdicts(df, v).collect()}
    assert (rows[1].is_live_music, rows[1].is_manual_override, rows[1].classification_reason, rows[1].approved_at) == (False, True, "manual", ts(2))
    assert (rows[2].is_manual_override, rows[2].approved_at) == (False, None)
    assert (rows[3].is_live_music, rows[3].is_manual_override, rows[3].approved_at) == (False, False, None)


def test_series_approval(spark):
    df = events(spark, dict(name="Jam 1"), dict(name="Jam 2", approved_at=ts(1)), dict(name="Jam 3", date=D(2025, 1, 1)), dict(name="2/14"), dict(name="Jam", venue_id=2))
    a = lambda *rows: spark.createDataFrame(rows, "event_id long, whole_series boolean, approve boolean, decided_at timestamp")
    state = lambda df: {r.id: r.approved_at for r in df.collect()}
    assert state(moderation.apply_approvals(df, a((3, True, True, ts(5))), AS_OF)) == {1: ts(5), 2: ts(1), 3: None, 4: None, 5: None}
    assert state(moderation.apply_approvals(df, a((1, True, False, ts(5)), (1, False, True, ts(6))), AS_OF)) == {1: ts(6), 2: None, 3: None, 4: None, 5: None}
    reasons = {r.event_id: r.reason for r in moderation.approval_decisions(df, a((4, True, True, ts(5)), (9, False, True, ts(5)))).collect()}
    assert reasons == {4: "title has no series key", 9: "missing row"}


def test_override_upsert_and_queue(spark):
    df = events(spark, dict(name="Jam 1", is_live_music=False), dict(name="Jam 2", is_live_music=False, approved_at=ts(1)), dict(name="Solo"), dict(name="Solo", duplicate_of_id=3, is_live_music=False))
    old = spark.createDataFrame([(5, 1, "jam", "Jam", True, "x", ts(1))], "id long, venue_id long, normalized_name string, display_name string, is_live_music boolean, note string, created_at timestamp")
    req = spark.createDataFrame([(1, False, "n", ts(2)), (3, True, None, ts(2))], "event_id long, is_live_music boolean, note string, decided_at timestamp")
    new = moderation.upsert_overrides(old, df, req)
    rows = {r.normalized_name: r for r in new.collect()}
    assert (rows["jam"].id, rows["jam"].is_live_music, rows["jam"].display_name, rows["jam"].created_at) == (5, False, "Jam 1", ts(1)) and rows["solo"].is_live_music
    view = {r.id: r for r in moderation.queue_view(df, venues(spark), new, AS_OF).collect()}
    assert set(view) == {1, 4} and view[1].series_size == 2 and view[1].series_override_id == 5 and view[4].duplicate_of_name == "Solo"
    assert tuple(moderation.queue_counts(df, AS_OF).first()) == (2, 1)


# --- validation ---

BODY = ("seq long, venue_id long, name string, date string, price_min double, price_max double, doors_time string, show_time string, artist string, "
        "support_artists string, ticket_url string, genre string, age_restriction string, description string, is_live_music boolean")


def bodies(spark, *rows):
    cols = [c.split()[0] for c in BODY.split(", ")]
    return spark.createDataFrame([[{"seq": i + 1, "venue_id": 1, "name": f"N{i}", "date": "2026-05-01", **r}.get(c) for c in cols] for i, r in enumerate(rows)], BODY)


def test_manual_events(spark):
    from marquee.functions.text import identity_hash

    stored = events(spark, dict(name="Taken", date=D(2026, 5, 1))).withColumn("hash", identity_hash(F.lit("the-hall"), "date", "name"))
    checked = validation.check_manual_events(bodies(
        spark, dict(name=" A &amp; B ", show_time="20:00"), dict(venue_id=9), dict(name=" "), dict(date="2026-02-30"), dict(date="2014-12-31"), dict(date="2029-01-01"),
        dict(price_min=-1.0), dict(price_min=5.0, price_max=4.0), dict(doors_time="7pm"), dict(name="TAKEN!"), dict(name="a b"), dict(name="Ok", ticket_url="www.x")),
        venues(spark), stored, AS_OF)
    got = {r.seq: list(r.reasons) for r in checked.collect()}
    assert got == {1: [], 2: ["no such venue"], 3: ["name missing"], 4: ["date malformed"], 5: ["date out of range"], 6: ["date out of range"], 7: ["negative price"],
                   8: ["highest price below lowest"], 9: ["doors_time malformed"], 10: ["already on the calendar"], 11: ["already in this batch"], 12: []}
    rows = {r.name: r for r in validation.manual_event_rows(checked, stored, dt.datetime(2026, 3, 10)).collect()}
    assert set(rows) == {"A & B", "Ok"} and rows["A & B"].show_min == 1200 and rows["A & B"].is_manual_override and rows["Ok"].ticket_url is None


def test_event_edits(spark):
    stored = events(spark, dict(name="One", is_manually_created=True, hash="h1", price_min=5.0), dict(name="Two", hash="h2"))
    cols = "seq long, event_id long, venue_id long, name string, date string, price_min double, price_max double, show_time string, doors_time string, genre string, fields_set array<string>"
    p = spark.createDataFrame([
        (1, 1, None, "ignored", None, None, 1.0, None, None, "jazz", ["price_max"]), (2, 1, None, "New &amp; name", "2026-06-01", None, None, "21:00", None, " ", ["name", "date", "show_time", "genre"]),
        (3, 2, None, "x", None, None, None, None, None, None, ["name"]), (4, 9, None, None, None, None, None, None, None, None, ["genre"])], cols)
    checked = validation.check_event_edits(p, stored, venues(spark), AS_OF)
    assert {r.event_id: list(r.reasons) for r in checked.collect()} == {1: [], 2: ["not added by hand"], 9: ["no such event", "not added by hand"]}
    rows = {r.id: r for r in validation.apply_event_edits(stored, checked).collect()}
    assert (rows[1].name, rows[1].date, rows[1].show_min, rows[1].genre, rows[1].price_min) == ("New & name", D(2026, 6, 1), 1260, None, 5.0)
    assert rows[1].hash != "h1" and rows[2].name == "Two"


def test_event_and_venue_deletes(spark):
    df = events(spark, dict(is_manually_created=True), dict(duplicate_of_id=1), dict())
    checked = validation.check_event_deletes(spark.createDataFrame([(1,), (3,), (9,)], "event_id long"), df)
    assert {r.event_id: (r.accepted, r.restored_duplicates) for r in checked.collect()} == {1: (True, 1), 3: (False, None), 9: (False, None)}
    assert {r.id: r.duplicate_of_id for r in validation.apply_event_deletes(df, checked).collect()} == {2: None, 3: None}
    got = validation.check_venue_deletes(spark.createDataFrame([(1,), (3,), (8,)], "venue_id long"), venues(spark), df.withColumn("venue_id", F.lit(1)))
    assert {r.venue_id: list(r.reasons) for r in got.collect()} == {1: ["venue has a source"], 3: [], 8: ["no such venue"]}


def test_submissions(spark):
    cols = ("seq long, venue_id long, name string, date string, price_min double, price_max double, doors_time string, show_time string, ticket_url string, "
            "new_venue_name string, new_venue_city string, new_venue_website string")
    names = [c.split()[0] for c in cols.split(", ")]
    rows = [dict(venue_id=1, new_venue_name="Ignored"), dict(new_venue_name="Barn", new_venue_city="Cary"), dict(new_venue_name="the hall", new_venue_city="X"), dict(),
            dict(new_venue_name="Barn"), dict(venue_id=1, ticket_url="www.x"), dict(venue_id=1, name="x" * 501), dict(venue_id=1, date="2026-01-01"), dict(venue_id=8),
            dict(new_venue_name="!!", new_venue_city="X")]
    df = spark.createDataFrame([[{"seq": i + 1, "name": "N", "date": "2026-05-01", **r}.get(c) for c in names] for i, r in enumerate(rows)], cols)
    got = {r.seq: r for r in validation.check_submissions(df, venues(spark), AS_OF).collect()}
    assert {k: list(r.reasons) for k, r in got.items()} == {
        1: [], 2: [], 3: ["venue already listed"], 4: ["venue missing"], 5: ["city missing"], 6: ["ticket_url not absolute"], 7: ["name too long"],
        8: ["date has passed"], 9: ["no such venue"], 10: ["name has no letter or digit"]}
    assert got[1].new_venue_name is None and got[1].venue_slug == "the-hall" and got[2].venue_slug == "barn"


def test_admission_matches_model(spark):
    rng = random.Random(21)
    for cap in (1, 3):
        rows = [(i, rng.choice("abcd"), rng.choice("klmnopqr")) for i in range(60)]
        pending = [("a", "z1"), ("a", "z2"), ("b", "k")]
        counts = {}
        for who, _ in pending:
            counts[who] = counts.get(who, 0) + 1
        want = models.admissions(rows, counts, {"m"}, {k for _, k in pending}, cap)
        df = spark.createDataFrame(rows, "seq long, submitted_by string, show_key string")
        got = validation.admit_submissions(df, spark.createDataFrame([("m",)], "hash string"), spark.createDataFrame(pending, "submitted_by string, show_key string"), cap)
        assert {r.seq: r.reason for r in got.collect()} == want


def test_reviews(spark):
    subs = spark.createDataFrame(
        [(1, "pending", "A", D(2026, 5, 1), 1, None, None), (2, "pending", "B", D(2026, 5, 1), None, "Barn", "Cary"), (3, "rejected", "C", D(2026, 5, 1), 1, None, None),
         (4, "pending", "D", D(2026, 5, 1), None, "the hall", "X"), (5, "pending", "E", D(2026, 5, 1), 1, None, None)],
        "id long, status string, name string, date date, venue_id long, new_venue_name string, new_venue_city string").withColumns({
            "new_venue_website": F.lit(None).cast("string"), "price_min": F.lit(None).cast("double"), "price_max": F.lit(None).cast("double"),
            "show_min": F.lit(1200), "doors_min": F.lit(None).cast("int")})
    reviews = spark.createDataFrame([(1, True, "me", 1), (1, False, "me", 2), (2, True, "me", 3), (3, True, "me", 4), (4, True, "me", 5), (5, False, "me", 6), (9, True, "me", 7)],
                                    "submission_id long, approve boolean, reviewed_by string, seq long")
    got = {r.submission_id: (r.outcome, r.reason) for r in validation.review_submissions(subs, reviews, venues(spark), events(spark, dict(hash="x")), AS_OF).collect()}
    assert got == {1: ("approved", None), 2: ("approved", None), 3: ("refused", "already reviewed"), 4: ("refused", "no such venue"), 5: ("rejected", None), 9: ("refused", "no such submission")}


def test_manual_venues(spark):
    df = spark.createDataFrame([(1, "Barn", "Cary", None, None, " #ABCDEF "), (2, "barn!", "Cary", None, None, None), (3, "!!", "X", None, None, None),
                                (4, "The Hall", "X", None, None, None), (5, "New", "X", None, None, "red"), (6, None, "", None, None, None)],
                               "seq long, name string, city string, size_category string, website string, color string")
    got = {r.seq: (list(r.reasons), r.color, r.size_category) for r in validation.check_manual_venues(df, venues(spark)).collect()}
    assert got[1] == ([], "#abcdef", "small") and got[2][0] == ["already in this batch"] and got[3][0] == ["name has no letter or digit"]
    assert got[4][0] == ["name already used"] and got[5][0] == ["colour is not hex"] and got[6][0] == ["name missing", "city missing"]


# --- run log and integrity ---

def test_freshness_ignores_unfinished_successes(spark):
    now = dt.datetime(2026, 3, 10, 12)
    log = spark.createDataFrame([("success", now - dt.timedelta(hours=14)), ("success", None), ("failed", now)], "status string, finished_at timestamp")
    assert runlog.freshness(log, events(spark, {}), venues(spark), now).first().status == "stale"
    assert runlog.freshness(log, events(spark, {}), venues(spark), now - dt.timedelta(hours=2)).first().status == "ok"
    assert runlog.freshness(log.limit(0), events(spark, {}), venues(spark), now).first().status == "stale"


def test_run_log_rows(spark):
    scraped = spark.createDataFrame([(1,), (1,)], "venue_id long")
    outcomes = spark.createDataFrame([(1, 1, 1, 0, 0)], "venue_id long, created long, updated long, merged long, expired long")
    errors = spark.createDataFrame([(2, "HTTPError", "at ?apikey=s3cret")], "venue_id long, kind string, message string")
    rows = {r.venue_id: r for r in runlog.run_log_rows(venues(spark), scraped, outcomes, errors, dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 1, 0, 1)).collect()}
    assert (rows[1].status, rows[1].events_found, rows[1].events_created, rows[1].duration_seconds) == ("success", 2, 1, 60.0)
    assert (rows[2].status, rows[2].error_message) == ("failed", "HTTPError: at ?apikey=<redacted>")


def test_dangling_pointers(spark):
    df = events(spark, dict(duplicate_of_id=2), dict(duplicate_of_id=9), dict())
    assert {r.id: r.duplicate_of_id for r in runlog.clear_dangling(df, "duplicate_of_id", df).collect()} == {1: 2, 2: None, 3: None}
    assert runlog.self_folds(events(spark, dict(duplicate_of_id=1))).count() == 1


def test_a_page_reads_and_sorts_its_days_only(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, None if r.random() < 0.05 else dt.date(2026, 1, 1) + dt.timedelta(days=int(r.paretovariate(1)) % 60)) for i in range(1, 1001)]
    spark.createDataFrame(rows, "id long, date date").repartition(4).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    want = [i for i, d in sorted(rows, key=lambda x: (x[1] is not None, x[1] or dt.date(1, 1, 1), x[0]))]
    for size in (1, 7, 50, 200):
        for no in {1, 2, 3, 1000 // size, 1000 // size + 1, 1000 // size + 5}:
            assert [x.id for x in filters.page(df, no, size).collect()] == want[(no - 1) * size : no * size]
    plan = filters.page(df, 95, 10)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date," in plan and "LessThanOrEqual(date," in plan
