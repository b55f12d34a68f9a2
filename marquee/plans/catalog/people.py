"""Visitors: saved shows, hidden shows and taste."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.text import taste_form
from ...operators import visitor
from .aggregates import TOP_USER, _user_favorites
from .entry import q
from .standin import AS_OF

TASTE = r"trim(regexp_replace(regexp_replace(lower({x}), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"
MINE = f"SELECT DISTINCT {TASTE.format(x='artist')} AS a FROM artist_entries WHERE user_id = {TOP_USER}"
TITLE = "coalesce(nullif(artist, ''), name)"
MATCHES = f"""SELECT id FROM (SELECT id, {TASTE.format(x=TITLE + " || ' ' || coalesce(artist, '')")} AS hay, {TASTE.format(x=TITLE)} AS t FROM listings) l
  WHERE EXISTS (SELECT 1 FROM ({MINE}) WHERE length(a) > 1 AND (contains(hay, a) OR (length(a) > 3 AND contains(a, t))))"""


def _top_user(t):
    f = t.favorites()
    return f.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "user_id").limit(1).select("user_id")


def _of_top(t, df):
    return df.join(_top_user(t), "user_id", "left_semi")


def _artists(t):
    return visitor.artist_list(_of_top(t, t.artist_entries()))


ENTRIES = [
    q("visitor_view", "F11 F12 J13 P18", lambda t: visitor.visitor_view(
        t.listings(), t.venues(), favorites=_user_favorites(t), hidden=_of_top(t, t.hidden()), hidden_venues=_of_top(t, t.hidden_venues()),
        search="Brand#1").select("id", "name", "date", "venue_slug"),
      f"""SELECT l.id, l.name, l.date, l.venue_slug FROM listings l JOIN venues v ON l.venue_id = v.id WHERE l.is_live_music
      AND l.id NOT IN (SELECT event_id FROM hidden WHERE user_id = {TOP_USER}) AND l.venue_slug NOT IN (SELECT venue_slug FROM hidden_venues WHERE user_id = {TOP_USER})
      AND contains(lower(concat_ws(' ', coalesce(l.artist, l.name), l.name, l.artist, v.name)), 'brand#1')"""),
    q("favourites_view", "F11 J13", lambda t: visitor.visitor_view(
        t.listings(), t.venues(), favorites=_user_favorites(t), favorites_only=True, city="NATION_3").select("id", "venue_city", "is_live_music"),
      f"""SELECT l.id, v.city AS venue_city, l.is_live_music FROM listings l JOIN venues v ON l.venue_id = v.id WHERE v.city = 'NATION_3'
      AND l.id IN (SELECT event_id FROM favorites WHERE user_id = {TOP_USER})"""),
    q("taste_matches", "J12 T37", lambda t: visitor.taste_matches(t.listings(), _artists(t)), MATCHES),
    q("for_you_view", "F11 J12", lambda t: visitor.visitor_view(
        t.listings(), t.venues(), artists=_artists(t), for_you=True, include_non_music=True).select("id"), MATCHES),
    q("artist_list", "A22", lambda t: visitor.artist_list(t.artist_entries()).select(
        "user_id", "artist", F.col("first_seen.list_no").alias("list_no"), F.col("first_seen.pos").alias("pos")),
      f"""SELECT user_id, artist, list_no, pos FROM (SELECT user_id, {TASTE.format(x='artist')} AS artist, list_no, pos,
      row_number() OVER (PARTITION BY user_id, {TASTE.format(x='artist')} ORDER BY list_no, pos) AS place FROM artist_entries) WHERE place = 1 AND length(artist) > 1"""),
    q("poster_events", "O7", lambda t: visitor.poster_events(visitor.saved_events(t.favorites(), t.listings(), t.venues()), AS_OF)
      .select("user_id", "place", "event_id", "title", "date"),
      f"""SELECT * FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY date, {TITLE}, event_id)::INT AS place, event_id, {TITLE} AS title,
      strftime(date, '%Y-%m-%d') AS date FROM (SELECT DISTINCT user_id, event_id FROM favorites) JOIN listings ON id = event_id WHERE date >= '1998-06-01') WHERE place <= 15"""),
    q("taste_words", "T37", lambda t: t.table("documents").select("doc_id", taste_form("text").alias("words")),
      f"SELECT doc_id, {TASTE.format(x='text')} AS words FROM documents"),
]
