"""Live-music verdicts: ordered title and genre rules under layered overrides."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, series_key
from ..session import cut_lineage
from .filters import revision_floor
from .joins import is_true
from .series import RECURRENCE_THRESHOLD, recurring_series

# Fixed values, in the order in which they are tried.
KEYWORDS = (
    "karaoke", "trivia", "bingo", "quizzo", "quiz", "open mic", "open-mic", "open decks", "comedy", "stand-up",
    "standup", "improv", "drag", "burlesque", "silent disco", "screening", "film screening", "movie", "market",
    "pop-up", "popup", "yoga", "brunch", "book club", "poetry", "spoken word", "workshop", "meetup", "networking",
    "speed dating", "sing-along", "singalong",
)
NIGHT_EXCEPTIONS = (
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "last", "one", "good", "hard",
)
PARTY_THEMES = (
    "listening", "release", "album", "single", "launch", "block", "dance", "watch", "viewing", "after", "silent",
)
GENRE_TOKENS = ("comedy", "theatre", "theater", "film", "sports", "family", "magic", "illusion", "spoken word")
ALWAYS_LIVE_VENUES = ("dpac",)


@dataclass(frozen=True)
class Rules:
    keywords: Sequence[str] = KEYWORDS
    night_exceptions: Sequence[str] = NIGHT_EXCEPTIONS
    party_themes: Sequence[str] = PARTY_THEMES
    genre_tokens: Sequence[str] = GENRE_TOKENS


def _word(text: str) -> str:
    return r"\b" + re.escape(text).replace(r"\ ", " ") + r"\b"


def rule_reason(name: Column | str, genre: Column | str, subgenre: Column | str, rules: Rules = Rules()) -> Column:
    """Why a listing is not live music, or null when it is."""
    name, genre, subgenre = (F.col(c) if isinstance(c, str) else c for c in (name, genre, subgenre))
    text = F.coalesce(name, F.lit(""))

    # One pass decides whether any keyword occurs; only then is the first of them sought.
    any_keyword = "(?iU)" + "|".join(_word(k) for k in rules.keywords)
    first_keyword = F.coalesce(
        *[F.when(text.rlike("(?iU)" + _word(k)), F.lit(f"keyword: {k}")) for k in rules.keywords]
    )
    themes = "|".join(re.escape(t) for t in rules.party_themes)
    theme = blank_to_null(F.lower(F.regexp_extract(text, rf"(?iU)\b({themes})\s+part(?:y|ies)\b", 1)))
    words = F.transform(F.regexp_extract_all(text, F.lit(r"(?iU)\b(\w+)\s+nights?\b"), F.lit(1)), F.lower)
    themed = F.get(
        F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*rules.night_exceptions)), F.lit(0)
    )
    haystack = F.lower(F.concat_ws(" ", blank_to_null(genre), blank_to_null(subgenre)))
    token = F.coalesce(*[F.when(haystack.contains(t), F.lit(f"genre: {t}")) for t in rules.genre_tokens])
    return F.coalesce(
        F.when(text.rlike(any_keyword), first_keyword),
        F.concat(F.lit("keyword: "), theme, F.lit(" party")),
        F.when(F.lower(text).contains("night"), F.concat(F.lit("keyword: "), themed, F.lit(" night"))),
        token,
    )


def classify(listings: DataFrame, overrides: DataFrame | None = None, venues: DataFrame | None = None, *,
             exempt_slugs: Sequence[str] = ALWAYS_LIVE_VENUES, rules: Rules = Rules(),
             threshold: int = RECURRENCE_THRESHOLD, series: DataFrame | None = None) -> DataFrame:
    """``(id, is_live_music, classification_reason)`` for rows without a person's verdict.

    Layers, strongest first: series override, always-live venue, recurrence, rules.
    Recurrence counts every listing passed in, also those a person has judged; ``series``
    (venue_id, series_key, n_dates) names the recurring series where they are known already.
    """
    found = recurring_series(listings, threshold) if series is None else series
    judged = _judged(listings.where(~is_true("is_manual_override")), found, overrides, venues, exempt_slugs, rules)
    return judged.select("id", F.col("_live").alias("is_live_music"), F.col("_why").alias("classification_reason"))


def _judged(rows: DataFrame, series: DataFrame, overrides: DataFrame | None, venues: DataFrame | None,
            exempt_slugs: Sequence[str], rules: Rules) -> DataFrame:
    """``rows`` with their verdict ``_live`` and the reason ``_why``."""
    shown = rows.columns
    found = series.select("venue_id", F.col("series_key").alias("_key"), F.col("n_dates").alias("_dates"))
    rows = rows.withColumn("_key", series_key("name")).join(found, ["venue_id", "_key"], "left")
    forced = F.lit(None).cast("boolean")
    exempt = F.lit(False)
    if overrides is not None:
        rows = rows.join(
            overrides.select("venue_id", F.col("normalized_name").alias("_key"), F.col("is_live_music").alias("_forced")),
            ["venue_id", "_key"], "left",
        )
        forced = F.col("_forced")
    if venues is not None:
        chosen = venues.where(F.col("slug").isin(list(exempt_slugs))).select(
            F.col("id").alias("venue_id"), F.lit(True).alias("_exempt")
        )
        rows = rows.join(chosen, "venue_id", "left")
        exempt = is_true("_exempt")
    why = rule_reason("name", "genre", "subgenre", rules)
    reason = (
        F.when(forced, F.lit("series override: live music"))
        .when(~forced, F.lit("series override: non-live"))
        .when(exempt, F.lit("venue: always live music"))
        .when(F.col("_dates").isNotNull(), F.concat(F.lit("recurring: "), F.col("_dates").cast("string"), F.lit(" dates")))
        .otherwise(why)
    )
    judged = rows.select(*shown, forced.alias("_forced"), exempt.alias("_exempt"), reason.alias("_why"))
    live = F.coalesce(F.col("_forced"), F.col("_exempt") | F.col("_why").isNull())
    return judged.select(*shown, live.alias("_live"), "_why")


def reclassify(listings: DataFrame, as_of: dt.date, overrides: DataFrame | None = None,
               venues: DataFrame | None = None, **options) -> DataFrame:
    """The stored table with fresh verdicts from the revision floor on.

    Adds ``seen``, ``changed`` and ``approval_cleared``. An approval is cleared only when the verdict flips;
    a reworded reason keeps it.
    """
    floor = F.lit(revision_floor(as_of))
    fresh = classify(listings.where(F.col("date") >= floor), overrides, venues, **options).select(
        F.col("id").alias("_id"), F.col("is_live_music").alias("_live"), F.col("classification_reason").alias("_why"),
        F.lit(True).alias("_judged"),
    )
    return _revised(listings.join(fresh, listings["id"] == fresh["_id"], "left").drop("_id"), floor)


def _revised(rows: DataFrame, floor: Column) -> DataFrame:
    """``rows`` with the verdicts ``_live`` and ``_why`` put in place where ``_judged`` is true."""
    judged = is_true("_judged")
    flips = judged & ~F.col("is_live_music").eqNullSafe(F.col("_live"))
    changes = flips | (judged & ~F.col("classification_reason").eqNullSafe(F.col("_why")))
    cleared = flips & F.col("approved_at").isNotNull()
    return rows.withColumns({
        "seen": F.coalesce(F.col("date") >= floor, F.lit(False)),
        "changed": changes,
        "approval_cleared": cleared,
        "approved_at": F.when(~cleared, F.col("approved_at")),
        "is_live_music": F.when(judged, F.col("_live")).otherwise(F.col("is_live_music")),
        "classification_reason": F.when(judged, F.col("_why")).otherwise(F.col("classification_reason")),
    }).drop("_live", "_why", "_judged")


def reclassify_written(table: DataFrame, as_of: dt.date, overrides: DataFrame | None = None, venues: DataFrame | None = None, *,
                       exempt_slugs: Sequence[str] = ALWAYS_LIVE_VENUES, threshold: int = RECURRENCE_THRESHOLD,
                       series: DataFrame | None = None) -> DataFrame:
    """:func:`reclassify` of a written table, which may be read several times.

    Verdicts are put in place on the rows that get one, so that the table itself need not travel
    to them; the other rows stay where they are. Rows that share an id share verdicts as well: they
    alone, found by 64-bit prints of the ids, go by :func:`reclassify`.
    """
    floor = F.lit(revision_floor(as_of))
    recent = is_true(F.col("date") >= floor)
    if series is None:
        series = recurring_series(table.where(F.col("date") >= floor), threshold)
    prints = table.select(F.xxhash64("id").alias("_print")).groupBy("_print").agg(F.count(F.lit(1)).alias("_n"))
    shared = cut_lineage(prints.where("_n > 1").select("_print"), "shared")
    single = table
    if not shared.isEmpty():
        table = table.withColumn("_print", F.xxhash64("id"))
        single = table.join(shared, "_print", "left_anti").drop("_print")
        several = table.join(shared, "_print", "left_semi").drop("_print")
    judge = recent & ~is_true("is_manual_override") & F.col("id").isNotNull()
    rows = _judged(single.where(judge), series, overrides, venues, exempt_slugs, Rules()).withColumn("_judged", F.lit(True))
    rest = single.where(~judge).select("*", F.lit(None).cast("boolean").alias("_live"), F.lit(None).cast("string").alias("_why"), F.lit(False).alias("_judged"))
    revised = _revised(rows.unionByName(rest), floor)
    if single is table:
        return revised
    again = reclassify(several, as_of, overrides, venues, exempt_slugs=exempt_slugs, threshold=threshold, series=series)
    return revised.unionByName(again)


def reclassify_stats(reclassified: DataFrame) -> DataFrame:
    return reclassified.agg(
        F.count_if("seen").alias("seen"), F.count_if("changed").alias("changed"),
        F.count_if("approval_cleared").alias("unapproved"),
    )
