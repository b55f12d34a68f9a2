"""Duplicate review: candidates by fact, similarity only for the order; folding."""

from __future__ import annotations

import datetime as dt
import sys
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import similarity_form
from ..session import cut_lineage
from .filters import revision_floor, unfolded
from .joins import is_true

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 64  # titles per block where many share a letter


def crowded_nights(listings: DataFrame) -> DataFrame:
    """(venue, date) pairs with more than one unfolded row."""
    return (
        unfolded(listings).groupBy("venue_id", "date").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
    )


def rows_of_nights(listings: DataFrame, nights: DataFrame) -> DataFrame:
    """Every row, folded or not, of the given (venue, date) pairs."""
    return listings.join(nights, ["venue_id", "date"], "left_semi")


SYMBOLS = " abcdefghijklmnopqrstuvwxyz0123456789"
#: From rare to frequent. Any order gives the same scores; a good one keeps lists short.
RARE_FIRST = "0123456789zqxjkvbpygfwmucldrhsnioate "
FOUND = T.StructType([T.StructField("best", T.DoubleType()), T.StructField("pairs", T.LongType())])


def _ratio(earlier: str, later: str) -> float:
    return SequenceMatcher(None, earlier, later).ratio()


@F.pandas_udf(FOUND)
def _neighbour_ratio(titles: pd.Series, others: pd.Series) -> pd.DataFrame:
    """Similarity of two titles; of a missing one 0."""
    scores = [_ratio(a, b) if a and b else 0.0 for a, b in zip(titles, others)]
    return pd.DataFrame({"best": scores, "pairs": [int(bool(a and b)) for a, b in zip(titles, others)]})


@F.pandas_udf(FOUND)
def _tile_best(tiles: pd.Series, floors: pd.Series) -> pd.DataFrame:
    """The best similarity above ``floor`` (or ``floor``) in each tile, and how many pairs were scored for it.

    Each item is (order, title, side); two sides are compared with each other, a single
    side with itself. The letters two titles have in common bound their similarity. Pairs
    are taken from the highest bound on; the first bound that is not above the best ends it.
    """
    place = {c: i for i, c in enumerate(SYMBOLS)}

    def best(items, floor: float) -> tuple[float, int]:
        rows = sorted(((i["order"], i["title"], i["side"]) for i in items), key=lambda r: (r[0] is not None, *r))
        if len(rows) == 2 and not floor:  # most nights: nothing to choose from
            return max(floor, _ratio(rows[0][1], rows[1][1])), 1
        bags = np.zeros((len(rows), len(SYMBOLS)), np.int32)
        for i, (_, title, _) in enumerate(rows):
            for c in title:
                bags[i, place[c]] += 1
        sizes = bags.sum(1)
        sides = np.array([r[2] for r in rows])
        two_sided = len(set(sides.tolist())) > 1
        offers = []
        for j in range(1, len(rows)):
            bound = 2.0 * np.minimum(bags[:j], bags[j]).sum(1) / (sizes[:j] + sizes[j])
            for i in np.flatnonzero((bound > floor) & ((sides[:j] != sides[j]) if two_sided else True)):
                offers.append((-bound[i], j, int(i)))
        offers.sort()
        top, pairs = floor, 0
        for bound, j, i in offers:
            if -bound <= top:
                break
            top, pairs = max(top, _ratio(rows[i][1], rows[j][1])), pairs + 1
        return top, pairs

    return pd.DataFrame([best(t, f) for t, f in zip(tiles, floors)], columns=["best", "pairs"])


NIGHT = ["venue_id", "date"]


def _folded(found: DataFrame, floors: DataFrame | None = None) -> DataFrame:
    """The best and the number of scored pairs per night, over ``found`` and an earlier result."""
    rows = found if floors is None else found.unionByName(floors)
    return cut_lineage(rows.groupBy(*NIGHT).agg(F.max("best").alias("best"), F.sum("pairs").alias("pairs")), "night-best")


def _neighbours(titles: DataFrame) -> DataFrame:
    """A first guess: titles next to each other by their beginnings, endings and letters."""
    letters = F.array_join(F.array_sort(F.split("title", "")), "")
    found = []
    for key in (F.col("title"), F.reverse("title"), letters):
        # windows are cut by the first characters, so a crowded night is not one window
        rows = titles.withColumn("_key", key).withColumn("_part", F.substring("_key", 1, 3))
        w = Window.partitionBy(*NIGHT, "_part").orderBy("_key", "order")
        before = F.lag(F.struct("order", "title")).over(w)
        rows = rows.withColumn("_before", before).withColumn("_swap", F.col("_before.order") > F.col("order"))
        first = F.when(F.col("_swap"), F.col("title")).otherwise(F.col("_before.title"))
        second = F.when(F.col("_swap"), F.col("_before.title")).otherwise(F.col("title"))
        found.append(rows.select(*NIGHT, _neighbour_ratio(first, second).alias("_found")).select(*NIGHT, "_found.*"))
    return reduce(DataFrame.unionByName, found)


def _rarest(titles: DataFrame, floors: DataFrame, most: int | None = None) -> DataFrame:
    """Titles by those of their letters (the k-th of its kind) that a better pair must share one of.

    Two titles over ``best`` have so many letters in common that, all letters being in one
    order, they share one of the first few of each; how few follows from length and ``best``.
    """
    letters = F.array_sort(F.split("title", ""))
    cells = F.transform("_letters", lambda c, i: F.struct(
        (F.array_position("_letters", c) - i - 2).cast("int").alias("again"), F.instr(F.lit(RARE_FIRST), c).alias("rank")))
    size = F.length("title")
    needed = F.ceil(size * F.col("best") / (2 - F.col("best")) - 1e-9)
    some = F.least(size, size - needed + 1).cast("int")
    if most:
        some = F.least(some, F.lit(most))
    rows = titles.join(floors.where("best < 1").select(*NIGHT, "best"), NIGHT).withColumn("_letters", letters)
    return rows.select(*NIGHT, "order", "title", "best", F.explode(F.slice(F.array_sort(cells), F.lit(1), some)).alias("_letter"))


def _tiles(lists: DataFrame, block: int) -> DataFrame:
    """Best and pairs of each list of titles; a long list is cut into blocks, each pair of which is a task of its own."""
    key = [*NIGHT, "_letter"]
    blocks = lists.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    blocked = (
        lists.join(blocks.drop("_n"), key)
        .withColumn("_own", F.pmod(F.xxhash64("title"), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    )
    tiles = blocked.groupBy(*key, F.least("_own", "_other").alias("_lo"), F.greatest("_own", "_other").alias("_hi")).agg(
        F.collect_list(F.struct("order", "title", F.col("_own").alias("side"))).alias("_titles"), F.first("best").alias("best"))
    return tiles.where(F.size("_titles") > 1).select(*NIGHT, _tile_best("_titles", "best").alias("_found")).select(*NIGHT, "_found.*")


def best_pairs(titles: DataFrame, block: int = BLOCK) -> DataFrame:
    """venue_id, date, the best similarity of two ``titles`` (order, title; distinct, not empty) of a night, and the pairs scored for it.

    Rounds share the best of each night: neighbours in three orders, then titles with the same
    rarest letter, then all that can still beat what those found.
    """
    floors = _folded(_neighbours(titles))
    for most in (1, None):
        floors = _folded(_tiles(_rarest(titles, floors, most), block), floors)
    return floors


def cluster_scores(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The strongest title similarity per (venue, date), from 0 to 1.

    Titles are first reduced to distinct forms. A form held by two rows settles its
    night at 1 without any comparison, so copies cost nothing. A night of at most ``block``
    forms is one tile; the titles of larger ones are searched for their best pair by
    bounds (:func:`best_pairs`). The forms are written once, so ``rows`` is read once.
    """
    night = NIGHT
    forms = cut_lineage(
        rows.groupBy(*night, similarity_form("name").alias("title"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("order")), "night-forms",
    )
    summary = forms.groupBy(*night).agg(
        F.max((F.col("title") != "") & (F.col("n") > 1)).alias("_equal"),
        F.count_if(F.col("title") != "").alias("_forms"),
    )
    settled = summary.where(F.col("_equal") | (F.col("_forms") < 2)).select(
        *night, F.when(F.col("_equal"), 1.0).otherwise(0.0).alias("score")
    )
    open_nights = summary.where(~F.col("_equal") & (F.col("_forms") >= 2)).select(*night, "_forms")
    titles = cut_lineage(forms.where(F.col("title") != "").join(open_nights, night).select(*night, "order", "title", "_forms"), "night-titles")
    small, large = titles.where(F.col("_forms") <= block), titles.where(F.col("_forms") > block).drop("_forms")
    tiles = small.groupBy(*night).agg(F.collect_list(F.struct("order", "title", F.lit(0).alias("side"))).alias("_titles"))
    scores = settled.unionByName(tiles.select(*night, _tile_best("_titles", F.lit(0.0))["best"].alias("score")))
    if large.isEmpty():
        return scores
    return scores.unionByName(best_pairs(large, block).select(*night, F.col("best").alias("score")))


def review_clusters(listings: DataFrame, as_of: dt.date, future_only: bool = True) -> DataFrame:
    """Nights to review: score, whether every unfolded row is approved, and sizes."""
    floor = as_of if future_only else revision_floor(as_of)
    near = listings.where(F.col("date") >= F.lit(floor))
    # what is asked of a row, written once: nights, facts and scores are all taken from it
    near = cut_lineage(unfolded(near).select("id", "venue_id", "date", "name", "approved_at", "duplicate_of_id"), "near")
    live = near.join(crowded_nights(near).select("venue_id", "date"), ["venue_id", "date"])
    facts = live.groupBy("venue_id", "date").agg(
        F.bool_and(F.col("approved_at").isNotNull()).alias("all_approved"), F.count(F.lit(1)).alias("unfolded_rows")
    )
    return facts.join(cluster_scores(live), ["venue_id", "date"])


def review_order(clusters: DataFrame) -> DataFrame:
    """Likely duplicates first, then unapproved, then by date; the venue settles ties."""
    return clusters.orderBy(F.col("score").desc(), "all_approved", "date", "venue_id")


def review_queue(listings: DataFrame, as_of: dt.date, future_only: bool = True, limit: int = 200) -> DataFrame:
    """Member rows of the first ``limit`` clusters, in review order.

    Members are rows, not an array: a night may be very large. ``review_totals`` says how
    many clusters there are in all.
    """
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be from 1 to 1000")
    chosen = review_order(review_clusters(listings, as_of, future_only)).limit(limit)
    starts = F.coalesce("show_min", "doors_min")
    return listings.join(chosen, ["venue_id", "date"]).orderBy(
        F.col("score").desc(), "all_approved", "date", "venue_id", starts.asc_nulls_last(), "id"
    )


def review_totals(listings: DataFrame, as_of: dt.date, future_only: bool = True, limit: int = 200) -> DataFrame:
    """One row: all clusters to review, and how many of them a queue of ``limit`` shows."""
    floor = as_of if future_only else revision_floor(as_of)
    nights = crowded_nights(listings.where(F.col("date") >= F.lit(floor)))
    return nights.agg(F.count(F.lit(1)).alias("total")).select("total", F.least("total", F.lit(limit)).alias("shown"))


# --- folding ---

def fold_decisions(listings: DataFrame, requests: DataFrame) -> DataFrame:
    """Check fold requests. ``requests``: (request_id, survivor_id, duplicate_id), request_id being the order.

    One row per request: ``accepted``, ``reason`` and ``crosses`` (a duplicate of another
    venue or day; allowed, but worth a look). Refusals: nothing to fold, self, missing
    rows, survivor already folded, a duplicate that others are folded into. Requests of
    one batch are judged in order: an earlier accepted one may make a later one fail.
    """
    pairs = requests.select("request_id", "survivor_id", "duplicate_id").distinct()
    known = listings.select(F.col("id").alias("_id"), "venue_id", "date", F.col("duplicate_of_id").alias("_target"))
    targets = listings.where(F.col("duplicate_of_id").isNotNull()).select(F.col("duplicate_of_id").alias("_dep")).distinct()
    dup, sur = known.alias("d"), known.alias("s")
    joined = (
        pairs.join(dup, F.col("duplicate_id") == F.col("d._id"), "left")
        .join(sur, F.col("survivor_id") == F.col("s._id"), "left")
        .join(targets, F.col("duplicate_id") == F.col("_dep"), "left")
    )
    given = F.col("duplicate_id").isNotNull()
    checked = joined.groupBy("request_id", "survivor_id").agg(
        F.bool_or(given).alias("_any"),
        F.bool_or(is_true(F.col("duplicate_id") == F.col("survivor_id"))).alias("_self"),
        F.bool_or(F.col("s._id").isNull() | (given & F.col("d._id").isNull())).alias("_missing"),
        F.bool_or(F.col("s._target").isNotNull()).alias("_chained"),
        F.bool_or(F.col("_dep").isNotNull()).alias("_dependents"),
        F.bool_or(given & is_true((F.col("d.venue_id") != F.col("s.venue_id")) | (F.col("d.date") != F.col("s.date")))).alias("crosses"),
    )
    reason = (
        F.when(F.col("_missing"), "missing row").when(~F.col("_any"), "nothing to fold")
        .when(F.col("_self"), "self").when(F.col("_chained"), "survivor is folded")
        .when(F.col("_dependents"), "duplicate has dependents")
    )
    checked = cut_lineage(checked.select("request_id", "survivor_id", "crosses", reason.alias("reason")), "folds")
    roles = checked.where(F.col("reason").isNull()).select("request_id").join(pairs, "request_id")
    roles = cut_lineage(
        roles.select("request_id", F.col("survivor_id").alias("_event"), F.lit(True).alias("_keeps"))
        .unionByName(roles.select("request_id", F.col("duplicate_id").alias("_event"), F.lit(False).alias("_keeps")))
        .distinct(), "folds",
    )
    late = _late_conflicts(roles)
    if late is not None:
        checked = checked.join(late.withColumn("_late", F.lit(True)), "request_id", "left").withColumn(
            "reason", F.coalesce("reason", F.when(F.col("_late"), "clashes with an earlier request"))
        ).drop("_late")
    return checked.select("request_id", "survivor_id", F.col("reason").isNull().alias("accepted"), "reason", "crosses")


def _late_conflicts(roles: DataFrame) -> DataFrame | None:
    """Requests that use a row in the opposite role of an earlier accepted request.

    Same idea as ``ordered.keep_first_by_keys``: a request with no earlier opposite use
    is safe, whatever is opposite to it later is refused, and the rest goes round again.
    """
    refused: DataFrame | None = None
    undecided = roles
    while True:
        firsts = undecided.groupBy("_event").agg(
            F.min(F.when(F.col("_keeps"), F.col("request_id"))).alias("_first_keep"),
            F.min(F.when(~F.col("_keeps"), F.col("request_id"))).alias("_first_drop"),
        ).where(F.col("_first_keep").isNotNull() & F.col("_first_drop").isNotNull())
        if firsts.isEmpty():
            return refused
        opposite = F.when(F.col("_keeps"), F.col("_first_drop")).otherwise(F.col("_first_keep"))
        waits = undecided.join(firsts, "_event").where(opposite < F.col("request_id")).select("request_id").distinct()
        safe = undecided.join(waits, "request_id", "left_anti")
        held = safe.groupBy("_event").agg(
            F.min(F.when(F.col("_keeps"), F.col("request_id"))).alias("_first_keep"),
            F.min(F.when(~F.col("_keeps"), F.col("request_id"))).alias("_first_drop"),
        )
        waiting = undecided.join(waits, "request_id", "left_semi")
        lost = cut_lineage(
            waiting.join(held, "_event").where(opposite < F.col("request_id")).select("request_id").distinct(), "folds"
        )
        refused = lost if refused is None else refused.unionByName(lost)
        undecided = cut_lineage(undecided.join(lost, "request_id", "left_anti"), "folds")


def apply_folds(listings: DataFrame, requests: DataFrame, decisions: DataFrame) -> DataFrame:
    """Point the duplicates of accepted requests at their survivors; the last request wins."""
    writes = (
        requests.join(decisions.where("accepted").select("request_id"), "request_id", "left_semi")
        .groupBy("duplicate_id").agg(F.max_by("survivor_id", "request_id").alias("_survivor"))
    )
    return listings.join(writes, listings["id"] == writes["duplicate_id"], "left").withColumn(
        "duplicate_of_id", F.coalesce("_survivor", "duplicate_of_id")
    ).drop("duplicate_id", "_survivor")


def unfold(listings: DataFrame, event_ids: DataFrame) -> DataFrame:
    """Clear the fold of the given rows (column ``event_id``)."""
    ids = event_ids.select(F.col("event_id").alias("_id"), F.lit(True).alias("_unfold")).distinct()
    return listings.join(ids, listings["id"] == ids["_id"], "left").withColumn(
        "duplicate_of_id", F.when(F.col("_unfold").isNull(), F.col("duplicate_of_id"))
    ).drop("_id", "_unfold")
