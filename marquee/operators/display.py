"""What the calendar shows: one row per show, one tile per grouped venue and day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.moneytime import calendar_price_label, clock_12h
from ..functions.text import display_label, first_nonblank
from ..schema import DEFAULT_COLOR
from .enrich import with_venue
from .joins import is_true

# Fixed value: venues whose same-day listings share one tile.
GROUPED_VENUES = ("dpac",)


def first_per(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in the given order.

    Written as ``row_number() = 1`` because Spark then keeps one row per group and
    task before the shuffle, so a hot group sends almost nothing.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1).drop("_rank")


def filled(*cols: str) -> Column:
    """How many of these text columns hold something."""
    return sum(((F.coalesce(F.length(c), F.lit(0)) > 0).cast("int") for c in cols), F.lit(0))


def completeness(price: str = "price_min") -> Column:
    return filled("image_url", "ticket_url") + F.col(price).isNotNull().cast("int")


def best_per_show(listings: DataFrame, keep_unlabelled: bool = False) -> DataFrame:
    """One row per venue, date and label: decided by a person, live, fuller, newer, higher id.

    Titles without a letter or digit share the empty label and so collapse; pass
    ``keep_unlabelled=True`` to keep each of them.
    """
    label = display_label("artist", "name")
    if keep_unlabelled:
        label = F.when(label == "", F.concat(F.lit("id:"), F.col("id").cast("string"))).otherwise(label)
    order = [
        is_true("is_manual_override").desc(), is_true("is_live_music").desc(), completeness().desc(),
        F.col("updated_at").desc_nulls_last(), F.col("id").desc(),
    ]
    return first_per(listings.withColumn("_label", label), ["venue_id", "date", "_label"], order).drop("_label")


def one_tile_per_day(visible: DataFrame, order: Sequence[Column], slugs: Sequence[str] = GROUPED_VENUES,
                     per: Sequence[str] = ()) -> DataFrame:
    """At grouped venues, keep the first on-sale listing of a day, else the first one.

    ``order`` is the feed order; ``per`` adds keys such as the user.
    """
    grouped = is_true(F.col("venue_slug").isin(list(slugs)))
    tiles = first_per(
        visible.where(grouped), [*per, "venue_slug", "date"],
        [(~F.col("status").eqNullSafe("on_sale")).asc(), *order],
    )
    return visible.where(~grouped).unionByName(tiles)


def calendar_rows(listings: DataFrame, venues: DataFrame) -> DataFrame:
    """Tiles with nested details, as the calendar widget reads them."""
    e = with_venue(listings, venues)
    color = F.coalesce("venue_color", F.lit(DEFAULT_COLOR))
    day = F.date_format("date", "yyyy-MM-dd")
    details = F.struct(
        F.col("id").alias("event_id"), "name", "artist", "support_artists", "venue_name", "venue_slug", "venue_city",
        color.alias("venue_color"), day.alias("date"), clock_12h("doors_min").alias("doors_time"),
        clock_12h("show_min").alias("show_time"), "ticket_url", calendar_price_label("price_min", "price_max").alias("price"),
        "price_min", "price_max", "image_url", "genre", "subgenre", "status", "age_restriction", "description",
        "is_live_music",
    )
    return e.select(
        "id", first_nonblank("artist", "name").alias("title"), day.alias("start"), F.lit(True).alias("all_day"),
        color.alias("background_color"), color.alias("border_color"), F.lit("#ffffff").alias("text_color"),
        details.alias("details"),
    )
