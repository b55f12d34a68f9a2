"""Column lists and accepted values of the stored tables.

Times of day are integers, minutes after midnight (``*_min``).
"""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values.
EVENT_STATUSES = ("on_sale", "sold_out", "cancelled", "free")
RUN_STATUSES = ("running", "success", "failed")
SUBMISSION_STATUSES = ("pending", "approved", "rejected")
MANUAL_KIND = "manual"
DEFAULT_COLOR = "#6366f1"

_S, _L, _I, _D, _B, _DATE, _TS = (
    T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.DateType(), T.TimestampType()
)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SCRAPED = _struct(
    name=_S, date=_DATE, venue_slug=_S, source=_S, external_id=_S, artist=_S, support_artists=_S,
    doors_min=_I, show_min=_I, ticket_url=_S, price_min=_D, price_max=_D, image_url=_S, genre=_S,
    subgenre=_S, status=_S, age_restriction=_S, description=_S, source_url=_S,
)

EVENTS = _struct(
    id=_L, external_id=_S, venue_id=_L, name=_S, artist=_S, support_artists=_S, date=_DATE, doors_min=_I,
    show_min=_I, ticket_url=_S, price_min=_D, price_max=_D, image_url=_S, genre=_S, subgenre=_S, status=_S,
    age_restriction=_S, description=_S, source=_S, source_url=_S, hash=_S, is_live_music=_B,
    is_manual_override=_B, is_manually_created=_B, duplicate_of_id=_L, classification_reason=_S,
    approved_at=_TS, created_at=_TS, updated_at=_TS,
)

VENUES = _struct(
    id=_L, name=_S, slug=_S, city=_S, capacity=_I, size_category=_S, website=_S, source_venue_id=_S,
    source_kind=_S, source_config=T.MapType(_S, _S), color=_S, created_at=_TS, updated_at=_TS,
)

RUN_LOG = _struct(
    id=_L, venue_id=_L, source_kind=_S, started_at=_TS, finished_at=_TS, status=_S, events_found=_L,
    events_created=_L, events_updated=_L, error_message=_S, duration_seconds=_D,
)

SERIES_OVERRIDES = _struct(
    id=_L, venue_id=_L, normalized_name=_S, display_name=_S, is_live_music=_B, note=_S, created_at=_TS, updated_at=_TS,
)

# Columns a new batch may leave empty without blanking the stored value.
KEEP_IF_EMPTY = (
    "artist external_id source_url image_url ticket_url doors_min show_min support_artists genre subgenre "
    "age_restriction description"
).split()
# Columns a new batch always overwrites.
OVERWRITE = "name hash source price_min price_max status".split()

# Columns filled from a merged row when the survivor's own value is empty.
MERGEABLE = (
    "external_id artist support_artists doors_min show_min ticket_url price_min price_max image_url genre "
    "subgenre age_restriction description source_url"
).split()
