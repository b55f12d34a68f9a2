"""Show grids: a second list on a page that holds the images of the first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, leading_age, url_last_segment, without_leading_age
from ..operators.display import first_per

ANCHOR = r"""(?is)(<a\b[^>]*\bhref\s*=\s*["'][^"']*["'][^>]*>.*?)</a>"""
HREF = r"""(?is)^<a\b[^>]*\bhref\s*=\s*["']([^"']*)["']"""
SRC = r"""(?is)<img\b[^>]*?\ssrc\s*=\s*["']([^"']+)["']"""
LAZY_SRC = r"""(?is)<img\b[^>]*?\sdata-src\s*=\s*["']([^"']+)["']"""


def images_by_slug(pages: DataFrame, shows_path: str, page_key: str = "page_id") -> DataFrame:
    """``(page_key, slug, image_url)`` from links under ``shows_path``; the first in the page wins."""
    links = pages.select(page_key, F.posexplode(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1))).alias("pos", "link"))
    href = F.regexp_extract("link", HREF, 1)
    source = F.coalesce(blank_to_null(F.regexp_extract("link", SRC, 1)), blank_to_null(F.regexp_extract("link", LAZY_SRC, 1)))
    found = links.where(href.startswith(shows_path)).select(
        page_key, "pos", url_last_segment(href).alias("slug"), source.alias("image_url")
    ).where((F.col("slug") != "") & F.col("image_url").isNotNull())
    return first_per(found, [page_key, "slug"], [F.col("pos").asc()]).drop("pos")


def with_images(records: DataFrame, images: DataFrame, page_key: str = "page_id") -> DataFrame:
    """Records with ``slug`` get their image; a slug without one keeps null."""
    return records.drop("image_url").join(images, [page_key, "slug"], "left")


def with_leading_age(records: DataFrame) -> DataFrame:
    """``(18+) Name`` split into the age limit and the title."""
    return records.withColumns({"age_restriction": leading_age("name"), "name": without_leading_age("name")})
