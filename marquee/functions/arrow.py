"""The three rules Spark's built-ins cannot express, as Arrow batches.

They are small helpers: Spark partitions the rows, these only map strings.
"""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator
from difflib import SequenceMatcher
from html.parser import HTMLParser
from urllib.parse import unquote

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import as_col, blank_to_null, similarity_form, strip

# Executors receive these helpers with the task, so they need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PERCENT = re.compile("%[0-9A-Fa-f]{2}")
_BLANKS = re.compile("[ \t ]+")


def _decode(text: str) -> str:
    for _ in range(3):
        plain = html.unescape(text)
        if plain == text:
            break
        text = plain
    return unquote(text) if _PERCENT.search(text) else text


@F.pandas_udf(T.StringType())
def _decode_batch(s: pd.Series) -> pd.Series:
    return s.map(_decode, na_action="ignore")


# Values of these two are neither looked up twice nor moved: a filter on a cleaned column that Spark
# pushed below them would send every row to Python once more.
_decode_batch = _decode_batch.asNondeterministic()


def clean_title(c: Column | str) -> Column:
    """Decode entities and percent escapes, then collapse white space.

    Only titles that hold an escape carry text to Python; the others travel as nulls.
    """
    text = as_col(c)
    escaped = text.contains("&") | text.rlike("%[0-9A-Fa-f]{2}")
    decoded = F.coalesce(_decode_batch(F.when(escaped, text)), text)
    return F.regexp_replace(F.regexp_replace(decoded, r"(?U)\s+", " "), "^ | $", "")


def ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp similarity of two already normalised titles."""
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def _ratio_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b)], dtype=float)


def title_similarity(a: Column | str, b: Column | str) -> Column:
    """0 when either title normalises to nothing, 1 when both are equal, else their ratio.

    Only pairs that need the ratio carry text to Python.
    """
    x, y = similarity_form(a), similarity_form(b)
    open_pair = (x != "") & (y != "") & (x != y)
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).otherwise(
        _ratio_batch(F.when(open_pair, x), F.when(open_pair, y))
    )


class _Paragraphs(HTMLParser):
    """Collects the text of ``<p>`` elements, and the whole text as a fallback."""

    # Elements whose start closes an open paragraph, and raw-text elements.
    CLOSERS = frozenset(
        "p div ul ol dl table section article aside header footer nav main form h1 h2 h3 h4 h5 h6 "
        "blockquote pre hr fieldset address".split()
    )
    RAW = frozenset(("script", "style", "template"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.paragraphs: list[list[str]] = []
        self.whole: list[str] = []
        self.inside = False
        self.raw = 0

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self._add("\n")
            return
        if tag in self.CLOSERS:
            self.inside = False
        if tag == "p":
            self.inside = True
            self.paragraphs.append([])
        if tag in self.RAW:
            self.raw += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in self.RAW:
            self.raw -= 1

    def handle_endtag(self, tag):
        if tag in self.CLOSERS:
            self.inside = False
        if tag in self.RAW and self.raw:
            self.raw -= 1

    def handle_data(self, data):
        if not self.raw:
            self._add(data)

    def _add(self, text: str) -> None:
        self.whole.append(text)
        if self.inside:
            self.paragraphs[-1].append(text)


# Tags without attributes that neither hold raw text nor hide it.
_PLAIN_TAG = re.compile("<(?:/([a-zA-Z][a-zA-Z0-9]*)|([a-zA-Z][a-zA-Z0-9]*) ?/?)>")
_PLAIN_NAMES = _Paragraphs.CLOSERS | frozenset("br b i u em strong small span li".split())


def _parse(parser: _Paragraphs, text: str) -> None:
    """``text`` through ``parser``; the many fragments of plain tags only, without the scanner, which takes most of the time."""
    parts = _PLAIN_TAG.split(text)      # text, end tag, start tag, text, ...
    names = [(end or start).lower() for end, start in zip(parts[1::3], parts[2::3])]
    if "&" in text or any("<" in p for p in parts[::3]) or not _PLAIN_NAMES.issuperset(names):
        parser.feed(text)
        parser.close()
        return
    if parts[0]:
        parser.handle_data(parts[0])
    for name, end, words in zip(names, parts[1::3], parts[3::3]):
        if end:
            parser.handle_endtag(name)
        else:
            parser.handle_starttag(name, [])
        if words:
            parser.handle_data(words)


def paragraphs_of(raw: str | None, title: str | None = None, limit: int | None = None) -> str | None:
    """Readable paragraphs of an HTML fragment, joined by blank lines; null when empty.

    ``title``: drop the first paragraph when it only repeats this text. ``limit``
    applies to the cleaned text.
    """
    if not raw:
        return None
    parser = _Paragraphs()
    _parse(parser, html.unescape(raw))
    found = [t for t in (_BLANKS.sub(" ", "".join(p)).strip() for p in parser.paragraphs) if t]
    if not found:
        whole = _BLANKS.sub(" ", "".join(parser.whole)).strip()
        found = [whole] if whole else []
    if title and found and found[0].casefold() == title.strip().casefold():
        found = found[1:]
    text = "\n\n".join(found).strip()
    if not text:
        return None
    return text[:limit] if limit else text


@F.pandas_udf(T.StringType())
def _html_batch(raw: pd.Series, title: pd.Series) -> pd.Series:
    return pd.Series([
        paragraphs_of(r if isinstance(r, str) else None, t if isinstance(t, str) else None) for r, t in zip(raw, title)
    ], dtype=object)


_html_batch = _html_batch.asNondeterministic()


def html_text(raw: Column | str, drop_title: Column | None = None, limit: int | None = None) -> Column:
    """Column form of :func:`paragraphs_of`. Truncation happens in the JVM, after cleaning.

    Text without markup or entities needs no parser and stays in the JVM, unless a
    repeated title has to be dropped.
    """
    source = as_col(raw)
    if drop_title is None:
        marked = source.contains("<") | source.contains("&")
        plain = blank_to_null(strip(F.regexp_replace(source, "[ \\t\u00a0]+", " ")))
        parsed = _html_batch(F.when(marked, source), F.lit(None).cast("string"))
        text = F.when(marked, parsed).otherwise(plain)
    else:
        text = _html_batch(source, drop_title)
    return F.substring(text, 1, limit) if limit else text


def html_text_table(pages: DataFrame, key: str, html_col: str = "html") -> DataFrame:
    """``(key, text)`` for a table of pages."""
    schema = T.StructType([pages.schema[key], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [paragraphs_of(h if isinstance(h, str) else None) for h in pdf[html_col]]
            yield pd.DataFrame({key: pdf[key], "text": pd.Series(texts, dtype=object)})

    return pages.select(key, html_col).mapInPandas(run, schema)
