"""Hashed words of many texts at once, for the classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .hashing import Prefixes, U, mix

CHUNK = 1 << 20             # bytes handled at once
BLANK, LETTER, DIGIT, SIGN = range(4)
_KIND = np.full(256, SIGN, np.uint8)
_KIND[[0x20, *range(9, 14)]] = BLANK
_KIND[48:58] = DIGIT
_KIND[65:91] = _KIND[97:123] = LETTER
_KIND[128:] = LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1


class Tokens:
    """Runs of letters, digits or signs in the bytes of ``texts``; ``owner`` is the text of each."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        kind = _KIND[raw]
        turn = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1], [True])))
        start, end = turn[:-1], turn[1:]
        solid = kind[start] != BLANK
        self.start, self.end = start[solid], end[solid]
        self.kind, self.first = kind[self.start].astype(np.int64), raw[self.start].astype(np.int64)
        self.length = self.end - self.start
        upper = np.concatenate(([0], np.cumsum(_UPPER[raw])))
        self.upper = upper[self.end] - upper[self.start]
        self.prefixes = Prefixes(_LOWER[raw] if lower else raw)
        self.word = mix(self.prefixes.hashed(self.start, self.end))
        self.owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), self.start, "right")


def parts(texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Groups of about CHUNK bytes, with the places of their texts. A longer text comes in parts, cut at a blank."""
    places: list[int] = []
    held: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text) or not at:
            end = at + CHUNK
            if end < len(text):
                blank = max(text.rfind(c, at + 1, end) for c in (b" ", b"\n"))
                end = blank if blank > at else end
            part = text[at:end]
            if held and size + len(part) > CHUNK:
                yield np.array(places), held
                places, held, size = [], [], 0
            places.append(i)
            held.append(part)
            size += len(part) + 1
            at = max(end, at + 1)
    if held:
        yield np.array(places), held


def utf8(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no fit reads: crc32 of the id as text, modulo 3, is 1. A null id is one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def labelled(labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id and y: one label of each id that is not held out, at most ``most`` ids in the order of their hash."""
    rows = labels.where(~held_out(F.col("doc_id")) & F.col(label).isin(0, 1))
    each = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    return each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def learnt(docs: DataFrame, labels: DataFrame, label: str, most: int, *columns: str) -> DataFrame:
    """The rows of ``docs`` whose ids ``labelled`` names, one per id, with y."""
    return docs.join(labelled(labels, label, most), "doc_id").select("doc_id", "y", *columns).dropDuplicates(["doc_id"])
