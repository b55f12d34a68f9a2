"""Fill-in-middle: a text is cut twice and put together in another order, so that a model learns to fill a gap.

``prefix``, ``middle`` and ``suffix`` become ``<P>prefix<S>suffix<M>middle`` (form psm) or
``<S>suffix<P>prefix<M>middle`` (form spm); some texts stay as they are (form plain), and so do
the empty ones and those that hold a marker, so that every output can be taken apart again.

A cut falls between two units: code points, words (with the blanks after them) or lines. The
UTF-8 bytes of a text are looked at in blocks of BLOCK bytes. A Fenwick tree over the blocks
stores how many units and how many code points begin in each; a binary-lifting descent finds
the block that holds the unit a cut falls before and the counts ahead of it, and the boundary
is then located within that one block. Where a text is cut and which form it takes follow from
the hash of its id alone, so a repeated run and a recomputed task give the same rows.

Defined results: a null text is an empty one; a null id draws as the word ``null``; repeated
rows are each transformed, alike; columns beside id and text are not read; an empty table gives
no rows. A text is held whole, twice, by one task: it is one value of one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import until

BLOCK = 4096                # bytes of a block
BATCH = 8 << 20             # bytes of output handed to Spark at once
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM, SPM_BELOW = 90, 20      # of 100: texts that stay plain, and spm among the others
COLUMNS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(9, 14)]] = True


def _chars(raw: np.ndarray) -> np.ndarray:
    return (raw & 0xC0) != 0x80


def _words(raw: np.ndarray) -> np.ndarray:
    blank = _BLANK[raw]
    first = ~blank
    first[1:] &= blank[:-1]
    first[:1] = True
    return first


def _lines(raw: np.ndarray) -> np.ndarray:
    return np.concatenate((np.ones(min(1, len(raw)), bool), raw[:-1] == 10))


#: For each kind of unit, which bytes begin one.
UNITS = {"chars": _chars, "words": _words, "lines": _lines}


class Blocks:
    """Fenwick tree over the blocks of one text; row i holds units and code points of the blocks it stands for."""

    def __init__(self, raw: np.ndarray, units: str):
        self.begins, self.chars = UNITS[units](raw), _chars(raw)
        self.count = -(-len(raw) // BLOCK)
        edges = np.arange(0, len(raw), BLOCK)
        tree = np.zeros((self.count + 1, 2), np.int64)
        if self.count:
            tree[1:, 0] = np.add.reduceat(self.begins, edges, dtype=np.int64)
            tree[1:, 1] = np.add.reduceat(self.chars, edges, dtype=np.int64)
        self.units, self.points = (int(x) for x in tree.sum(0))
        step = 1
        while step <= self.count:       # a level at a time: each node joins the one half as wide on its left
            at = np.arange(2 * step, self.count + 1, 2 * step)
            tree[at] += tree[at - step]
            step *= 2
        self.tree, self.size = tree, len(raw)

    def cut(self, before: int) -> tuple[int, int]:
        """The byte at which unit number ``before`` begins, and the code points ahead of it."""
        if before >= self.units:
            return self.size, self.points
        block, units, points = 0, 0, 0
        step = 1 << max(self.count.bit_length() - 1, 0)
        while step:
            to = block + step
            if to <= self.count and units + self.tree[to, 0] <= before:
                block, units, points = to, units + int(self.tree[to, 0]), points + int(self.tree[to, 1])
            step >>= 1
        start = block * BLOCK
        here = start + int(np.flatnonzero(self.begins[start : start + BLOCK])[before - units])
        return here, points + int(np.count_nonzero(self.chars[start:here]))


def draws(doc_id: int | None, seed: str = "1") -> list[int]:
    """Four numbers of 32 bits that depend on the seed and the id alone."""
    text = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(text[8 * i : 8 * i + 8], 16) for i in range(4)]


@dataclass(frozen=True)
class Cut:
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: bytes


def transform(text: bytes, doc_id: int | None, units: str = "chars", seed: str = "1") -> Cut:
    blocks = Blocks(np.frombuffer(text, np.uint8), units)
    n = blocks.units
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= PLAIN_FROM or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return Cut(n, "plain", None, None, text)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    (a, before), (b, upto) = blocks.cut(low), blocks.cut(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SPM_BELOW:
        form, parts = "spm", (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
    else:
        form, parts = "psm", (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
    return Cut(n, form, before, upto - before, b"".join(parts))


def transformed(docs: DataFrame, units: str = "chars", seed: str = "1") -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of every row."""
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                cut = transform(text.as_py() or b"", doc_id, units, seed)
                rows.append((doc_id, cut.n, cut.form, cut.prefix_chars, cut.middle_chars, cut.output))
                held += len(cut.output)
                if held > BATCH:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)

    made = docs.selectExpr("cast(doc_id as long) doc_id", "cast(cast(text as string) as binary) text").mapInArrow(run, COLUMNS)
    return made.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text an output was made from."""
    p, s, m = (F.lit(x.decode()) for x in (PREFIX, SUFFIX, MIDDLE))
    # the text holds no marker, so each stands in the output once
    first = F.when(form == "psm", s).otherwise(p)
    head = F.substring(until(output, first, 1), F.lit(4), F.length(output))
    rest = until(output, first, -1)
    one, middle = until(rest, m, 1), until(rest, m, -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(head, middle, one)).otherwise(F.concat(one, middle, head))


def digest(made: DataFrame) -> DataFrame:
    """``transformed`` with hashes in the place of texts."""
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


#: The default cuts, between code points, in DuckDB.
DIGEST_SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
numbers AS (
  SELECT doc_id, text, n, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b,
    ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS d FROM drawn),
cuts AS (
  SELECT doc_id, text, n, least(a, b) AS low, greatest(a, b) AS high,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 90 THEN 'plain'
      WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
parts AS (SELECT *, left(text, low) AS prefix, substring(text, low + 1, high - low) AS middle, substring(text, high + 1) AS suffix FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
