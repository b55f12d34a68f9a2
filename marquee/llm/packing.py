"""Best-fit packing of tokenised documents into sequences of a fixed number of tokens.

Every document is its tokens and an end token. A document over CAPACITY is cut into pieces of
CAPACITY, of which the first may be shorter; no other is cut. Bulk-synchronous best fit then
places the pieces: sizes are taken from the longest on; in a round all pieces of a size sweep
to their successor among the gaps, the smallest one that holds them; where more pieces than
gaps meet, the lower ranks get them and the others go on to the next gap; the gaps are
updated and the next round follows. What no gap holds opens sequences.

Pieces of one size are interchangeable, and there are at most CAPACITY sizes and gaps, so the
sweeps run over classes with counts: what the driver sees is a histogram of at most CAPACITY
rows, whatever the input. The pieces themselves stay distributed: they are numbered within
their size (by sorted parts and prefix sums, so that a size that a third of the rows have is
no task of its own) and find sequence and offset by their number.

Defined results: a null or empty text is the end token alone; repeated rows are packed each;
null ids are kept; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from threading import Timer

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut_lineage
from .workers import give_back

CAPACITY = 2048
END = 0                     # the id after every document
WORDS = 800_000             # chunks whose ids a worker keeps (some 200 bytes each), the first it meets; others are encoded each time
IDLE = 3.0                  # seconds after its last task until it drops them
LONGEST = 48                # characters of a chunk that is kept
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Before a space that a character other than white space follows the tokenizer always splits.
CHUNK = re.compile(r" (?=\S)")


class Encoder:
    """Ids of texts as little-endian 32-bit numbers. Text between safe split points is encoded once and kept."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.timer: Timer | None = None

    def in_use(self) -> Encoder:
        if self.timer:
            self.timer.cancel()
        return self

    def leave(self) -> None:
        """Drop what is kept unless another task comes soon: a worker outlives its stage, and the next one needs the memory."""
        def forget() -> None:
            self.known = {}
            give_back()

        self.timer = Timer(IDLE, forget)
        self.timer.daemon = True
        self.timer.start()

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        first, *rest = CHUNK.split(text)
        known = self.known
        try:
            tail = b"".join([known[w] for w in rest])
        except KeyError:
            parts = []
            for w in rest:
                ids = known.get(w)
                if ids is None:
                    ids = self._ids(" " + w)
                    if len(w) <= LONGEST and len(known) < WORDS:
                        known[w] = ids
                parts.append(ids)
            tail = b"".join(parts)
        return self._ids(first) + tail


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """The encoder of this worker process, kept over its tasks."""
    return Encoder(path)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of the pieces of every row. ``vocabulary``: path of the tokenizer."""
    end = np.array([END], "<u4").tobytes()

    def cut(held: Encoder, b: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
            ids = memoryview(held.encode(text.as_py() or "") + end)
            n = len(ids) // 4
            at, stop = 0, n % capacity or capacity
            while at < n:
                out.append((doc_id, (at + capacity - 1) // capacity, at, stop - at, zlib.crc32(ids[4 * at : 4 * stop])))
                at, stop = stop, stop + capacity
        cols = list(zip(*out)) if out else [[]] * 5
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = encoder(vocabulary).in_use()
        try:
            for b in batches:
                yield cut(held, b)
        finally:
            held.leave()

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, PIECES)


def sweeps(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit by classes: (size, first rank, pieces, pieces in a sequence, first sequence, offset).

    The pieces of a size from that rank on go, so many to each, to successive sequences.
    """
    out = []
    gaps: dict[int, list[tuple[int, int]]] = {}         # gap: runs of sequences (first, number)
    opened = 0
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            gap = min((g for g in gaps if g >= size), default=capacity)
            each = gap // size
            if gap in gaps:
                first, number = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
            else:
                first, number = opened, -(-left // each)
                opened += number
            used = min(number, -(-left // each))
            full, more = (used, 0) if used * each <= left else (used - 1, left - (used - 1) * each)
            placed = min(left, used * each)
            out.append((size, rank, placed, each, first, capacity - gap))
            for at, n, rest in ((first, full, gap - each * size), (first + full, used - full, gap - more * size), (first + used, number - used, gap)):
                if n and rest:
                    gaps.setdefault(rest, []).append((at, n))
            rank, left = rank + placed, left - placed
    return out


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rank``: gapless from 0 within each ``length``. ``rows`` must be a written table."""
    # a size that many rows have is numbered in parts: a part is at most what one task wrote
    rows = cut_lineage(rows.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "pack-pieces")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("length", "part").count().select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inner = F.row_number().over(Window.partitionBy("length", "part").orderBy("row")) - 1
    return rows.withColumn("inner", inner).join(parts, ["length", "part"]).withColumn("rank", F.col("before") + F.col("inner"))


def packed(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset, one row per piece."""
    rows = numbered(pieces(docs, vocabulary, capacity))
    counts = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}     # at most ``capacity`` rows
    kinds = "length long, first_rank long, placed long, each long, first_sequence long, base long"
    runs = docs.sparkSession.createDataFrame(sweeps(counts, capacity), kinds)
    # a piece looks its run up by size: few runs share one, so the range test costs little
    at = F.col("rank") - F.col("first_rank")
    hit = rows.join(F.broadcast(runs), "length").where((at >= 0) & (at < F.col("placed")))
    return hit.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("base") + F.pmod(at, "each") * F.col("length")).cast("long").alias("offset"),
    )
