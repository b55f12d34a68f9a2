"""Prefix polynomial hashes of byte arrays, and a bitmap of fixed size that spares shuffles."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(BASE), -1, 1 << 64))
FILTER_BITS = 1 << 26       # 8 MB at most reach the driver and each executor


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


with np.errstate(over="ignore"):
    CODES = mix(np.arange(1, 257, dtype=np.uint64) * BASE)


@lru_cache(4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(size, BASE), np.full(size, _INVERSE)
        up[0] = down[0] = U(1)
        return np.cumprod(up), np.cumprod(down)


def forget() -> None:
    """Drop the tables that are kept between calls."""
    _powers.cache_clear()


class Prefixes:
    """Hashes of any part of ``raw`` (bytes, or codes of 64 bits) in constant time."""

    def __init__(self, raw: np.ndarray):
        size = 1 << max(16, len(raw).bit_length())
        up, self.down = _powers(size)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((CODES[raw] if raw.dtype == np.uint8 else raw) * up[: len(raw)])))

    def hashed(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[end] - self.sums[start]) * self.down[start]

    def rolling(self, k: int) -> np.ndarray:
        """The hash of every part of length ``k``."""
        n = len(self.sums) - k
        with np.errstate(over="ignore"):
            return (self.sums[k:] - self.sums[:n]) * self.down[:n] if n > 0 else np.zeros(0, np.uint64)


def _places(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(np.uint64) ^ U(0x5851F42D4C957F2D)) & U(FILTER_BITS - 1)).astype(np.int64)


def bitmap(keys: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """For a frame of one long column: a function that tells which keys may be in it.

    It never misses one; of others it lets some through, so an exact join has to follow.
    """

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(_places(b.column(0).to_numpy()))
            word, where = np.unique(at >> 6, return_index=True)
            bits = np.bitwise_or.reduceat(np.left_shift(U(1), (at & 63).astype(np.uint64)), where) if len(at) else at.view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], names=["word", "bits"])

    found = keys.mapInArrow(marks, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    table = np.zeros(FILTER_BITS // 64, np.uint64)
    table[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    shared = keys.sparkSession.sparkContext.broadcast(table)

    def may_hold(some: np.ndarray) -> np.ndarray:
        at = _places(some)
        return (shared.value[at >> 6] >> (at & 63).astype(np.uint64) & U(1)).astype(bool)

    return may_hold
