"""What a Python worker does at the end of a task: hand memory back that the next stage may need.

Spark keeps worker processes for later tasks, also of stages that use no Python. Freed blocks
then stay with the process, beside a JVM that has grown to its limit.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

from . import hashing

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    """Free blocks go to the system, where the C library can do that."""
    hashing.forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(run: Run) -> Run:
    """``run`` over the batches of a task, and what it leaves behind handed back."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
