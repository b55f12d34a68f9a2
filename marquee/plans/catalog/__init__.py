"""The registered queries: each a Spark function and, where SQL can say it, its SQL."""

from __future__ import annotations

from . import aggregates, curation, decisions, people, reads, scalars, feeds
from .entry import Entry


def entries() -> dict[str, Entry]:
    out: dict[str, Entry] = {}
    for module in (reads, aggregates, curation, decisions, people, scalars, feeds):
        for e in module.ENTRIES:
            if e.name in out:
                raise ValueError(f"{e.name} is registered twice")
            out[e.name] = e
    return out
