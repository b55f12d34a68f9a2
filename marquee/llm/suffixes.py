"""Suffix-array dedup: bytes covered by a string of 400 bytes that starts more than once.

A window is a string of LENGTH bytes. Its anchor is the least of its hashed 64-byte grams,
the leftmost on ties, so equal windows have equal grams at equal offsets. Successive windows
of one anchor form a stretch. Stretches that are equal in whole are found by hash; what
remains are stretches with the same gram but different bytes, once each. Their windows are
the suffixes to sort: all of a gram's stretches come to one task, which sorts the suffixes
of equal offset by mergesort. Two suffixes are compared by the hash of prefixes and binary
search for the length of their common extension; neighbours in the sorted order with an
extension of a whole window are repeats once their bytes are found to be equal.

A Scale tells what a window is made of: BYTES is the window of the digest. In WORDS a window
is 51 successive words (maximal runs of bytes other than ASCII blanks), whatever blanks lie
between them; words are compared by 64-bit hashes. A text is then the row of its words'
hashes, and all the above holds with words in the place of bytes.

A gram with more than HOT different stretches goes another way, so that no task gets an
unbounded group: its windows are counted by hash.

Defined results: a null text is empty; texts under LENGTH bytes keep all; repeated rows and
copies lose all of a text of LENGTH or more; ids may be null or repeat; other columns are not
read; an empty table gives no rows. Overlapping repeats inside one text count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut_lineage
from .hashing import BASE, Prefixes, U, bitmap, mix
from .workers import tidied

LENGTH = 400
HOT = 2048                  # different stretches of a gram that one task sorts
CHUNK = 1 << 20             # window starts or bytes handled at once
_POS = U((1 << 24) - 1)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(9, 14)]] = True


@dataclass(frozen=True)
class Scale:
    label: str
    length: int             # units in a window
    gram: int               # units in a gram
    by_word: bool = False

    @property
    def block(self) -> int:
        """Window offsets whose common middle is compared first."""
        return max(1, self.length * 43 // 400)

    def units(self, text: bytes) -> bytes | np.ndarray:
        return word_hashes(text) if self.by_word else text

    def bounds(self, text: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """Where the units of ``text`` begin and end; None for bytes."""
        return word_bounds(text) if self.by_word else None


BYTES = Scale("suffixes", LENGTH, 64)
WORDS = Scale("suffix-words", 51, 8, by_word=True)


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(_BLANK[np.frombuffer(text, np.uint8)].view(np.int8), prepend=np.int8(1), append=np.int8(1))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(text: bytes) -> np.ndarray:
    raw = np.frombuffer(text, np.uint8)
    first, last = word_bounds(text)
    out, i = [np.zeros(0, np.uint64)], 0
    while i < len(first):
        j = int(np.searchsorted(first, first[i] + CHUNK))
        a, b = first[i:j], last[i:j]
        out.append(mix(Prefixes(raw[a[0] : b[-1]]).hashed(a - a[0], b - a[0]) ^ mix((b - a).astype(np.uint64))))
        i = j
    return np.concatenate(out)


def _joined(parts: list[bytes] | list[np.ndarray]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), np.uint8) if isinstance(parts[0], bytes) else np.concatenate(parts)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` successive keys."""
    n = len(keys) - width + 1
    whole = np.full(-(-len(keys) // width) * width, U(0xFFFFFFFFFFFFFFFF))
    whole[: len(keys)] = keys
    rows = whole.reshape(-1, width)
    right = np.minimum.accumulate(rows, axis=1).ravel()
    left = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[:n], right[width - 1 : width - 1 + n])


def stretches(texts: list[bytes] | list[np.ndarray], scale: Scale = BYTES) -> list[tuple[np.ndarray, ...]]:
    """For each text (its units): gram, whole (hashes), first start, number of starts and offset of the anchor."""
    out: list[list[tuple[np.ndarray, ...]]] = [[] for _ in texts]
    batch: list[tuple[int, int, bytes | np.ndarray]] = []        # text, place of the part in it, part
    size = 0

    def flush() -> None:
        nonlocal size
        if batch:
            for (i, at, _), found in zip(batch, _stretches([p for _, _, p in batch], scale)):
                out[i].append((found[0], found[1], found[2] + at, found[3], found[4]))
        batch.clear()
        size = 0

    for i, text in enumerate(texts):
        for at in range(0, max(0, len(text) - scale.length + 1), CHUNK):
            part = text[at : at + CHUNK + scale.length - 1]
            if size + len(part) > CHUNK + scale.length:
                flush()
            batch.append((i, at, part))
            size += len(part)
    flush()
    none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    return [tuple(np.concatenate(c) for c in zip(*parts)) if parts else none for parts in out]


def _stretches(parts: list[bytes] | list[np.ndarray], scale: Scale) -> list[tuple[np.ndarray, ...]]:
    raw = _joined(parts)
    ends = np.cumsum([len(p) for p in parts])
    begins = ends - [len(p) for p in parts]
    hashes = Prefixes(raw)
    grams = mix(hashes.rolling(scale.gram))
    keys = (grams & ~_POS) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_least(keys, scale.length - scale.gram + 1) & _POS).astype(np.int64)
    step = np.zeros(len(raw) + 1, np.int8)
    step[begins] += 1
    step[ends - scale.length + 1] -= 1
    valid = np.cumsum(step[: len(anchor)], dtype=np.int8) > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    first = np.flatnonzero(new)
    stop = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True)) + 1
    with np.errstate(over="ignore"):
        place = (anchor[first] - first).astype(np.uint64) * U(1 << 20) + (stop - first).astype(np.uint64)
        whole = mix(hashes.hashed(first, stop - 1 + scale.length) ^ mix(place + BASE))
    owner = np.searchsorted(ends, first, "right")
    cuts = np.searchsorted(owner, np.arange(len(parts) + 1))
    a = anchor[first]
    return [(grams[a[x:y]], whole[x:y], first[x:y] - begins[i], (stop - first)[x:y], (a - first)[x:y]) for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:]))]


def _utf8(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat).cast(kind))


_BOOK = "doc_id long, key binary, n_bytes long, sha binary, fits boolean, gram array<long>, whole array<long>, start array<long>, n array<int>, off array<int>"


def _at(run: Callable[..., Iterator[pa.RecordBatch]], scale: Scale) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    return lambda batches: run(batches, scale)


def _described(batches: Iterator[pa.RecordBatch], scale: Scale) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
            texts = _utf8(b.column("text"))
            units = [scale.units(t) for t in texts]
            found = list(zip(*stretches(units, scale)))
            shas = [hashlib.sha256(t).digest() for t in texts]
            cols = [b.column("doc_id"), pa.array([s[:16] for s in shas], pa.binary()), pa.array([len(t) for t in texts], pa.int64()), pa.array(shas, pa.binary()), pa.array([len(u) >= scale.length for u in units], pa.bool_())]
            cols += [_lists(list(c), k) for c, k in zip(found, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "n_bytes", "sha", "fits", "gram", "whole", "start", "n", "off"])


def common_extension(h: Prefixes, x: np.ndarray, y: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Length of the longest common prefix, ``length`` at most, of the suffixes at ``x`` and ``y``."""
    out = np.full(len(x), length, np.int64)
    rest = np.flatnonzero(h.hashed(x, x + length) != h.hashed(y, y + length))
    x, y = x[rest], y[rest]
    low, high = np.zeros(len(rest), np.int64), np.full(len(rest), length - 1, np.int64)
    while len(rest) and (low < high).any():
        mid = (low + high + 1) >> 1
        same = h.hashed(x, x + mid) == h.hashed(y, y + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    out[rest] = low
    return out


def _before(raw: np.ndarray, h: Prefixes, x: np.ndarray, y: np.ndarray, ties: bool | np.ndarray, length: int) -> np.ndarray:
    """Whether the suffix at ``x`` sorts before that at ``y``; ``ties`` answers for equal ones."""
    ext = common_extension(h, x, y, length)
    at = np.minimum(ext, length - 1)
    return np.where(ext == length, ties, raw[x + at] < raw[y + at])


def merge_sorted(raw: np.ndarray, h: Prefixes, at: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """``at`` with the suffixes of each group (successive equal numbers) in order, by bottom-up mergesort.

    All runs of a round are merged together: the place of a suffix is its place in its own
    run plus the number of suffixes of the sibling run before it, found by binary search.
    """
    head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(head, len(at)))
    begin, total = np.repeat(head, size), np.repeat(size, size)
    i = np.arange(len(at)) - begin
    width = 1
    while width < size.max(initial=1):
        run = i // width
        sib = (run ^ 1) * width
        low = np.minimum(sib, total)
        high = np.minimum(sib + width, total)
        least = low.copy()
        ties = (run & 1) == 1              # of equal suffixes the left run's comes first
        live = np.flatnonzero(low < high)
        while len(live):
            mid = (low[live] + high[live]) >> 1
            # the sibling's is before mine (or equal, if mine is of the right run)
            less = _before(raw, h, at[begin[live] + mid], at[live], ties[live], length)
            low[live] = np.where(less, mid + 1, low[live])
            high[live] = np.where(less, high[live], mid)
            live = live[low[live] < high[live]]
        new = begin + np.minimum(run & ~1, run) * width + (i - run * width) + (low - least)
        moved = np.empty_like(at)
        moved[new] = at
        at, width = moved, width * 2
    return at


def _equal(raw: np.ndarray, x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
    """Whether the windows at x and y have equal units: what the hashes said is verified."""
    windows = np.lib.stride_tricks.sliding_window_view(raw, length)
    return np.concatenate([(windows[x[k : k + 8192]] == windows[y[k : k + 8192]]).all(axis=1) for k in range(0, len(x), 8192)]) if len(x) else np.zeros(0, bool)


def repeated_starts(grams: np.ndarray, offs: np.ndarray, data: list[bytes], scale: Scale = BYTES) -> list[np.ndarray]:
    """For each stretch the starts (from 0) of windows that another stretch of the same gram also has."""
    length, span = scale.length, scale.block
    parts = [scale.units(d) for d in data]
    raw = _joined(parts)
    h = Prefixes(raw)
    sizes = np.array([len(d) for d in parts])
    begin = np.cumsum(sizes) - sizes
    n = sizes - length + 1
    piece = np.repeat(np.arange(len(data)), n)
    start = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    at, d = begin[piece] + start, offs[piece] - start           # place of the window; how far the anchor is
    # all windows of a block of offsets hold the same middle: only where that is shared can they be equal
    block = d // span
    mid = begin[piece] + offs[piece] - block * span
    core = mix(h.hashed(mid, mid + length - span + 1) ^ mix(grams[piece] + d.astype(np.uint64)))
    order = np.argsort(core, kind="stable")
    core = core[order]
    same = core[1:] == core[:-1]
    order = order[np.append(same, False) | np.append(False, same)]
    if not len(order):
        return [np.zeros(0, np.int64) for _ in data]
    group = core[np.append(same, False) | np.append(False, same)]
    back = np.empty(len(raw), np.int64)                          # from a place to its window's number
    back[at] = np.arange(len(at))
    placed = merge_sorted(raw, h, at[order], group, length)
    pair = np.flatnonzero(group[1:] == group[:-1])
    pair = pair[common_extension(h, placed[pair], placed[pair + 1], length) == length]
    pair = pair[_equal(raw, placed[pair], placed[pair + 1], length)]
    hit = np.zeros(len(at), bool)
    hit[back[placed[pair]]] = hit[back[placed[pair + 1]]] = True
    at = np.flatnonzero(hit)
    cuts = np.searchsorted(piece[at], np.arange(len(data) + 1))
    return [start[at[x:y]] for x, y in zip(cuts[:-1], cuts[1:])]


def _spans(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of successive starts, as first and last one."""
    gap = np.flatnonzero(np.diff(starts) != 1)
    return starts[np.append(0, gap + 1)], starts[np.append(gap, len(starts) - 1)]


def _sorted_repeats(batches: Iterator[pa.RecordBatch], scale: Scale) -> Iterator[pa.RecordBatch]:
    """From stretches in the order of gram and whole: spans of their repeated windows."""
    held: list[tuple[int, int, int, bytes]] = []
    size = 0

    def out(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        cols: list[list[np.ndarray]] = [[], [], [], []]
        if len(rows) > 1:
            found = repeated_starts(np.array([r[0] for r in rows]).view(np.uint64), np.array([r[2] for r in rows]), [r[3] for r in rows], scale)
            for r, starts in zip(rows, found):
                if len(starts):
                    first, last = _spans(starts)
                    for c, x in zip(cols, (np.full(len(first), r[0]), np.full(len(first), r[1]), first, last)):
                        c.append(x)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in cols], names=["gram", "whole", "first", "last"])

    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("gram", "whole", "off", "data"))):
            if held and row[:2] == held[-1][:2]:
                continue
            if size > CHUNK and row[0] != held[-1][0]:
                yield out(held)
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    yield out(held)


def _bytes_at(bounds: tuple[np.ndarray, np.ndarray] | None, start: int, end: int) -> tuple[int, int]:
    """The bytes of the units from ``start`` to before ``end``."""
    return (int(bounds[0][start]), int(bounds[1][end - 1])) if bounds else (start, end)


def _cut(batches: Iterator[pa.RecordBatch], scale: Scale) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple] = []
        for text, parts in zip(_utf8(b.column("text")), b.column("parts").to_pylist()):
            bounds = scale.bounds(text)
            for p in parts:
                start, end = _bytes_at(bounds, p["start"], p["start"] + p["n"] - 1 + scale.length)
                out.append((p["gram"], p["whole"], p["off"], p["hot"], text[start:end]))
        cols = list(zip(*out)) if out else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["gram", "whole", "off", "hot", "data"])


def _window_hashes(batches: Iterator[pa.RecordBatch], scale: Scale) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for g, w, off, data in zip(*(b.column(c).to_pylist() for c in ("gram", "whole", "off", "data"))):
            h = Prefixes(_joined([scale.units(data)])).rolling(scale.length)
            at = np.arange(len(h))
            with np.errstate(over="ignore"):
                h = mix(h ^ mix(np.array([g]).view(np.uint64) + (off - at).astype(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(h), g), np.full(len(h), w), at, h.view(np.int64))], names=["gram", "whole", "at", "h"])


def _texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """key and text of (about) the texts that ``keys`` names, once for each task."""
    may = bitmap(keys.select(F.xxhash64("key").alias("k")).distinct())
    return _chosen(docs.select("text", F.xxhash64(_key()).alias("k")), may)


def _key() -> Column:
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)), 1, 16)


def _chosen(docs: DataFrame, may) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            k = b.column("k").to_numpy()
            keep = may(k)
            for i in np.flatnonzero(keep):
                keep[i] = k[i] not in seen
                seen.add(k[i])
            some = b.filter(pa.array(keep))
            texts = _utf8(some.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(t).digest()[:16] for t in texts], pa.binary()), some.column("text").cast(pa.string())], names=["key", "text"])

    return docs.mapInArrow(tidied(run), "key binary, text string")


_EMPTY = hashlib.sha256(b"").hexdigest()


def _removed(batches: Iterator[pa.RecordBatch], scale: Scale) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans: list[list[dict]] = []
        shas = []
        for text, found in zip(_utf8(b.column("text")), b.column("spans").to_pylist()):
            merged: list[dict] = []
            for s in sorted(found, key=lambda s: s["start"]):
                if merged and s["start"] <= merged[-1]["end"]:
                    merged[-1]["end"] = max(merged[-1]["end"], s["end"])
                else:
                    merged.append(dict(s))
            bounds = scale.bounds(text)
            merged = [dict(zip(("start", "end"), _bytes_at(bounds, s["start"], s["end"]))) for s in merged]
            rest, at = hashlib.sha256(), 0
            for s in merged:
                rest.update(text[at : s["start"]])
                at = s["end"]
            rest.update(text[at:])
            spans.append(merged)
            shas.append(rest.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [b.column("key"), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(shas, pa.string())], names=["key", "spans", "kept_sha256"],
        )


def _decided(docs: DataFrame, scale: Scale = BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The book of all rows, the keys of texts that rows share, and spans and kept_sha256 of other texts that lose something."""
    label = scale.label
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    book = cut_lineage(rows.mapInArrow(tidied(_at(_described, scale)), _BOOK), f"{label}-stretches")
    copied = cut_lineage(book.where("fits").groupBy("key").count().where("count > 1").select("key", F.lit(True).alias("copied")), f"{label}-copied")
    each = book.select("key", F.inline(F.arrays_zip("gram", "whole", "start", "n", "off")))
    grams = each.groupBy("gram").agg(F.min("whole").alias("low"), F.max("whole").alias("high"), F.count("*").alias("c")).where("c > 1")
    met = cut_lineage(each.join(grams.select("gram", F.expr("low <> high").alias("mixed")), "gram"), f"{label}-met")
    wholes = met.groupBy("gram", "whole").agg(F.count("*").alias("c"), F.first("mixed").alias("mixed"), F.min(F.struct("key", "start", "n", "off")).alias("rep"))
    wholes = cut_lineage(wholes.select("gram", "whole", "c", "mixed", "rep.*"), f"{label}-wholes")
    # stretches that are alone with their bytes but not with their gram, and what they may share windows with
    parts = wholes.where("mixed")
    hot = parts.groupBy("gram").count().where(F.col("count") > HOT).select("gram", F.lit(True).alias("hot"))
    parts = parts.join(hot, "gram", "left").select("key", F.struct("gram", "whole", "start", "n", "off", F.coalesce("hot", F.lit(False)).alias("hot")).alias("part"))
    by_text = cut_lineage(parts.groupBy("key").agg(F.collect_list("part").alias("parts")), f"{label}-parts")
    cut = cut_lineage(_texts(rows, by_text).join(by_text, "key").select("text", "parts").mapInArrow(tidied(_at(_cut, scale)), "gram long, whole long, off long, hot boolean, data binary"), f"{label}-cut")
    kinds = "gram long, whole long, first long, last long"
    found = cut.where("not hot").repartition("gram").sortWithinPartitions("gram", "whole").select("gram", "whole", "off", "data").mapInArrow(tidied(_at(_sorted_repeats, scale)), kinds)
    windows = cut.where("hot").select("gram", "whole", "off", "data").mapInArrow(tidied(_at(_window_hashes, scale)), "gram long, whole long, at long, h long").distinct()
    twice = windows.groupBy("h").count().where("count > 1").select("h")
    found = found.unionByName(windows.join(twice, "h").select("gram", "whole", F.col("at").alias("first"), F.col("at").alias("last")))
    # a stretch with copies goes whole; of another, the windows found
    whole = wholes.where("c > 1").select("gram", "whole", F.lit(0).cast("long").alias("first"), (F.col("n") - 1).cast("long").alias("last"))
    single = found.join(wholes.where("mixed and c = 1").select("gram", "whole"), ["gram", "whole"])
    lone = met.join(copied, "key", "left_anti").select("gram", "whole", "key", "start")
    spans = lone.join(whole.unionByName(single), ["gram", "whole"]).select("key", F.struct((F.col("start") + F.col("first")).alias("start"), (F.col("start") + F.col("last") + scale.length).alias("end")).alias("span"))
    by_text = cut_lineage(spans.groupBy("key").agg(F.collect_list("span").alias("spans")), f"{label}-spans")
    kind = "key binary, spans array<struct<start: long, end: long>>, kept_sha256 string"
    changed = cut_lineage(_texts(rows, by_text).join(by_text, "key").mapInArrow(tidied(_at(_removed, scale)), kind), f"{label}-changed")
    return book, copied, changed


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs of bytes: start, end), kept_sha256, key (of the text); a row per row of ``docs``."""
    book, copied, changed = _decided(docs)
    # whole copies need no look at the text
    all_of = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    none = all_of.getItem(0)
    rows = book.select("doc_id", "key", "n_bytes", "sha").join(copied, "key", "left").join(changed, "key", "left")
    return rows.select(
        "doc_id", "key", "n_bytes",
        F.when(F.col("copied"), all_of).otherwise(F.coalesce("spans", F.filter(F.array(none), lambda x: F.lit(False)))).alias("spans"),
        F.when(F.col("copied"), F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of what ``repeats`` gives."""
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", size.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def _trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text without its spans. A character that a span cuts in two goes whole."""
    for b in batches:
        texts = []
        for text, spans in zip(_utf8(b.column("text")), b.column("suffix_spans").to_pylist()):
            at, kept = 0, []
            for s in sorted(spans, key=lambda s: s["start"]):
                kept.append(text[at : max(at, s["start"])].decode("utf-8", "ignore"))
                at = max(at, s["end"])
            texts.append("".join(kept) + text[at:].decode("utf-8", "ignore"))
        i = b.schema.get_field_index("text")
        yield b.set_column(i, b.schema.field(i), pa.array(texts, b.schema.field(i).type)).drop_columns(["suffix_spans"])


def cleaned(docs: DataFrame, scales: tuple[Scale, ...] = (BYTES,)) -> DataFrame:
    """``docs`` without what repeats at any of the scales; n_chars, if there, is counted anew. Rows of which no word is left go."""
    every = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(1 << 62).alias("end")))
    marks = None
    for scale in scales:
        _, copied, changed = _decided(docs, scale)
        found = changed.select(F.col("key").alias("suffix_key"), F.col("spans").alias("suffix_spans")).unionByName(copied.select(F.col("key").alias("suffix_key"), every.alias("suffix_spans")))
        marks = marks.unionByName(found) if marks else found
    if len(scales) > 1:
        marks = marks.groupBy("suffix_key").agg(F.flatten(F.collect_list("suffix_spans")).alias("suffix_spans"))
    both = docs.join(marks, _key() == F.col("suffix_key"), "left").drop("suffix_key")
    same = both.where("suffix_spans is null").drop("suffix_spans")
    trimmed = both.where("suffix_spans is not null").mapInArrow(tidied(_trimmed), docs.schema).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        trimmed = trimmed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return same.unionByName(trimmed)
