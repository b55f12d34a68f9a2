"""N-gram Jaccard join: documents whose sets of word n-grams overlap by a bound.

``linked`` and ``representatives`` take the length of the n-grams and the bound, in 100ths;
4 and 85 unless said otherwise. All that follows from the bound is derived in ``Link``; the
numbers below are those of 85.

The document by n-gram incidence matrix is multiplied in blocks of columns, each n-gram a
column that Spark brings to one place by its hash. Columns are ordered by frequency, the rare
ones first, and a row takes part only with its first 15 of 100: a linked row shares one of
them, as the bound of their sizes says. So what many documents share (a passage, a line)
joins nothing unless it is nearly all they have. Frequencies are counts of hashed n-grams over
all rows in a fixed number of counters; they set the order only, and any order is right.

Candidates are pairs that meet in a column; a pair is dropped where its places in the column
leave less than its sizes require, or where sketches of the two rows (parities of counters)
differ in more bits than their sizes allow. The overlap of the others is accumulated exactly. Only
links that can join components are multiplied: each row of a column with the column's first
one and with its neighbour, then with a few hubs of a crowded column, then the pairs of a
column whose rows still belong to different components. So a large family of near copies meets
its hubs, not itself. Copies and sets that are equal are one node.

Defined results: a null or blank text has an empty set and links with nothing; a text of
fewer than n words has one n-gram, itself; repeated rows and equal sets share a component;
null ids take part and never name a component; an empty table gives no rows; other columns
are not read. Sets are compared by 64-bit hashes of n-grams, sets as a whole by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import cut_lineage
from .graph import components
from .hashing import bitmap
from .workers import tidied

N = 4
LEAST, MOST = 85, 100       # link: MOST * |x & y| >= LEAST * |x | y|
CHUNK = 1 << 20             # bytes hashed at once
ROWS = 256                  # texts whose sets are held at once
COUNTERS = 1 << 21          # of frequencies: 8 MB, on the driver and each executor
BITS, WIDE = 512, 2048      # of the sketch of a set, and of the second one of a set of over BITS
HUBS = 12                   # of a column and a band of sizes; columns of up to twice as many rows need none
COUNTED = 1 << 12           # counters that travel as one row
U = np.uint64


@dataclass(frozen=True)
class Link:
    n: int = N
    least: int = LEAST

    @property
    def smallest(self) -> int:
        """Smaller sets link with equal ones only."""
        return -(-self.least // (MOST - self.least))

    def first(self, size: int) -> int:
        """How many of a set's columns, the rarest, hold one that a linked set shares."""
        return size * (MOST - self.least) // MOST + 1


LINK = Link()
_BASE = U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _letters() -> np.ndarray:
    with np.errstate(over="ignore"):
        codes = _mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
    codes[65:91] = codes[97:123]
    return codes


_CODES = _letters()
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(9, 14)]] = True
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))


def gram_sets(texts: list[bytes], n: int = N) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
            size += len(texts[end]) + 1
            end += 1
        out += _chunk_sets(texts[at:end], n)
        at = end
    return out


def _chunk_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    edge = np.diff(_BLANK[raw].view(np.int8), prepend=np.int8(1))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    with np.errstate(over="ignore"):
        powers = np.full(len(raw), _BASE)
        powers[0] = U(1)
        powers = np.cumprod(powers)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_CODES[raw] * powers)))
        back = np.full(len(raw), _INVERSE)
        back[0] = U(1)
        hashes = _mix((sums[last] - sums[first]) * np.cumprod(back)[first] + (last - first).astype(np.uint64))
        grams = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
        for k in range(n):
            grams = _mix(grams * _BASE + hashes[k : len(hashes) - n + 1 + k]) if len(grams) else grams
        starts = np.searchsorted(first, np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))))
        out = []
        for a, b in zip(starts[:-1], starts[1:]):
            if b - a >= n:
                out.append(np.unique(grams[a : b - n + 1]))
            elif b > a:
                whole = U(b - a)
                for h in hashes[a:b]:
                    whole = _mix(whole * _BASE + h)
                out.append(np.array([whole], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _sets_of(batch: pa.RecordBatch, n: int) -> Iterator[np.ndarray]:
    """``gram_sets`` of a batch, a few texts at a time: a task never holds the sets of a whole batch."""
    texts = batch.column("text")
    for start in range(0, len(texts), ROWS):
        yield from gram_sets(_utf8(texts.slice(start, ROWS)), n)


def _places(grams: np.ndarray) -> np.ndarray:
    return (grams >> U(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def _tallies(batches: Iterator[pa.RecordBatch], link: Link) -> Iterator[pa.RecordBatch]:
    """The task's number of sets by counter, in blocks of counters."""
    total = np.zeros(COUNTERS, np.int64)
    seen: set[int] = set()
    for b in batches:
        for g in _sets_of(b, link.n):
            node = _node(g)
            if node not in seen:
                seen.add(node)
                np.add.at(total, _places(g), 1)
    blocks = total.astype(np.uint32).reshape(-1, COUNTED)
    filled = np.flatnonzero(blocks.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array([blocks[i].tobytes() for i in filled], pa.binary())], names=["block", "counts"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for block, counts in zip(b.column("block").to_pylist(), b.column("counts")):
            counts = np.frombuffer(counts.as_buffer(), np.uint32)
            held[block] = np.minimum(held.get(block, np.uint64(0)) + counts.astype(np.uint64), U(0xFFFFFFFF))
    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int64()), pa.array([c.astype(np.uint32).tobytes() for c in held.values()], pa.binary())], names=["block", "counts"])


def frequencies(texts: DataFrame, link: Link = LINK) -> np.ndarray:
    """In how many sets the n-grams of each counter are, over all rows: COUNTERS numbers, whatever the input."""
    kinds = "block long, counts binary"
    found = texts.mapInArrow(tidied(lambda batches: _tallies(batches, link)), kinds).repartition("block").mapInArrow(_added, kinds).toPandas()
    total = np.zeros((COUNTERS // COUNTED, COUNTED), np.uint32)
    for block, counts in zip(found["block"], found["counts"]):
        total[block] = np.frombuffer(counts, np.uint32)
    return total.ravel()


def rarest(grams: np.ndarray, counts: np.ndarray, link: Link = LINK) -> np.ndarray:
    """The n-grams of a set that a linked one may meet first, in the order of frequency and hash."""
    n = len(grams)
    if n < link.smallest:
        return grams[:0]
    order = (counts[_places(grams)].astype(np.uint64) << U(32)) | (_mix(grams) >> U(32))
    length = link.first(n)
    first = np.argpartition(order, length - 1)[:length] if length < n else np.arange(n)
    return grams[first[np.lexsort((grams[first], order[first]))]]


def _node(grams: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(_mix(np.sum(_mix(grams ^ _BASE), dtype=np.uint64) + U(len(grams))).view(np.int64))


def _utf8(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def sketch(grams: np.ndarray, bits: int = BITS) -> np.ndarray:
    """For each of ``bits`` counters whether an odd number of n-grams falls on it. Sets differ in at least as many n-grams as these in bits."""
    at = (_mix(grams) >> U(8)) & U(bits - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(bool), bitorder="little").view(np.uint64)


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def described(docs: DataFrame, link: Link = LINK) -> DataFrame:
    """doc_id, h (of the text), n (set size), node (its set; null if empty), sigs, bits and wide (of the first row of a node in its task)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _text_hash().alias("h"))
    counts = docs.sparkSession.sparkContext.broadcast(frequencies(rows.select("text"), link))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()      # a set that the task has met emits nothing again
        for b in batches:
            nodes, sizes, sigs, bits, wide = [], [], [], [], []
            for g in _sets_of(b, link.n):
                node = _node(g)
                nodes.append(node if len(g) else None)
                sizes.append(len(g))
                sigs.append(np.zeros(0, np.int64) if node in seen else rarest(g, counts.value, link).view(np.int64))
                bits.append(None if node in seen or len(g) < link.smallest else sketch(g).view(np.int64))
                wide.append(None if bits[-1] is None or len(g) <= BITS else sketch(g, WIDE).view(np.int64))
                seen.add(node)
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sigs]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), lists, *(pa.array(x, pa.list_(pa.int64())) for x in (bits, wide))], names=["doc_id", "h", "n", "node", "sigs", "bits", "wide"])

    return cut_lineage(rows.mapInArrow(tidied(run), "doc_id long, h long, n long, node long, sigs array<long>, bits array<long>, wide array<long>"), "gram-sets")


def _runs(batches: Iterator[pa.RecordBatch], link: Link) -> Iterator[pa.RecordBatch]:
    """From rows sorted by sig, n and node: each set after the first of its sig, with the previous one.

    ``first`` is the first set of the sig in the same band of sizes. Only the last row met is
    kept between batches, however long a run is.
    """
    last: tuple | None = None       # sig, n, at, node, band; n, at and node of the first
    for b in batches:
        s, n, at, v = (b.column(c).to_numpy() for c in ("sig", "n", "at", "node"))
        if not len(s):
            continue
        band = np.floor(np.log(n) / np.log(MOST / link.least)).astype(np.int64)
        if last:
            s, n, at, v, band = (np.concatenate(([x], y)) for x, y in zip(last[:5], (s, n, at, v, band)))
        start = np.concatenate(([True], (s[1:] != s[:-1]) | (band[1:] != band[:-1])))
        head = np.flatnonzero(start)
        firsts = [x[head[np.cumsum(start) - 1]] for x in (n, at, v)]
        if last:
            for x, known in zip(firsts, last[5:]):
                x[: head[1] if len(head) > 1 else len(s)] = known
        new = np.flatnonzero((s[1:] == s[:-1]) & (v[1:] != v[:-1])) + 1
        before = [np.where(start[new], x[new - 1], y[new]) for x, y in zip((n, at, v), firsts)]
        cols = (s[new], *before, n[new - 1], at[new - 1], v[new - 1], n[new], at[new], v[new])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=_RUN)
        last = (s[-1], n[-1], at[-1], v[-1], band[-1], *(x[-1] for x in firsts))


_RUN = ["sig", "first_n", "first_at", "first", "prev_n", "prev_at", "prev", "n", "at", "node"]


def runs(book: DataFrame, link: Link = LINK) -> DataFrame:
    """The neighbours in every column of the incidence matrix that several sets have, as far as it is a rare one to them."""
    at = book.select(F.posexplode("sigs").alias("at", "sig"), "node", F.col("n").cast("int").alias("n"))
    at = at.select("sig", "n", "at", "node").repartition("sig").sortWithinPartitions("sig", "n", "node")
    kinds = ", ".join(f"{c} {'int' if c.endswith(('n', 'at')) else 'long'}" for c in _RUN)
    return cut_lineage(at.mapInArrow(tidied(lambda batches: _runs(batches, link)), kinds), "gram-runs")


def _may_link(n: str, at: str, n2: str, at2: str, link: Link) -> Column:
    """Whether two sets of these sizes may link if what they meet in is the first column they share.

    No more than n - at of each can then be shared. Sets that link pass at their first one.
    """
    bound = link.least * (F.col(n) + F.col(n2))
    return ((MOST + link.least) * (F.col(n) - F.col(at)) >= bound) & ((MOST + link.least) * (F.col(n2) - F.col(at2)) >= bound)


def sets_of(docs: DataFrame, nodes: DataFrame, link: Link = LINK) -> DataFrame:
    """node, grams (sorted hashes as bytes), once for each of ``nodes`` (node, and h of a text that has it).

    A bitmap of fixed size spares most other texts the work and the shuffle; the join after it is exact.
    """
    may_hold = bitmap(nodes.select("h"))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in (whole.slice(start, ROWS) for whole in batches for start in range(0, len(whole), ROWS)):
            b = b.filter(pa.array(may_hold(b.column("h").to_numpy())))
            out: dict[int, bytes] = {}
            for g in _sets_of(b, link.n):
                node = _node(g)
                if len(g) and node not in seen:
                    seen.add(node)
                    out[node] = g.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(out.keys(), pa.int64()), pa.array(out.values(), pa.binary())], names=["node", "grams"])

    every = docs.select(F.col("text").cast("string").alias("text"), _text_hash().alias("h")).mapInArrow(tidied(chosen), "node long, grams binary")
    return cut_lineage(every.join(nodes, "node", "left_semi").dropDuplicates(["node"]), "gram-columns")


def _product(batches: Iterator[pa.RecordBatch], link: Link) -> Iterator[pa.RecordBatch]:
    """Accumulates the overlap of each pair and keeps the pairs that link."""
    for b in batches:
        keep = []
        for x, y in zip(b.column("x"), b.column("y")):
            x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
            if MOST * min(len(x), len(y)) < link.least * max(len(x), len(y)):
                keep.append(False)
                continue
            both = np.sort(np.concatenate((x, y)), kind="stable")       # two sorted runs: one merge
            shared = int(np.count_nonzero(both[1:] == both[:-1]))
            keep.append(MOST * shared >= link.least * (len(x) + len(y) - shared))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _bits_allow(n: Column, n2: Column, ending: str, link: Link) -> Column:
    """Linked sets differ in at most 15 of 185 (at the bound 85) of their sizes, so no more bits of their sketches do.

    The columns of the second set have ``ending`` in their names. Without a second sketch of both the first one decides.
    """
    apart = sum((F.bit_count(F.get("bits", F.lit(i)).bitwiseXOR(F.get("bits" + ending, F.lit(i)))) for i in range(BITS // 64)), F.lit(0))
    further = F.aggregate(F.zip_with("wide", "wide" + ending, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    most = (MOST - link.least) * (n + n2)
    return ((MOST + link.least) * apart <= most) & F.coalesce((MOST + link.least) * further <= most, F.lit(True))


def _plausible(pairs: DataFrame, sketches: DataFrame, link: Link) -> DataFrame:
    """The pairs whose sketches do not rule a link out."""
    one = sketches.select(F.col("node").alias("a"), "n", "bits", "wide")
    two = sketches.select(F.col("node").alias("b"), *(F.col(c).alias(c + "2") for c in ("n", "bits", "wide")))
    return pairs.join(one, "a").join(two, "b").where(_bits_allow(F.col("n"), F.col("n2"), "2", link)).select("a", "b")


def products(docs: DataFrame, pairs: DataFrame, sketches: DataFrame, link: Link = LINK) -> DataFrame:
    """The pairs (a, b) of ``pairs``, a written table, that link. ``sketches`` holds node and h."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = sets_of(docs, cut_lineage(sketches.select("node", "h").join(nodes, "node", "left_semi"), "gram-nodes"), link)
    wide = pairs.join(sets.toDF("b", "y"), "b").join(sets.toDF("a", "x"), "a").select("a", "b", "x", "y")
    return cut_lineage(wide.mapInArrow(tidied(lambda batches: _product(batches, link)), "a long, b long"), "gram-links")


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _mixed(members: DataFrame, found: DataFrame) -> DataFrame:
    """sig, node, n, at, c (the component) and rows (of the column), of the columns that hold several components."""
    named = members.join(found, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    mixed = named.groupBy("sig").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("rows")).where("low <> high").select("sig", "rows")
    return named.join(mixed, "sig").select("sig", "node", "n", "at", "c", "rows")


def _near(link: Link) -> Column:
    return _may_link("n", "at", "n2", "at2", link) & _bits_allow(F.col("n"), F.col("n2"), "2", link)


def to_hubs(rest: DataFrame, link: Link) -> DataFrame:
    """Pairs of each row of a crowded column with the column's hubs: in each band of sizes the nodes that HUBS hashes put first."""
    kinds = ("node", "n", "at", "c", "bits", "wide")
    band = F.floor(F.log(F.col("n").cast("double")) / np.log(MOST / link.least))
    place = Window.partitionBy("sig", "band")
    hubs = F.array(*(F.min_by(F.struct(*kinds), F.xxhash64("node", F.lit(i))).over(place) for i in range(HUBS)))
    each = rest.where(F.col("rows") > 2 * HUBS).withColumn("band", band).withColumn("hubs", hubs).withColumn("hub", F.explode(F.array_distinct("hubs")))
    each = each.select(*kinds, *(F.col("hub")[c].alias(c + "2") for c in kinds))
    return each.where((F.col("c") != F.col("c2")) & _near(link)).select(*_pair("node", "node2")).distinct()


def node_components(docs: DataFrame, book: DataFrame, link: Link = LINK) -> DataFrame:
    """node, component: of the nodes that link with another one."""
    met = runs(book, link)
    one = [F.min("h").alias("h"), F.first("n").cast("int").alias("n"), F.first("bits").alias("bits"), F.first("wide").alias("wide")]
    sketches = cut_lineage(book.where("bits is not null").groupBy("node").agg(*one), "gram-bits")
    by_first = met.where(_may_link("n", "at", "first_n", "first_at", link)).groupBy("node", "first").count()
    # a run's first node, most shared columns first: one likely partner of each node
    likely = by_first.groupBy("node").agg(F.max_by("first", "count").alias("first")).select(*_pair("node", "first")).distinct()
    tried = cut_lineage(_plausible(likely, sketches, link), "gram-likely")
    links = products(docs, tried, sketches, link)
    found = components(links)

    def joined(pairs: DataFrame, label: str) -> bool:
        """Multiplies the pairs not yet tried. False if there are none."""
        nonlocal tried, links, found
        new = cut_lineage(pairs.join(tried, ["a", "b"], "left_anti"), label)
        if new.isEmpty():
            return False
        tried = tried.unionByName(new)
        links = links.unionByName(products(docs, new, sketches, link))
        found = components(links)
        return True

    # neighbours in a run that are still apart
    beside = met.where(_may_link("n", "at", "prev_n", "prev_at", link)).select(*_pair("node", "prev")).distinct()
    joined(_plausible(_apart(beside, found), sketches, link), "gram-apart")
    # what remains: the columns whose sets are in several components, first with hubs, then all members
    rest = cut_lineage(_mixed(_members(met), found).join(sketches.select("node", "bits", "wide"), "node"), "gram-mixed")
    if joined(to_hubs(rest, link), "gram-hubs"):
        again = _mixed(rest.select("sig", "node", "n", "at"), found)
        rest = cut_lineage(again.join(sketches.select("node", "bits", "wide"), "node"), "gram-mixed")
    other = rest.select("sig", *(F.col(c).alias(c + "2") for c in ("node", "n", "at", "c", "bits", "wide")))
    joined(rest.join(other, "sig").where((F.col("c") < F.col("c2")) & _near(link)).select(*_pair("node", "node2")).distinct(), "gram-rest")
    return found


def _members(met: DataFrame) -> DataFrame:
    return met.select("sig", "node", "n", "at").unionByName(met.select("sig", F.col("prev").alias("node"), F.col("prev_n").alias("n"), F.col("prev_at").alias("at"))).distinct()


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    ca, cb = found.toDF("a", "ca"), found.toDF("b", "cb")
    both = pairs.join(ca, "a", "left").join(cb, "b", "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _grouped(docs: DataFrame, link: Link) -> DataFrame:
    """doc_id, h, n and ``at``, the group of linked rows (null for an empty set)."""
    book = described(docs, link)
    rows = book.select("doc_id", "h", "n", "node").join(node_components(docs, book, link), "node", "left")
    return rows.select("doc_id", "h", "n", F.coalesce("component", "node").alias("at"))


def linked(docs: DataFrame, n: int = N, least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of ``docs``.

    component_id is the smallest doc_id that links reach, the row's own included (null only
    where all reached ids are null).
    """
    rows = _grouped(docs, Link(n, least))
    least = rows.where("at is not null").groupBy("at").agg(F.min("doc_id").alias("low"))
    # blank rows have no group: they are spread by their ids
    spread = F.when(F.col("at").isNull(), F.pmod(F.xxhash64("doc_id"), F.lit(1024))).otherwise(F.lit(0))
    rows = rows.withColumn("spread", spread).join(least.withColumn("spread", F.lit(0)), ["at", "spread"], "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("at").isNull(), F.col("doc_id")).otherwise(F.col("low")).alias("component_id"))


def representatives(docs: DataFrame, n: int = N, least: int = LEAST) -> DataFrame:
    """The rows of ``docs`` without those that link to one with a smaller id (null ids last), repeated rows once.

    Rows with an empty set link with nothing and all stay.
    """
    rows = cut_lineage(_grouped(docs, Link(n, least)).where("at is not null").select("doc_id", "h", "at"), "gram-groups")
    first = rows.groupBy("at").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("first"))
    gone = rows.join(first, "at").where(~(F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.h") == F.col("h")))).select("doc_id", "h").distinct()
    twice = rows.groupBy("doc_id", "h").count().where("count > 1").select("doc_id", "h")
    out = _without(docs, gone, "left_anti")
    if twice.isEmpty():
        return out
    return _without(out, twice, "left_anti").unionByName(_without(out, twice, "left_semi").dropDuplicates(["doc_id", "text"]))


def _without(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    k = keys.toDF("gram_key_id", "gram_key_hash")
    return docs.join(k, (_text_hash() == F.col("gram_key_hash")) & F.col("doc_id").cast("long").eqNullSafe(F.col("gram_key_id")), how)
