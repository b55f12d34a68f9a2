"""Repair of conversations: the cheapest edits that bring the roles of each into order, with an audit.

In order means: an optional system row, then one or more pairs of user and assistant, or no
row at all; a role counts by its first character. A row may be kept (K, costs 0), given the
role user or assistant (R, 2) or deleted (D, 3; a must for blank and repeated rows), and an
empty user or assistant row may be inserted anywhere (I, 2); a truncated row that stays costs 1
more. Of the cheapest edits those whose letters in order come first in ASCII are taken.

The search is a dynamic program over four states (nothing yet, after system, after user, after
assistant). The edits that lead to a state are a node that links to the node before it, so
prefixes are shared. A node knows its ancestors at powers of two and the rolling hash of its
letters; two nodes of equal cost are compared at the end of their longest common prefix, which
is found by descending both over ancestors of unequal hashes, and that the prefixes are in fact
equal is verified. Equal costs over the same rows exclude that one string is a prefix of the
other, so what is best up to a row stays best whatever follows.

For the same reason the program can be cut. Rows are range-sorted and written once; a segment
is at most SEGMENT rows of one conversation, coded by one letter each. Tasks find the best
edits of a segment from every state to every state; segments of a longer conversation are
joined FAN at a time, in rounds, so no task sees the rows of a long conversation. Only its
audit and the hash of its repaired text, values of one row of the result, run through it whole.

Defined results: null roles and texts are one space; null turns come first; rows of equal turn
go by role and text; rows without conversation are one; repeated rows count as duplicates;
other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut_lineage

SEGMENT_BITS = 12           # a segment has 4,096 rows at most
FAN = 16                    # segments joined at once
CACHED = 1 << 16            # code strings whose edits a task keeps
BLANKS = " \t\n\x0b\f\r"
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
#: The next role of a pair from each state, and what it leads to.
_NEXT = (USER, USER, ASSISTANT, USER)
_KEPT = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "x": {}}
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_BASE, _MOD = 1_000_003, (1 << 61) - 1
EDGES = "array<struct<start:int,stop:int,cost:long,audit:string>>"
LINKS = f"conv_id long, seg long, first string, last string, illegal long, edges {EDGES}"


# -- the table ---------------------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the rows after damage by the hash of conversation and turn; ``there`` is false for a dropped one."""
    either = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))      # noqa: E731
    how = F.crc32(F.concat(either("conv_id"), F.lit(":"), either("turn")).cast("binary")) % 20
    text = F.when(how == 1, "").when(how == 2, F.translate(either("text"), ".!?", "")).otherwise(either("text"))
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(how == 4, "user").otherwise(either("role")).alias("role"), text.alias("text"), (how != 0).alias("there"),
        F.explode(F.array_repeat(F.lit(0), F.when(how == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("x")


def ordered(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with ``pos``, written in the order of conversation, turn, role and text."""
    order = ["conv_id", "turn", "role", "text", "row"]      # equal rows differ by their number, so they too can be dealt out
    rows = rows.select("conv_id", "turn", "role", "text").withColumn("row", F.monotonically_increasing_id())
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
    return cut_lineage(placed.withColumn("pos", F.monotonically_increasing_id()), "conv-rows")


def faults(rows: DataFrame) -> DataFrame:
    """Of every row of ``ordered``: conv_id, pos, initial, and whether it is blank, a duplicate or truncated; one of them at most."""
    bare = F.rtrim("text", F.lit(BLANKS))
    marks = rows.select(
        "conv_id", "pos", _initial(F.col("role")).alias("initial"), (bare == "").alias("blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"),
        F.unhex(F.sha2(F.concat_ws(":", F.octet_length("role"), "role", "text"), 256)).alias("same"),
    )
    firsts = marks.groupBy("conv_id", "same").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("earliest"))
    again = F.col("earliest").isNull()
    return marks.join(firsts, "pos", "left").select(
        "conv_id", "pos", "initial", "blank", (~F.col("blank") & again).alias("duplicate"), (~F.col("blank") & ~again & F.col("cut")).alias("truncated"),
    )


def segments(marks: DataFrame) -> DataFrame:
    """conv_id, seg, codes (a letter for each row), first, last and illegal of every segment."""
    code = F.when(F.col("blank") | F.col("duplicate"), "d").when(F.col("truncated"), F.upper("initial")).otherwise(F.col("initial"))
    cells = F.sort_array(F.collect_list(F.struct("pos", code.alias("code"), "initial")))
    held = marks.groupBy("conv_id", F.shiftright("pos", SEGMENT_BITS).alias("seg")).agg(cells.alias("cells"))
    roles = F.transform("cells", lambda c: c["initial"])
    held = held.select("conv_id", "seg", F.array_join(F.transform("cells", lambda c: c["code"]), "").alias("codes"), roles.alias("roles"))
    pairs = F.zip_with(F.col("roles"), F.slice("roles", F.lit(2), F.size("roles")), lambda a, b: F.concat(a, b))
    illegal = F.size(F.filter(pairs, lambda p: p.isNotNull() & ~p.isin("su", "ua", "au")))
    return held.select("conv_id", "seg", "codes", F.get("roles", F.lit(0)).alias("first"), F.element_at("roles", -1).alias("last"), illegal.cast("long").alias("illegal"))


# -- the dynamic program -----------------------------------------------------------------------


class Edits:
    """Strings of edits as linked nodes; node 0 is the empty one."""

    def __init__(self):
        self.letter, self.depth, self.hash = [""], [0], [0]
        self.up: list[tuple[int, ...]] = [()]       # ancestors at distance 1, 2, 4, ...

    def add(self, parent: int, letter: str) -> int:
        node, chain = len(self.up), [parent]
        while len(self.up[chain[-1]]) >= len(chain):
            chain.append(self.up[chain[-1]][len(chain) - 1])
        self.letter.append(letter)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * _BASE + ord(letter)) % _MOD)
        self.up.append(tuple(chain))
        return node

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def lifted(self, node: int, depth: int) -> int:
        rest = self.depth[node] - depth
        while rest:
            k = rest.bit_length() - 1
            node, rest = self.up[node][k], rest - (1 << k)
        return node

    def _equal(self, a: int, b: int) -> bool:
        """Whether two nodes of equal depth spell the same; ends where they share a node."""
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        least = min(self.depth[a], self.depth[b])
        x, y = self.lifted(a, least), self.lifted(b, least)
        if self.hash[x] == self.hash[y]:
            if self._equal(x, y):
                return self.depth[a] < self.depth[b]
            return self.text(a) < self.text(b)
        for k in range(len(self.up[x]) - 1, -1, -1):
            if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        if self._equal(self.up[x][0], self.up[y][0]):
            return self.letter[x] < self.letter[y]
        return self.text(a) < self.text(b)          # two different prefixes of one hash


Paths = dict[int, tuple[int, int]]      # state: cost and node


def _settle(edits: Edits, offers: dict[int, list[tuple[int, int, str]]]) -> Paths:
    """Of the offers (cost, node, letter to add) of each state the cheapest, of these the least."""
    out: Paths = {}
    for state, some in offers.items():
        cost = min(o[0] for o in some)
        nodes = [edits.add(n, letter) if letter else n for c, n, letter in some if c == cost]
        best = nodes[0]
        for node in nodes[1:]:
            if edits.less(node, best):
                best = node
        out[state] = (cost, best)
    return out


def _inserted(edits: Edits, paths: Paths) -> Paths:
    """The paths and those that inserts make of them. More than two in a row lead back at a higher cost."""
    for _ in range(2):
        offers = {s: [(c, n, "")] for s, (c, n) in paths.items()}
        for s, (c, n) in paths.items():
            to = _NEXT[s]
            if to not in paths or paths[to][0] >= c + COST[INSERT]:
                offers.setdefault(to, []).append((c + COST[INSERT], n, INSERT))
        paths = _settle(edits, offers)
    return paths


def best_edits(codes: str, start: int) -> list[tuple[int, int, int, str]]:
    """(start, end, cost, audit) of the best edits from ``start`` over all rows to each state."""
    edits = Edits()
    paths: Paths = {start: (0, 0)}
    for code in codes:
        offers: dict[int, list[tuple[int, int, str]]] = {}
        extra, kind = int(code.isupper()), code.lower()
        for state, (cost, node) in _inserted(edits, paths).items():
            offers.setdefault(state, []).append((cost + COST[DELETE], node, DELETE))
            if kind == "d":
                continue
            offers.setdefault(_NEXT[state], []).append((cost + COST[REROLE] + extra, node, REROLE))
            if state in _KEPT[kind]:
                offers.setdefault(_KEPT[kind][state], []).append((cost + extra, node, KEEP))
        paths = _settle(edits, offers)
    return [(start, stop, cost, edits.text(node)) for stop, (cost, node) in sorted(paths.items())]


def joined(left: list[tuple], right: list[tuple]) -> list[tuple]:
    """The best edits over two successive stretches, from every state to every state."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start, middle, cost, audit in left:
        for begin, stop, more, tail in right:
            if begin == middle:
                found = (cost + more, audit + tail)
                if (start, stop) not in best or found < best[start, stop]:
                    best[start, stop] = found
    return [(*ends, *found) for ends, found in sorted(best.items())]


def closed(edges: list[tuple]) -> tuple[int, str]:
    """Cost and audit of a whole conversation: from nothing to nothing or to an assistant's row."""
    left = {NOTHING: "", ASSISTANT: "", USER: INSERT, SYSTEM: INSERT * 2}
    return min((cost + COST[INSERT] * len(left[stop]), audit + left[stop]) for start, stop, cost, audit in edges if start == NOTHING)


# -- in Spark ----------------------------------------------------------------------------------

_EDGE = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _links(rows: list[tuple]) -> pa.RecordBatch:
    names = ["conv_id", "seg", "first", "last", "illegal", "edges"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), _EDGE)
    cols = list(zip(*rows)) if rows else [[]] * 6
    cols[5] = [[dict(zip(("start", "stop", "cost", "audit"), e)) for e in edges] for edges in cols[5]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, list[tuple]] = {}
    for b in batches:
        rows = []
        for conv_id, seg, codes, first, last, illegal in zip(*(b.column(c).to_pylist() for c in ("conv_id", "seg", "codes", "first", "last", "illegal"))):
            edges = known.get(codes)
            if edges is None:
                edges = [e for start in range(4) for e in best_edits(codes, start)]
                if len(known) < CACHED and len(codes) <= 64:
                    known[codes] = edges
            rows.append((conv_id, seg, first, last, illegal, edges))
        yield _links(rows)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for conv_id, seg, parts in zip(*(b.column(c).to_pylist() for c in ("conv_id", "seg", "parts"))):
            edges, illegal = None, 0
            for i, p in enumerate(parts):
                more = [(e["start"], e["stop"], e["cost"], e["audit"]) for e in p["edges"]]
                edges = more if edges is None else joined(edges, more)
                illegal += p["illegal"] + (i > 0 and parts[i - 1]["last"] + p["first"] not in ("su", "ua", "au"))
            rows.append((conv_id, seg, parts[0]["first"], parts[-1]["last"], illegal, edges))
        yield _links(rows)


def linked(parts: DataFrame) -> DataFrame:
    """One row of ``LINKS`` for each conversation, from ``segments``."""
    whole = cut_lineage(parts.mapInArrow(_solved, LINKS), "conv-links")
    sizes = whole.groupBy("conv_id").agg(F.count("*").alias("n"))
    longest = sizes.agg(F.max("n")).first()[0] or 0
    if longest < 2:
        return whole
    # dense numbers for the segments of the conversations that have several
    from pyspark.sql import Window

    several = sizes.where("n > 1").select("conv_id")
    key = ["conv_id", "seg"]
    at = whole.select(key).join(several.select(F.col("conv_id").alias("long_id")), F.col("conv_id").eqNullSafe(F.col("long_id"))).drop("long_id")
    at = at.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("seg")) - 1)
    at = cut_lineage(at, "conv-places")
    same = [F.col(f"w.{c}").eqNullSafe(F.col(f"p.{c}")) for c in key]
    rest = whole.alias("w").join(at.alias("p"), same, "left_anti")
    part = whole.alias("w").join(at.alias("p"), same).select("w.conv_id", F.col("p.place").cast("long").alias("seg"), *(f"w.{c}" for c in ("first", "last", "illegal", "edges")))
    while longest > 1:
        held = part.groupBy("conv_id", F.floor(F.col("seg") / FAN).alias("to")).agg(
            F.sort_array(F.collect_list(F.struct("seg", "first", "last", "illegal", "edges"))).alias("parts"))
        part = cut_lineage(held.select("conv_id", F.col("to").alias("seg"), "parts").mapInArrow(_chained, LINKS), "conv-links")
        longest = -(-longest // FAN)
    return rest.select(part.columns).unionByName(part)


def audits(links: DataFrame) -> DataFrame:
    """conv_id, illegal, cost and audit of each conversation."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [closed([(e["start"], e["stop"], e["cost"], e["audit"]) for e in edges]) for edges in b.column("edges").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("illegal"), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())],
                names=["conv_id", "illegal", "cost", "audit"],
            )

    return links.mapInArrow(run, "conv_id long, illegal long, cost long, audit string")


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, edit, role, text) of every edit in order, from rows sorted behind the audit of their conversation; edit "" starts one."""
    audit, at, state, here = "", 0, NOTHING, None

    def fill() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(audit) and audit[at] == INSERT:
            state, at = _NEXT[state], at + 1
            yield here, INSERT, _NAMES[state], ""

    for b in batches:
        for conv_id, role, text, header in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text", "audit"))):
            yield from fill()
            if header is not None:
                audit, at, state, here = header, 0, NOTHING, conv_id
                yield here, "", None, None
                continue
            edit, at = audit[at], at + 1
            if edit == REROLE:
                state = _NEXT[state]
                role = _NAMES[state]
            elif edit == KEEP:
                state = _KEPT[role[:1]][state]
            yield here, edit, role, text
    yield from fill()


def _behind_audits(rows: DataFrame, found: DataFrame) -> DataFrame:
    heads = found.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit")
    both = rows.select("conv_id", "pos", "role", "text", F.lit(None).cast("string").alias("audit")).unionByName(heads)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "pos")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit, role and text of what is left of ``ordered`` rows after the edits of ``audits``."""
    names = ["conv_id", "place", "edit", "role", "text"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, out = 0, []
        for conv_id, edit, role, text in _replayed(batches):
            if not edit:
                place = 0
            elif edit != DELETE:
                out.append((conv_id, place, edit, role, text))
                place += 1
            if len(out) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return _behind_audits(rows, found).mapInArrow(run, "conv_id long, place long, edit string, role string, text string")


def hashed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id and the hash of the repaired conversation, worked out row by row."""
    def batch(ids: list, sums: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sums, pa.string())], names=["conv_id", "repaired_sha256"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sums, state, first = [], [], None, True
        for conv_id, edit, role, text in _replayed(batches):
            if not edit:
                if state:
                    sums.append(state.hexdigest())
                if len(sums) >= 2000:
                    yield batch(ids, sums)
                    ids, sums = [], []
                ids.append(conv_id)
                state, first = hashlib.sha256(), True
            elif edit != DELETE:
                state.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
        if state:
            yield batch(ids, [*sums, state.hexdigest()])

    return _behind_audits(rows, found).mapInArrow(run, "conv_id long, repaired_sha256 string")


def digest(conversations: DataFrame) -> DataFrame:
    """The faults, the cheapest edits and the repaired text's hash of every conversation, after damage."""
    spoilt = damaged(conversations)
    rows = ordered(spoilt.where("there"))
    marks = cut_lineage(faults(rows), "conv-faults")
    counts = marks.groupBy("conv_id").agg(*(F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")))
    found = cut_lineage(audits(linked(segments(marks))), "conv-audits")
    turns = spoilt.groupBy("conv_id", "turn").agg(F.max("there").alias("there"))
    turn = F.when(F.col("there"), F.col("turn"))
    gaps = turns.groupBy("conv_id").agg((F.max(turn) - F.min(turn) + 1 - F.count(turn)).alias("gaps"))
    out = gaps.alias("g")
    for side, name in ((counts, "c"), (found, "f"), (hashed(rows, found), "h")):
        out = out.join(side.alias(name), F.col("g.conv_id").eqNullSafe(F.col(f"{name}.conv_id")), "left")
    whole = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c.split(".")[-1])     # noqa: E731
    return out.select(
        "g.conv_id", *map(whole, ("g.gaps", "c.blank", "c.duplicate", "c.truncated", "f.illegal", "f.cost")),
        F.coalesce("f.audit", F.lit("")).alias("audit"), F.coalesce("h.repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


# -- the same in DuckDB ------------------------------------------------------------------------


def _sql() -> str:
    """:func:`digest` as SQL: a recursive query carries, for each state, cost and audit as one string that sorts by both."""
    more = lambda f, cost, letter: f"lpad((left({f}, 10)::BIGINT + {cost})::VARCHAR, 10, '0') || substr({f}, 11) || '{letter}'"     # noqa: E731
    when = lambda test, f: f"CASE WHEN {test} THEN {f} ELSE '{far}' END"        # noqa: E731
    far = "9000000000"
    insert = lambda src: f"""SELECT * REPLACE (least(fu, {more('f0', 2, 'I')}, {more('fs', 2, 'I')}, {more('fa', 2, 'I')}) AS fu, least(fa, {more('fu', 2, 'I')}) AS fa) FROM ({src})"""       # noqa: E731
    stay = "code <> 'd'"
    extra = "(code = upper(code))::INT"
    keep = lambda letter, *states: when(f"lower(code) = '{letter}'", "least(" + ", ".join(more(f, extra, "K") for f in states) + ")")     # noqa: E731
    rerole = lambda *states: when(stay, "least(" + ", ".join(more(f, f"(2 + {extra})", "R") for f in states) + ")")       # noqa: E731
    step = f"""SELECT conv, rn + 1 AS rn, {more('f0', 3, 'D')} AS f0, least({more('fs', 3, 'D')}, {keep('s', 'f0')}) AS fs,
        least({more('fu', 3, 'D')}, {rerole('f0', 'fs', 'fa')}, {keep('u', 'f0', 'fs', 'fa')}) AS fu,
        least({more('fa', 3, 'D')}, {rerole('fu')}, {keep('a', 'fu')}) AS fa
      FROM ({insert(insert("SELECT d.*, m.code FROM best d JOIN marks m ON m.conv = d.conv AND m.rn = d.rn + 1"))})"""
    bit = "xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END)"
    crc = f"""xor(list_reduce(list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: {bit}), 4294967295::BIGINT), 4294967295::BIGINT)"""
    return rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, dense_rank() OVER (ORDER BY conv_id) AS conv,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
rolled AS (SELECT *, {crc} % 20 AS how FROM keyed),
spoilt AS (
  SELECT conv, turn, CASE how WHEN 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE how WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM rolled)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS rn FROM spoilt),
faults AS (
  SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS initial,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY rn) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM placed),
marks AS (
  SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'd' WHEN fault = 'truncated' THEN upper(initial) ELSE initial END AS code,
    coalesce(lag(initial) OVER (PARTITION BY conv ORDER BY rn) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal FROM faults),
best AS (
  SELECT DISTINCT conv, 0::BIGINT AS rn, '0000000000' AS f0, '{far}' AS fs, '{far}' AS fu, '{far}' AS fa FROM marks
  UNION ALL {step}),
audits AS (
  SELECT conv, left(f, 10)::BIGINT AS cost, substr(f, 11) AS audit FROM (
    SELECT conv, least(f0, fa, {more('fu', 2, 'I')}, {more('fs', 4, 'II')}) AS f FROM best QUALIFY row_number() OVER (PARTITION BY conv ORDER BY rn DESC) = 1)),
replay AS (
  SELECT conv, audit, 0::BIGINT AS spot, 0::BIGINT AS rn, '' AS state, []::VARCHAR[] AS done FROM audits
  UNION ALL
  SELECT conv, audit, spot + 1, rn, CASE edit WHEN 'D' THEN state WHEN 'K' THEN left(role, 1) ELSE left(need, 1) END,
    CASE edit WHEN 'D' THEN done WHEN 'I' THEN list_append(done, need || ':') WHEN 'R' THEN list_append(done, need || ':' || text) ELSE list_append(done, role || ':' || text) END
  FROM (
    SELECT p.conv, p.audit, p.spot, p.edit, p.need, p.state, p.done, p.rn + (p.edit <> 'I')::BIGINT AS rn, m.role, m.text
    FROM (SELECT *, substr(audit, spot::INT + 1, 1) AS edit, CASE state WHEN 'u' THEN 'assistant' ELSE 'user' END AS need FROM replay WHERE spot < length(audit)) p
    LEFT JOIN marks m ON m.conv = p.conv AND m.rn = p.rn + 1)),
texts AS (SELECT conv, array_to_string(done, chr(10)) AS repaired FROM replay WHERE spot = length(audit)),
counts AS (
  SELECT conv, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE illegal) AS illegal
  FROM marks GROUP BY conv)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM keyed) i LEFT JOIN counts USING (conv) LEFT JOIN audits USING (conv) LEFT JOIN texts USING (conv)
"""


DIGEST_SQL = _sql()
