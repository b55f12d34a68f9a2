"""Byte-level BPE with a vocabulary of ranks: ids of texts, and texts of ids.

A text is split by the tokenizer's pattern. A word that is in the vocabulary is its own id.
Any other starts as its bytes; of all adjacent pairs whose bytes together have a rank the one
with the least rank, the leftmost of several, is merged, until no pair has a rank. The merges
are a fold (``aggregate``) over an array with one number for each piece: in its bits the rank
of the piece with its right neighbour, the byte at which it starts, and its id, so that
``array_min`` names the next merge. Ranks of pairs come from a literal: an array of buckets,
each with the keys of a few pairs and the ids they merge to.

The distinct words of all texts are counted, and the most frequent ones, WORDS at most and of
WORD_BYTES at most, are folded once. Their ids are broadcast; tasks look the words of a text up
and pass on what is known, joined, between the words that are not, which Spark then folds where
they stand. So the dictionary spares work only: ids do not depend on it. Nothing but the words
is shuffled. Decoding joins the pieces of the ids.

Defined results: a null or empty text has no ids; repeated rows are encoded each; columns beside
id and text are not read; an empty table gives no rows. A word may have up to 2^28 bytes; one of
n bytes takes up to n merges of n steps each.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import cut_lineage, text_of

WORDS = 1 << 18             # entries of the dictionary
WORD_BYTES = 64
ROWS = 64                   # texts whose words a task holds at once
PAIR_BUCKETS = 1 << 15
PLANE = 1 << 16             # code points whose classes are compared at once
ID_BITS, START_BITS = 17, 28
NONE = 1 << ID_BITS         # stands for the rank of a pair without one
MOST = 100_000              # counts of words above are equal


@dataclass(frozen=True)
class Vocabulary:
    pattern: str
    ranks: dict[bytes, int]

    def __hash__(self):
        return hash((self.pattern, len(self.ranks)))


@lru_cache(4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """The ranks in a file of lines ``base64 rank``, and the pattern that splits texts."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    if max(ranks.values()) >= NONE or any(bytes([i]) not in ranks for i in range(256)):
        raise ValueError("ids must be under 2^17 and every byte must have one")
    return Vocabulary(pattern, ranks)


# -- splitting ---------------------------------------------------------------------------------


def _members(kind: str, text: str) -> set[str]:
    """The characters of ``text`` that the tokenizer's regular expressions count to a class."""
    import tiktoken

    one = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return set(bytes(one.encode_ordinary(text)).decode())      # what no match covers is dropped


def _ranges(points: list[int]) -> str:
    runs: list[list[int]] = []
    for c in points:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs)


def jvm_pattern(spark: SparkSession, pattern: str) -> str:
    """``pattern`` for Spark: the JVM knows an older Unicode, so its classes get the members it lacks."""
    kinds = sorted(set(re.findall(r"\\p\{\w+\}", pattern)))
    lacking: dict[str, list[int]] = {kind: [] for kind in kinds}
    for start in range(0, 0x110000, PLANE):
        text = "".join(chr(c) for c in range(max(1, start), start + PLANE) if not 0xD800 <= c < 0xE000)
        known = spark.range(1).select(*(F.regexp_replace(F.lit(text), kind.replace("p", "P", 1), "") for kind in kinds)).first()
        for kind, members in zip(kinds, known):
            inside = _members(kind, text)
            extra = set(members) - inside
            if extra:
                raise ValueError(f"the JVM counts {len(extra)} more characters to {kind} than the tokenizer")
            lacking[kind] += sorted(map(ord, inside - set(members)))
    out, depth, at = [], 0, 0
    while at < len(pattern):
        kind = next((k for k in kinds if pattern.startswith(k, at)), None)
        if kind:
            more = lacking[kind]
            if not more:
                out.append(kind)
            elif depth:
                out.append(kind + _ranges(more))
            else:       # the coarse range comes first: few characters of a text are compared with all the others
                out.append(f"[{kind}[\\x{{{more[0]:X}}}-\\x{{10FFFF}}&&[{_ranges(more)}]]]")
            at += len(kind)
            continue
        if pattern[at] == "\\":
            out.append(pattern[at : at + 2])
            at += 2
            continue
        depth += {"[": 1, "]": -1}.get(pattern[at], 0)
        out.append(pattern[at])
        at += 1
    return "(?U)" + "".join(out)


# -- merging -----------------------------------------------------------------------------------


def _long(x: int) -> Column:
    return F.expr(f"{x}L")


def _bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def rank_map(vocab: Vocabulary) -> Column:
    """A literal: ``pairs`` (buckets: the keys of n pairs, a null, and the ids they merge to) and ``bytes`` (the id of each byte)."""
    buckets: list[list[tuple[int, int]]] = [[] for _ in range(PAIR_BUCKETS)]
    for whole, rank in vocab.ranks.items():
        for i in range(1, len(whole)):
            left, right = vocab.ranks.get(whole[:i]), vocab.ranks.get(whole[i:])
            if left is not None and right is not None:
                buckets[(left * 31 + right) % PAIR_BUCKETS].append((left << ID_BITS | right, rank))
    data = {"pairs": [[k for k, _ in b] + [None] + [r for _, r in b] for b in buckets], "bytes": [vocab.ranks[bytes([i])] for i in range(256)]}
    return F.from_json(F.lit(json.dumps(data, separators=(",", ":"))), "pairs array<array<bigint>>, bytes array<bigint>")


def fold(word: Column, literal: Column) -> Column:
    """The ids (array of numbers) of a binary ``word`` of at least one byte, by merges from its bytes."""
    id_mask, low = _long((1 << ID_BITS) - 1), _long((1 << (ID_BITS + START_BITS)) - 1)
    top = ID_BITS + START_BITS

    def ranked(piece: Column, right: Column) -> Column:
        """``piece``, whose rank bits are empty, with the rank of it and its right neighbour (null: none)."""
        a, b = piece.bitwiseAND(id_mask), right.bitwiseAND(id_mask)
        bucket = F.get(literal["pairs"], (a * _long(31) + b).bitwiseAND(_long(PAIR_BUCKETS - 1)).cast("int"))
        # a key that is not there has place 0, and one that equals an id a place over n: both lead to a null
        merged = _bind(bucket, lambda x: F.get(x, F.array_position(x, F.shiftleft(a, ID_BITS) + b).cast("int") + F.shiftright(F.size(x), 1)))
        return piece + F.shiftleft(F.coalesce(merged + _long(1), _long(NONE)), top)

    def step(pieces: Column, _: Column) -> Column:
        def merge(k: Column) -> Column:         # k, from 1: the left piece of the merge
            def put(new: Column) -> Column:
                left = F.get(pieces, k - 2)
                return F.concat(
                    F.slice(pieces, F.lit(1), F.greatest(k - 2, F.lit(0))),
                    F.when(k > 1, F.array(ranked(left.bitwiseAND(low), new))).otherwise(F.slice(pieces, 1, 0)),
                    F.array(ranked(new, F.get(pieces, k + 1))), F.slice(pieces, k + 2, F.size(pieces)),
                )
            old = F.get(pieces, k - 1)
            return _bind(F.shiftright(old, top) - _long(1) + old.bitwiseAND(_long(((1 << START_BITS) - 1) << ID_BITS)), put)

        least = F.array_min(pieces)
        return F.when(least >= _long(NONE << top), pieces).otherwise(_bind(F.array_position(pieces, least).cast("int"), merge))

    size = F.octet_length(word)
    chars = F.filter(F.split(F.decode(word, "ISO-8859-1"), ""), lambda c: c != "")
    raw = F.transform(chars, lambda c, i: F.get(literal["bytes"], F.ascii(c)) + F.shiftleft(i.cast("bigint") + _long(1), ID_BITS))
    start = _bind(raw, lambda a: F.transform(a, lambda x, i: ranked(x, F.get(a, i + 1))))
    merged = F.aggregate(F.sequence(F.lit(2), F.greatest(size, F.lit(2))), start, step)
    return F.transform(merged, lambda x: x.bitwiseAND(id_mask).cast("int"))


# -- texts -------------------------------------------------------------------------------------


def split(text: Column, pattern: str) -> Column:
    """The words of a text: every match of a ``jvm_pattern``."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def counted(docs: DataFrame, pattern: str) -> DataFrame:
    """``word`` and its ``count`` over all rows."""
    each = docs.select(F.explode(split(text_of(), pattern)).alias("word"))
    return each.groupBy("word").count()


def _frequent(docs: DataFrame, pattern: str, most: int) -> DataFrame:
    """The words of the highest counts, ``most`` at most, of those that are short and not rare."""
    words = counted(docs, pattern).where((F.octet_length("word") <= WORD_BYTES) & (F.col("count") > 1))
    words = cut_lineage(words.withColumn("count", F.least("count", F.lit(MOST))), "bpe-words")
    least, taken = MOST + 1, 0
    for count, n in words.groupBy("count").agg(F.count("*")).orderBy(F.desc("count")).collect():    # MOST rows at most
        if taken + n > most:
            break
        least, taken = count, taken + n
    return words.where(F.col("count") >= least).select("word")


def _written(word: Column, literal: Column) -> Column:
    """The ids of a word by merges, each 32 bits, least byte first, in hex."""
    def name(i: Column) -> Column:
        six = F.lpad(F.hex(i), 6, "0")
        return F.concat(F.substring(six, 5, 2), F.substring(six, 3, 2), F.substring(six, 1, 2), F.lit("00"))

    return F.array_join(F.transform(fold(word.cast("binary"), literal), name), "")


def _is_text(word: bytes) -> bool:
    try:
        return bool(word.decode())
    except UnicodeDecodeError:
        return False


def dictionary(docs: DataFrame, vocab: Vocabulary, pattern: str, most: int = WORDS) -> bytes:
    """An Arrow table of ``word`` and ``ids`` in hex: the frequent words, and the tokens that merges from their bytes do not give."""
    spark = docs.sparkSession
    own = pa.table({
        "word": [t.decode() for t in vocab.ranks if _is_text(t)],
        "id": [i.to_bytes(4, "little").hex().upper() for t, i in vocab.ranks.items() if _is_text(t)],
    })
    tokens = spark.createDataFrame(own).repartition(spark.sparkContext.defaultParallelism)
    words = tokens.unionByName(_frequent(docs, pattern, most).select("word", F.lit(None).cast("string").alias("id")))
    found = words.select("word", "id", _bind(rank_map(vocab), lambda m: _written(F.col("word"), m)).alias("ids"))
    found = found.where(F.col("id").isNull() | (F.col("id") != F.col("ids")))
    # a token's own id counts, whatever merges give: it comes last
    out = pa.BufferOutputStream()
    table = found.select("word", F.coalesce("id", "ids").alias("ids"), F.col("id").isNotNull().alias("own")).toArrow()
    table = pa.concat_tables([table.filter(pc.invert(table["own"])), table.filter(table["own"])]).drop(["own"])
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def encoded(docs: DataFrame, vocab: Vocabulary, most: int = WORDS) -> DataFrame:
    """doc_id and ids (32 bits each, least byte first) of every row. ``most``: entries of the dictionary."""
    spark = docs.sparkSession
    pattern = jvm_pattern(spark, vocab.pattern)
    shared = spark.sparkContext.broadcast(dictionary(docs, vocab, pattern, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.ipc.open_stream(shared.value).read_all()
        held = dict(zip(table["word"].to_pylist(), table["ids"].to_pylist())).get
        for b in batches:
            for start in range(0, len(b), ROWS):
                some = b.slice(start, ROWS)
                known, rare = [], []
                for words in some.column("words"):
                    words = words.values.to_pylist()
                    ids = list(map(held, words))
                    gaps = [i for i, x in enumerate(ids) if x is None]
                    edges = [-1, *gaps, len(ids)]
                    known.append(["".join(ids[a + 1 : z]) for a, z in zip(edges, edges[1:])])
                    rare.append([words[i] for i in gaps])
                kinds = pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(known, kinds), pa.array(rare, kinds)], names=["doc_id", "known", "rare"])

    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), split(text_of(), pattern).alias("words"))
    parts = words.mapInArrow(run, "doc_id long, known array<string>, rare array<string>")
    joined = lambda m: F.array_join(        # noqa: E731
        F.zip_with("known", F.transform("rare", lambda w: _written(w, m)), lambda k, r: F.concat(k, F.coalesce(r, F.lit("")))), "")
    return parts.select("doc_id", F.unhex(_bind(rank_map(vocab), joined)).alias("ids"))


def numbers(ids: Column) -> Column:
    """Packed ids as an array of numbers."""
    byte = lambda i, k: F.shiftleft(F.conv(F.hex(F.substring(ids, 4 * i + k + 1, F.lit(1))), 16, 10).cast("int"), 8 * k)      # noqa: E731
    count = F.floor(F.octet_length(ids) / 4).cast("int")
    every = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: byte(i, 0) + byte(i, 1) + byte(i, 2))
    return F.when(count == 0, F.array().cast("array<int>")).otherwise(every)


def decoded(rows: DataFrame, vocab: Vocabulary) -> DataFrame:
    """``rows`` with ``text``: the bytes that their packed ``ids`` stand for, the pieces joined. Unknown ids stand for nothing."""
    pieces = [b""] * NONE
    for piece, i in vocab.ranks.items():
        pieces[i] = piece

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, len(b), ROWS):
                some = b.slice(start, ROWS)
                texts = [b"".join([pieces[i] if i < NONE else b"" for i in memoryview(ids.as_buffer()).cast("I")]) for ids in some.column("ids")]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.binary())], names=[*some.schema.names, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, text binary")


def digest(rows: DataFrame, vocab: Vocabulary) -> DataFrame:
    """doc_id, n_tokens and the hashes of the packed ids and of the bytes decoded from them."""
    return decoded(rows.select("doc_id", "ids"), vocab).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"),
    )
