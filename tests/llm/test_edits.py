"""Fill-in-middle, byte-level BPE and the repair of conversations against plain models."""

import hashlib
import random
import zlib
from itertools import groupby

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from marquee.llm import bpe, conversations, fim

from .common import awkward, collected, empty, frame

LONG = "Grüße, wörld! " * 3000 + "\n" + "é" * 5000
sha = lambda x: hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()     # noqa: E731
TRICKY = [(9001, LONG, "a"), (9002, "a <S> b", "a"), (9003, "<", "a"), (9004, "<P", "b"), (9005, "\0\1 <M\0>", "b"), (9006, "𝔘̀ ﷽" * 50, "c")]


def fim_model(doc_id, text):
    text = text or ""
    n = len(text)
    h = sha(f"1:{'null' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, n, form, len(p), len(m), sha(out), sha(text))


def test_fill_in_middle(spark):
    rows = awkward() + TRICKY
    made = fim.transformed(frame(spark, rows))
    want = sorted((fim_model(i, t) for i, t, _ in rows), key=lambda r: tuple((x is None, x) for x in r))
    assert collected(fim.digest(made), "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256") == want
    assert {r[0] for r in collected(made, "form")} == {"plain", "psm", "spm"}
    assert fim.digest(fim.transformed(empty(spark))).count() == 0


def test_the_tree_finds_every_unit():
    r = random.Random(3)
    for units in fim.UNITS:
        for size in (0, 1, fim.BLOCK - 1, fim.BLOCK, fim.BLOCK + 1, 9 * fim.BLOCK + 17):
            text = "".join(r.choice("ab é\n𝔘") for _ in range(size)).encode()[:size].decode(errors="ignore").encode()
            raw = np.frombuffer(text, np.uint8)
            blocks = fim.Blocks(raw, units)
            starts = np.flatnonzero(fim.UNITS[units](raw)).tolist() + [len(raw)]
            assert blocks.units == len(starts) - 1
            for i in {0, len(starts) - 1, *(r.randrange(len(starts)) for _ in range(60))}:
                assert blocks.cut(i) == (starts[i], len(text[: starts[i]].decode()))


@pytest.fixture(scope="module")
def vocab():
    return bpe.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.mark.parametrize("most", [0, 50, bpe.WORDS])
def test_byte_level_bpe(spark, vocab, most):
    rows = awkward() + TRICKY + [(9010, "ab" * 400 + "   x\U0001e5f7ࡰ '’s's 12½ ﻿᠎ ", "a"), (9011, "\0Ab\1𐀀\0", "a")]
    out = bpe.encoded(frame(spark, rows), vocab, most)
    known = tiktoken.Encoding("model", pat_str=vocab.pattern, mergeable_ranks=vocab.ranks, special_tokens={})
    want = [(i, known.encode_ordinary(t or "")) for i, t, _ in rows]
    key = lambda r: (r[0] is None, r)       # noqa: E731
    assert sorted((tuple(r) for r in out.select("doc_id", bpe.numbers(F.col("ids"))).collect()), key=key) == sorted(want, key=key)
    back = bpe.decoded(out, vocab).select("doc_id", F.decode("text", "UTF-8").alias("text"))
    assert sorted((tuple(r) for r in back.collect()), key=key) == sorted(((i, t or "") for i, t, _ in rows), key=key)
    if most:
        assert collected(bpe.digest(out, vocab), "n_tokens", "ids_sha256") == sorted((len(x), sha(np.array(x, "<u4").tobytes())) for _, x in want)
        assert bpe.encoded(empty(spark), vocab, most).count() == 0


def test_classes_agree_with_the_tokenizer(spark, vocab):
    """Every code point alone, between a letter and a digit, is split as the tokenizer splits it."""
    pattern = bpe.jvm_pattern(spark, vocab.pattern)
    single = {bytes([i]): i for i in range(256)}
    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for kind in (r"\p{L}", r"\p{N}"):
        one = bpe.jvm_pattern(spark, kind)
        text = "".join(chars)
        got = spark.range(1).select(F.array_join(bpe.split(F.lit(text), one), "")).first()[0]
        assert got == bytes(tiktoken.Encoding("m", pat_str=kind, mergeable_ranks=single, special_tokens={}).encode_ordinary(text)).decode()
    assert pattern.startswith("(?U)")


SCHEMA = "conv_id long, turn long, role string, text string, pos string, seg string, audit string"


def talk(spark, rows):
    return spark.createDataFrame([(*r, *"xyz") for r in rows], SCHEMA)


def repair_model(rows):
    """Damage, faults and the best edits of each conversation, audits as plain strings."""
    out = []
    for conv_id in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in (r for r in rows if r[0] == conv_id):
            role, text = " " if role is None else role, " " if text is None else text
            how = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if how == 1 else text.translate({ord(c): None for c in ".!?"}) if how == 2 else text
            role = "user" if how == 4 else role
            kept += [(turn, role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = {t for t, *_ in kept if t is not None}
        seen, rows_, faults = set(), [], []
        for _, role, text in kept:
            bare = text.rstrip(" \t\n\x0b\f\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
            rows_.append((role, text, faults[-1]))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows_, rows_[1:]))
        cost, audit, done = search(rows_)
        out.append((conv_id, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                    illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in done))))
    return out


def search(rows):
    need = lambda s: "a" if s == "u" else "u"        # noqa: E731
    name = {"u": "user", "a": "assistant"}

    def relax(table, key, found):
        if key not in table or found[:2] < table[key][:2]:
            table[key] = found

    def inserts(layer):
        for _ in range(3):
            for s, (c, a, out) in list(layer.items()):
                relax(layer, need(s), (c + 2, a + "I", out + [(name[need(s)], "")]))
        return layer

    layer = {"": (0, "", [])}
    for role, text, fault in rows:
        before, layer = inserts(layer), {}
        for s, (c, a, out) in before.items():
            relax(layer, s, (c + 3, a + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            t = int(fault == "truncated")
            relax(layer, need(s), (c + 2 + t, a + "R", out + [(name[need(s)], text)]))
            if role[:1] == need(s) or (role[:1] == "s" and s == ""):
                relax(layer, role[:1], (c + t, a + "K", out + [(role, text)]))
    return min((v for s, v in inserts(layer).items() if s in ("", "a")), key=lambda v: v[:2])


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def talks(seed, n=80, long=700):
    r = random.Random(seed)
    texts = ["Hello.", "What?", "cut off", " \t", "", None, "Yes!\n", "mm..", "so: it goes", "Fine. \x0b"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "u", "ünder"]
    rows = [(None, None, None, None), (None, 3, "user", "x."), (1, None, "user", "a."), (1, None, "assistant", "b.")]
    for conv in range(2, n):
        for turn in range(r.randint(1, 9)):
            role = ["user", "assistant"][turn % 2] if r.random() < 0.6 else r.choice(roles)
            text = f"{r.choice(['A', 'b c', 'd'])}{turn}{r.choice(['.', '?', '', '.'])}" if r.random() < 0.7 else r.choice(texts)
            rows.append((conv, turn + r.randrange(2), role, text))
    rows += [(7000, t, r.choice(roles), f"t{r.randrange(long)}{r.choice(['.', ''])}") for t in range(long)]
    return rows + rows[-3:] * 2 + [rows[6]] * 3


@pytest.mark.parametrize("bits", [2, 12])
def test_repair(spark, monkeypatch, bits):
    monkeypatch.setattr(conversations, "SEGMENT_BITS", bits)
    monkeypatch.setattr(conversations, "FAN", 4)
    rows = talks(bits)
    key = lambda r: (r[0] is None, r)       # noqa: E731
    assert sorted(map(tuple, conversations.digest(talk(spark, rows)).select(*COLUMNS).collect()), key=key) == sorted(repair_model(rows), key=key)


def test_sql_of_the_repair_equals_the_model():
    import duckdb
    import pandas as pd

    rows = [r for r in talks(3, 120, 150)]
    columns = list(zip(*rows))
    kinds = ("Int64", "Int64", object, object)
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame({n: pd.Series(c, dtype=k) for n, c, k in zip(("conv_id", "turn", "role", "text"), columns, kinds)}))
    key = lambda r: (r[0] is None, r)       # noqa: E731
    assert sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({conversations.DIGEST_SQL})").fetchall(), key=key) == sorted(repair_model(rows), key=key)


def test_repair_of_nothing(spark):
    assert conversations.digest(talk(spark, [(1, 1, "user", "a.")]).where("false")).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert [tuple(r) for r in conversations.digest(talk(spark, [(gone, 0, "user", "a.")])).select(*COLUMNS).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", sha(""))]


def test_repaired_rows_are_in_order(spark):
    rows = conversations.ordered(conversations.damaged(talk(spark, talks(5))).where("there"))
    found = conversations.audits(conversations.linked(conversations.segments(conversations.faults(rows)))).cache()
    out = sorted((tuple(r) for r in conversations.repaired(rows, found).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    import re

    for _, some in groupby(out, key=lambda r: r[0]):
        some = list(some)
        assert [r[1] for r in some] == list(range(len(some)))
        assert re.fullmatch("s?(ua)+", "".join(r[3][:1] for r in some))


def test_ties_and_collisions(monkeypatch):
    """Comparison of linked strings agrees with that of plain ones, also where every hash collides."""
    for mod in (conversations._MOD, 3):
        monkeypatch.setattr(conversations, "_MOD", mod)
        r = random.Random(mod)
        edits, nodes = conversations.Edits(), [0]
        for _ in range(400):
            nodes.append(edits.add(r.choice(nodes[-6:]), r.choice("DIKR")))
        for _ in range(3000):
            a, b = r.choice(nodes), r.choice(nodes)
            assert edits.less(a, b) == (edits.text(a) < edits.text(b))
