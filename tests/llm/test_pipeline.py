"""The whole pipeline against a plain model of its five stages, and the ledger's ablations."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from marquee.llm import mixing, packing, rules

from .common import awkward, frame, words
from .test_dedup import edited, planted

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    """Ids are unique and set, for the model keeps rows by id; everything else may be awkward."""
    r = random.Random(31)
    rows = [(k, t, s) for k, (_, t, s) in enumerate(awkward(31, 90))]
    texts = [t for seed in range(3) for _, t, _ in planted(56, 40 + seed)[1]]
    texts += [t for seed in range(6) for t in edited(98, (30, 60), 50 + seed)] + [edited(98, (20, 40, 60), 70)[k] for k in (0, 1)]
    texts += ["LOUD WORDS " * 12, "a b c d e " * 30, "# $ % & " * 10 + "word " * 9, "one\ntwo\none\ntwo\none\nthree four five six seven eight nine ten"]
    texts += ["z" * 420 + f" tail {k} of a text with enough other words in it to pass the rules {k}" for k in range(2)]
    return rows + [(1000 + k, t, r.choice(["a", "b", None])) for k, t in enumerate(texts)]


def table_of(rows):
    return pd.DataFrame({"doc_id": [r[0] for r in rows], "text": pd.Series([r[1] for r in rows], dtype=object), "source": pd.Series([r[2] for r in rows], dtype=object)})


def ledger_of(rows):
    con = duckdb.connect()
    con.register("documents", table_of(rows))
    return dict(con.execute("WITH " + rules.LEDGER_CTES.format(src="documents") + f"SELECT doc_id, failures FROM ({rules.LEDGER_SQL})").fetchall())


def by_rules(rows):
    failed = ledger_of(rows)
    return [x for x in rows if not failed[x[0]] & rules.CURRENT.mask]


def one_of_each_group(rows, n=5, least=80):
    sets = []
    for _, t, _ in rows:
        w = words((t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    of = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= least * len(sets[i] | sets[j]):
                of = [of[j] if g == of[i] else g for g in of]
    low: dict[int, int] = {}
    for (i, _, _), g in zip(rows, of):
        low[g] = min(low.get(g, i), i)
    return [x for x, g in zip(rows, of) if low[g] == x[0]]


def without_repeats(rows, n_words=51, n_bytes=400):
    texts = [(t or "").encode() for _, t, _ in rows]
    found = [[(len(t[: m.start()].encode()), len(t[: m.end()].encode()), m[0]) for m in WORD.finditer(t or "")] for _, t, _ in rows]
    runs = Counter(tuple(w for _, _, w in f[k : k + n_words]) for f in found for k in range(len(f) - n_words + 1))
    strings = Counter(t[k : k + n_bytes] for t in texts for k in range(len(t) - n_bytes + 1))
    out = []
    for x, t, f in zip(rows, texts, found):
        gone = bytearray(len(t))
        spans = [(f[k][0], f[k + n_words - 1][1]) for k in range(len(f) - n_words + 1) if runs[tuple(w for _, _, w in f[k : k + n_words])] > 1]
        spans += [(k, k + n_bytes) for k in range(len(t) - n_bytes + 1) if strings[t[k : k + n_bytes]] > 1]
        for a, b in spans:
            gone[a:b] = b"\1" * (b - a)
        if not spans:
            out.append(x)
            continue
        left, kept = [], bytearray()
        for c, g in zip(t, gone):       # a character that a span cuts in two goes whole
            if g:
                left.append(kept.decode("utf-8", "ignore"))
                kept = bytearray()
            else:
                kept.append(c)
        rest = "".join(left) + kept.decode("utf-8", "ignore")
        if words(rest):
            out.append((x[0], rest, x[2]))
    return out


def mixture(rows):
    con = duckdb.connect()
    con.register("documents", table_of(rows))
    copies = dict(con.execute("WITH " + mixing.MIXED_CTES.format(src="documents") + "SELECT doc_id, copies FROM mixed").fetchall())
    return [x for x in rows for _ in range(copies[x[0]])]


def pieces(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for i, text, _ in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        at, stop, k = 0, len(ids) % packing.CAPACITY or packing.CAPACITY, 0
        while at < len(ids):
            out.append((i, k, at, stop - at, zlib.crc32(ids[at:stop].tobytes())))
            at, stop, k = stop, stop + packing.CAPACITY, k + 1
    return out


def best_fit(sizes):
    gaps: list[int] = []
    for s in sorted(sizes, reverse=True):
        fit = min((g for g in gaps if g >= s), default=None)
        if fit is None:
            gaps.append(packing.CAPACITY - s)
        else:
            gaps[gaps.index(fit)] = fit - s
    return len(gaps)


def test_run_equals_a_plain_model(spark, tmp_path):
    rows = corpus()
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = [by_rules(rows)]
    for step in (one_of_each_group, without_repeats, mixture):
        kept.append(step(kept[-1]))
    sizes = [len(x) for x in [rows, *kept]]
    assert sizes[0] > sizes[1] > sizes[2] and kept[2] != kept[1] and sizes[4] != sizes[3]       # every decision takes effect
    want = pieces(kept[-1])
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(want)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(places) <= best_fit([w[3] for w in want])


def test_ablations_equal_counts(spark):
    rows = corpus()
    failed = ledger_of(rows)
    mask = rules.CURRENT.mask
    want = {
        name: (sum(bool(f & rules.BITS[name]) for f in failed.values()), sum(f & mask == rules.BITS[name] for f in failed.values()))
        for name in rules.CURRENT.rules
    }
    got = rules.ablation(rules.ledger(frame(spark, rows))).collect()
    assert {r.rule: (r.failing, r.rejected_by_it_alone) for r in got} == want and any(b for _, b in want.values())
