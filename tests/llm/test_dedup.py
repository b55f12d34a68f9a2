"""The n-gram Jaccard join and the suffix-array dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from marquee.llm import jaccard, suffixes
from marquee.llm.hashing import Prefixes

from .common import awkward, collected, empty, frame, words


def shingles(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = words(low)
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def groups(rows):
    sets = [shingles(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    return sets, [root(i) for i in range(len(rows))]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = awkward(seed)
    sets, of = groups(rows)
    low = {}
    for (i, _, _), g in zip(rows, of):
        low[g] = min([x for x in (low.get(g), i) if x is not None], default=None)
    want = sorted(((i, len(s), low[g]) for (i, _, _), s, g in zip(rows, sets, of)), key=lambda r: tuple((x is None, x) for x in r))
    assert collected(jaccard.linked(frame(spark, rows)), "doc_id", "n_shingles", "component_id") == want


def test_representatives_are_one_row_per_group(spark):
    rows = awkward(3)
    sets, of = groups(rows)
    docs = frame(spark, rows)
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    best = {}
    for (i, t, _), g, s in zip(rows, of, sets):
        if s:
            best[g] = min(best.get(g, (True, 0)), (i is None, i or 0))
    assert sorted((i is None, i or 0) for i, t in got if shingles(t)) == sorted(best.values())
    assert sum(not shingles(t) for _, t in got) == sum(not s for s in sets)


def test_chain_of_links_is_one_component(spark):
    words_ = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words_[4 * i : 4 * i + 120]), "a") for i in range(60)]
    assert {r.component_id for r in jaccard.linked(frame(spark, rows)).collect()} == {0}


def test_jaccard_of_an_empty_table(spark):
    assert jaccard.linked(empty(spark)).count() == 0
    assert jaccard.representatives(empty(spark)).count() == 0


def removed(rows):
    texts = [(t or "").encode() for _, t, _ in rows]
    size = suffixes.LENGTH
    count = Counter(t[p : p + size] for t in texts for p in range(len(t) - size + 1))
    out = []
    for (i, _, _), t in zip(rows, texts):
        mask = bytearray(len(t))
        for p in range(len(t) - size + 1):
            if count[t[p : p + size]] > 1:
                mask[p : p + size] = b"\1" * size
        rest = bytes(c for c, m in zip(t, mask) if not m)
        spans = sum(1 for k, m in enumerate(mask) if m and not (k and mask[k - 1]))
        out.append((i, len(t), sum(mask), spans, hashlib.sha256(rest).hexdigest(), rest))
    return out


@pytest.mark.parametrize("seed,hot", [(1, suffixes.HOT), (2, 1)])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    rows = awkward(seed)
    want = sorted((r[:5] for r in removed(rows)), key=lambda r: tuple((x is None, x) for x in r))
    assert any(0 < r[2] < r[1] for r in want)
    found = suffixes.digest(suffixes.repeats(frame(spark, rows)))
    assert collected(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_cleaned_texts_hold_what_is_left(spark):
    rows = awkward(4)
    docs = frame(spark, rows)
    out = suffixes.cleaned(docs)
    assert out.columns == docs.columns
    want = [(i, rest.decode("utf-8", "ignore")) for i, n, cut, _, _, rest in removed(rows) if not cut or words(rest.decode("utf-8", "ignore"))]
    got = out.collect()
    assert Counter((r.doc_id, r.text or "") for r in got) == Counter(want)
    assert all(r.n_chars == len(r.text) for r in got if r.text is not None)


def test_suffix_dedup_of_an_empty_table(spark):
    assert suffixes.repeats(empty(spark)).count() == 0
    assert suffixes.cleaned(empty(spark)).count() == 0


def test_mergesort_orders_suffixes():
    r = random.Random(5)
    raw = np.frombuffer(bytes(r.choice(b"ab") for _ in range(3000)) + b"ab" * 400, np.uint8)
    at = np.array(r.sample(range(len(raw) - suffixes.LENGTH), 300))
    group = np.sort(np.array([r.randrange(4) for _ in at]))
    got = suffixes.merge_sorted(raw, Prefixes(raw), at.copy(), group)
    text = raw.tobytes()
    for g in range(4):
        keys = [text[p : p + suffixes.LENGTH] for p in got[group == g]]
        assert keys == sorted(keys)
        assert sorted(got[group == g]) == sorted(at[group == g])


def test_stretches_of_a_text_longer_than_a_chunk(monkeypatch):
    r = random.Random(6)
    text = bytes(r.choice(b"abcd ") for _ in range(5000))
    whole = suffixes.stretches([text])[0]
    monkeypatch.setattr(suffixes, "CHUNK", 700)
    parts = suffixes.stretches([b"short", text, text[:450]])
    for gram, _, start, n, off in (whole, parts[1]):
        covered = np.concatenate([np.arange(s, s + k) for s, k in zip(start, n)])
        assert (covered == np.arange(len(text) - suffixes.LENGTH + 1)).all()
    anchors = [dict(zip(np.concatenate([np.arange(s, s + k) for s, k in zip(p[2], p[3])]), np.repeat(p[2] + p[4], p[3]))) for p in (whole, parts[1])]
    assert anchors[0] == anchors[1]
    assert len(parts[0][0]) == 0


def unworded(rows, size=51):
    """Texts without the words under a run of ``size`` words that occurs twice in any text."""
    texts = [t or "" for _, t, _ in rows]
    found = [list(re.finditer(r"[^\x20\x09-\x0D]+", t)) for t in texts]
    runs = [[tuple(w[0] for w in ws[k : k + size]) for k in range(len(ws) - size + 1)] for ws in found]
    count = Counter(run for each in runs for run in each)
    out = []
    for t, ws, each in zip(texts, found, runs):
        gone = bytearray(len(t))
        for k, run in enumerate(each):
            if count[run] > 1:
                a, b = ws[k].start(), ws[k + size - 1].end()
                gone[a:b] = b"\1" * (b - a)
        out.append((bytes(gone), "".join(c for c, g in zip(t, gone) if not g)))
    return out


@pytest.mark.parametrize("seed,hot", [(1, suffixes.HOT), (2, 1)])
def test_repeats_of_words_equal_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    rows = awkward(seed)
    out = suffixes.cleaned(frame(spark, rows), (suffixes.WORDS,))
    want = Counter((i, rest) for (i, _, _), (gone, rest) in zip(rows, unworded(rows)) if not any(gone) or words(rest))
    assert Counter((r.doc_id, r.text or "") for r in out.collect()) == want


def planted(n_words, seed=12):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    passage = " ".join(word() for _ in range(n_words))
    return passage, [(i, " ".join(word() for _ in range(60)) + "\n" + passage + "\n" + " ".join(word() for _ in range(70)), "a") for i in (1, 2)]


@pytest.mark.parametrize("n_words,stays", [(55, False), (51, False), (50, True)])
def test_pipeline_cuts_passages_of_over_50_words(spark, n_words, stays):
    passage, rows = planted(n_words)
    assert len(passage) < suffixes.LENGTH
    out = corpus_pipeline.repeated_passages(spark, frame(spark, rows), "").collect()
    assert len(out) == 2 and all((passage in r.text) == stays for r in out)
    if not stays:
        assert {r.text for r in out} == {t.replace(passage, "") for _, t, _ in rows}


def test_pipeline_cuts_long_strings_of_few_words(spark):
    r = random.Random(13)
    text = lambda k: "".join(r.choice("abcdefghij") for _ in range(k))
    passage = text(450)
    rows = [(i, f"{text(30)} {passage} {text(40)}", "a") for i in (1, 2)]
    out = corpus_pipeline.repeated_passages(spark, frame(spark, rows), "").collect()
    assert len(out) == 2 and not any(passage in r.text for r in out)


def edited(n_words, at, seed=14):
    r = random.Random(seed)
    text = [f"{r.choice('abcdef')}{i}" for i in range(n_words)]
    return " ".join(text), " ".join("edited" + str(i) if i in at else w for i, w in enumerate(text))


def similarity(x, y, n):
    x, y = (frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for w in (words(x), words(y)))
    return len(x & y) / len(x | y)


def test_pipeline_drops_near_copies_at_5_words_and_80(spark):
    x, y = edited(98, (30, 60))
    far, apart = edited(98, (20, 40, 60), 15)
    assert similarity(x, y, 5) >= 0.8 and similarity(x, y, 4) < 0.85 and similarity(far, apart, 5) < 0.8
    out = corpus_pipeline.near_duplicates(spark, frame(spark, [(1, x, "a"), (2, y, "a"), (3, far, "a"), (4, apart, "a")]), "")
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4]


@pytest.mark.parametrize("n,least", [(5, 80), (3, 60)])
def test_components_at_other_bounds_equal_brute_force(spark, n, least):
    rows = awkward(3) + [(200 + k, text, "a") for k in range(12) for text in edited(40 + 5 * k, (15, 30), 20 + k)]
    rows += [(300 + k, " ".join("pqrstuvwxyz"[: n + k]), "a") for k in range(6)]
    sets = [frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []) for w in (words((t or "").translate({i: i + 32 for i in range(65, 91)})) for _, t, _ in rows)]
    of = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= least * len(sets[i] | sets[j]):
                of = [of[j] if g == of[i] else g for g in of]
    low = {}
    for (i, _, _), g in zip(rows, of):
        low[g] = min([x for x in (low.get(g), i) if x is not None], default=None)
    want = sorted(((i, len(s), low[g]) for (i, _, _), s, g in zip(rows, sets, of)), key=lambda r: tuple((x is None, x) for x in r))
    assert collected(jaccard.linked(frame(spark, rows), n, least), "doc_id", "n_shingles", "component_id") == want


def multiplied(monkeypatch):
    """The pairs whose sets are multiplied from now on."""
    seen, products = [], jaccard.products

    def noted(docs, pairs, *rest):
        seen.extend(map(tuple, pairs.collect()))
        return products(docs, pairs, *rest)

    monkeypatch.setattr(jaccard, "products", noted)
    return seen


def lows(rows):
    _, of = groups(rows)
    low = {}
    for (i, _, _), g in zip(rows, of):
        low[g] = min(low.get(g, i), i)
    return {i: low[g] for (i, _, _), g in zip(rows, of)}


def test_a_family_of_near_copies_meets_its_hubs_only(spark, monkeypatch):
    r = random.Random(31)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(120):
        at = {r.randrange(300) for _ in range(r.randint(1, 6))}
        rows.append((i, " ".join(f"e{i}x{k}" if k in at else w for k, w in enumerate(base)), "a"))
    seen = multiplied(monkeypatch)
    got = {x.doc_id: x.component_id for x in jaccard.linked(frame(spark, rows)).collect()}
    assert got == lows(rows)
    assert len(seen) == len(set(seen)) < 120 * 119 // 2 / 4


def test_sketches_tell_long_sets_apart(spark, monkeypatch):
    r = random.Random(32)
    pool = [" ".join(f"p{k}w{r.randrange(10 ** 6)}" for _ in range(100)) for k in range(60)]
    rows = [(i, " ".join(r.sample(pool, 30)), "a") for i in range(24)]
    words_ = rows[0][1].split()
    words_[1500] = "edited"
    rows.append((24, " ".join(words_), "a"))
    seen = multiplied(monkeypatch)
    got = {x.doc_id: x.component_id for x in jaccard.linked(frame(spark, rows)).collect()}
    assert got == lows(rows) == {i: i % 24 for i in range(25)}
    assert len(seen) == 1
