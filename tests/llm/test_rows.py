"""Rules, sharding, mixing, packing, extraction and the pipeline."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from marquee.llm import extract, mixing, packing, rules, sharding

from .common import awkward, empty, frame, words

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    rows = [(k, t, s) for k, (_, t, s) in enumerate(awkward(6, 80))] + [(900, "long text  of\n many words   x" * 900, "a"), (901, "日本語" * 50 + " <|endoftext|> b", "a")]
    got = packing.packed(frame(spark, rows), VOCABULARY).collect()
    by, places, total = defaultdict(list), defaultdict(list), 0
    for r in got:
        by[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for i, text, _ in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == packing.CAPACITY)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids) and len(by[i]) == -(-at // packing.CAPACITY)
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(places) <= -(-total // packing.CAPACITY) + 1


def test_sweeps_are_best_fit_decreasing():
    rng = np.random.default_rng(2)
    sizes = [int(s) for s in rng.integers(1, 65, 700)]
    gaps: list[int] = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - s)
        else:
            gaps.append(64 - s)
    used = Counter()
    for size, _, placed, each, first, offset in packing.sweeps(Counter(sizes), 64):
        for k in range(placed):
            assert offset + (k % each) * size == used[first + k // each]
            used[first + k // each] += size
    assert sum(used.values()) == sum(sizes) and max(used.values()) <= 64 and len(used) == len(gaps)


def test_packing_an_empty_table(spark):
    assert packing.packed(empty(spark), VOCABULARY).count() == 0


def test_rules_by_hand(spark):
    text = "a b c d e a b c d e f g h\nx #*\n\nx #*\n"
    book = rules.ledger(frame(spark, [(1, text, "a"), (2, None, "a"), (None, "", None)])).orderBy("doc_id").collect()
    one = next(r for r in book if r.doc_id == 1)
    assert (one.n_words, one.n_symbols, one.n_dup_lines, one.n_repeat_words) == (17, 4, 1, 10)
    assert all(r.n_words == 0 and r.failures & 1 for r in book if r.doc_id != 1)
    assert rules.ledger(empty(spark)).count() == 0


def test_rules_keep_columns_and_clean_rows(spark):
    rows = awkward(7)
    docs = frame(spark, rows)
    kept = rules.passing(docs)
    assert kept.columns == docs.columns
    assert all(len(words(r.text)) >= 10 for r in kept.collect())


def _shards(spark, rows, shards, **limits):
    """The rows of ``by_bytes``, compared with the texts: sizes, checksums, gapless slots, whole groups, level shards."""
    out = sharding.by_bytes(frame(spark, rows), shards, **limits).collect()
    bare = [(r[0], (r[1] or "").encode()) for r in rows]
    facts = Counter((i, len(t) + 16, zlib.crc32(t)) for i, t in bare)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == facts
    slots, loads, groups, where = defaultdict(list), Counter(), Counter(), defaultdict(set)
    for r in out:
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
        groups[r.text_crc32] += r.size
        where[r.text_crc32].add(r.shard)
    assert set(slots) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    share = sum(loads.values()) / shards
    assert all(len(where[g]) == 1 for g, size in groups.items() if size <= share)
    largest = max([r.size for r in out] + [size for size in groups.values() if size <= share])
    assert max(loads.values()) <= share + largest
    return loads, share, where


def test_sharding_laws(spark):
    _shards(spark, [(k, t, s) for k, (_, t, s) in enumerate(awkward(8))], 4)
    assert sharding.by_bytes(empty(spark), 4).count() == 0
    _shards(spark, awkward(9), 3)                   # repeated and null ids
    _shards(spark, awkward(9), 40)                  # shares smaller than a text


@pytest.mark.parametrize("hot", ["", None, "one text that stands on a third of the rows " * 3])
def test_sharding_of_a_hot_text(spark, hot):
    rows = [(i, f"text {i} " + "filler " * (i * 37 % 90), "s") for i in range(1200)]
    rows += [(5000 + i if i % 2 else None, hot, "s") for i in range(600)]
    rows += [(9000 + i, "a pair of long ones " * 60, "s") for i in range(2)]
    loads, share, _ = _shards(spark, rows, 8, ranges=16, full=50)
    assert max(loads.values()) - min(loads.values()) <= share / 20
    # no slice of the order that one task sorts is much above the bound
    keyed = sharding.sized(frame(spark, rows))
    crowded = keyed.groupBy("k1", "text_crc32").count().where("count > 50").collect()
    own = sharding._own_ranges(spark, [(r.k1, r.text_crc32, None, -(-r["count"] // 50)) for r in crowded])
    placed = sharding._placed(keyed, own, sharding.splitters(keyed, 2), 50)
    assert max(r["count"] for r in placed.groupBy("own", "range", "part").count().collect()) < 150


def test_rooms_level_the_shards():
    assert sharding._room([0, 0, 0], 30) == [10, 10, 10]
    assert sharding._room([9, 2, 4], 8) == [0, 5, 3]
    assert sharding._room([50, 0], 10) == [0, 10]


def test_mix_meets_targets(spark):
    rows = awkward(9, 200)
    out = mixing.mixed(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    sums, goal, most = Counter(), {}, Counter()
    for r in out:
        sums[r.source] += r.taken
        goal[r.source] = r.target
        most[r.source] = max(most[r.source], r.size)
        assert r.taken <= 2 * r.size
    assert all(abs(sums[s] - goal[s]) <= most[s] / 2 + 1 for s in goal)
    assert mixing.mixed(empty(spark)).count() == 0


def test_resampled_rows_are_the_mix(spark):
    rows = [(k, t, s) for k, (_, t, s) in enumerate(awkward(10))]
    docs = frame(spark, rows)
    out = mixing.resampled(docs)
    assert out.columns == docs.columns
    want = {r.doc_id: r.copies for r in mixing.mixed(docs).collect() if r.copies}
    assert Counter(r.doc_id for r in out.collect()) == Counter(want)
    assert mixing.resampled(empty(spark)).count() == 0


ARTICLE = "<p>" + "The story goes on and on with many words. " * 4 + "</p>"


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("<html><body></body></html>", ""),
    (f"<nav><a>Menu</a></nav><article><h1>Top &amp; tail</h1>{ARTICLE}</article><footer>end</footer>", "Top & tail\n" + ("The story goes on and on with many words. " * 4).strip()),
    (f"<body><div class='sidebar'>{ARTICLE}</div><div>{ARTICLE}</div><div id=comments>{ARTICLE}</div></body>", ("The story goes on and on with many words. " * 4).strip()),
    ("<article><p>one<p>two <b>bold</b>\n three<br>four<script>var a='</p>';</script></article>", "one\ntwo bold three four"),
    ("<article><p>kept</p><div class='ad'>buy</div><form>mail</form><p>too</p></article>", "kept\ntoo"),
])
def test_main_text(page, want):
    assert extract.main_text(page) == want


STORY = ("The story goes on and on with many words. " * 4).strip()


@pytest.mark.parametrize("page,want", [
    ("<body><p>A short page.</p></body>", "A short page."),
    (f"<body><h1>Top</h1><div class='share'>Post it</div>{ARTICLE}</body>", f"Top\n{STORY}"),
    (f"<body>{ARTICLE}<div class='ad'>Buy</div><p>The end.</p></body>", f"{STORY}\nThe end."),
    (f"<body><h1>Top</h1><div class='ad'>Buy</div><p>Short.</p><div class='ad'>Buy</div>{ARTICLE}</body>", f"Top\nShort.\n{STORY}"),
    (f"<body>{ARTICLE}<div class='ad'>Buy</div><p><a href='/x'>The whole report</a></p><div class='ad'>Buy</div>{ARTICLE}</body>", f"{STORY}\nThe whole report\n{STORY}"),
    (f"<body><div><a href='/'>Home</a> <a href='/x'>News</a></div><div class='ad'>Buy</div>{ARTICLE}</body>", STORY),
    ("<body><nav>Menu</nav><footer>end</footer></body>", ""),
])
def test_main_text_without_an_article_element(page, want):
    assert extract.main_text(page) == want


@pytest.mark.parametrize("attrs", [
    'class="overflow-hidden"', 'style="overflow:hidden"', 'aria-hidden="false"', 'title="display:none"', 'data-hidden="x"', 'class="has-sidebar"', 'class="layout-with-sidebar"',
    'class="entry-header"', 'data-class="sidebar"', 'title=\'class="ad"\'', 'class="post-12 comments-open"',
])
def test_words_in_attributes_that_shut_nothing_out(attrs):
    assert extract.main_text(f"<body><div {attrs}><h1>Top</h1>{ARTICLE}</div></body>") == f"Top\n{STORY}"
    assert extract.main_text(f"<article><div {attrs}><h1>Top</h1></div>{ARTICLE}</article>") == f"Top\n{STORY}"


@pytest.mark.parametrize("attrs", [
    "hidden", 'HIDDEN=""', 'class="x" hidden', 'aria-hidden="true"', "aria-hidden=true", 'style="color:red; display : none"', 'class="ad"', 'class="x sidebar"', 'id="site-footer"', 'class="navBar"',
    'class="site-header"', 'role="complementary"', 'class="ad-slot"', 'class="related-posts"',
])
def test_attributes_that_shut_out(attrs):
    assert extract.main_text(f"<article><p>kept</p><div {attrs}>gone</div><p>too</p></article>") == "kept\ntoo"


@pytest.mark.parametrize("page,want", [
    ("<article class='post has-sidebar'><p>kept</p></article>", "kept"),
    ("<main id='sidebar-main'><p>kept</p></main>", "kept"),
    ("<div class='sidebar-right'><article><p>kept</p></article></div>", "kept"),
    ("<article><p>By the <a href='/hidden-lake'>hidden lake</a> we sat.</p></article>", "By the hidden lake we sat."),
    ("<article><p>kept</p></article><article class='comment'><p>gone</p></article>", "kept"),
])
def test_articles_and_links_that_stay(page, want):
    assert extract.main_text(page) == want


SUBJECTS = "side-by-side social-policy legal-analysis related-work search-results ad-hoc sponsor-story tags-of-war newsletter-archive".split()


@pytest.mark.parametrize("name", SUBJECTS)
def test_names_of_subjects_shut_nothing_out(name):
    assert extract.main_text(f"<article><h1>Top</h1><div class='{name}'><p>The body.</p></div></article>") == "Top\nThe body."
    assert extract.main_text(f"<body><div class='page {name}'><p>The body of it.</p></div></body>") == "The body of it."


@pytest.mark.parametrize("name", ["comment-list", "post-comments", "left-rail", "share-buttons", "site-search", "cookie-banner", "articleFooter"])
def test_parts_of_a_page_stay_out_however_long(name):
    assert extract.main_text(f"<article><p>kept</p><div class='{name}'>{ARTICLE * 5}</div></article>") == "kept"


def test_nesting_takes_linear_time():
    import time

    start = time.perf_counter()
    assert extract.main_text("<div>" * 100_000 + "<p>deep" + "</b>" * 100_000) == "deep"
    assert time.perf_counter() - start < 5      # quadratic work takes minutes


def test_extraction_of_a_table(spark):
    kind = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, "u", f"<article>{ARTICLE * 3000}</article>", "x", 1), (1, "u", "<article><p>é</p></article>", "x", 1), (None, None, None, None, None)]
    got = extract.extracted(spark.createDataFrame(rows, kind)).collect()
    assert sorted(r.n_chars for r in got)[:2] == [0, 1] and len(got) == 3
    assert extract.extracted(spark.createDataFrame([], kind)).count() == 0


def test_pipeline_stages(spark):
    rows = awkward(11, 120)
    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.cut_lineage(stage(spark, docs, ""), f"test-{i}")
        assert out.count() > 0, name
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns, name
            docs = out
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
