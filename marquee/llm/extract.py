"""Main text of HTML pages by line-block distribution.

A page is reduced to lines, one for each block of text, in page order. What the markup
itself marks as no article (menus, headers and footers of the page, side bars, notices,
adverts, forms, scripts, reader comments) leaves a gap of empty lines. Text lengths are
summed over a sliding window of lines; text surges where the sum rises from zero and dives
where it returns to it. Lines in the article element are kept. On a page without one, a
surge is content when less than half of what comes before its dive is link text, and every
line from the first to the last such surge is kept, however short its block; what goes are
blocks of links before and after them. A mark word within a longer name shuts an element out only where
the name reads as a part of a page (site-footer, related-posts), not as a subject (related-work).

Defined results: a null or empty page, or one without such a surge, gives an empty text;
unclosed and stray tags are closed by what encloses them; repeated rows are extracted each;
other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 3
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*>|<[A-Za-z][^>]*>""", re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
UNSEEN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset("nav aside form footer button select dialog menu head svg math object canvas audio video fieldset label".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Words of class, id and role that mark a part of the page as no article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted menu nav navbar navigation breadcrumb "
    "breadcrumbs sidebar side aside rail widget widgets footer header masthead topbar toolbar comment comments respond reply replies disqus discussion "
    "notice notices cookie cookies consent gdpr popup modal overlay alert newsletter subscribe subscription signup login share sharing social related "
    "recommended recommendations pagination pager skip search form complementary contentinfo copyright legal tags".split()
)
#: Marks that at the end of a compound are as often a subject (anti-social, job-search, side-by-side).
SUBJECTS = frozenset("side social legal related search rail skip respond reply alert tags discussion copyright".split())
#: Places of a page; a mark after one of these is a part of the page all the same (left-rail, post-tags).
PLACES = frozenset("site page main top bottom left right primary secondary global mobile entry post article story".split())
#: What a part of the page is called after its mark (share-buttons, related-posts); other words make a compound a subject.
PARTS = frozenset(
    "area areas bar bars block blocks box boxes button buttons container content form frame group holder icon icons inner item items label link links "
    "list lists module outer panel panels placeholder posts slot slots stories articles title top bottom left right unit units wrap wrapper zone".split()
)
#: In a compound with one of these a mark word tells of a state or layout (has-sidebar, comments-open).
STATES = frozenset("has have with without no not layout open closed enabled disabled".split())
#: A header of one of these is a headline's (entry-header), not the page's.
HEADED = frozenset("entry post article story content page section headline title".split())
PARAGRAPHS = frozenset("p li dt dd tr td th".split())


NO, LIKELY, SURELY = range(3)


def _compound(words: list[str]) -> bool:
    """Whether the words of a name make it a part of the page that is no article."""
    marks = MARKS - (frozenset(["header"]) if HEADED & set(words) else frozenset())
    if words[-1] in marks and (words[-1] not in SUBJECTS or (len(words) == 2 and words[0] in PLACES)):
        return True
    held = [w in marks for w in words]
    if True not in held:
        return False
    rest = words[held.index(True) + 1 :]
    return bool(rest) and all(w in PARTS or w in marks for w in rest)


def _marked(tag: str, attrs: str) -> int:
    """Whether attributes hide an element or mark it as no article: surely, or likely, by a compound name.

    On article and main a name of class, id or role marks as a whole only, not by a word in it.
    """
    if not attrs:
        return NO
    given: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attrs):
        given.setdefault(m[1].lower(), html.unescape((m[2] or "").strip("\"'")))
    if "hidden" in given or given.get("aria-hidden", "").strip().lower() == "true" or UNSEEN.search(given.get("style", "")):
        return SURELY
    found = NO
    for name in " ".join(given.get(k, "") for k in ("class", "id", "role")).split():
        if name.lower() in MARKS:
            return SURELY
        if tag in ("article", "main"):
            continue
        words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
        if words and not set(words) & STATES and _compound(words):
            found = LIKELY
    return found


def lines(page: str, least: int = LIKELY) -> tuple[list[tuple[str, int, bool]], int]:
    """The lines of a page: text, characters of link text, whether in an article. Gaps are empty lines.

    Elements marked ``least`` or more are shut out. The number is of characters that only likely marks shut out.
    """
    out: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []    # open elements; whether each shuts its content out, and by a likely mark alone
    opened: Counter[str] = Counter()            # how many of each are open
    shut = likely = lost = linked = articles = 0
    seen_article = in_link = False

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append((text, min(linked, len(text)), articles > 0))
        linked = 0

    def pop() -> None:
        nonlocal shut, likely, articles
        tag, out_of, perhaps = stack.pop()
        opened[tag] -= 1
        shut -= out_of
        likely -= perhaps
        articles -= tag in ("article", "main") and not out_of
        if out_of and not shut:
            out.extend([("", 0, False)] * WINDOW)

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text and not shut:
            parts.append(text)
            linked += len(text) * in_link
        elif text and shut == likely:
            lost += len(text.strip())
        if not m:
            break
        at, tag = m.end(), (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            if tag == "a":
                in_link = False
            if tag in BLOCK and not shut:
                flush()
            if opened[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in RAW:
            if not m["attrs"].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
                at = end.start() if end else len(page)
            continue
        if tag == "br":
            parts.append(" ")
        if tag == "a":
            in_link = True
        if tag in BLOCK and not shut:
            flush()
        if tag in PARAGRAPHS and stack and stack[-1][0] == tag:
            pop()
        if tag in VOID or m["attrs"].endswith("/"):
            continue
        how = _marked(tag, m["attrs"])
        marked = how >= least
        if tag in ("article", "main", "body") and not marked and not seen_article:
            # an advert or menu left open does not swallow the article
            while shut:
                pop()
        page_header = tag == "header" and not articles
        out_of = tag not in ("html", "body") and (tag in OUTSIDE or page_header or marked)
        perhaps = out_of and how == LIKELY and not (tag in OUTSIDE or page_header)
        stack.append((tag, out_of, perhaps))
        opened[tag] += 1
        if out_of and not shut:
            out.extend([("", 0, False)] * WINDOW)
        shut += out_of
        likely += perhaps
        if tag in ("article", "main") and not out_of:
            articles += 1
            seen_article = True
    if not shut:
        flush()
    return out, lost


def main_text(page: str | None) -> str:
    """The lines between surge and dive points, joined by line feeds."""
    rows, lost = lines(page or "")
    if lost and not any(t for t, _, _ in rows):
        # likely marks shut everything out, so they were names of subjects
        rows, _ = lines(page or "", SURELY)
    article = any(a for _, _, a in rows)
    if article:
        # outside the article element nothing is text of the article
        rows = [r if r[2] else ("", 0, False) for r in rows]
        return "\n".join(t for t, _, _ in rows if t)
    sizes = [len(t) for t, _, _ in rows]
    window = [sum(sizes[max(0, i - WINDOW + 1) : i + 1]) for i in range(len(rows))]
    first = last = i = 0        # the first surge of content and the last dive
    while i < len(rows):
        if not sizes[i]:
            i += 1
            continue
        end = i
        while end < len(rows) and window[end]:
            end += 1
        if 2 * sum(r[1] for r in rows[i:end]) < sum(sizes[i:end]):
            first, last = first if last else i, end
        i = end
    return "\n".join(t for t, _, _ in rows[first:last] if t)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points), one row per row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
