"""Main text of web pages by a maximum-scoring subsequence.

A page becomes a sequence of words and tags. Words score positive, tags negative; what a word scores depends
on where it stands, and the weights are log odds learned from labelled pages. One linear scan finds the
contiguous region with the highest sum, whose blocks are the main text, less what stands in it in menus,
adverts, notices, forms, scripts or comments.

Elements that only their class or id marks as no article are marked with reserve: what holds the page's
content, or without which nothing is left, is a wrapper whatever its name says.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinia.llm.common import wide_rows

# Fixed values of HTML: elements without text, without an end, and those that part blocks.
SILENT = {"script", "style", "noscript", "template", "textarea", "select", "option", "button", "svg", "math", "iframe", "object", "canvas", "audio", "video", "head", "title", "map", "datalist"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
ASIDE, MAIN = {"nav", "footer", "aside", "menu", "dialog"}, {"main", "article"}
#: Elements whose end tag may be left out: the open ones that a start tag closes, and those within which it does.
_ROW, _CELL = {"tr", "td", "th"}, {"td", "th"}
_HOLDS = BLOCK - {"address", "div", "p", "li", "dt", "dd"}
IMPLIED = {
    "li": ({"li"}, _HOLDS), "dt": ({"dt", "dd"}, _HOLDS), "dd": ({"dt", "dd"}, _HOLDS), "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": (_CELL, {"tr", "table"}), "th": (_CELL, {"tr", "table"}), "tr": (_ROW, {"table"}), "tbody": ({*_ROW, "thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({*_ROW, "thead", "tbody", "tfoot"}, {"table"}),
}
#: Start tags that close an open paragraph, and the elements that one stays open around.
ENDS_P = BLOCK - {"body", "html", "caption", "legend", "tbody", "td", "tfoot", "th", "thead", "tr"}
AROUND_P = {"button", "caption", "html", "marquee", "object", "table", "td", "template", "th"}
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alertdialog", "alert", "toolbar"}
#: Words in class or id names that mark what is no article: comments of readers, other content, and places
#: in a layout, whose names wrappers of whole pages bear as well.
READER_NAMES = re.compile(r"comments?|commentlist|replies|reply|respond|disqus")
OTHER_NAMES = re.compile(
    r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alerts?|popups?|modal|overlay|newsletter|subscri\w*|signup|login|"
    r"breadcrumbs?|pagination|pager|share|sharing|social\w*|related|recommend\w*|teasers?|tags?|taglist|metas?|byline|toc|skip\w*"
)
LAYOUT_NAMES = re.compile(r"banner\w*|sidebar\w*|side|widgets?|menus?|nav\w*|toolbar|footer|foot|masthead|topbar|header|print|hidden")
CONTENT_NAMES = re.compile(r"article|post|entry|content|story|main|body|text")
#: Beside a word of content, these still mark an aside.
STRONG_NAMES = re.compile(r".*(?:comment|sidebar|nav|foot|related|share).*|ads?")
#: First and last words of names that tell of a state or a neighbour, not of the element itself.
STATE_FIRST = {"has", "is", "no", "not", "with", "without", "show", "hide", "js", "can", "in"}
STATE_LAST = {"open", "opened", "closed", "active", "inactive", "enabled", "disabled", "visible", "on", "off", "wrapper", "layout"}
RESERVED = {"reader", "aside", "layout"}
#: Plain words a page needs outside of an element for the element's mark to stand without question.
ENOUGH_WORDS = 12

_OPEN = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|/?[A-Za-z])")
_COMMENT_END, _CDATA_END = re.compile(r"--!?>"), re.compile(r"\]\]>")
# Quotes only count behind an equals sign; nothing is tried twice, so that broken tags cost no more than others.
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.IGNORECASE | re.ASCII) for tag in RAW}
_ATTR = re.compile(r"([^\s\"'/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_READ = {"class", "id", "role", "hidden", "aria-hidden", "style"}


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", tag, attributes) and ("close", tag, "") in page order, in linear time."""
    at, n, tag_of = 0, len(page), _TAG
    end = page.rfind(">")
    while at < n:
        m = _OPEN.search(page, at)
        if m is None or m.start() > end:  # no tag ends behind here
            comment = m is not None and (m[1] or m[2])
            text = page[at : m.start()] if comment else page[at:]  # what follows is a comment without an end
            if text:
                yield "text", text, ""
            return
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        if m[1] or m[2]:
            ends = (_COMMENT_END if m[1] else _CDATA_END).search(page, m.end())
            at = ends.end() if ends else n
            continue
        if m[3]:
            at = page.index(">", m.start()) + 1
            continue
        t = tag_of.match(page, m.start())
        if t is None:  # a quote hides the end of this tag: from here on, tags end at the next mark
            tag_of = _PLAIN_TAG
            t = tag_of.match(page, m.start())
        at = t.end()
        tag = t[2].lower()
        if t[1]:
            yield "close", tag, ""
            continue
        yield "open", tag, t[3]
        if tag in RAW and not t[3].endswith("/"):
            ends = _RAW_END[tag].search(page, at)
            at = ends.start() if ends else n


@lru_cache(4096)
def _named(names: str) -> str:
    """What the names of class and id make of an element: reader, aside, layout, main or plain."""
    found = set()
    for name in names.split():
        words = [w.lower() for w in re.findall(r"[A-Z]?[^\W\dA-Z_]+|[A-Z]+(?![a-z])|\d+", name)]
        if len(words) > 1 and (words[0] in STATE_FIRST or words[-1] in STATE_LAST):
            continue
        for w in words:
            for kind, pattern in (("reader", READER_NAMES), ("aside", OTHER_NAMES), ("layout", LAYOUT_NAMES), ("main", CONTENT_NAMES), ("strong", STRONG_NAMES)):
                if pattern.fullmatch(w):
                    found.add(kind)
    if "main" in found and "strong" not in found:
        return "main"
    return next((k for k in ("reader", "aside", "layout", "main") if k in found), "plain")


def _kind(tag: str, attributes: str, inside: bool) -> str:
    """What an element is by itself: silent, frame (never content), main or plain; or, marked with reserve,
    reader, aside or layout."""
    if tag in SILENT:
        return "silent"
    found: dict[str, str] = {}
    for m in _ATTR.finditer(attributes):
        if (name := m[1].lower()) in _READ:  # the first of a name counts
            found.setdefault(name, m[2] or m[3] or m[4] or "")
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return "silent"
    role = found.get("role", "").lower()
    if tag in ASIDE or tag == "header" and not inside or role in ASIDE_ROLES:
        return "frame"
    if tag == "form":
        return "layout"
    names = f"{found.get('class', '')} {found.get('id', '')}"
    kind = "plain" if names.isspace() else _named(names)
    if tag in ("html", "body", "main") and kind != "main":
        kind = "plain"
    return "main" if kind == "plain" and (tag in MAIN or role in ("main", "article")) else kind


class _Marks:
    """Elements marked with reserve, by number: the mark around them, their plain words outside of marks
    within, and whether they hold a heading of the page or an element of content outside of marks within."""

    def __init__(self):
        self.kind, self.around, self.words, self.holds = ["plain"], [0], [0], [False]

    def add(self, kind: str, around: int) -> int:
        self.kind.append(kind)
        self.around.append(around)
        self.words.append(0)
        self.holds.append(False)
        return len(self.kind) - 1

    def standing(self) -> list[bool]:
        """Whether a mark stands, by number, or one around it does. The outermost are judged first. A mark is
        void if its element holds content and half of the page's plain words at least, those of readers set
        apart; or, for names of a layout, if the rest of the page has hardly any words."""
        n = len(self.kind)
        inner, holds = list(self.words), list(self.holds)
        for k in range(n - 1, 0, -1):  # what lies within other marks of a layout counts for the one around
            if self.kind[k] == "layout":
                inner[self.around[k]] += inner[k]
                holds[self.around[k]] |= holds[k]
        total = inner[0] + sum(inner[k] for k in range(1, n) if self.kind[k] == "aside")
        void = [True] + [False] * (n - 1)
        out = [False] * n
        for k in range(1, n):
            up = self.around[k]
            if not void[up]:
                out[k] = True
                continue
            if self.kind[k] == "reader":
                void[k] = holds[k] and total < ENOUGH_WORDS
            else:
                void[k] = holds[k] and 2 * inner[k] >= total or self.kind[k] == "layout" and inner[k] >= 2 * ENOUGH_WORDS and total - inner[k] < ENOUGH_WORDS
            out[k] = not void[k]
        return out


def _first_after(places: list[int], bound: int) -> int | None:
    """The first of ascending places beyond bound."""
    k = bisect_right(places, bound)
    return places[k] if k < len(places) else None


def blocks(page: str) -> list[tuple[str, dict[str, int]]]:
    """Blocks of a page in order: their text, with white space turned to single spaces and without words of
    elements of the aside kind, and counts of features: words by where they stand (main, plain, link, aside) and tags (block, inline, link); ``-in``
    marks those in an element that is named as the main one."""
    raw: list[tuple[list[tuple[str, int]], dict[tuple[str, int], int]]] = []
    stack: list[tuple[str, str, bool]] = []
    opened: dict[str, list[int]] = {}  # places in the stack, by tag
    depth = {"silent": 0, "frame": 0}
    mains = links = 0
    marks, mark = _Marks(), 0
    parts: list[tuple[str, int]] = []
    counts: dict[tuple[str, int], int] = {}

    def flush() -> None:
        nonlocal parts, counts
        if parts or counts:
            raw.append((parts, counts))
        parts, counts = [], {}

    def put(kind: str, at: int = 0, n: int = 1) -> None:
        counts[kind, at] = counts.get((kind, at), 0) + n

    def last(tags: Iterable[str]) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=-1)

    def cut(size: int) -> None:
        nonlocal mark, mains, links
        while len(stack) > size:
            tag, kind, main = stack.pop()
            opened[tag].pop()
            if kind in depth:
                depth[kind] -= 1
            elif kind in RESERVED:
                mark = marks.around[mark]
            mains -= main
            links -= tag == "a"

    def imply(tag: str) -> None:
        """Close what the start tag leaves no room for: the outermost of these inside what holds them."""
        if opened.get("p") and tag in ENDS_P:
            at = opened["p"][-1]
            if at == len(stack) - 1 or at > last(AROUND_P):
                cut(at)
        if tag in IMPLIED:
            closed, around = IMPLIED[tag]
            bound = last(around)
            inner = [at for t in closed if opened.get(t) for at in (_first_after(opened[t], bound),) if at is not None]
            if inner:
                cut(min(inner))

    for what, value, attributes in tokens(page):
        if what == "text":
            if not depth["silent"]:
                if not depth["frame"]:
                    parts.append((value, mark))
                elif value[0].isspace() or value[-1].isspace():
                    parts.append((" ", mark))
                if n := len(value.split()):
                    if not depth["frame"] and not links:
                        marks.words[mark] += n
                    put(("aside" if depth["frame"] else "link" if links else "plain") + "-in" * (mains > 0), mark, n)
            continue
        block = value in BLOCK
        if block:
            flush()
        elif value == "br":
            parts.append((" ", 0))
        if what == "open":
            imply(value)
        put(("t-block" if block else "t-link" if value == "a" else "t-inline") + "-in" * (mains > 0))
        if value in VOID:
            continue
        if what == "open":
            if attributes.endswith("/") and value in ("svg", "path"):
                continue
            kind = _kind(value, attributes, mains > 0)
            main = kind == "main" or value in MAIN
            opened.setdefault(value, []).append(len(stack))
            stack.append((value, kind, main))
            if kind in depth:
                depth[kind] += 1
            elif kind in RESERVED:
                mark = marks.add(kind, mark)
            if (main or value == "h1") and not depth["silent"] and not depth["frame"]:
                marks.holds[mark] = True
            mains += main
            links += value == "a"
        elif opened.get(value):
            cut(opened[value][-1])
    flush()
    stands, out = marks.standing(), []
    for parts, counts in raw:
        words = "".join(" " * (x[0].isspace() or x[-1].isspace()) if stands[at] else x for x, at in parts)
        text = " ".join(html.unescape(words).split())
        found: dict[str, int] = {}
        for (kind, at), n in counts.items():
            if stands[at] and not kind.startswith("t-"):
                kind = "aside-in" if kind.endswith("-in") else "aside"
            found[kind] = found.get(kind, 0) + n
        if text or found:
            out.append((text, found))
    return out


def _labelled() -> list[tuple[str, set[str]]]:
    """Small labelled pages: their source and the texts of their main blocks."""
    line = "a longer line of the article with some words and a full stop at its end."
    nav = "<nav><ul>" + "".join(f'<li><a href="/{k}">topic {k}</a></li>' for k in range(6)) + "</ul></nav>"
    menu = '<div class="menu">' + "".join(f'<a href="/{k}">section {k}</a> | ' for k in range(8)) + "</div>"
    foot = "<footer>&copy; some site &middot; all rights reserved</footer>"
    comments = '<div class="comments"><h3>Comments</h3><p>I liked this one a lot.</p><p>So did I.</p></div>'
    pages = []
    for n in (1, 2, 4, 8, 16):
        body = [f"{k} {line}" for k in range(n)]
        paragraphs = "".join(f"<p>{x}</p>" for x in body)
        pages.append((f'<html><body>{nav}<div class="ad">buy this now</div><article><h1>The title</h1>{paragraphs}</article>{foot}</body></html>', {"The title", *body}))
        pages.append((f'<html><body>{menu}<div id="c"><h2>The title</h2>{paragraphs}</div>{comments}{foot}</body></html>', {"The title", *body}))
        pages.append((f'<html><body><header>Site name</header><main><h1>The title</h1>{paragraphs}</main><aside><p>Read more</p><ul><li><a href="#">next</a></li></ul></aside></body></html>', {"The title", *body}))
        items = [f"{k} short item" for k in range(4 * n)]
        listed = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        brief = [f"{k} brief." for k in range(4 * n)]
        for own, texts in ((listed, items), ("".join(f"<div><p>{x}</p></div>" for x in brief), brief)):
            pages.append((f'<html><body>{nav}<div id="c"><h2>The title</h2>{own}{paragraphs}{own}</div>{foot}</body></html>', {"The title", *body, *texts}))
        inner = '<div class="advert">Buy this</div><form><label>Mail</label><input></form><aside>See also</aside>'
        pages.append((f'<html><body>{nav}<article><h1>The title</h1>{paragraphs}{inner}<p>Last words.</p></article>{comments}{foot}</body></html>', {"The title", *body, "Last words."}))
        pages.append((f'<html><body>{menu}<div class="post"><h2>The title</h2>{paragraphs}{inner}<p>Last <a href="#">words</a>.</p></div>{comments}{foot}</body></html>', {"The title", *body, "Last words."}))
        pages.append((f'<table><tr><td><a href="/">home</a></td><td><a href="/b">news</a></td></tr><tr><td>{body[0]}<br>{" ".join(body[1:])}</td></tr></table>', {" ".join(body)}))
    return pages


def learn(labelled: Iterable[tuple[str, set[str]]]) -> dict[str, float]:
    """Weights from labelled pages: their source and the texts of their main blocks. A weight is the log odds of a feature
    between the first and the last main block against elsewhere, with one added to each count; words of text
    are kept above zero and tags below, as the method asks. Pages without a main block are all elsewhere."""
    inside: dict[str, int] = {}
    outside: dict[str, int] = {}
    for page, main in labelled:
        found = blocks(page)
        places = [k for k, (text, _) in enumerate(found) if text in main]
        for at, (_, counts) in enumerate(found):
            into = inside if places and places[0] <= at <= places[-1] else outside
            for k, n in counts.items():
                into[k] = into.get(k, 0) + n
    kinds = [k + i for k in ("plain", "link", "aside", "t-block", "t-inline", "t-link") for i in ("", "-in")]
    a, b = (sum(x.values()) + len(kinds) for x in (inside, outside))
    odds = {k: math.log((inside.get(k, 0) + 1) / a) - math.log((outside.get(k, 0) + 1) / b) for k in kinds}
    for k in kinds:
        if k.startswith("t-"):
            odds[k] = min(odds[k], -0.1)
        elif k.startswith("plain"):
            odds[k] = max(odds[k], 0.1)
    return odds


@cache
def learned_weights() -> dict[str, float]:
    """Weights of the small labelled pages that come with this module."""
    return learn(_labelled())


def weights_of(labelled: DataFrame, sample: int = 2000) -> dict[str, float]:
    """Weights from a table of labelled pages (html, text: the main blocks, one a line), of which at most
    ``sample``, those of the smallest hashes, are taken. Rows with a null are left out; without rows the
    weights are those of ``learned_weights``."""
    rows = labelled.select(F.col("html").cast("string").alias("html"), F.col("text").cast("string").alias("text")).dropna().distinct()
    rows = rows.orderBy(F.xxhash64("html"), "html", "text").limit(sample).collect()
    return learn((r[0], set(r[1].split("\n"))) for r in rows) if rows else learned_weights()


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the highest sum; the longest of equal ones; empty if none
    is above zero."""
    best, at, total, start = (0.0, 0, 0), 0, 0.0, 0
    for at, x in enumerate(scores):
        if total < 0:
            total, start = 0.0, at
        total += x
        if total > 0 and (total, at + 1 - start) > (best[0], best[2] - best[1]):
            best = total, start, at + 1
    return best[1], best[2]


def main_text(page: str | None, weights: dict[str, float] | None = None) -> str:
    """The main text of a whole page; empty for a null, empty or text-free one."""
    if not page:
        return ""
    weights = weights or learned_weights()
    found = blocks(page)
    start, end = best_region([sum(weights[k] * n for k, n in counts.items()) for _, counts in found])
    return "\n".join(text for text, _ in found[start:end] if text)


def extract(pages: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of each page.

    pages: page_id, url, html; labelled: see ``weights_of``. text holds the blocks of the main region in page order, one a line, with
    character references decoded and white space inside a block as single spaces; n_chars counts its code
    points. Null and empty pages, and those without words outside menus and the like, have an empty text.
    Broken pages are read as browsers do: end tags may be missing at any depth, quotes only count behind an
    equals sign, what no mark ends is text; the time is linear in the length of a page. Repeated rows are
    extracted each; an empty table gives no rows; other columns are ignored.
    """
    weights = learned_weights() if labelled is None else weights_of(labelled)

    def rows(it) -> Iterator:
        import pyarrow as pa

        for batch in it:
            texts = [main_text(x.as_py(), weights) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    chosen = wide_rows(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return chosen.mapInArrow(rows, "page_id long, url string, text string, n_chars long")
