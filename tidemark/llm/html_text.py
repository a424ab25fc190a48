"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into blocks at block-level tags; br and inline tags do not cut.  Each block has its words, the share of
them inside links, the same of the block before and after it, whether it is a heading, and where it stands: in or under
an element that holds page furniture (nav, footer, aside, form, advert, notice, comments ..., by tag, role, class or id),
in article or main, and whether the page has such an element.  A CART tree, trained on the small labelled table below
when the module is loaded, keeps a block or not.

Edge cases: null, empty or text-free html gives an empty text; unclosed, misplaced and unknown tags, tags cut off at
the end and unclosed comments are taken as browsers do, roughly; a page of any length is read whole, in linear time;
repeated rows, null ids and other columns pass through or are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, tidy

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)", re.S)
_PLAIN, _STOP = re.compile(r"[^>\"']*+(?:>|\Z)"), re.compile(r"[>\"']")
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "select", "button", "object", "math", "audio", "video", "canvas", "datalist", "xmp", "noembed", "noframes"}
_BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_FURNITURE_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "search", "fieldset"}
_FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|adverts?|advertis\w+|banners?|promos?|promoted|sponsor\w*|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|overlay|newsletters?|subscribe|subscription|signup|sidebars?|side|rail|menus?|nav|navbar|navigation|breadcrumbs?|footers?|masthead|topbar|toolbar|comments?|commentlist|disqus|respond|repl(?:y|ies)|related|recommended|share|sharing|social|widgets?|pagination|pager|login|search|copyright|legal|disclaimer|skip|tags|byline-links)(?:$|[\s_-])",
    re.I,
)
_HEAD = re.compile(r"(?:^|[\s_-])(?:headers?|site-header|page-header|top)(?:$|[\s_-])", re.I)
_MAIN = re.compile(r"(?:^|[\s_-])(?:article|entry|post|story|main|content)(?:$|[\s_-]?(?:body|content|text)?$)", re.I)
_ATTR = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

#: words, links, words before, links before, words after, links after, heading, furniture, in article, page has article; main text?
_LABELLED = [
    # pages with an article: its own blocks, short and long, also next to furniture
    *[((w, 0.0, pw, pl, nw, nl, h, 0, 1, 1), 1) for w in (1, 2, 6, 20, 120) for pw, pl, nw, nl in ((0, 0.0, 30, 0.0), (6, 1.0, 90, 0.0), (80, 0.0, 7, 0.2), (9, 0.0, 0, 0.0), (40, 0.0, 5, 1.0), (5, 1.0, 4, 1.0)) for h in (0, 1)],
    *[((w, ld, 60, 0.0, 50, 0.0, 0, 0, 1, 1), 1) for w in (5, 40, 90) for ld in (0.1, 0.3, 1.0)],
    # furniture wherever it stands
    *[((w, ld, pw, 0.0, nw, 0.0, h, 1, a, p), 0) for w in (1, 4, 12, 60, 200) for ld in (0.0, 1.0) for pw, nw in ((0, 80), (70, 0)) for h in (0, 1) for a, p in ((0, 0), (0, 1), (1, 1))],
    # outside the article of a page that has one
    *[((w, ld, pw, pl, nw, nl, h, 0, 0, 1), 0) for w in (2, 15, 80) for ld in (0.0, 0.9) for h in (0, 1) for pw, pl, nw, nl in ((40, 0.0, 3, 1.0), (0, 0.0, 60, 0.0), (50, 0.0, 0, 0.0), (5, 1.0, 40, 0.0))],
    # pages without an article: text, neighbours decide on the short ones
    *[((w, ld, pw, 0.0, nw, 0.0, 0, 0, 0, 0), 1) for w in (16, 45, 150) for ld in (0.0, 0.15) for pw, nw in ((0, 40), (40, 0), (30, 30), (0, 0))],
    *[((w, ld, pw, pl, nw, nl, 0, 0, 0, 0), 1) for w in (16, 45, 150) for ld in (0.0, 0.15) for pw, pl, nw, nl in ((2, 1.0, 40, 0.0), (40, 0.0, 2, 1.0), (1, 1.0, 1, 1.0), (6, 1.0, 0, 0.0))],
    *[((w, 0.0, pw, 0.0, nw, 0.0, h, 0, 0, 0), 1) for w in (2, 8) for pw, nw in ((40, 60), (25, 30), (3, 50)) for h in (0, 1)],
    *[((w, 0.0, 60, 0.0, 2, nl, 0, 0, 0, 0), 1) for w in (4, 9) for nl in (0.0, 0.2)],
    *[((w, ld, pw, pl, nw, nl, 0, 0, 0, 0), 0) for w in (1, 3, 9, 30) for ld in (0.6, 1.0) for pw, pl, nw, nl in ((0, 0.0, 3, 1.0), (3, 1.0, 3, 1.0), (50, 0.0, 2, 1.0), (2, 1.0, 60, 0.0))],
    *[((w, 0.0, pw, pl, nw, nl, 0, 0, 0, 0), 0) for w in (1, 3, 8) for pw, pl, nw, nl in ((2, 1.0, 3, 1.0), (3, 0.8, 0, 0.0), (0, 0.0, 4, 1.0), (3, 0.0, 2, 0.9))],
]


def grow(rows: list[tuple[tuple, int]], depth: int = 8):
    """CART by Gini impurity: nested (feature, cut, below, above), or a class."""
    ones = sum(y for _, y in rows)
    if not depth or ones in (0, len(rows)):
        return int(2 * ones >= len(rows))
    best = None
    for f in range(len(rows[0][0])):
        values = sorted({x[f] for x, _ in rows})
        for a, b in zip(values, values[1:]):
            cut = (a + b) / 2
            low = [y for x, y in rows if x[f] <= cut]
            n, p, q = len(low), sum(low), ones - sum(low)
            m = len(rows) - n
            impurity = p * (n - p) / n + q * (m - q) / m
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, f, cut
    if best is None:
        return int(2 * ones >= len(rows))
    _, f, cut = best
    return f, cut, grow([r for r in rows if r[0][f] <= cut], depth - 1), grow([r for r in rows if r[0][f] > cut], depth - 1)


@lru_cache(1)
def tree():
    return grow(_LABELLED)


def classify(features: tuple) -> int:
    node = tree()
    while isinstance(node, tuple):
        node = node[2] if features[node[0]] <= node[1] else node[3]
    return node


class _Open:
    """Open elements: (tag, furniture, article, heading).  Where the last of a tag stands is known without a search."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, int, int]] = [("", 0, 0, 0)]
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = [0]

    def push(self, tag: str, furniture: int, article: int, heading: int) -> None:
        self.at.setdefault(tag, []).append(len(self.stack))
        if tag in _BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, furniture, article, heading))

    def last(self, tags) -> int:
        """The place of the innermost of these tags, or 0."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def cut(self, depth: int) -> None:
        """Close the element there and all in it."""
        while len(self.stack) > depth:
            tag = self.stack.pop()[0]
            self.at[tag].pop()
            if tag in _BLOCK:
                self.blocks.pop()


class _Tags:
    """Ends of tags of a page.  Quoted values may hold >; where the quotes of a tag go on to the end of the page, its first > ends it."""

    def __init__(self, page: str) -> None:
        self.page = page
        #: Places outside quotes from which no end is found, so that no part of a page is searched twice.
        self.hopeless: set[int] = set()
        #: From where on there is none of a quote, or of a closing raw tag.
        self.without: dict[str, int] = {}

    def end(self, at: int) -> int:
        page = self.page
        if m := _PLAIN.match(page, at):
            return m.end()
        seen, here = [], at
        while m := _STOP.search(page, here):
            if m[0] == ">":
                return m.end()
            if m.end() in self.hopeless:
                break
            seen.append(m.end())
            close = self.find(m[0], m.end())
            if close < 0:
                break
            here = close + 1
        self.hopeless.update(seen)
        close = page.find(">", at)
        return len(page) if close < 0 else close + 1

    def find(self, quote: str, at: int) -> int:
        if at >= self.without.get(quote, len(self.page) + 1):
            return -1
        found = self.page.find(quote, at)
        if found < 0:
            self.without[quote] = at
        return found

    def after(self, tag: str, at: int) -> int:
        """The end of the next closing tag, or -1."""
        if at >= self.without.get(tag, len(self.page) + 1):
            return -1
        m = _closing(tag).search(self.page, at)
        if m is None:
            self.without[tag] = at
        return m.end() if m else -1


@lru_cache(64)
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\s*>", re.I)


#: What a start tag closes, and what it does not reach past.
_ENDS = {t: {"p"} for t in _BLOCK} | {t: {"p", t} for t in ("li", "td", "th")} | {"tr": {"p", "tr", "td", "th"}} | {t: {"p", "dt", "dd"} for t in ("dt", "dd")}
_BARS = ("ul", "ol", "table", "div", "section", "article", "blockquote", "td", "body")


def blocks(page: str) -> list[tuple[str, float, int, int, int]]:
    """(text, link share, heading, furniture, in article) of each block of a page, in order."""
    out: list[tuple[str, float, int, int, int]] = []
    text: list[str] = []
    linked: list[str] = []
    opened, tags = _Open(), _Tags(page)
    stack = opened.stack
    links = 0

    def flush() -> None:
        words = "".join(text).split()
        if words:
            _, fur, art, head = stack[-1]
            out.append((" ".join(words), min(1.0, len("".join(linked).split()) / len(words)), head, fur, art))
        text.clear()
        linked.clear()

    def say(raw: str) -> None:
        if raw:
            t = html.unescape(raw) if "&" in raw else raw
            text.append(t)
            if links:
                linked.append(t)

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:].removesuffix("]]>"))
            continue
        at = tags.end(m.end())
        attrs = page[m.end() : at].removesuffix(">").rstrip()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
                linked.append(" ")
            if tag in _BLOCK:
                flush()
            depth = opened.last((tag,))
            if depth and (tag in _BLOCK or opened.blocks[-1] < depth):
                opened.cut(depth)
            continue
        if tag in _RAW:
            if not attrs.endswith("/"):
                end = tags.after(tag, at)
                at = end if end >= 0 else n if tag in ("script", "style", "textarea") else at
            text.append(" ")
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in _BLOCK:
            flush()
            links = 0
        if tag in _VOID or attrs.endswith("/"):
            continue
        if tag in _BLOCK:
            depth = opened.last(_ENDS[tag])
            if depth and depth >= opened.last(_BARS):
                opened.cut(depth)
        if tag == "a":
            links += 1
        _, fur, art, head = stack[-1]
        named = {a.lower(): (b or c or d or "") for a, b, c, d in _ATTR.findall(attrs)} if attrs else {}
        mark = " ".join(named.get(k, "") for k in ("class", "id", "role"))
        main = tag in ("article", "main") or named.get("itemprop", "").lower() == "articlebody" or (tag in ("div", "section") and bool(_MAIN.search(mark)) and not _FURNITURE.search(mark))
        own = tag in _FURNITURE_TAGS or "hidden" in named or named.get("aria-hidden") == "true" or (tag not in ("html", "body", "article", "main") and bool(mark.strip()) and bool(_FURNITURE.search(mark)))
        if not art and (tag == "header" or (tag not in ("html", "body") and bool(mark.strip()) and _HEAD.search(mark))):
            own = True
        heading = int(tag in ("h1", "h2", "h3", "h4", "h5", "h6"))
        opened.push(tag, int(fur or own), int(art or main), heading or (head if tag not in _BLOCK else 0))
    flush()
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    has = int(any(b[4] for b in found))
    size = [len(b[0].split(" ")) for b in found]
    kept = []
    for k, (text, link, head, fur, art) in enumerate(found):
        pw, pl = (size[k - 1], found[k - 1][1]) if k else (0, 0.0)
        nw, nl = (size[k + 1], found[k + 1][1]) if k + 1 < len(found) else (0, 0.0)
        if classify((size[k], link, pw, pl, nw, nl, head, fur, art, has)):
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages (page_id, url, html)."""

    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
