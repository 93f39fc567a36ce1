"""Main text of web pages by line-block distribution.

Markup is stripped to one line per block element. Lines of menus, headers, footers, sidebars,
notices, adverts, forms and reader comments, and lines that are mostly links, are noise. Sums of
text length over sliding windows of lines surge where text begins and dive to nothing where it ends.
Menus, headers, footers and lines of links count as empty there; other noise is left out, so an advert
does not end a text. The stretch between a surge and its dive that holds most text is the article, and
all its lines are kept; so are all others, noise apart, of the innermost ``article``, or else ``main``,
that holds most of the stretch, and without these of the element that holds most of it directly (sections
and list items count to what holds them). Gaps shorter than a window do not end it. A line of links inside
an ``article`` is text, unless it is an item of a list. An anchor without a target is no link, and one that is
never closed ends with its block.

A class or id is noise by its words, but not as a state (``has-sidebar``) and not around a ``main`` or
the ``h1`` of an ``article``. A page that has no text but in elements named so is read without their names.

Defined results: null or empty html gives an empty text; unclosed or cut tags end with the page; a
repeated page is extracted per row; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 3
LINKED = 0.5

# Element names and class words of HTML: fixed values.
_RAW = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "textarea", "select", "title"}
_ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "head"}
_BLOCK = {
    "address", "article", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "hr", "html", "li", "main", "ol", "p", "pre", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
} | _ASIDE
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_NOISE = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "cookie", "cookies", "consent", "footer", "masthead", "menu", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "notices", "popup", "promo", "promoted", "related", "share", "sharing", "sidebar", "social",
    "sponsor", "sponsored", "subscribe", "toolbar", "widget", "disqus", "respond", "replies",
}
_STATES = {"has", "with", "no", "without", "is", "not", "hide", "show"}
#: Elements between the parts of a page. Other noise may stand amid a text.
_PARTS = {"nav", "header", "footer", "menu", "head"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|<(/?[a-zA-Z][^>]*)(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ROLE = re.compile(r"\brole\s*=\s*[\"']?([a-z]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORDS = re.compile(r"[a-z]+")
_TARGET = re.compile(r"(?:^|\s)href\s*=", re.I)
_ANCHOR = re.compile(r"<(/?)a[\s/>]", re.I)
#: Elements that hold blocks of text. Sections and items inside them are parts of the same text.
_HOLDERS = {"body", "div", "td", "th", "center", "article", "main"}


def _noise(tag: str, attributes: str, inside: list, named: bool) -> int:
    """0 for no noise, 1 for noise, 2 for noise by class or id only."""
    if tag == "header" and any(t in ("article", "main") for t, *_ in inside):
        return 0
    if tag in _ASIDE:
        return 1
    if not attributes or attributes == "/" or tag in ("html", "body", "article", "main"):
        return 0
    if _HIDDEN.search(attributes):
        return 1
    role = _ROLE.search(attributes)
    if role and role[1].lower() in _ROLES:
        return 1
    if named:
        for m in _NAMED.finditer(attributes):
            for name in (m[1] or m[2] or m[3] or "").lower().split():
                words = _WORDS.findall(name)
                if words and words[0] not in _STATES and any(w in _NOISE for w in words):
                    return 2
    return 0


def lines(page: str, named: bool = True) -> list[tuple[str, bool, bool, int]]:
    """(text, is noise, may stand amid a text, number of what holds it or 0) of every block in page order."""
    out: list[tuple[str, bool, bool, int]] = []
    stack: list[tuple[str, int, int]] = []
    buffer: list[str] = []
    noisy = parted = links = 0
    linked = opened = 0
    place, size = 0, len(page)

    def flush():
        nonlocal linked, links
        text = " ".join(entities.unescape("".join(buffer)).split())
        if text or parted:
            inside = [n for t, _, n in stack if t == "article"]
            holders = inside or [n for t, _, n in stack if t == "main"] or [n for t, _, n in stack if t in _HOLDERS]
            listed = not inside or any(t == "li" and n > inside[-1] for t, _, n in stack)
            noise = noisy > 0 or listed and linked > LINKED * len(text)
            out.append((text, noise, noisy > 0 and not parted, holders[-1] if holders else 0))
        buffer.clear()
        linked = 0
        if links == 2:
            links = 0

    def drop(depth: int):
        nonlocal noisy, parted
        while len(stack) > depth:
            gone, noise, _ = stack.pop()
            noisy -= noise > 0
            parted -= noise > 0 and gone in _PARTS

    def clear():
        # What holds the main part or an article's headline is no noise for its name.
        nonlocal noisy
        if all(noise != 1 for _, noise, _ in stack):
            noisy = parted
            stack[:] = [(t, 0, n) for t, _, n in stack]

    while place < size:
        m = _TAG.search(page, place)
        text = page[place : m.start() if m else size]
        if text:
            buffer.append(text)
            if links:
                linked += len(text)
        if not m:
            break
        place = m.end()
        if m[2] is None:
            continue
        close, tag, attributes = m[1], m[2].lower(), m[3]
        if tag in _RAW and not close:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, place)
                place = end.end() if end else size
            if tag not in ("svg", "math", "select"):
                flush()
            continue
        if tag in ("br", "wbr"):
            buffer.append(" " if tag == "br" else "")
            continue
        if tag == "a":
            links = 0
            if not close and _TARGET.search(attributes):
                # 1 up to its end, 2 up to the end of the block where another anchor or nothing follows.
                after = _ANCHOR.search(page, place)
                links = 1 if after and after[1] else 2
        if tag in _BLOCK:
            flush()
        if tag in _VOID or tag == "a":
            continue
        if close:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                drop(depth)
        else:
            # A new block ends an open paragraph, a new item the open item.
            if tag in _BLOCK and stack and stack[-1][0] == "p":
                drop(len(stack) - 1)
            if noisy and (tag == "main" or tag == "h1" and any(t == "article" for t, *_ in stack)):
                clear()
            noise = _noise(tag, attributes, stack, named)
            if noise or tag in _BLOCK:
                if noise and tag not in _BLOCK:
                    flush()
                opened += 1
                stack.append((tag, noise, opened))
                noisy += noise > 0
                parted += noise > 0 and tag in _PARTS
        if close and tag not in _BLOCK and not buffer:
            continue
    flush()
    return out


def _article(rows: list[tuple[str, bool, bool, int]]) -> str:
    rows = [(text, 0 if noise else len(text), holder) for text, noise, amid, holder in rows if not amid]
    length = [size for _, size, _ in rows]
    best, best_size, i, n = (0, 0), 0, 0, len(rows)
    window = [sum(length[k : k + WINDOW]) for k in range(n)]
    while i < n:
        if not length[i]:
            i += 1
            continue
        surge = i
        while i < n and window[i]:
            i += 1
        size = sum(length[surge:i])
        if size > best_size:
            best, best_size = (surge, i), size
    held: dict[int, int] = {}
    for _, size, holder in rows[slice(*best)]:
        held[holder] = held.get(holder, 0) + size
    most = max(held, key=held.get, default=0)
    return "\n\n".join(rows[k][0] for k in range(n) if length[k] and (best[0] <= k < best[1] or rows[k][2] == most))


def main_text(page: str | None) -> str:
    """The article of a page: its blocks joined by two line ends."""
    return _article(lines(page or "")) or _article(lines(page or "", False))


def _extracting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [main_text(h.as_py()) for h in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""
    return pages.select("page_id", "url", "html").mapInArrow(_extracting, "page_id bigint, url string, text string, n_chars bigint")
