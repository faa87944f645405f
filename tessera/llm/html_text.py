"""HTML extraction by the distribution of text over lines.

Markup is stripped so that every block is a line; what menus, headers, footers, sidebars, notices, adverts, forms and comments hold
leaves empty lines. Text lengths are summed over windows of `WINDOW` lines. A stretch begins where the sums rise from zero (surge)
and ends where they fall back to it (dive); its lines are kept, however short. Where a page marks its article (article, main,
itemprop=articleBody), the other lines count nothing, and every stretch is the article's. Elsewhere the text of links counts nothing,
and a stretch is kept if one of its windows reaches the lesser of `SURGE` characters and half of the page's largest window.

Defined results: null and empty html and pages without such text give an empty text of 0 characters; unclosed comments, scripts and
tags end with the page (an unclosed title, noscript or object ends at once); white space is what str.split() takes for it; a repeated row is extracted again; a null page_id or url stays;
other columns are not read. Work is linear in the page, however long or deep.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow, pieces

WINDOW, SURGE = 3, 86

# Fixed values of HTML: elements without an end, without visible text, and within a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that are never the article's text; a header is, inside the article.
BESIDE = frozenset("head nav footer aside form menu dialog button select fieldset".split())
#: Words of class, id and role for what stands beside the article, and for readers' comments, which may hold articles of their own.
WORDS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertisements advertising adslot sponsor sponsored sponsors banner promo promos promoted promotion "
    "sidebar sidebars aside rail nav navs navbar navigation menu menus menubar breadcrumb breadcrumbs masthead topbar toolbar footer footers footnav colophon contentinfo complementary "
    "cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay dialog newsletter subscribe subscription signup signin login paywall "
    "share shares sharing social related recommended recommendations trending widget widgets pager pagination copyright disclaimer search searchbox".split()
)
OUTSIDE = frozenset("header headers".split())
COMMENTS = frozenset("comment comments commentlist commentary disqus respond reply replies discussion".split())
#: First words of class names that speak of the page and not of what the element is.
ABOUT = frozenset("has with no is not without".split())

_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>=`]+)))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"""["'>]""")
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>]|$)", re.I) for t in RAW}
_CLEAN, _SOFT, _HARD = 0, 1, 2


def _kind(tag: str, attributes: str) -> tuple[int, int, bool]:
    """(how surely the element is beside the article, 2 for an article and 1 for main, whether it is only so outside an article)."""
    beside, mark, outside = (_HARD, 0, False) if tag in BESIDE else (_CLEAN, 2 if tag == "article" else 1 if tag == "main" else 0, False)
    if tag == "header":
        beside, outside = _HARD, True
    if not attributes or tag in ("html", "body"):
        return beside, mark, outside
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s{0,9}:\s{0,9}none", value, re.I)):
            beside, outside = _HARD, False
        elif name in ("class", "id", "role"):
            if name == "role" and value.lower() in ("main", "article"):
                mark = max(mark, 1)
                continue
            for word in value.split():
                parts = [p.lower() for p in _PART.findall(word)]
                if not parts or parts[0] in ABOUT:
                    continue
                if not COMMENTS.isdisjoint(parts):
                    beside, outside = _HARD, False
                elif not WORDS.isdisjoint(parts):
                    if beside < _SOFT or outside:
                        beside, outside = max(beside, _SOFT), False
                elif beside == _CLEAN and not OUTSIDE.isdisjoint(parts):
                    beside, outside = _SOFT, True
        elif name == "itemprop" and value.lower() == "articlebody":
            mark = 2
    return beside, mark, outside


def lines_of(html: str) -> list[tuple[str, int, int, int] | None]:
    """(text, characters outside links, mark, beside) of every block in page order; None where an element beside the article begins or ends."""
    lines: list[tuple[str, int, int, int] | None] = []
    words: list[str] = []
    open_: list[tuple[str, int, int, bool]] = []  # tag, beside, mark, link
    n_open: dict[str, int] = {}
    count = {_SOFT: 0, _HARD: 0, "article": 0, "main": 0, "link": 0}
    linked = around = 0  # characters of links in the line; elements with such class names around the article
    no_quote: set[str] = set()  # quotes that no longer occur

    def flush() -> None:
        nonlocal linked
        if words:
            if text := " ".join("".join(words).split()):
                mark = 2 if count["article"] else 1 if count["main"] else 0
                beside = _HARD if count[_HARD] or (mark and count[_SOFT] > around) else _SOFT if count[_SOFT] else _CLEAN
                lines.append((text, len(text.replace(" ", "")) - linked, mark, beside))
            words.clear()
        linked = 0

    def text_at(start: int, end: int) -> None:
        nonlocal linked
        if end > start:
            part = unescape(html[start:end])
            words.append(part)
            if count["link"]:
                linked += len("".join(part.split()))

    def pop() -> None:
        tag, beside, mark, link = open_.pop()
        n_open[tag] -= 1
        if beside:
            flush()
            lines.append(None)
            count[beside] -= 1
        elif tag not in INLINE:
            flush()
        if mark:
            flush()
            count["article" if mark == 2 else "main"] -= 1
        count["link"] -= link

    def close(tag: str) -> None:
        while n_open.get(tag):
            top = open_[-1][0]
            pop()
            if top == tag:
                break

    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0 or lt + 1 >= n:
            text_at(at, n)
            break
        follows = html[lt + 1]
        if follows == "!" or follows == "?":
            text_at(at, lt)
            end = html.find("-->", lt + 4) if html.startswith("<!--", lt) else html.find(">", lt)
            if html.startswith(("<!-->", "<!--->"), lt):
                at = html.index(">", lt) + 1
            else:
                at = n if end < 0 else end + (3 if html.startswith("<!--", lt) else 1)
            continue
        ending = follows == "/"
        name = _NAME.match(html, lt + 1 + ending)
        if not name:  # a bare "<" is text
            text_at(at, lt + 1)
            at = lt + 1
            continue
        text_at(at, lt)
        tag, end = name[0].lower(), name.end()
        while (stop := _STOP.search(html, end)) and stop[0] != ">":
            quote = stop[0]
            other = -1 if quote in no_quote else html.find(quote, stop.end())
            if other < 0:
                no_quote.add(quote)
            end = stop.end() if other < 0 else other + 1
        if not stop:
            break
        attributes, at = html[name.end() : stop.start()], stop.end()
        if ending:
            if tag == "p" and not n_open.get("p"):
                flush()
            elif tag == "br":
                flush()
            else:
                close(tag)
                if tag not in INLINE:
                    flush()
            continue
        if tag in RAW:
            found = _ENDS[tag].search(html, at)
            if found:
                end = html.find(">", found.end())
                at = n if end < 0 else end + 1
            elif tag not in ("title", "noscript", "object"):  # of these, unclosed, what follows counts
                at = n
            continue
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        if tag not in INLINE:
            flush()
            if n_open.get("p"):
                close("p")
        if tag == "li" and n_open.get("li"):
            for i in range(len(open_) - 1, max(-1, len(open_) - 9), -1):
                if open_[i][0] in ("ul", "ol", "menu"):
                    break
                if open_[i][0] == "li":
                    close("li")
                    break
        if tag == "body" and n_open.get("head"):
            close("head")
        beside, mark, outside = _kind(tag, attributes)
        if outside and count["article"]:
            beside = _CLEAN
        if beside:
            flush()
            lines.append(None)
            count[beside] += 1
        if mark:
            flush()
            if not count["article"] and not count["main"]:
                around = count[_SOFT]
            count["article" if mark == 2 else "main"] += 1
        link = tag == "a"
        count["link"] += link
        if attributes.endswith("/") and tag not in INLINE and beside == mark == 0:
            continue  # <div/> opens nothing that matters
        open_.append((tag, beside, mark, link))
        n_open[tag] = n_open.get(tag, 0) + 1
    flush()
    return lines


def stretches(lengths: list[int], least: float) -> list[tuple[int, int]]:
    """(first, last) line with text of every stretch between a surge and a dive whose largest window is at least `least`."""
    found, begins, last, peak = [], -1, -1, 0
    padded = [0] * (WINDOW - 1) + lengths + [0] * WINDOW
    total = 0
    for i, length in enumerate(padded):
        total += length - (padded[i - WINDOW] if i >= WINDOW else 0)
        if length:
            begins = i if begins < 0 else begins
            last = i
        if total:
            peak = max(peak, total)
        elif begins >= 0:  # a dive
            if peak >= least:
                found.append((begins - WINDOW + 1, last - WINDOW + 1))
            begins, peak = -1, 0
    return found


def main_text(html: str | None) -> str:
    """The text of the article, blocks joined by one space."""
    lines = lines_of(html or "")
    some = {(line[2], line[3]) for line in lines if line}
    for beside in (_CLEAN, _SOFT):  # an article that stands wholly in elements with such class names is one all the same
        for mark in (2, 1):
            if any(m >= mark and b <= beside for m, b in some):
                return _kept(lines, lambda x: len(x[0]) if x[2] >= mark and x[3] <= beside else 0, True)  # noqa: B023
    return _kept(lines, lambda x: x[1] if x[3] == _CLEAN else 0, False)


def _kept(lines, length, marked: bool) -> str:
    """Lines of stretches; lines that count nothing, and borders, are empty lines unless links alone make them so."""
    texts: list[str] = []
    lengths: list[int] = []
    for line in lines:
        n = length(line) if line else 0
        if n or (line and not marked and line[3] == _CLEAN):
            texts.append(line[0])
            lengths.append(n)
        elif texts and (texts[-WINDOW:] != [""] * WINDOW):
            texts += [""] * WINDOW
            lengths += [0] * WINDOW
    windows = [sum(lengths[i : i + WINDOW]) for i in range(len(lengths))]
    least = 1 if marked else max(1, min(SURGE, max(windows, default=0) / 2))
    return " ".join(t for first, last in stretches(lengths, least) for t in texts[first : last + 1] if t)


def _extracted(batches):
    for batch in pieces(batches, column="html"):
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of `pages` (page_id, url, html)."""
    kinds = dict(pages.dtypes)
    return arrow(pages.select("page_id", "url", "html"), _extracted, f"page_id {kinds['page_id']}, url string, text string, n_chars bigint")
