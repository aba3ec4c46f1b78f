"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of text, and a line's length is its characters outside links (none if these
are most of it). The lengths
summed over a sliding window of WINDOW lines rise at a surge point and fall to nothing at a dive point; the lines between
are one stretch, and a stretch whose sum passes SURGE is text. Tags, roles and names are evidence about lines: what stands
in a menu, header, footer, sidebar, notice, advert, form or reader comment has no length and leaves an empty window, the
edge of an article or main element leaves one too, other edges of containers leave up to WINDOW - 1 empty lines. A page
with articles has two kinds of stretches, and those in articles are its text unless what surges elsewhere has ARTICLE times
their length. Of the lowest box that holds the chosen stretches all is kept, and where that is one box without boxes of text
in it, or the whole page, what else stands beside it but stretches that are mostly links. When nothing surges, a page's articles or its longest stretch are its text.

A null or empty page gives an empty text; pages of any length are read whole, in time that grows with their length; repeated
rows are extracted each on its own; an empty table gives an empty table. Unclosed elements end with what they cannot contain,
or with the page. Other columns of the input pass through extract(); a column named like its output is replaced.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import read_table

WINDOW, SURGE, ARTICLE = 3, 86, 4

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/><]*)")
_STOP = re.compile(r"[<>\"']")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in _RAW}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_GONE = frozenset("nav header footer aside form head menu svg math canvas object select button dialog audio video map datalist fieldset".split())
_BOX = frozenset("div section article main body table tbody thead tfoot tr td th html center".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_BLOCK = _BOX | _HEADING | frozenset("address blockquote caption dd details dl dt figcaption figure hgroup hr legend li ol optgroup option p pre summary ul".split()) | _GONE
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar note status".split())
#: Words that make the name of a part outside the article: as a class or id ...
_OUTSIDE = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors promo promoted sidebar sidebars
    widget widgets nav navbar navigation navi menu menus breadcrumb breadcrumbs masthead topbar footer footnav colophon cookie cookies consent gdpr
    popup modal newsletter subscribe subscription signup signin login sharing comment comments commentlist disqus pagination pager toolbar
    disclaimer paywall""".split()
)
#: ... or as a class only, since headings' ids are often such words.
_OUTSIDE_CLASS = frozenset("banner rail header notice notices notification notifications alert alerts overlay register share social follow related recommended recommendations recirculation respond reply replies copyright form search skip".split())
#: Words that may stand beside these in one name.
_BESIDE = frozenset(
    """area article articles bar block body bottom box btn button buttons col column container content entry group icon icons inner item items js left link links
    list main message module my outer page panel policy post posts primary right row secondary section site slot stories story text the title top unit wrap wrapper""".split()
)
#: Words beside which "header" names the article's own heading.
_OF_ARTICLE = frozenset("entry post article story content".split())
_KEPT = frozenset(("html", "body", "main"))
_ROOT = frozenset(("html", "body"))
_INSIDE_P = re.compile(r"h[1-6]$|p$|div$|ul$|ol$|table$|section$|article$|main$|blockquote$|pre$|form$|nav$|header$|footer$|aside$|hr$|dl$|address$|figure$")


def _names_outside(value: str, known: frozenset[str], in_article: bool) -> bool:
    """Whether one of the names in a class or an id consists of such words, with at most words that may stand beside them."""
    for name in value.split():
        words = {w for w in re.split(r"[_:.-]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if not w.isdigit()} - {""}
        found = words & known
        if "header" in found and (in_article or words & _OF_ARTICLE):
            found = found - {"header"}
        if found and words <= _BESIDE | _OUTSIDE | _OUTSIDE_CLASS:
            return True
    return False


def _outside(name: str, attributes: str, in_article: bool) -> bool:
    if name in _GONE:
        return not (name == "header" and in_article)
    if name in _KEPT or not attributes.strip():
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), next((v for v in m.groups()[1:] if v is not None), "")
        if key == "class" and name in _BLOCK - _HEADING and _names_outside(value, _OUTSIDE | _OUTSIDE_CLASS, in_article):
            return True
        if key == "id" and name in _BLOCK - _HEADING and _names_outside(value, _OUTSIDE, in_article):
            return True
        value = value.lower()
        if key == "role" and value in _ROLES or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


class _Tags:
    """The tags of a page in turn; every character is looked at a bounded number of times."""

    def __init__(self, page: str) -> None:
        self.page, self.absent = page, set()

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, closing, name or empty for what only is skipped, attributes) of the first tag from at on."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(page), False, "", ""
            m = _NAME.match(page, start + 1)
            if m:
                stop, end = self.ending(m.end())
                return start, end, bool(m[1]), m[2].lower(), page[m.end() : stop]
            if page[start + 1 : start + 2] in ("!", "?", "/"):
                end = page.find(">", start)
                return start, end + 1 if end >= 0 else len(page), False, "", ""
            at = start + 1
        return None

    def ending(self, at: int) -> tuple[int, int]:
        """Where a tag's attributes stop and where the tag ends: at a >, or before a < or the page's end where that is missing."""
        page = self.page
        while m := _STOP.search(page, at):
            sign, at = m[0], m.end()
            if sign == ">":
                return m.start(), at
            if sign == "<":
                return m.start(), m.start()
            before = m.start() - 1
            while page[before].isspace():
                before -= 1
            if page[before] == "=" and sign not in self.absent:  # a value in quotes
                closing = page.find(sign, at)
                if closing < 0:
                    self.absent.add(sign)
                else:
                    at = closing + 1
        return len(page), len(page)


class _Lines:
    """The page as lines: (text, its length as evidence has it, inside the article, number of the innermost box or 0)."""

    def __init__(self) -> None:
        self.lines: list[tuple[str, int, bool, int]] = []
        self.boxes: list[tuple[str, int]] = []
        self.named: dict[str, int] = {}
        self.opened = 0
        self.parent = [0]
        self.last: dict[int, int] = {}
        self.parts: list[str] = []
        self.linked = 0
        self.link = False
        self.empty = 0

    def text(self, raw: str) -> None:
        if raw:
            self.parts.append(piece := html.unescape(raw) if "&" in raw else raw)
            if self.link:
                self.linked += len(piece.strip())

    def box(self, name: str, closing: bool) -> None:
        if not closing:
            if name not in _ROOT:
                self.opened += 1
                self.parent.append(self.boxes[-1][1] if self.boxes else 0)
            self.boxes.append((name, self.opened if name not in _ROOT else 0))
            self.named[name] = self.named.get(name, 0) + 1
        elif self.named.get(name):
            while True:
                open_, number = self.boxes.pop()
                self.named[open_] -= 1
                self.last[number] = self.opened
                if open_ == name:
                    break

    def around(self, numbers: set[int]) -> tuple[int, int]:
        """First and last number of the boxes in the lowest one that holds all of the given ones."""
        low, high = min(numbers), max(numbers)
        while low and self.last.get(low, self.opened) < high:
            low = self.parent[low]
        return low, self.last.get(low, self.opened) if low else self.opened

    def end(self, article: bool) -> None:
        """The end of a block."""
        if self.parts:
            if line := " ".join("".join(self.parts).split()):
                own = len(line) - self.linked
                self.lines.append((line, own if 2 * own > len(line) else 0, article, self.boxes[-1][1] if self.boxes else 0))
                self.empty = 0
            self.parts, self.linked = [], 0

    def gap(self, most: int) -> None:
        """One more empty line, up to `most` in a row, or all of WINDOW at once."""
        if self.lines and self.empty < most:
            n = 1 if most < WINDOW else most - self.empty
            self.lines.extend([("", 0, False, 0)] * n)
            self.empty += n


def to_lines(page: str) -> list[tuple[str, int, bool, int]]:
    return _read(page).lines


def _read(page: str) -> _Lines:
    out, tags = _Lines(), _Tags(page)
    at, articles, skipped, depth = 0, 0, "", 0
    size = len(page)
    while at < size:
        tag = tags.next(at)
        if not skipped:
            out.text(page[at : tag[0] if tag else size])
        if not tag:
            break
        _, at, closing, name, attributes = tag
        if not name:
            continue
        if name in _RAW and not closing and not attributes.endswith("/"):
            end = _RAW_END[name].search(page, at)
            at = tags.ending(end.end())[1] if end else size
            continue
        if skipped:
            if name == skipped and name not in _VOID:
                depth += -1 if closing else 1
                if not depth:
                    skipped = ""
                    continue
            if not (skipped == "head" and name == "body" or skipped == "p" and not closing and _INSIDE_P.match(name) or closing and name in ("body", "html", "article", "main") and name != skipped):
                continue
            skipped = ""
        if not closing and _outside(name, attributes, articles > 0):
            out.end(articles > 0)
            out.gap(WINDOW)
            if name not in _VOID and not attributes.endswith("/"):
                skipped, depth = name, 1
            continue
        if name in ("article", "main"):
            out.end(articles > 0)
            out.gap(WINDOW)
            articles = max(0, articles + (-1 if closing else 1))
            out.box(name, closing)
        elif name in _BLOCK:
            out.end(articles > 0)
            if name in _BOX:
                out.gap(WINDOW - 1)
                out.box(name, closing)
        elif name == "br":
            out.text(" ")
        elif name == "a":
            out.link = not closing
    out.end(articles > 0)
    return out


def stretches(lines: list[tuple[str, int, bool, int]]) -> list[tuple[int, int, int]]:
    """(first line, line after the last, largest window sum) from each surge point to the dive point after it, and lines of
    links that stand in none by themselves, with a sum of 0."""
    lengths = [x[1] for x in lines]
    sums, total = [], sum(lengths[:WINDOW])
    for i in range(len(lengths)):
        sums.append(total)
        total += (lengths[i + WINDOW] if i + WINDOW < len(lengths) else 0) - lengths[i]
    found, start = [], None
    for i, above in enumerate([*sums, 0]):
        if start is None and above and lengths[i]:
            start = i  # surge: the first line with text after an empty window
        elif start is not None and not above:
            found.append((start, i, max(sums[start:i])))  # dive: nothing in the window any more
            start = None
        if start is None and i < len(lines) and lines[i][0]:
            found.append((i, i + 1, 0))
    return found


def main_text(page: str | None) -> str:
    read = _read(page or "")
    lines = read.lines
    runs = stretches(lines)
    if not runs:
        return ""
    mass = lambda r: sum(x[1] for x in lines[r[0] : r[1]])
    inside = lambda r: any(x[2] for x in lines[r[0] : r[1]])
    text = lambda r: mass(r) * 2 > sum(len(x[0]) for x in lines[r[0] : r[1]])
    surging = [r for r in runs if r[2] > SURGE and text(r)]
    among = surging or runs
    own, other = [r for r in among if inside(r)], [r for r in among if not inside(r)]
    in_article = bool(own) and ARTICLE * sum(map(mass, own)) >= sum(map(mass, other))
    chosen = own if in_article else other if surging else [max(other, key=mass)]
    boxes = {x[3] for a, b, _ in chosen for x in lines[a:b] if x[0]}
    low, high = read.around(boxes)
    outer = read.parent[low] if low and len(boxes) == 1 else low
    last = read.last.get(outer, read.opened) if outer else read.opened

    first = set(chosen)

    def kept(r: tuple[int, int, int]) -> bool:
        own = [x[3] for x in lines[r[0] : r[1]] if x[0]]
        if r in first or low and any(low <= box <= high for box in own):
            return True
        return text(r) and any(outer <= box <= last for box in own) and (inside(r) or not in_article)

    return "\n".join(x[0] for r in runs if kept(r) for x in lines[r[0] : r[1]] if x[0])


def _extract(pages: pd.Series) -> pd.Series:
    return pages.map(main_text, na_action=None)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with text and n_chars (code points)."""
    kept = [f"`{c}`" for c in pages.columns if c.lower() not in ("text", "n_chars")]
    return pages.select(*kept, F.pandas_udf(_extract, "string")(F.col(f"`{column}`")).alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
