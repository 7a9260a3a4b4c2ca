"""Main text of web pages: parser events, text-to-tag ratio of each line, Gaussian smoothing, threshold."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Elements that begin and end a line of the page.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
#: Elements that never have an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text nobody sees as text; it is on no line.
UNSEEN = frozenset("head script style noscript template iframe object svg math canvas select textarea audio video".split())
#: Elements whose lines are lines of the page but no part of an article, wherever they stand.
ASIDE = frozenset("nav header footer aside button dialog menu".split())
#: What stands for them among the marks of a piece of text.
OUT = -1
#: Roles and words of class or id that mark the same.
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies consent notice gdpr popup modal overlay newsletter subscribe signup login share sharing social related recommended recommendations comment comments respond disqus widget pagination pager toolbar skip".split())
#: Words that may stand beside those in one class or id: site-footer is marked, has-sidebar and related-work are not.
BESIDE = frozenset("area bar block bottom box btn button buttons center container desktop fixed footer global group icon icons inline inner item items js left link links list main mobile outer page panel post posts primary right row secondary section site slot sticky tabs this top unit wp wrap wrapper text thread title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPLIT = re.compile(r"[^a-z]+")
SPACE = re.compile(r"\s+")
#: Elements that may contain the article.
HOLDERS = frozenset("body article main section div td blockquote".split())


class Line(NamedTuple):
    text: str
    length: int
    tags: int
    holders: tuple[int, ...]
    heading: bool


class _Lines(HTMLParser):
    """All lines of the page, with the tags met since the line before and the elements that hold them.

    Whether the text of a form or of an element with a marked class may be kept is known only at the end of the page.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, tuple[int, ...], tuple[int, ...]]] = [("", False, (0,), ())]
        self.pieces: list[tuple[list[tuple[str, tuple[int, ...]]], int, tuple[int, ...], bool]] = []
        self.buffer: list[tuple[str, tuple[int, ...]]] = []
        self.tags = self.holders = 0
        self.articles: set[int] = set()
        self.bodies = {0}
        self.forms: list[bool] = []
        self.wraps: set[int] = set()

    def _end_line(self) -> None:
        if self.buffer:
            self.pieces.append((self.buffer, self.tags, self.stack[-1][2], any(x[0] in HEADINGS for x in self.stack)))
            self.buffer = []
            self.tags = 0

    def lines(self) -> list[Line]:
        """Each line: its text without asides and the marked elements that are not the page itself, and the length of
        all that is seen there."""
        gone = self._gone() | {OUT}
        out, before = [], 0
        for pieces, tags, holders, heading in self.pieces:
            before += tags
            if seen := SPACE.sub(" ", "".join(x for x, _ in pieces)).strip():
                kept = [x for x, marks in pieces if not marks or gone.isdisjoint(marks)]
                out.append(Line(seen if len(kept) == len(pieces) else SPACE.sub(" ", "".join(kept)).strip(), len(seen), before, holders, heading))
                before = 0
        return out

    def _gone(self) -> set[int]:
        """Marked elements and forms, but those that hold an article or main element or most of the page's text.

        Beside an article with text, marked elements may hold articles or much text, as comments do; forms don't.
        """
        if not self.forms:
            return set()
        size, total, free, article = [0] * len(self.forms), 0, 0, 0
        for pieces, _, holders, _ in self.pieces:
            for x, marks in pieces:
                if OUT in marks:
                    continue
                n = len(x.strip())
                total += n
                for m in marks:
                    size[m] += n
                if not marks:
                    free += n
                    article += n * (not self.articles.isdisjoint(holders))
        keep = {m for m, form in enumerate(self.forms) if form or not article}
        return {m for m in range(len(size)) if m not in keep or not (2 * size[m] > total or (m in self.wraps and (self.forms[m] or size[m] >= free)))}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._end_line()
        elif tag == "br":
            self.handle_data(" ")
        self.tags += 1
        if tag in VOID:
            return
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
            self._close_open(tag)
        _, skip, holders, marks = self.stack[-1]
        if not skip:
            skip = tag in UNSEEN
            if tag in ASIDE:
                marks = (*marks, OUT)
            if tag in ("article", "main"):
                self.wraps.update(marks)
            elif tag == "form" or (bool(attrs) and tag not in ("html", "body") and _marked(tag, attrs)):
                marks = (*marks, len(self.forms))
                self.forms.append(tag == "form")
            if tag in HOLDERS:
                self.holders += 1
                holders = (*holders, self.holders)
                if tag in ("article", "main"):
                    self.articles.add(self.holders)
                elif tag == "body":
                    self.bodies.add(self.holders)
        self.stack.append((tag, skip, holders, marks))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._end_line()
        self.tags += 1
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                return
            # An inline end tag doesn't close blocks around it, nor does one of a part close its holder.
            if tag not in BLOCKS and self.stack[k][0] in BLOCKS:
                return
            if tag in ("p", "li", "dt", "dd", "td", "th", "tr") and self.stack[k][0] in HOLDERS and self.stack[k][0] != "blockquote":
                return

    def _close_open(self, tag: str) -> None:
        """The end tags of paragraphs and list or table parts may be left out, with what is open inside them."""
        for k in range(len(self.stack) - 1, 0, -1):
            name = self.stack[k][0]
            if name == tag:
                del self.stack[k:]
                return
            if name in BLOCKS:
                return

    def handle_data(self, data: str) -> None:
        if not self.stack[-1][1]:
            self.buffer.append((data, self.stack[-1][3]))


def _marked(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    for name, value in attrs:
        if name in ("class", "id") and value:
            if tag not in HEADINGS and not (tag == "p" and name == "id") and any(map(_names_other, value.lower().split())):
                return True
        elif name == "role" and value and value.lower() in ROLES:
            return True
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        elif name == "style" and value and "display:none" in value.replace(" ", "").lower():
            return True
    return False


def _names_other(name: str) -> bool:
    """Whether a class or id is one of WORDS, alone or beside words that say where or of what kind."""
    words = {w for w in SPLIT.split(name) if w}
    return not WORDS.isdisjoint(words) and words <= WORDS | BESIDE


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """``ratios`` under a Gaussian of ``sigma`` lines, cut at three sigma, ends weighted by what is there."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = lambda x: np.convolve(x, kernel)[reach : reach + len(x)]
    return full(ratios) / full(np.ones(len(ratios)))


def ratios(lines: list[Line]) -> np.ndarray:
    """Text to tags of every line of the page, asides and menus too."""
    return np.array([x.length / max(1, x.tags) for x in lines])


def main_text(html: str | None, sigma: float = 1.0, share: float = 0.8) -> str:
    """The article of a page: its lines, white space as one space, joined by a line feed.

    Lines whose smoothed text-to-tag ratio is above ``share`` of its deviation are content, and runs of them the
    clusters. The cluster with most text, the first if several tie, is the main one, and the deepest element that holds at least half of it the
    core. Names of elements and classes only support that: lines in menus, headers, footers, sidebars, notices, adverts,
    forms and comments count in the ratios but are in no cluster, and an article or main element around
    the core bounds the text, all its other lines being kept, short ones too. Without one, content is what shares an element below
    the body with the core, or the main cluster alone if it stands in none; all lines of the core are kept, those of content
    outside it but thin ones at the ends of a run, and what lies between them.
    Null or empty html, or a page without text, gives an empty text.
    """
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser._end_line()
    lines = parser.lines()
    if not any(x.text for x in lines):
        return ""
    ratio = ratios(lines)
    smooth = smoothed(ratio, sigma)
    least = share * smooth.std()
    kept = np.array([bool(x.text) for x in lines])
    content = (smooth >= least) & kept
    content = content if content.any() else kept
    # Runs of content; what is out breaks them as thin lines do.
    run = np.cumsum(content & ~np.append(False, content[:-1])) * content
    size = np.array([len(x.text) for x in lines])
    main = run == np.argmax(np.bincount(run[content], weights=size[content]))
    held: dict[int, int] = {}
    for k in np.flatnonzero(main):
        for h in lines[k].holders:
            held[h] = held.get(h, 0) + int(size[k])
    core = max(h for h in held if 2 * held[h] >= size[main].sum())  # elements are numbered as they begin: the deepest
    around = next(x.holders for x in lines if core in x.holders)
    around = around[: around.index(core) + 1]
    if article := next((h for h in around if h in parser.articles), None):
        return "\n".join(x.text for x in lines if x.text and article in x.holders)
    inner = [h for h in around if h not in parser.bodies]
    own = np.array([bool(inner) and core in x.holders for x in lines])
    chosen = content & np.array([bool(inner) and inner[0] in x.holders for x in lines]) | main
    # Smoothing lifts thin lines beside dense ones: at the ends of a run they go, unless they are headings.
    firm = (ratio >= least) | own | np.array([x.heading for x in lines])
    for edge in (slice(None), slice(None, None, -1)):
        for k in np.flatnonzero(chosen[edge] & ~np.append(False, chosen[edge][:-1])):
            while k < len(lines) and chosen[edge][k] and not firm[edge][k]:
                chosen[edge][k] = False
                k += 1
    if (at := np.flatnonzero(chosen)).size:
        chosen[at[0] : at[-1] + 1] = True
    return "\n".join(lines[k].text for k in np.flatnonzero((chosen | own if at.size else main) & kept))


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with ``text``, the main text of each whole page, in place of a column of that name.

    Every row gives a row; null and empty html give an empty text; other columns pass through, of any type.
    Pages are independent, so a lost executor's pages are parsed again elsewhere.
    """
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(x) for x in batch], dtype="object")

    return pages.withColumn(text, of(F.col(html)))
