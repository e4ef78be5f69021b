"""Main text of web pages.

Events of the standard-library HTML parser become lines (blocks of text) with
their tags. The text-to-tag ratio of each line, weighted by what its elements
and their class words say, is smoothed with a Gaussian and clustered in two by
a threshold (Weninger, Hsu and Han, 2010). Lines in the upper cluster by their
own and by the smoothed ratio are content; the regions that they select bring
along their headings and short lines.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: HTML elements by role
SILENT = {"head", "title", "script", "style", "noscript", "template", "svg", "math", "iframe", "object", "select",
          "textarea", "button", "datalist", "canvas", "audio", "video", "map"}
ASIDE = {"nav", "header", "footer", "aside", "menu", "dialog"}
FORMS = {"form", "fieldset"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
          "ins", "kbd", "label", "mark", "meter", "output", "progress", "q", "rp", "rt", "ruby", "s", "samp", "small",
          "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: blocks that authors leave open; they bound lines but hold no region
LEAVES = {"p", "li", "dt", "dd", "tr", "td", "th", "option", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "thead",
          "tbody", "tfoot", "caption", "figcaption", "summary", "legend", "address", "body", "html"}
#: words of a class, id or role that speak against a line
MARKS = frozenset("""
ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion
nav navbar navigation menu breadcrumb breadcrumbs sidebar aside complementary widget toolbar
header masthead topbar footer contentinfo copyright legal
cookie cookies consent gdpr notice notification alert popup modal overlay dialog newsletter subscribe subscription
paywall signup login
comment comments commentlist discussion disqus respond replies reviews
share sharing social related recommended recommendations teaser teasers pagination pager tags search hidden
""".split())
#: words that speak against it more, also around an element that announces an article
FIRM = frozenset({"ad", "ads", "advert", "advertisement", "comment", "comments", "discussion", "disqus", "replies",
                  "related", "recommended", "recommendations", "teaser", "teasers"})
#: words of the article itself; its own header is no page header
BODY_MARKS = frozenset({"article", "main", "content", "post", "entry", "story", "articlebody"})
#: how a line stands by its elements; APART: in a form or what is not shown, never content
_FREE, _MARKED, _FIRM, _APART = range(4)
#: weights of the ratio for the first three, and for a free line of an announced article
_WEIGHTS, _ANNOUNCED = np.array([1.0, 1 / 8, 1 / 32, 0.0]), 8.0
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_OPEN_END = re.compile(r"<[A-Za-z/!?][^<>]*\Z|<\Z")


def _names(attrs: list[tuple[str, str | None]]) -> set[str]:
    found: set[str] = set()
    for key, value in attrs:
        if key in ("class", "id", "role") and value:
            found.update(w.lower() for w in _NAME.findall(value))
    return found


class Page(HTMLParser):
    """Lines of a page and the elements around them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # element, how its lines stand, region
        self.stack: list[tuple[str, int, int]] = [("", _FREE, 0)]
        self.parents = [-1]  # enclosing region of each region
        self.kinds = [""]  # "article" for the elements that announce one
        # text, tags, region, how it stands, characters of links, in a first-level heading
        self.lines: list[tuple[str, int, int, int, int, bool]] = []
        self.parts: list[str] = []
        self.tags = 0
        self.links = 0  # open links
        self.linked = 0  # characters in them since the line began
        self.heading = False
        self.silent = 0

    def end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts.clear()
            if text:
                _, stands, region = self.stack[-1]
                self.lines.append((text, self.tags, region, stands, self.linked, self.heading))
                self.tags = self.linked = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        self.links += tag == "a"
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in VOID:
            if tag == "hr":
                self.end_line()
            return
        if tag in SILENT:
            self.stack.append((tag, _APART, self.stack[-1][2]))
            self.silent += 1
            return
        if tag in ("body", "article", "main") and self.silent:  # a head or the like was left open
            while self.silent:
                self._pop()
        if tag in LEAVES and self.stack[-1][0] == tag:  # the one before was left open
            self.end_line()
            self._pop()
        if tag in LEAVES:
            self.end_line()
            self.heading = tag == "h1"
        if tag in ("html", "body") or tag in LEAVES and not attrs:
            self.end_line()
            return
        names = _names(attrs) if attrs else set()
        within = self._in_article()
        marks = names & MARKS
        if within or names & BODY_MARKS:
            marks -= {"header"}
        mark = _FIRM if marks & FIRM else _MARKED if marks else _FREE
        if tag in INLINE:
            if mark:
                self.end_line()
                self.stack.append((tag, max(mark, self.stack[-1][1]), self.stack[-1][2]))
            return
        self.end_line()
        announces = not mark and (tag in ("article", "main") or "main" in names or "articlebody" in names)
        if announces:  # never inside a menu: one was left open
            for k, (name, _, _) in enumerate(self.stack):
                if name in ("nav", "form"):
                    del self.stack[k:]
                    break
        _, stands, region = self.stack[-1]
        if announces and stands == _MARKED:  # a wrapper named after another part of the page
            stands = _FREE
        if tag in FORMS or any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs):
            mark = _APART
        elif tag in ASIDE and not (tag == "header" and within):
            mark = _FIRM
        stands = max(stands, mark)
        if tag in LEAVES:
            if stands > self.stack[-1][1]:  # until its end tag, or the next one of its kind
                self.stack.append((tag, stands, region))
            return
        if stands < _APART:
            self.parents.append(region)
            self.kinds.append("article" if announces else tag)
            region = len(self.parents) - 1
        self.stack.append((tag, stands, region))

    def _in_article(self) -> bool:
        region = self.stack[-1][2]
        while region > 0:
            if self.kinds[region] == "article":
                return True
            region = self.parents[region]
        return False

    def _pop(self) -> None:
        if self.stack.pop()[0] in SILENT:
            self.silent -= 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:  # HTML ignores the slash
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        self.links = max(0, self.links - (tag == "a"))
        if tag not in INLINE and tag not in SILENT:
            self.end_line()
            self.heading = False
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                while len(self.stack) > k:
                    self._pop()
                return
            if tag in INLINE and self.stack[k][0] not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())

    def close(self) -> None:
        super().close()
        self.end_line()


def smooth(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing along the lines; the ends keep their own weight."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[reach:-reach]
    return np.convolve(ratios, kernel)[reach:-reach] / weight


def content_cluster(values: np.ndarray) -> np.ndarray:
    """Values (logarithms of 1 and a ratio) of the upper of two clusters: the
    threshold that leaves the least squared deviation from the cluster means.
    The page's ends, where there is no text, are two more values of zero; less
    than a character for each tag is never content."""
    ends = np.sort(np.concatenate((values, [0.0, 0.0])))
    n = np.arange(1, len(ends))
    sums = np.cumsum(ends)
    within = -(sums[:-1] ** 2 / n + (sums[-1] - sums[:-1]) ** 2 / (len(ends) - n))  # less a constant
    return (values >= ends[1:][np.argmin(within)]) & (values >= np.log(2.0))


def content_lines(page: Page, sigma: float) -> np.ndarray:
    """Which lines of a page are its main text."""
    texts, tags, regions, stands, linked, headings = zip(*page.lines)
    sizes, regions, stands = np.array([len(t) for t in texts], float), np.array(regions), np.array(stands)
    announced = np.zeros(len(page.parents), int)  # region of the announced article around a region (0: none)
    for r in range(1, len(page.parents)):
        announced[r] = announced[page.parents[r]] or (r if page.kinds[r] == "article" else 0)
    weights = np.where((stands == _FREE) & (announced[regions] > 0), _ANNOUNCED, _WEIGHTS[stands])
    if weights.max() == _WEIGHTS[_MARKED]:  # where all lines are marked, marks say nothing
        weights /= weights.max()
    free = weights >= 1
    ratios = weights * sizes / np.maximum(1, np.array(tags))
    by_own, by_smooth = content_cluster(np.log1p(ratios)), content_cluster(np.log1p(smooth(ratios, sigma)))
    seeds = by_own & by_smooth & (weights > 0)
    if not seeds.any():
        seeds = free & (np.array(linked) < 0.5 * sizes)
    if not seeds.any():
        return seeds
    # free lines of the regions that content selects, and of announced articles around it
    chosen = np.zeros(len(page.parents), bool)
    chosen[regions[seeds & free]] = True
    articles = np.zeros(len(page.parents), bool)
    articles[announced[regions[seeds]]] = True
    articles[0] = False
    content = seeds | free & (chosen[regions] | articles[announced[regions]])
    if not articles.any():
        # free lines between content that are no links (lists, short parts), and nothing before the page's main heading
        first, last = np.flatnonzero(content)[[0, -1]]
        place = np.arange(len(texts))
        content |= free & (place > first) & (place < last) & (np.array(linked) < 0.5 * sizes)
        titles = np.flatnonzero(content & np.array(headings))
        if len(titles):
            before = content & (place < titles[0])
            if sizes[before].sum() < sizes[content & ~before].sum():
                content &= ~before
    return content


def main_text(html: str | None, sigma: float = 1.5) -> str:
    """Article text of a page: its blocks, white space folded, joined by one
    space. Null, empty and text-free pages give an empty string."""
    if not html:
        return ""
    page = Page()
    page.feed(_OPEN_END.sub("", html))
    page.close()
    if not page.lines:
        return ""
    return " ".join(line[0] for line, kept in zip(page.lines, content_lines(page, sigma)) if kept)


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (code points) of every page in
    place of ``html``; other columns pass, columns of those two names are
    replaced, repeated rows stay. A projection: no shuffle."""

    @F.pandas_udf("string")
    def text_of(column):
        return column.map(main_text, na_action=None)

    out = pages.withColumn("text", text_of(F.col(html)))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).drop(html)
