"""Main text of web pages from a stream of parser events and the text-to-tag ratio of lines.

The standard library's parser reports tags and text.  They make *lines*, the runs of text between tags that
begin or end a block, each with the number of tags it takes and the block elements it stands in.  Lines in
elements that are named for something else (menus, headers, forms, ...) are out.  The ratio of characters to
tags of the others is smoothed by a Gaussian along the page, and lines at or above one standard
deviation of it are content.  Content lines choose the regions of the page, which are taken whole, since short paragraphs of an
article don't reach the threshold by themselves.

A page is judged on its own, so the work needs no shuffle and runs where the pages are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from halocline.llm.frames import pick

SIGMA = 1.0  # of the smoothing, in lines
THRESHOLD = 1.0  # of the content, in standard deviations of the smoothed ratio
PAGES_PER_PIECE = 256

# Elements of HTML that begin and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section summary table tbody td tfoot th thead title tr ul".split()
)
# Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Block elements that a start tag ends, and those that shield them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select", "optgroup"}),
    "body": ({"head"}, {"body"}),
}
# Elements that hold no text of the article, whatever their names say.
OUT = frozenset(
    "head title script style noscript template svg nav aside footer form button select textarea dialog menu iframe object "
    "canvas search".split()
)
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
# Words in a class or id that tell the same.
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices notification popup modal sidebar sidebars nav navigation navbar menu menus breadcrumb breadcrumbs header masthead "
    "footer copyright comment comments commentlist disqus discussion respond replies share sharing social related recommended "
    "newsletter subscribe subscription signup login pagination pager toolbar".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
ROOTS = frozenset(("", "html", "body"))
# kinds of elements
PLAIN, EXCLUDED, HEADER, ARTICLE = range(4)


@lru_cache(maxsize=4096)
def _named_out(names: str) -> bool:
    """Whether a class or an id says that its element isn't the article."""
    for name in names.split():
        words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
        if words and words[0] not in ("has", "with", "no", "without") and not OUT_WORDS.isdisjoint(words):
            return True
    return False


class _Element:
    """A block element; what it holds is filled in when the page has ended."""

    __slots__ = ("tag", "kind", "parent", "open", "out", "article", "holder", "size", "content", "peak", "whole")

    def __init__(self, tag: str, kind: int, parent: _Element | None):
        self.tag, self.kind, self.parent, self.open = tag, kind, parent, True
        self.out, self.article, self.holder = False, None, None
        self.size = self.content = 0
        self.peak = self.whole = False


class Lines(HTMLParser):
    """The lines of a page: (text, tags, characters in links, element) each, and its elements, parents first."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, _Element]] = []
        self.top = _Element("", PLAIN, None)
        self.elements = [self.top]
        self.standing: Counter[str] = Counter()  # open elements by tag
        self.words: list[str] = []
        self.tags = self.links = self.linked = 0

    def _end_line(self) -> None:
        if self.words:
            text = " ".join("".join(self.words).split())
            if text:
                self.lines.append((text, max(1, self.tags), self.linked, self.top))
            self.words = []
            self.tags = self.linked = 0

    def _pop_to(self, element: _Element) -> None:
        end = element.parent
        while self.top is not end:
            self.top.open = False
            self.standing[self.top.tag] -= 1
            self.top = self.top.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        block = tag in BLOCKS
        if not block and tag not in OUT:
            if tag == "a":
                self.links += 1
            elif tag == "br":
                self.words.append(" ")
            return
        self._end_line()
        if block:
            if self.top.tag == "p":
                self._pop_to(self.top)
            if tag in ENDS and any(self.standing[t] for t in ENDS[tag][0]):
                mine, shields = ENDS[tag]
                at, found = self.top, None
                while at.parent is not None and at.tag not in shields:
                    if at.tag in mine:
                        found = at
                    at = at.parent
                if found:
                    self._pop_to(found)
        if tag not in VOID:
            self.top = _Element(tag, _kind(tag, attrs), self.top)
            self.elements.append(self.top)
            self.standing[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # in HTML a slash at the end of a start tag means nothing
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag not in BLOCKS and tag not in OUT:
            if tag == "a" and self.links:
                self.links -= 1
            return
        self._end_line()
        if self.standing[tag]:
            at = self.top
            while at.tag != tag:
                at = at.parent
            self._pop_to(at)

    def handle_data(self, data: str) -> None:
        self.words.append(data)
        if self.links:
            self.linked += len(data)

    def close(self) -> None:
        super().close()
        self._end_line()


def _kind(tag: str, attrs: list[tuple[str, str | None]]) -> int:
    named = False
    role = ""
    for name, value in attrs:
        if value and name in ("class", "id"):
            named = named or _named_out(value)
        elif value and name == "role":
            role = value.strip().lower()
    if tag in ("html", "body"):
        return PLAIN
    if tag in OUT or role in OUT_ROLES:
        return EXCLUDED
    if tag == "main" or role == "main":
        return ARTICLE
    if tag == "header" or named and tag not in HEADINGS:
        return HEADER if tag == "header" else EXCLUDED
    return ARTICLE if tag == "article" or role == "article" else PLAIN


def lines_of(html: str) -> Lines:
    """A page read to its end, with every element's ``out`` and the outermost ``article`` it stands in."""
    page = Lines()
    page.feed(html)
    page.close()
    for e in page.elements[1:]:
        up = e.parent
        # the innermost excluded element or header that the element is or stands in
        e.out, e.article, e.holder = up.out, up.article, up.holder if e.kind in (PLAIN, ARTICLE) else e
        if e.kind == ARTICLE:
            # an excluded element that the page never ends gives way to an article in it
            e.out = e.out and not e.holder.open
            e.article = e if e.article is None or up.out else e.article
        elif e.kind != PLAIN:
            e.out = True
        elif e.tag in HEADINGS and e.out and e.holder.kind == HEADER and not e.holder.parent.out:
            # of a header inside an article the headings stay
            e.out = e.holder.parent.article is None
    return page


def content_lines(ratios: np.ndarray, sigma: float = SIGMA, threshold: float = THRESHOLD) -> tuple[np.ndarray, float]:
    """Which lines reach ``threshold`` standard deviations of the smoothed ratio, and that cut; the largest always does."""
    if not len(ratios):
        return np.zeros(0, bool), 0.0
    reach = max(1, int(np.ceil(2 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    smooth = np.convolve(ratios, kernel)[reach:-reach] / np.convolve(np.ones(len(ratios)), kernel)[reach:-reach]
    cut = min(threshold * smooth.std(), smooth.max())
    return smooth >= cut, float(cut)


def _regions(elements: list[_Element], lines: list[tuple[str, int, int, _Element]], ratios: np.ndarray, content: np.ndarray, cut: float) -> list[bool]:
    """Lines of the regions that hold content, for a page that doesn't say where its article is.

    A block is a region if most of its text is content and a line of it reaches the cut by itself, not by its neighbours alone.
    Otherwise, and for the body itself, its parts are judged one by one, and of the lines directly in it those from the
    first to the last content line count.  Lists of links are no content.
    """
    linked = np.array([2 * x[2] >= len(x[0]) for x in lines], bool)
    content = content & ~linked
    peaks = content & (ratios >= cut)
    holders = []
    for (text, _, _, e), c, p in zip(lines, content, peaks):
        # a paragraph or heading belongs to the block around it
        e = e.parent if e.tag in HEADINGS or e.tag in ("p", "pre", "blockquote") else e
        e.size, e.content, e.peak = e.size + len(text), e.content + len(text) * bool(c), e.peak or bool(p)
        holders.append(e)
    for e in reversed(elements[1:]):
        up = e.parent
        up.size, up.content, up.peak = up.size + e.size, up.content + e.content, up.peak or e.peak
    for e in elements[1:]:
        e.whole = e.parent.whole or e.tag not in ROOTS and e.peak and 2 * e.content >= e.size
    kept = [e.whole for e in holders]
    own: dict[_Element, list[int]] = {}
    for i, e in enumerate(holders):
        if not e.whole:
            own.setdefault(e, []).append(i)
    for rows in own.values():
        hits = [i for i in rows if content[i]]
        if hits and peaks[rows].any():
            for i in rows:
                kept[i] = bool(hits[0] <= i <= hits[-1] or lines[i][3].tag in HEADINGS) and not linked[i]
    return kept


def main_text(html: str | None, sigma: float = SIGMA, threshold: float = THRESHOLD) -> str:
    """The blocks of a page's article, white space in each made one space, joined by line breaks.

    Null, empty pages and pages without text of their own give an empty text.  Where elements say that they are the article, those
    that hold content are taken whole; elsewhere the regions are found by the ratio alone.  A page cut short or with
    unended elements is read as far as it goes.
    """
    if not html:
        return ""
    page = lines_of(html)
    lines = [x for x in page.lines if not x[3].out]
    in_articles = [x for x in lines if x[3].article is not None]
    lines = in_articles or lines
    ratios = np.array([len(x[0]) / x[1] for x in lines], float)
    content, cut = content_lines(ratios, sigma, threshold)
    if in_articles:
        chosen = {x[3].article for x, c in zip(lines, content) if c}
        kept = [x[3].article in chosen for x in lines]
    else:
        kept = _regions(page.elements, lines, ratios, content, cut)
    return "\n".join(x[0] for x, k in zip(lines, kept) if k)


def extract_main_text(pages: DataFrame, sigma: float = SIGMA, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; further columns of ``pages`` don't matter.

    A null html is an empty page; null or repeated ids and urls are passed on, one row for each row; an empty table gives no rows.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES_PER_PIECE):
                piece = batch.slice(at, PAGES_PER_PIECE)
                texts = [main_text(h, sigma, threshold) for h in piece.column("html").to_pylist()]
                sizes = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    rows = pick(pages, "page_id", "url", "html")
    id_type = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(extract, f"page_id {id_type}, url string, text string, n_chars long")
