"""Main text of web pages: parser events, text-to-tag ratio per line, smoothing, clustering."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyrisk.llm.common import text_slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that run on inside a line of text.
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that are never part of an article.
DROPPED = frozenset("head script style noscript template nav footer aside form iframe object svg canvas button select textarea dialog menu audio video map".split())
MAIN = frozenset(("article", "main"))
#: An open element of these ends when the next one of the same list starts.
SIBLINGS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Where the search for an open sibling stops.
SCOPE = frozenset("ul ol dl table div section article main body aside nav footer header form td th blockquote".split())
#: Words of class, id and role that name other things than the article.
BOILER = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar sidenav rail footer masthead topbar toolbar comment comments commentlist disqus discussion replies reply respond cookie cookies consent gdpr notice notices alert alerts popup modal overlay "
    "newsletter subscribe subscription signup login search share sharing social related recommended recommendations widget widgets pagination pager skip contentinfo complementary hidden".split()
)
COMMENTS = frozenset("comment comments commentlist disqus discussion replies reply respond".split())
#: Names that an article's own sections have as well; inside an article the clusters decide on them.
DOUBTFUL = frozenset("discussion alert alerts".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


#: What a line lies in outside of all elements.
NOTHING = ("", False, False, 0, 0, False)


class Lines(HTMLParser):
    """Turns a page's events into lines: [text parts, tags, boilerplate?, main element or 0, element, doubtful?]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[list] = []
        self.open: list[tuple[str, bool, bool, int, int, bool]] = []  # tag, drops, marks a comment, main, element, doubtful
        self.held: Counter[str] = Counter()  # tags in ``open``
        #: Parent and tag of each element that is not inline, in the page's order; 0 is the page.
        self.parents, self.tags = [0], [""]
        self.fresh()
        self.mains = 0

    def fresh(self) -> None:
        top = self.open[-1] if self.open else NOTHING
        if self.lines and not self.lines[-1][0]:
            self.lines[-1][2:] = [top[1], *top[3:]]
        else:
            self.lines.append([[], 0, top[1], *top[3:]])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ENDS_P:
            self._end(("p",))
        if tag in SIBLINGS:
            self._end(SIBLINGS[tag])
        top = self.open[-1] if self.open else NOTHING
        names: set[str] = set()
        gone = False
        for key, value in attrs:
            if key in ("class", "id", "role") and value:
                names.update(w.lower() for w in _WORDS.findall(value))
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and value and "display:none" in value.replace(" ", "").lower()):
                gone = True
        main, doubtful = top[3], top[5]
        if main and names & DOUBTFUL:
            names, doubtful = names - DOUBTFUL, True
        remark = top[2] or bool(names & COMMENTS)
        drops = top[1] or gone or tag in DROPPED or (bool(names & BOILER) and tag not in ("html", "body"))
        if tag == "header" and not main:
            drops = True
        if (tag in MAIN or "main" in names and tag in ("div", "section")) and not remark and not gone:
            # An article counts even below an advert that was never closed.
            drops = bool(names & BOILER)
            if not main and not drops:
                self.mains += 1
                main = self.mains
        if tag not in VOID:
            element = top[4]
            if tag not in INLINE:
                self.parents.append(element)
                self.tags.append(tag)
                element = len(self.tags) - 1
            self.open.append((tag, drops, remark, main, element, doubtful))
            self.held[tag] += 1
        if tag not in INLINE:
            self.fresh()
        self.lines[-1][1] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # <![ and a word that no standard has: skipped to the next >
            return self.parse_bogus_comment(i)

    def _close(self, k: int) -> None:
        for element in self.open[k:]:
            self.held[element[0]] -= 1
        del self.open[k:]

    def _end(self, tags: tuple[str, ...]) -> None:
        if not any(self.held[t] for t in tags):
            return
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k][0]
            if name in tags:
                self._close(k)
                return
            if name in SCOPE:
                return

    def handle_endtag(self, tag: str) -> None:
        if self.held[tag]:
            k = len(self.open) - 1
            while self.open[k][0] != tag:
                k -= 1
            self._close(k)
        if tag not in INLINE:
            self.fresh()
        self.lines[-1][1] += 1

    def handle_data(self, data: str) -> None:
        if not data.isspace() or self.lines[-1][0]:
            top = self.open[-1] if self.open else NOTHING
            if not self.lines[-1][0]:
                self.lines[-1][2:] = [top[1], *top[3:]]
            if not top[1]:
                self.lines[-1][0].append(data)
                self.lines[-1][2] = False


def smooth(ratios: np.ndarray, sigma: float) -> np.ndarray:
    reach = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def clusters(ratios: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """(lines in content, lines that are content by their own ratio as well).

    Content is where the smoothed ratio is over a threshold between two
    cluster means; smoothing takes in short lines beside long ones.
    """
    smoothed = smooth(ratios, sigma)
    threshold = smoothed.std()
    for _ in range(20):
        high, low = smoothed[smoothed > threshold], smoothed[smoothed <= threshold]
        if not len(high) or not len(low):
            break
        moved = 0.25 * (high.mean() + 3 * low.mean())
        if abs(moved - threshold) < 1e-9:
            break
        threshold = moved
    content = smoothed > threshold if (smoothed > threshold).any() else np.ones(len(ratios), bool)
    return content, content & (ratios > threshold)


def region(parser: Lines, kept: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Which lines lie in the article of a page without article or main elements.

    The article is the smallest element around all content lines.  It grows
    to its parent while it holds one line only, and, if it holds no heading
    before the content, to the smallest element around that does.
    """
    parents, where = parser.parents, np.array([line[4] for line in parser.lines])
    last = list(range(len(parents)))  # elements are numbered in the page's order
    for e in range(len(parents) - 1, 0, -1):
        last[parents[e]] = max(last[parents[e]], last[e])

    def inside(e: int) -> np.ndarray:
        return (where >= e) & (where <= last[e])

    lines, first = where[content], int(np.flatnonzero(content)[0])
    e, end, held = int(lines.min()), int(lines.max()), np.sort(where[kept])
    heads = [int(where[i]) for i in np.flatnonzero(kept[:first]) if parser.tags[where[i]] in HEADINGS]
    while e and (last[e] < end or np.searchsorted(held, last[e], "right") - np.searchsorted(held, e) < 2):
        e = parents[e]
    while e and heads and not any(e <= h <= last[e] for h in heads):
        e = parents[e]
    return inside(e)


def main_text(html: str, sigma: float = 1.0) -> str:
    """The article of one page ("" if there is none).

    A line's ratio is its text length over its tags (lines of menus, adverts,
    comments and the like count as no text).  The ratios are smoothed and cut
    into content and other lines.  Content lines choose the regions: the
    article or main elements that long ones lie in, or, on a page without such, the
    element around them all (see :func:`region`).  Of a chosen region every
    line is kept, short ones too, but for the boilerplate inside it; sections
    whose name an article's own may have keep their content lines.  A page
    that the parser can't read to its end is taken as far as it goes.
    """
    parser = Lines()
    try:
        parser.feed(html)
        parser.close()
    except AssertionError:
        pass
    texts = [" ".join("".join(line[0]).split()) for line in parser.lines]
    ratios = np.array([0.0 if line[2] else len(t) / max(line[1], 1) for t, line in zip(texts, parser.lines, strict=True)])
    if not ratios.any():
        return ""
    content, core = (mask & (ratios > 0) for mask in clusters(ratios, sigma))
    if not content.any():
        content = ratios > 0
    regions = {parser.lines[i][3] for i in np.flatnonzero(core if core.any() else content)} - {0}
    if not regions and parser.mains:
        regions = {line[3] for line, r in zip(parser.lines, ratios, strict=True) if r} - {0}
    if regions:
        return " ".join(t for t, line, c in zip(texts, parser.lines, content, strict=True) if t and not line[2] and line[3] in regions and (c or not line[5]))
    kept = np.array([bool(t) and not line[2] for t, line in zip(texts, parser.lines, strict=True)])
    return " ".join(texts[i] for i in np.flatnonzero(kept & region(parser, kept, content)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sigma: float = 1.0) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``; see :func:`main_text`.

    Null or empty html gives an empty text.  Rows are independent: repeated
    rows repeat, any order and any length will do, and other columns are
    ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "html"):
            texts = [main_text(h, sigma) for h in pc.fill_null(part.column("html"), "").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
