"""Main text of web pages by text-to-tag ratios.

The standard library's streaming parser turns a page into lines: a line is a block of text between two block-level tags. Each line
has a text-to-tag ratio (characters over tags); the ratios are smoothed with a Gaussian kernel and clustered into two by a
threshold. The content region is chosen by the text of the lines above the threshold: the article or main element that holds most of
it, which no text outside outvotes if it is the only one, or the only one with such lines. Where several have some, and more than ``OUTSIDE`` times the
best one's whole text stands outside of all of these above the threshold (teasers beside a text in plain divisions), or where none has,
it is the smallest element around the lines above the threshold there, and the articles with such lines stay beside it. All lines of the region are kept, in page order, but for those in elements that
are never content: menus, headers (but an article's own, and those in a main element that hold a heading), footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments. Outside of articles, where one part of the
page (an element right below the body that isn't a paragraph) has all lines above the threshold, lines below it in other parts go, but
for headings; where the lines above it stand in several parts, all stay. Menus that nothing names go as well: lines of links alone, no headings, outside the
smallest element around all other lines above the threshold (where that is the body itself, before the first and after the last of them).

Defined results: null or empty html, and pages without content, give an empty text; of two regions with as much text above the
threshold the first is taken; unclosed and stray tags, unfinished character references and tags at the end are read as browsers do;
time and memory grow in proportion to a page's length, however long; repeated rows each get a row; an empty table gives an empty
result; extra columns don't matter.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("head script style noscript template nav aside footer form button select textarea iframe object svg canvas dialog menu audio video".split())
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
REGION = frozenset(("article", "main"))
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
LOOSE = frozenset("p pre blockquote".split())
#: Elements whose start closes an open p.
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Names of noise, and what may stand beside them in one class; a class with any other part is not noise.
_REMARKS = "comments?|commentlist|disqus|reply|replies|responses"
_NAMES = (
    f"ads?|adverts?|advertisement|advertising|sponsor(?:ed|s)?|promo(?:tion)?|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|cookies?|consent|gdpr|notices?|banner|popup|modal|overlay|newsletter|subscribe|"
    f"{_REMARKS}|share|sharing|social|related|recommended|footer|masthead|toolbar|pagination|pager|login|signup"
)
_BESIDE = "site|page|main|global|top|bottom|left|right|primary|secondary|bar|box|buttons?|icons?|links?|list|items?|widget|wrapper|wrap|container|section|area|block|slot|unit|posts?|articles?|stories|form|thread|body|inner|outer|dialog|message"
_NOISE = re.compile(f"(?:(?:{_BESIDE})[_-]+)*(?:{_NAMES})(?:[_-]+(?:{_NAMES}|{_BESIDE}|[0-9]+))*", re.IGNORECASE)
_REMARK = re.compile(f"(?:(?:{_BESIDE})[_-]+)*(?:{_REMARKS})(?:[_-]+(?:{_REMARKS}|{_BESIDE}|[0-9]+))*", re.IGNORECASE)
_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_SPACE = re.compile(r"\s+")
#: How many times the best of several articles' text must stand above the threshold outside of all for that to be the region.
OUTSIDE = 2.0


def _named(tag: str, attrs: list[tuple[str, str | None]]) -> re.Pattern[str] | None:
    """The pattern (of remarks, or else of noise) that a class or the id matches as a whole; headings, and ids of inline elements and paragraphs, are never noise."""
    if tag in ("html", "body") or tag in HEADING:
        return None
    names = [n for name, value in attrs if value and (name == "class" or name == "id" and tag not in INLINE and tag != "p") for n in value.split()]
    if any(map(_REMARK.fullmatch, names)):
        return _REMARK
    return _NOISE if tag not in REGION and any(map(_NOISE.fullmatch, names)) else None


class _Lines(HTMLParser):
    """Collects text, number of tags, region, elements around it, whether it is a menu's (links alone, no heading) and whether it is in no part of the page (a heading, or a paragraph right below the body) for each line.

    Region 0 is the page outside any article or main element.
    """

    def __init__(self, cleared: frozenset[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, tuple[int, ...], bool, bool]] = []
        self.open: list[tuple[str, bool, int, int, tuple[int, ...] | None]] = []  # tag, never content, region, number of the element, named elements around it (None: never content for another reason)
        self.elements = 0
        self.cleared = cleared  # named elements that are content all the same
        self.remarks: set[int] = set()  # named elements, of remarks
        self.holds: dict[int, set[str]] = {}  # article and main in each named element
        self.weight: dict[int, int] = {}  # characters in each
        self.free = 0  # characters outside of them
        self.named = 0  # characters in any of them
        self.parts: list[str] = []
        self.plain = False  # the line has text outside of links
        self.tags = 0
        self.regions = 0
        self.mains: set[int] = set()  # regions of main elements; an article in one is a region of its own
        self.headers: set[int] = set()  # header elements in a main element, outside of any article
        self.titled: set[int] = set()  # those of them that hold a heading

    def _state(self) -> tuple[bool, int]:
        return (self.open[-1][1], self.open[-1][2]) if self.open else (False, 0)

    def end_line(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip() if self.parts else ""
        self.parts = []
        if text:
            around = tuple(x[3] for x in self.open if x[0] not in INLINE and x[0] not in ("html", "body"))
            heading = any(x[0] in HEADING for x in self.open)
            loose = heading or not around or len(around) == 1 and any(x[0] in LOOSE for x in self.open)
            self.lines.append((text, self.tags, self._state()[1], around, not self.plain and not heading, loose))
            self.tags = 0
        self.plain = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in INLINE:
            if tag == "br":
                self.parts.append(" ")
            if tag in VOID:
                return
        else:
            self.end_line()
            if tag in CLOSES_P:
                self._close("p", CLOSES_P - {"p"})
            elif tag == "li":
                self._close("li", frozenset(("ul", "ol", "menu")))
            elif tag in VOID:
                return
        never, region = self._state()
        marks = self.open[-1][4] if self.open else ()
        self.elements += 1
        if marks is not None:
            dropped = tag in NEVER or (tag == "header" and not region)
            for name, value in attrs:
                if name == "role" and value in _ROLE or name == "hidden" or name == "aria-hidden" and value == "true":
                    dropped = True
            named = None if dropped or self.elements in self.cleared else _named(tag, attrs)
            if named:
                marks = (*marks, self.elements)
                if named is _REMARK:
                    self.remarks.add(self.elements)
            elif tag in REGION and not dropped:
                for m in marks:
                    self.holds.setdefault(m, set()).add(tag)
            if dropped:
                marks = None
            elif tag == "header" and region in self.mains:
                self.headers.add(self.elements)
            elif tag in HEADING and self.headers:
                self.titled.update(self.headers.intersection(x[3] for x in self.open))
            never = marks != ()
        if tag in REGION and not never and (not region or tag == "article" and region in self.mains):
            self.regions += 1
            region = self.regions
            if tag == "main":
                self.mains.add(region)
        self.open.append((tag, never, region, self.elements, marks))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # as in HTML, the slash alone doesn't close an element

    def _close(self, tag: str, within: frozenset[str]) -> None:
        """Drop the innermost open ``tag`` and what is open in it, unless one of ``within`` stands between."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return
            if self.open[k][0] in within:
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag not in INLINE:
            self.end_line()
        if any(x[0] == tag for x in reversed(self.open)):
            if tag in INLINE:  # a stray inline end tag doesn't close the blocks around it
                self._close(tag, CLOSES_P | {"li", "td", "th", "body"})
            else:
                self._close(tag, frozenset())

    def contents(self) -> frozenset[int]:
        """Named elements that are no noise: where no article or main stands outside of them, those that hold a main, most of the text, or an article and more text than stands outside."""
        remarks = sum(self.weight.get(m, 0) for m in self.remarks)
        total = self.free + self.named - remarks
        found = set()
        for m in (self.weight.keys() | self.holds.keys()) - self.remarks:
            held, weight = self.holds.get(m, ()), self.weight.get(m, 0)
            if not self.regions and ("main" in held or 2 * weight > total or "article" in held and weight > self.free):
                found.add(m)
        return frozenset(found)

    def handle_data(self, data: str) -> None:
        marks = self.open[-1][4] if self.open else ()
        if marks is not None:
            n = len(data.strip())
            if marks:
                self.named += n
                # what stands in remarks counts for these alone
                for m in set(marks) & self.remarks or marks:
                    self.weight[m] = self.weight.get(m, 0) + n
            else:
                self.free += n
        if not self._state()[0]:
            self.parts.append(data)
            if not self.plain and not data.isspace() and all(x[0] != "a" for x in self.open):
                self.plain = True


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines, weights renormalised at the ends."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / weight


def threshold(values: np.ndarray, rounds: int = 30) -> float:
    """Two clusters on a line: the cut half-way between the clusters' means."""
    cut = float(values.mean())
    for _ in range(rounds):
        above = values >= cut
        if above.all() or not above.any():
            break
        new = float((values[above].mean() + values[~above].mean()) / 2)
        if new == cut:
            break
        cut = new
    return cut


def extract(html: str | None, sigma: float = 1.0) -> str:
    """The page's main text, one line a block."""
    if not html:
        return ""
    page = _Lines()
    page.feed(html)
    page.close()
    cleared = page.contents()
    if cleared:
        page = _Lines(cleared)
        page.feed(html)
        page.close()
    page.end_line()
    lines = page.lines
    if not lines:
        return ""
    untitled = page.headers - page.titled
    if untitled:
        lines = [x for x in lines if untitled.isdisjoint(x[3])]
        if not lines:
            return ""
    region = np.fromiter((x[2] for x in lines), np.int64, len(lines))
    chars = np.fromiter((len(x[0]) for x in lines), float, len(lines))
    tags = np.fromiter((x[1] for x in lines), float, len(lines))
    ratio = smoothed(chars / np.maximum(1, tags), sigma)
    content = ratio >= threshold(ratio)
    # what lies below the threshold only decides where nothing lies above
    weight = np.bincount(region, chars * (content + 1e-6), page.regions + 1)
    if region.any():
        best = int(weight[1:].argmax()) + 1
        with_content = np.flatnonzero(np.bincount(region, content, page.regions + 1)[1:]) + 1
        alone = page.regions == 1 and not all(x[4] for x, r in zip(lines, region, strict=True) if r)
        if alone or len(with_content) == 1 or weight[0] <= OUTSIDE * chars[region == best].sum():
            return "\n".join(x[0] for x in lines if x[2] == best)
        # articles without a line above the threshold are teasers
        real = (np.bincount(region, content, page.regions + 1) > 0)[region] | (region == 0)
        lines, content, region = [x for x, r in zip(lines, real, strict=True) if r], content[real], region[real]
    menu = np.fromiter((x[4] for x in lines), bool, len(lines))
    outside = content & (region == 0)
    at = np.flatnonzero(outside & ~menu if (outside & ~menu).any() else outside if outside.any() else content)
    inside = [lines[k][3][:-1] for k in at]
    common = os.path.commonprefix(inside)
    within = [x[3][: len(common)] == common if common else at[0] <= k <= at[-1] for k, x in enumerate(lines)]
    # outside of the page's part that has the text only what lies above the threshold is content, headings, and whole articles with such lines
    part = common[:1]
    return "\n".join(x[0] for x, w, c in zip(lines, within, content, strict=True) if w or x[2] or not x[4] and (c or x[5] or x[3][: len(part)] == part))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row; html is read whole."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h.as_py()) for h in b.column("html")]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(each, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
