"""Main text of web pages from streaming parser events.

The parser hands over tags and text as it meets them. Text gathers in lines (blocks); each line counts its characters
outside links by its tags, the text-to-tag ratio. Along the page the ratio is smoothed by a Gaussian, and lines above a
threshold form clusters. The content region is then found from the top of the page: as long as one part holds nearly all of
the clusters' text, weighed by its smoothed ratio, the region narrows to that part. Of the region every line is kept, short
ones too, so nothing of an article is lost to the smoothing, but for parts without a clustered line that are links for the
most part (menus).

What a page says about its parts is a signal beside the ratio: lines within article or main weigh more, and parts whose tag,
role or name says that they are no article (a comment section has the ratio of an article) are left out. Neither is needed:
``signals=False`` goes by the ratio alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEED = 64 << 10
#: Width of the smoothing in lines; what the rest may hold, beside one part, for the region to narrow to that part; the weight
#: of lines within a landmark; the share of link characters from which a part is a menu.
SIGMA, REST, LANDMARK, LINKS = 0.6, 0.25, 3.0, 0.7
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Never text of a page.
CODE = frozenset("script style noscript template svg math iframe object canvas audio video head title select textarea button".split())
#: Parts that say of themselves that they are no article.
ASIDE = frozenset("nav aside footer form dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar form".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|newsletter|subscribe|signup|popup|modal|overlay|"
    r"side-?bar|nav\w*|menu|breadcrumbs?|pagination|pager|foot(?:er)?|site-?header|page-?header|masthead|top-?bar|toolbar|"
    r"comments?|comment-?list|respond|disqus\w*|replies|share|sharing|social|related|recommend\w*|widget|login|search)(?:$|[\s_-])"
)
#: An open paragraph ends where one of these begins.
ENDS_P = BLOCK - {"body", "html", "head", "title", "option", "optgroup", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: Elements whose end is left out: what begins anew ends the last of these, unless a list or table began since.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table", "tbody", "thead", "tfoot")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
#: The region never narrows into one of these.
FINE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote span b i em strong a u s small big font".split())
SPACE = re.compile(r"\s+")


class Lines(HTMLParser):
    """Collects lines as [text parts, tags, characters in links, innermost element]. Elements are numbered as they open; 0 is
    the page. What an end tag closes is found from the places of open tags, so the work is linear in the page, however deep
    it nests."""

    def __init__(self, signals: bool = True) -> None:
        super().__init__(convert_charrefs=True)
        self.signals = signals
        self.open: list[int] = []
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.left_out, self.links, self.landmarks = 0, 0, 0
        self.kind, self.parent, self.inside = ["#page"], [0], [False]
        self.lines: list[list] = []
        self.line: list | None = None

    def _last(self, tags: tuple[str, ...]) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def _unwanted(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in CODE:
            return True
        if not self.signals:
            return False
        if tag in ASIDE or tag == "header" and not self.landmarks:
            return True
        if tag in ("html", "body", "article", "main"):
            return False
        a = dict(attrs)
        if (a.get("role") or "").lower() in ROLES or (a.get("aria-hidden") or "").lower() == "true" or "hidden" in a:
            return True
        name = f"{a.get('class') or ''} {a.get('id') or ''}".lower()
        return bool(name.strip()) and bool(NAMES.search(name))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.line = None
        if tag in ENDS_P and self.blocks and self.kind[self.open[self.blocks[-1]]] == "p":
            self._pop(self.blocks[-1])
        if tag in SIBLINGS:
            same, ends = SIBLINGS[tag]
            if (at := self._last(same)) > self._last(ends):
                self._pop(at)
        if tag in VOID:
            if not self.left_out and self.line is not None:
                if tag == "br":
                    self.line[0].append(" ")
                self.line[1] += 1
            return
        self.parent.append(self.open[-1] if self.open else 0)
        self.kind.append(tag)
        self.landmarks += tag in ("article", "main")
        self.inside.append(self.landmarks > 0)
        self.at.setdefault(tag, []).append(len(self.open))
        if tag in BLOCK:
            self.blocks.append(len(self.open))
        self.open.append(len(self.kind) - 1)
        if self.left_out or self._unwanted(tag, attrs):
            self.left_out += 1
        elif self.line is not None:
            self.line[1] += 1
        self.links += tag == "a"

    def _pop(self, to: int) -> None:
        for n in reversed(self.open[to:]):
            tag = self.kind[n]
            self.at[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
            self.left_out -= self.left_out > 0
            self.links -= tag == "a"
            self.landmarks -= tag in ("article", "main")
        del self.open[to:]

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes nothing in HTML but what is void anyway

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.line = None
        at = self._last((tag,))
        # a stray inline end does not close blocks
        if at >= 0 and (tag in BLOCK or tag in CODE or not self.blocks or self.blocks[-1] < at):
            self._pop(at)

    def handle_data(self, data: str) -> None:
        if self.left_out or not data:
            return
        if self.line is None:
            if data.isspace():
                return
            self.line = [[], 1, 0, self.open[-1] if self.open else 0]
            self.lines.append(self.line)
        self.line[0].append(data)
        if self.links:
            self.line[2] += len(data.strip())


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing along the lines; at the ends of the page the weights of the lines that there are."""
    reach = min(math.ceil(3 * sigma), len(ratio) - 1)
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    cut = slice(reach, reach + len(ratio))
    return np.convolve(ratio, kernel)[cut] / np.convolve(np.ones(len(ratio)), kernel)[cut]


def clusters(ratio: np.ndarray) -> np.ndarray:
    """For each line its smoothed ratio where that is above the threshold, half of the mean, which long paragraphs raise;
    0 for lines of no cluster."""
    s = smoothed(ratio)
    return np.where(s >= min(s.max(), 0.5 * s.mean()), s, 0.0)


def _region(parser: Lines, at: np.ndarray, mass: np.ndarray, stop: bool) -> int:
    """The element that holds the clusters: from the page down, as long as one part has all of the mass but a REST of its
    own; a landmark is not narrowed (if ``stop``), nor are paragraphs regions."""
    n = len(parser.kind)
    weight = np.bincount(at, mass, n)
    for i in range(n - 1, 0, -1):  # an element's number is above that of the one around it
        weight[parser.parent[i]] += weight[i]
    best = np.zeros(n, np.int64)  # the heaviest part of each element
    for i in range(1, n):
        p = parser.parent[i]
        if best[p] == 0 or weight[i] > weight[best[p]]:
            best[p] = i
    here = 0
    while best[here] and not (stop and parser.kind[here] in ("article", "main")):
        part = int(best[here])
        if parser.kind[part] in FINE or weight[here] - weight[part] > REST * weight[part] or weight[part] == 0:
            break
        here = part
    return here


def main_text(html: str | None, signals: bool = True) -> str:
    """The article's lines, joined by two newlines; empty if there are none."""
    parser = Lines(signals)
    html = html or ""
    for i in range(0, len(html), FEED):
        parser.feed(html[i : i + FEED])
    parser.close()
    lines = [(SPACE.sub(" ", "".join(t)).strip(), tags, link, n) for t, tags, link, n in parser.lines]
    lines = [x for x in lines if x[0]]
    if not lines:
        return ""
    size, tags, link, at = (np.array([f(x) for x in lines]) for f in (lambda x: len(x[0]), lambda x: x[1], lambda x: x[2], lambda x: x[3]))
    plain = np.maximum(0, size - link)
    if not plain.any():  # nothing but links
        plain = size
    ratio = clusters(plain / tags)
    core = (ratio > 0) & (plain > 0)
    weight = np.where(np.array(parser.inside)[at], LANDMARK, 1.0) if signals else np.ones(len(lines))
    region = _region(parser, at, plain * ratio * weight, signals)
    # sums over each element's part of the page: whether it lies in the region, its clustered lines, its characters and links
    n = len(parser.kind)
    within = np.zeros(n, bool)
    within[region] = True
    some, chars, links = (np.bincount(at, v, n) for v in (core, size, link))
    for i in range(n - 1, 0, -1):
        for v in (some, chars, links):
            v[parser.parent[i]] += v[i]
    menu = (some == 0) & (links >= LINKS * chars) & (chars > 0)
    for i in range(region + 1, n):
        p = parser.parent[i]
        within[i] = within[p] and not (menu[i] and parser.kind[i] not in FINE)
    return "\n\n".join(x[0] for x in lines if within[x[3]])


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars (code points).

    Null or empty html, and html without text, gives an empty text; null ids and urls are passed on. Long pages are read whole,
    broken ones as far as they make sense. Repeated rows are extracted each by itself; other columns, whatever their names, are
    not looked at; an empty table gives an empty one.
    """
    source = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    names = ["page_id", "url", "text", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=names)

    kinds = [source.schema["page_id"].dataType, source.schema["url"].dataType, T.StringType(), T.LongType()]
    return source.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))
