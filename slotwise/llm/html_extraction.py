"""Main text of web pages: parser events, text-to-tag ratio, smoothing, clustering.

The standard library's parser streams over a page once and cuts it into blocks
at block elements. Each block has a text-to-tag ratio; the ratios, smoothed by
a Gaussian along the page, fall into two clusters, and the upper one is
content. The smallest element that holds most of the content is the content
region, of which every block is kept that lies in no menu, notice, advert, form
or other boilerplate element, however short. A word of a class or id marks an
element as boilerplate only while it is no heading and does not hold the main
element, an article or most of the text of the upper cluster.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from slotwise.llm.arrays import pieces
from slotwise.llm.tables import read, without

SPREAD = 1.0
REGION_SHARE = 0.7
OUT = ("text", "n_chars", "n_blocks", "n_blocks_kept")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup "
    "option p pre section select summary table tbody td template tfoot th thead title tr ul".split()
)
CONTAINER = frozenset("article body div html main section table td".split())
CLOSES_P = BLOCK - frozenset("body caption head html legend li option optgroup summary td th tr tbody thead tfoot title".split())
SILENT = frozenset("audio canvas datalist head iframe math noembed noframes noscript object script style svg template title video".split())
BOILER = frozenset("aside button dialog fieldset footer form input label menu nav select textarea".split())
BOILER_ROLE = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
BOILER_NAME = frozenset(
    "ad ads adv advert advertisement adverts alert banner breadcrumb breadcrumbs byline comment comments consent cookie "
    "cookies copyright disclaimer discussion disqus footer gdpr header login masthead menu menus meta modal nav navbar "
    "navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion recommended "
    "related reply replies respond search share sharing sidebar signup skip skyscraper social sponsor sponsored "
    "sponsors subscribe subscription tags toolbar widget widgets".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
MAIN = ("article", "main")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SIBLING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
           "th": ("td", "th"), "option": ("option",), "p": ("p",)}
SCOPE = frozenset("article aside body div footer form header html main nav ol section table ul dl td th".split())


def _named(attrs: list[tuple[str, str | None]]) -> bool:
    """Whether a class or id has a word that is usual for boilerplate."""
    return any(
        p.lower() in BOILER_NAME
        for name, value in attrs if name in ("class", "id") and value
        for p in NAME_PARTS.findall(value)
    )


def _stated(attrs: list[tuple[str, str | None]]) -> bool:
    """Whether a role says boilerplate, or the element is hidden."""
    for name, value in attrs:
        if name == "role" and value and value.strip().lower() in BOILER_ROLE:
            return True
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and HIDDEN.search(value):
            return True
    return False


class Blocks(HTMLParser):
    """Blocks of a page: text, characters in links, tags, container, boilerplate or not, mark, body of an article.

    An element left open ends with the element around it. ``containers`` has
    the parent and the name of each container element. ``marks`` has, of each
    element marked by its name alone, the mark around it and whether an article
    or main element was open; mark 0 is none. ``holders`` are marks that hold
    an article or main element, ``inner`` those that hold one within main.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool, int, int]] = []  # tag, silent, boilerplate, container, mark
        self.containers: list[tuple[int, str]] = [(-1, "page")]
        self.blocks: list[tuple[str, int, int, int, bool, int, bool]] = []
        self.marks: list[tuple[int, str]] = [(0, "")]
        self.holders: set[int] = set()
        self.inner: set[int] = set()
        self.parts: list[str] = []
        self.tags = self.linked = self.in_link = 0
        self.silent = self.boiler = False
        self.container = self.mark = self.in_main = 0

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are not asked for

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                body = self.in_main > 0 and self.stack[-1][0] not in HEADINGS
                self.blocks.append((text, min(self.linked, len(text)), self.tags, self.container, self.boiler, self.mark, body))
            self.parts = []
            self.tags = self.linked = 0

    def _restore(self) -> None:
        _, self.silent, self.boiler, self.container, self.mark = self.stack[-1] if self.stack else ("", False, False, 0, 0)

    def _close(self, depth: int) -> None:
        if any(tag in BLOCK for tag, *_ in self.stack[depth:]):
            self.flush()
        for tag, *_ in self.stack[depth:]:
            if tag == "a" and self.in_link:
                self.in_link -= 1
            elif tag in MAIN:
                self.in_main -= 1
        del self.stack[depth:]
        self._restore()

    def _implied_end(self, tag: str) -> None:
        ends = SIBLING.get(tag, ()) if tag != "p" else ()
        if tag in CLOSES_P:
            ends = (*ends, "p")
        for depth in range(len(self.stack) - 1, -1, -1):
            name = self.stack[depth][0]
            if name in ends:
                self._close(depth)
                return
            if name in SCOPE:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in VOID:
            if tag == "hr":
                self.flush()
            return
        if tag in BLOCK:
            self._implied_end(tag)
            self.flush()
        page = tag in ("html", "body", *MAIN)
        boiler = (
            self.boiler or tag in BOILER or tag == "header" and not self.in_main
            or bool(attrs) and not page and _stated(attrs)
        )
        mark, named = self.mark, bool(attrs) and _named(attrs)
        if named and not page and tag not in HEADINGS:
            around = [t for t, *_ in self.stack if t in MAIN] if self.in_main else []
            self.marks.append((mark, "article" if "article" in around else "main" if around else ""))
            mark = len(self.marks) - 1
        elif tag in MAIN and mark and not named and not boiler:
            mark = self._held(mark)
        if (boiler, mark) != (self.boiler, self.mark) and tag not in BLOCK:
            # an inline element of boilerplate must not share a block with its surroundings
            self.flush()
        silent = self.silent or tag in SILENT
        container = self.container
        if tag in CONTAINER:
            self.containers.append((container, tag))
            container = len(self.containers) - 1
        if tag == "a":
            self.in_link += 1
        elif tag in MAIN:
            self.in_main += 1
        elif tag == "body":
            silent = boiler = False
            mark = 0
        self.stack.append((tag, silent, boiler, container, mark))
        self.silent, self.boiler, self.container, self.mark = silent, boiler, container, mark

    def _held(self, mark: int) -> int:
        """The mark inside a main element or an article: none, unless one is around the marked element, as of comments."""
        inherited = mark
        while mark:
            outer, around = self.marks[mark]
            if not around:
                self.holders.add(mark)
            elif around == "main":
                self.inner.add(mark)
            mark = outer
        return 0 if inherited in self.holders else inherited

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "math", "path"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in VOID:
            return
        for depth in range(len(self.stack) - 1, -1, -1):
            name, _, boiler, _, mark = self.stack[depth]
            if name == tag:
                _, _, outer, _, around = self.stack[depth - 1] if depth else ("", False, False, 0, 0)
                if (boiler, mark) != (outer, around):
                    self.flush()
                self._close(depth)
                return
            if name in SCOPE and tag not in SCOPE:
                break
        if tag in BLOCK:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.in_link:
                self.linked += len(data)


def smoothed(values: np.ndarray, spread: float) -> np.ndarray:
    """Gaussian average along the page; the ends keep the weights that lie inside."""
    reach = max(1, math.ceil(3 * spread))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / spread) ** 2)
    return np.convolve(values, kernel)[reach:-reach] / np.convolve(np.ones(len(values)), kernel)[reach:-reach]


def upper_cluster(values: np.ndarray) -> np.ndarray:
    """Membership in the upper of two clusters; all values, if they are equal."""
    low, high = values.min(), values.max()
    if low == high:
        return np.ones(len(values), bool)
    while True:
        cut = (low + high) / 2
        upper = values >= cut
        new = values[~upper].mean(), values[upper].mean()
        if new == (low, high):
            return upper
        low, high = new


def _upper(ratio: np.ndarray, free: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """The content blocks among the free ones."""
    content = upper_cluster(smoothed(ratio, SPREAD)) & free & (linked < 0.5)
    return content if content.any() else free & (ratio == ratio[free].max())


def _marked(parser: Blocks, size: np.ndarray, content: np.ndarray, prose: np.ndarray) -> np.ndarray:
    """The blocks that are boilerplate by the name of an element around them."""
    blocks, marks = parser.blocks, parser.marks
    weight = np.zeros(len(marks))
    for block, n in zip(blocks, size * content, strict=True):
        weight[block[5]] += n
    for m in range(len(marks) - 1, 0, -1):  # a mark comes after the marks around it
        weight[marks[m][0]] += weight[m]
    stays = [False]
    most = weight >= REGION_SHARE * weight[0]
    for m in range(1, len(marks)):
        lifted = m in parser.holders or m in parser.inner and most[m]
        stays.append(stays[marks[m][0]] or not lifted)
    if any(p and b[6] and not stays[b[5]] for b, p in zip(blocks, prose, strict=True)):
        return np.array([stays[b[5]] for b in blocks])
    for m in range(1, len(marks)):  # no article has text: the elements that hold most of it are no boilerplate
        lifted = m in parser.holders or most[m]
        stays[m] = stays[marks[m][0]] or not lifted
    return np.array([stays[b[5]] for b in blocks])


def main_text(html: str) -> tuple[str, int, int]:
    """Main text of a page, its number of blocks, and how many of them are kept."""
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    blocks = parser.blocks
    if not blocks:
        return "", 0, 0
    size = np.array([len(b[0]) for b in blocks], float)
    free = np.array([not b[4] for b in blocks])
    linked = np.array([b[1] for b in blocks]) / size
    if not free.any():
        return "", len(blocks), 0
    density = np.log1p(size / np.maximum(1, [b[2] for b in blocks])) * (1 - linked)
    if len(parser.marks) > 1:
        free &= ~_marked(parser, size, _upper(density * free, free, linked), free & (linked < 0.5))
        if not free.any():
            return "", len(blocks), 0
    content = _upper(density * free, free, linked)
    # text of the content blocks below each container; the deepest with enough of it is the region
    weight = np.zeros(len(parser.containers))
    for block, chosen, n in zip(blocks, content, size, strict=True):
        if chosen:
            weight[block[3]] += n
    total = weight.sum()
    for c in range(len(weight) - 1, 0, -1):
        weight[parser.containers[c][0]] += weight[c]
    region = max(c for c in range(len(weight)) if weight[c] >= REGION_SHARE * total)
    named = region
    while named > 0 and parser.containers[named][1] not in MAIN:
        named = parser.containers[named][0]
    if named > 0:
        region = named
    inside = np.zeros(len(weight), bool)
    inside[region] = True
    for c in range(region + 1, len(weight)):
        inside[c] = inside[parser.containers[c][0]]
    kept = free & inside[[b[3] for b in blocks]]
    if parser.containers[region][1] in ("page", "html", "body"):
        # no element of its own: blocks in no other element, and from the first to the last
        # content block, but no lists of links
        places = np.flatnonzero(content)
        near = np.array([b[3] == region for b in blocks])
        near[places[0] : places[-1] + 1] = True
        kept &= content | near & (linked < 0.5)
    return "\n".join(b[0] for b, keep in zip(blocks, kept, strict=True) if keep), len(blocks), int(kept.sum())


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "html"):
        found = [main_text(html or "") for html in batch.column("html").to_pylist()]
        kept = batch.drop_columns(["html"])
        yield pa.RecordBatch.from_arrays(
            [
                *kept.columns, pa.array([t for t, _, _ in found], pa.string()),
                *[pa.array(x, pa.int64()) for x in ([len(t) for t, _, _ in found], [b for _, b, _ in found], [k for _, _, k in found])],
            ],
            [*kept.schema.names, *OUT],
        )


def extract(pages: DataFrame) -> DataFrame:
    """Main text of each page of ``pages`` (column ``html``).

    Returns the other columns of ``pages`` and ``text``, ``n_chars`` (code
    points), ``n_blocks`` and ``n_blocks_kept``. Character references are
    decoded, white space inside a block becomes one space, blocks are joined
    by a line end. A null or empty page, or one without text, has an empty
    text. Markup that is not closed ends with what holds it. Input columns
    with those names give way; repeated pages are treated alike.
    """
    base = without(pages, *OUT)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name != "html"]
    return base.mapInArrow(
        _texts, ", ".join([*kept, "text string, n_chars long, n_blocks long, n_blocks_kept long"])
    )


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: its main text."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")
