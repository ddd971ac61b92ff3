"""Main text of web pages from a stream of standard-library parser events."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML elements by their role.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
_SKIPPED = frozenset(
    "aside button canvas dialog embed footer form head iframe input math menu nav noscript object option script select "
    "style svg template textarea title".split()
)
_CONTAINERS = frozenset("article body center div main section table tbody td tr".split())
#: An opening tag ends open elements of these kinds, up to the boundary elements.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)),
    "option": (("option",), ("select",)),
}
_BOUNDS = frozenset("article aside body button caption div footer header main nav section table td th".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in class, id and role that mark what is no article text, and words that may stand beside them.
_MARKS = frozenset(
    "ad ads advert advertisement advertising adverts adbox advertorial alert banner breadcrumb breadcrumbs comment "
    "commentlist comments commenting consent contentinfo complementary cookie cookies dialog disclaimer disqus footer "
    "footnav gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notification outbrain pager "
    "pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar "
    "signup social sponsor sponsored subscribe subscription taboola toolbar topbar widget widgets".split()
)
_FILLERS = frozenset(
    "area article articles bar bars block blocks body bottom box boxes btn button buttons cell col column container content "
    "fixed form global group holder icon icons inline inner item items js label layer left link links list lists main media "
    "message meta mobile module news outer overlay page panel post posts primary right row secondary section site slot small "
    "sticky stories strip tag tags text the title top unit ui wrap wrapper zone".split()
)
_NOWHERE = (-1,)
_TOKEN = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class _Lines(HTMLParser):
    """Collects one line per block: words, tags, characters inside links, the container around it, if it is a heading.

    Containers are numbered as they open, so those inside one are the numbers from its own to its last. Open elements
    are found by tag without a walk: time and memory grow with the page, however deep it is nested.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int]] = []  # tag, marked, container number or -1
        self.places: dict[str, list[int]] = {}  # where in the stack the open elements of a tag are
        self.around = [-1]  # the containers that are open
        self.kinds: list[str] = []
        self.last: list[int] = []
        self.lines: list[tuple[str, int, int, int, bool]] = []
        self.pieces: list[str] = []
        self.tags = self.linked = self.marked = self.links = self.articles = self.headings = 0

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)

    def flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            if not self.marked:
                self.lines.append((text, self.tags, self.linked, self.around[-1], self.headings > 0))
            self.tags = 0
        self.pieces.clear()
        self.linked = 0

    def handle_data(self, data: str) -> None:
        if self.marked:
            return
        self.pieces.append(data)
        if self.links:
            self.linked += len(data.strip())

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag not in _INLINE:
            self._close_open("p", _BOUNDS)
            if tag in _ENDS:
                for kind in _ENDS[tag][0]:
                    self._close_open(kind, _ENDS[tag][1])
            self.flush()
        elif tag == "br":
            self.pieces.append(" ")
        if tag in _VOID:
            return
        marked = tag in _SKIPPED or (tag == "header" and not self.articles) or (bool(attrs) and _is_marked(tag, attrs))
        number = -1
        if tag in _CONTAINERS:
            number = len(self.kinds)
            self.kinds.append(tag)
            self.last.append(number)
            self.around.append(number)
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, marked, number))
        self.marked += marked
        self.links += tag == "a"
        self.headings += tag in _HEADINGS
        self.articles += tag in ("article", "main")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag not in _INLINE:
            self.flush()
        bounds = _BOUNDS if tag in _INLINE or tag == "p" else frozenset()
        self._close_open(tag, bounds - {tag})

    def _close_open(self, tag: str, bounds: frozenset[str] | tuple[str, ...]) -> None:
        """Close the innermost open element of this kind with all inside it, unless a boundary lies between."""
        open_ = self.places.get(tag)
        if not open_:
            return
        depth = open_[-1]
        if any(self.places.get(b, _NOWHERE)[-1] > depth for b in bounds if self.places.get(b)):
            return
        if tag not in _INLINE:
            self.flush()
        for name, marked, number in reversed(self.stack[depth:]):
            self.places[name].pop()
            self.marked -= marked
            self.links -= name == "a"
            self.headings -= name in _HEADINGS
            self.articles -= name in ("article", "main")
            if number >= 0:
                self.around.pop()
                self.last[number] = len(self.kinds) - 1
        del self.stack[depth:]


def _is_marked(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    if tag in ("html", "body", "article", "main") and not any(k == "hidden" for k, _ in attrs):
        # The page and the article are never dropped for a class, but an article that is a comment is.
        return tag == "article" and any(
            k in ("class", "id") and "comment" in (v or "").lower() for k, v in attrs
        )
    for key, value in attrs:
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key == "style" and value and "display:none" in value.replace(" ", "").lower():
            return True
        if key in ("class", "id", "role") and value:
            if any(_names_mark(token) for token in value.split()):
                return True
    return False


def _names_mark(token: str) -> bool:
    """Whether a class, id or role names a mark: share-buttons does, share-class-table and related-work do not."""
    words = set(_TOKEN.findall(_CAMEL.sub(" ", token).lower()))
    return not words.isdisjoint(_MARKS) and words <= _MARKS | _FILLERS


def _smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; beyond the ends there is nothing, and the kernel is scaled to what it covers."""
    radius = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    cut = slice(radius, radius + len(values))
    return (np.convolve(values, kernel) / np.convolve(np.ones_like(values), kernel))[cut]


def _threshold(values: np.ndarray) -> float:
    """The middle between the centres of two clusters (2-means from the extremes), at most half of the upper centre.

    So lines that differ by less than that are one cluster.
    """
    low, high = float(values.min()), float(values.max())
    for _ in range(30):
        cut = (low + high) / 2
        upper = values > cut
        if upper.all() or not upper.any():
            break
        was, low, high = (low, high), float(values[~upper].mean()), float(values[upper].mean())
        if (low, high) == was:
            break
    return min((low + high) / 2, high / 2)


def main_text(html: str | None, sigma: float = 1.0, cover: float = 0.8) -> str:
    """The article of a page, blocks joined by line feeds; empty for null, empty and text-free pages.

    Parser events become lines, one per block. Lines inside menus, headers, footers, sidebars, notices, adverts,
    forms, comments and the like are no candidates. Each line's ratio of unlinked text to tags is smoothed and the
    lines are clustered by a threshold; the upper cluster is content. The content region is the deepest article or
    main element with most of its text, else the whole page.

    All lines of the region are kept, short ones too, but for two kinds outside the cluster: runs of lines that are mostly
    links, unless the run as one line would be in the cluster (a list of sources between paragraphs), and lines at the ends
    of a page with more tags than characters. Headings, and single links that open or close the region, stay. Equal
    ratios make one cluster. Time and memory grow with the page, however it is nested.
    """
    if not html:
        return ""
    page = _Lines()
    page.feed(html)
    if page.rawdata.startswith("<!--"):  # a comment that never ends is none of the text
        page.rawdata = ""
    page.close()
    page.flush()
    lines = page.lines
    if not lines:
        return ""
    plain = np.array([len(x[0]) - min(x[2], len(x[0])) for x in lines], float)
    tags = np.array([max(1, x[1]) for x in lines])
    density = np.log1p(plain / tags)
    cut = _threshold(smooth := _smooth(density, sigma))
    chosen = smooth >= cut
    of = np.array([x[3] for x in lines])
    region = _region(page, of, plain, chosen, cover)
    whole = region is None
    inside = np.ones(len(lines), bool) if whole else (region[0] <= of) & (of <= region[1])
    at = np.flatnonzero(inside)
    heading = np.array([x[4] for x in lines])
    linked = (plain < np.array([len(x[0]) for x in lines]) / 2) & ~heading
    kept = np.ones(len(at), bool)
    for start, end in _link_runs(density[at], linked[at], sigma, cut):
        kept[start:end] = chosen[at[start:end]]
    if whole:
        bare = ~chosen & ~heading & (plain + np.array([x[2] for x in lines]) < tags)
        for ends in (range(len(at)), range(len(at) - 1, -1, -1)):
            for i in ends:
                if not bare[at[i]] and kept[i]:
                    break
                kept[i] = False
    return "\n".join(lines[i][0] for i in at[kept])


def _link_runs(density: np.ndarray, linked: np.ndarray, sigma: float, cut: float) -> list[tuple[int, int]]:
    """Runs (start, end) of linked lines that as one line each would be outside the cluster too; single ones at the
    ends are none."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], linked, [0]))))
    runs = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
    if not runs:
        return []
    first = np.ones(len(density), bool)
    first[1:] = ~(linked[1:] & linked[:-1])
    at = np.cumsum(first) - 1
    folded = np.bincount(at, density) / np.bincount(at)
    pad = max(1, round(3 * sigma))  # beyond the region there is no text
    value = _smooth(np.pad(folded, pad), sigma)[pad:]
    single = lambda a, b: b - a == 1 and (a == 0 or b == len(density))
    return [(a, b) for a, b in runs if value[at[a]] < cut and not single(a, b)]


def _region(page: _Lines, of: np.ndarray, plain: np.ndarray, chosen: np.ndarray, cover: float) -> tuple[int, int] | None:
    """The containers (first, last) of the deepest article or main with the share cover of the cluster's text.

    of: the container of each line, -1 outside all. None if there is no such element.
    """
    size = np.bincount(of[chosen] + 1, plain[chosen], minlength=len(page.kinds) + 1)
    # What is in a container: the sums over its numbers.
    sizes = np.concatenate(([0.0], np.cumsum(size)))
    for c in range(len(page.kinds) - 1, -1, -1):
        if page.kinds[c] in ("article", "main") and sizes[page.last[c] + 2] - sizes[c + 1] >= cover * sizes[-1]:
            return c, page.last[c]
    return None


def extract_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points); see main_text().

    Null html counts as empty, null ids and urls are passed on. Repeated rows answer alike; an empty table gives an
    empty result; other columns are not read. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            arrays = [batch.column(0), batch.column(1), pa.array(texts, pa.string())]
            arrays.append(pa.array([len(t) for t in texts], pa.int64()))
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    narrow = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    types = {f.name: f.dataType.simpleString() for f in narrow.schema}
    return narrow.mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
