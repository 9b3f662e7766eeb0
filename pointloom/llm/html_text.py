"""Main text of HTML pages: parser events, text-to-tag ratio, smoothing, threshold clustering."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import pieces
from .common import as_bytes

# Element names of the HTML standard.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre "
    "search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that group blocks.
CONTAINERS = frozenset("body article main section div td th center details".split())
#: Elements whose text is never part of an article.
SKIPPED = frozenset(
    "script style noscript template head title nav footer aside form button select option textarea iframe object "
    "svg canvas menu dialog datalist label input audio video map search".split()
)
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id names that mark what stands beside an article, alone or with words of LAYOUT.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion comment comments "
    "disqus sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar toolbar cookie cookies "
    "consent gdpr notice notification popup modal overlay newsletter subscribe signup login share sharing social widget pagination pager".split()
)
#: Words that do so only with a word of LAYOUT, as they also name subjects of articles.
HALF_WORDS = frozenset("related recommended recommendations search tags legal disclaimer copyright replies skip".split())
LAYOUT = frozenset(
    "site page global top bottom left right main post posts article entry box bar slot links link list area wrapper wrap container inner "
    "outer block section panel module items item button buttons icons form row col column fixed sticky id unit".split()
)
#: Start tags that end an open p, as the standard says.
ENDS_P = BLOCKS - {"br", "head", "html", "body", "title", "option", "legend", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: What ends its like, and what it doesn't reach beyond.
ENDS_LIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = {"li": ("ul", "ol", "menu"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}
WALLS = ("article", "section", "div", "main", "body", "td", "th", "li", "blockquote", "aside", "nav", "footer", "header", "table", "form")
#: End tags of other elements don't reach beyond these; end tags of the second group do.
CLOSED = ("article", "main", "body", "nav", "aside", "footer", "table")
CLOSING = frozenset(CLOSED) | {"html", "section", "div"}

_LIKE = {tag: (*ENDS_LIKE.get(tag, ()), *(("p",) if tag in ENDS_P else ())) for tag in {*ENDS_LIKE, *ENDS_P}}
_WALLS = {tag: tuple(x for x in (*STOPS.get(tag, ()), *WALLS) if x not in ENDS_LIKE.get(tag, ())) for tag in _LIKE}

_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
_QUOTE = re.compile(r"=\s*(['\"])")
_RAW = re.compile(r"(script|style)(?=[\s/>])", re.I)


@lru_cache(4096)
def beside(name: str) -> bool:
    """Whether a class or id name says that an element stands beside the article: ad-slot, site-footer, related-posts."""
    words = {w.lower() for w in _WORD.findall(name)}
    full, half, layout = words & ASIDE_WORDS, words & HALF_WORDS, words & LAYOUT
    return len(full) + len(half) + len(layout) == len(words) and bool(full or half and layout)


def whole_tags(html: str) -> str:
    """The page with tags and text only, in time linear in its length.

    Comments, declarations and the content of scripts and styles go, to the end of the
    page if they are not closed. A < that no whole tag follows, since its > or a closing
    quote is missing, stays as text.
    """
    out: list[str] = []
    at, n = 0, len(html)
    gt = quote = -1  # the next > and the next opening quote, as far as they are known
    opened: re.Match | None = None
    last = {q: html.rfind(q) for q in ("'", '"')}
    last_gt, last_comment = html.rfind(">"), html.rfind("-->")
    while (i := html.find("<", at)) >= 0:
        out.append(html[at:i])
        after = html[i + 1 : i + 2]
        if html.startswith("<!--", i):
            if last_comment < i + 2:
                return "".join(out)
            at = html.find("-->", i + 2) + 3
            continue
        if after in ("!", "?") or after == "/" and not html[i + 2 : i + 3].isalpha():
            if last_gt < i:
                return "".join(out)
            at = html.find(">", i) + 1
            continue
        if not (after.isalpha() and after.isascii()) and after != "/":
            out.append("&lt;")
            at = i + 1
            continue
        k, end = i + 1, -1
        while last_gt >= k:
            if gt < k:
                gt = html.find(">", k)
            if quote < k and quote < n:
                opened = _QUOTE.search(html, k)
                quote = opened.start() if opened else n
            if quote > gt:
                end = gt + 1
                break
            if last[opened[1]] < opened.end():
                break  # the value has no end
            k = html.find(opened[1], opened.end()) + 1
        if end < 0:
            out.append("&lt;")
            at = i + 1
            continue
        out.append(html[i:end])
        at = end
        if raw := _RAW.match(html, i + 1):
            close = re.compile(f"</{raw[1]}(?=[\\s/>])", re.I).search(html, end)
            if not close:
                return "".join(out)
            at = close.start()
    out.append(html[at:])
    return "".join(out)


class Lines(HTMLParser):
    """Turns parser events into lines: the text of a block, its tags, and how it is enclosed.

    All it does for an event takes time that doesn't grow with the nesting.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[dict] = []
        self.open: list[tuple[str, bool, bool, int]] = []  # name, skipped, marked, the container around it
        self.at: dict[str, list[int]] = {}  # where elements of a name stand in open
        self.parents: list[int] = [-1]  # of the containers; 0 is the page
        self.container = 0
        self.parts: list[tuple[str, bool]] = []
        self.tags = self.linked = self.skips = self.marks = self.headings = 0

    def last(self, names: tuple[str, ...]) -> int:
        """Where the innermost open element of these names stands, or -1."""
        found = -1
        for x in names:
            spots = self.at.get(x)
            if spots and spots[-1] > found:
                found = spots[-1]
        return found

    def end_line(self) -> None:
        text = " ".join("".join(x for x, _ in self.parts).split())
        if text:
            clean = " ".join("".join(x for x, marked in self.parts if not marked).split()) if any(marked for _, marked in self.parts) else text
            self.lines.append(
                {"text": text, "clean": clean, "tags": self.tags, "linked": min(self.linked, len(text)), "container": self.container, "header": bool(self.at.get("header")), "heading": self.headings > 0}
            )
            self.tags = 0
        self.parts, self.linked = [], 0

    def pop_to(self, k: int) -> None:
        for name, skipped, marked, container in reversed(self.open[k:]):
            self.at[name].pop()
            self.headings -= name in HEADINGS
            self.skips -= skipped
            self.marks -= marked
            self.container = container
        del self.open[k:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        if tag in _LIKE and (like := self.last(_LIKE[tag])) >= 0 and like > self.last(_WALLS[tag]):
            self.pop_to(like)
        if tag in VOID:
            return
        skipped, marked = tag in SKIPPED, False
        if attrs and tag not in ("html", "body", "article", "main"):
            found = dict(attrs)
            skipped = skipped or self.unseen(found)
            marked = any(beside(x) for key in ("class", "id") for x in (found.get(key) or "").split())
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, skipped, marked, self.container))
        self.skips += skipped
        self.marks += marked
        self.headings += tag in HEADINGS
        if tag in CONTAINERS and not (tag == "body" and self.container == 0):
            self.parents.append(self.container)
            self.container = len(self.parents) - 1

    @staticmethod
    def unseen(attrs: dict) -> bool:
        """Whether an element is hidden, or has a role beside the article."""
        hidden = "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true"
        return hidden or "display:none" in (attrs.get("style") or "").replace(" ", "").lower() or (attrs.get("role") or "").lower() in ASIDE_ROLES

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        k = self.last((tag,))
        if k >= 0 and (tag in CLOSING or k > self.last(CLOSED)):
            self.pop_to(k)

    def handle_data(self, data: str) -> None:
        if self.skips:
            return
        self.parts.append((data, self.marks > 0))
        if self.at.get("a"):
            self.linked += len(data.strip())

    def close(self) -> None:
        super().close()
        self.end_line()


def smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; the kernel is normed over the lines that exist."""
    half = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    return np.convolve(values, kernel, "same")[: len(values)] / np.convolve(np.ones(len(values)), kernel, "same")[: len(values)] if len(values) >= len(kernel) else np.array(
        [np.average(values, weights=np.exp(-0.5 * ((np.arange(len(values)) - i) / sigma) ** 2)) for i in range(len(values))]
    )


def main_text(html: str, sigma: float = 1.0, share: float = 0.8) -> str:
    """The article's blocks, one line each.

    Every line gets its text-to-tag ratio (characters outside links a tag), the ratios are
    smoothed, and lines at or above their standard deviation, or half of their maximum if
    that is less, are dense, unless most of the line is a link. The region is the innermost
    container (div, article, section, cell ..) that holds at least share of the dense
    text. Content is: the region; dense lines elsewhere with what stands directly in their
    container; lines directly in the containers around the region, before it; and headings
    before content. Where the region is the whole page, only the dense lines' containers
    are content. Runs of links are never content, nor is a page's header.

    What elements and names mark as beside the article (nav, aside, class="ad-slot") is
    left out before; but if nothing is left then, the names are not believed.
    """
    parser = Lines()
    parser.feed(whole_tags(html))
    parser.close()
    return _content(parser, "clean", sigma, share) or _content(parser, "text", sigma, share)


def _content(parser: Lines, key: str, sigma: float, share: float) -> str:
    lines = [x for x in parser.lines if x[key]]
    if not lines:
        return ""
    size = np.array([len(x[key]) for x in lines])
    linked = np.minimum([x["linked"] for x in lines], size)
    header = np.array([x["header"] for x in lines])
    where = np.array([x["container"] for x in lines])
    parents = np.array(parser.parents)
    ratio = (size - linked) / np.maximum(1, [x["tags"] for x in lines])
    smoothed = smooth(ratio, sigma)
    limit = min(float(smoothed.std()), 0.5 * float(smoothed.max()))
    mostly = linked > 0.5 * size
    dense = (smoothed >= limit) & ~mostly & ~header
    if not dense.any():
        return ""
    # the innermost container of the dense text; a container's number is above its parent's
    held = np.bincount(where, weights=np.where(dense, size - linked, 0), minlength=len(parents))
    for c in range(len(parents) - 1, 0, -1):
        held[parents[c]] += held[c]
    root = int(np.flatnonzero(held >= share * held[0])[-1])
    within, around = np.zeros(len(parents), bool), np.zeros(len(parents), bool)
    within[root] = True
    for c in range(root + 1, len(parents)):
        within[c] = within[parents[c]]
    c = root
    while (c := int(parents[c])) > 0:
        around[c] = True
    own = dense & (ratio >= limit)
    held_directly = np.zeros(len(parents), bool)
    held_directly[where[own]] = True
    if root:
        held_directly[0] = False
    first = int(np.flatnonzero(dense & within[where])[0])
    edge = np.concatenate(([False], mostly, [False]))
    listed = mostly & (edge[:-2] | edge[2:])  # a linked line by itself is no list
    keep = own | held_directly[where] & ~header | around[where] & (np.arange(len(lines)) < first) & ~mostly & ~header
    if root:
        keep |= within[where]
    keep &= ~listed
    for i in range(len(lines) - 2, -1, -1):
        keep[i] |= lines[i]["heading"] and keep[i + 1] and not header[i]
    return "\n".join(x[key] for x, k in zip(lines, keep) if k)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sigma: float = 1.0) -> DataFrame:
    """Main text of every page: id, url, text, n_chars (code points).

    A row per input row; null html is the empty page, whose text is empty. Null ids, null
    urls and repeated rows pass through. Other columns are ignored. No shuffle; a worker
    holds a slice of a batch and one page's lines at a time.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = as_bytes(batch.column(2))
            for part in pieces(raw):
                text = [main_text(x.decode(), sigma) for x in raw[part]]
                cut = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays(
                    [cut.column(0), cut.column(1), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())],
                    [id_col, url_col, "text", "n_chars"],
                )

    wanted = pages.select(id_col, pages[url_col].cast("string").alias(url_col), pages[html_col].cast("string").alias("html_"))
    return wanted.mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars bigint")
