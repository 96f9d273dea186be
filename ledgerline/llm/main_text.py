"""Main text of web pages by tag-path ratios.

A page is read into blocks: runs of text between the starts and ends of block elements, each piece of text with the
path of tags from the root to it. Text that no reader sees (scripts, styles, the head, hidden elements) has no path.
Elements whose tag, class, id or role tells of menus, adverts, notices, comments and the like have paths of their own,
with a prior: a factor on what their path scores. Names are read by whole words; a word that may tell of something else (notice, share)
only lowers the score, and a listed word in a compound with another (recipe-menu, comments-on-budget) hardly does. An element with most of the page's
text is not overruled by its name.

For each path the page's text is summed: characters and punctuation marks (and half a mark for each piece), over the
number of pieces. Both ratios are smoothed over similar paths (by a Gaussian of the steps between them), so that headings
and short paragraphs take part in the ratios of the text beside them, fused as the logarithm of their mean proportional
(which very long paragraphs don't dwarf others in), and multiplied by the prior. Paths over THRESHOLD times the mean over characters are content; the blocks with text on
a content path are the main text, in page order.

Null pages and pages without text give an empty text; text without any markup is an article of its own. Bytes that aren't
UTF-8 count as U+FFFD. Repeated pages each give their row. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import by_row, ship, texts_of

SPREAD = 1.0  # of the Gaussian, in steps between two paths
THRESHOLD = 0.35
#: Factors on the scores of paths in elements that name something else than the article: for sure, perhaps (outside and inside an article), and in a compound with a word of its own.
SURELY_NOT, PERHAPS_OUTSIDE, PERHAPS_NOT, COMPOUND = 0.02, 0.3, 0.4, 0.8
LINK = 0.6
#: More steps than these weigh 0 in floating point.
REACH = int(SPREAD * math.sqrt(2 * 746))
_GAUSSIAN = np.array([[math.exp(-((i + k) ** 2) / (2 * SPREAD**2)) for k in range(REACH + 1)] for i in range(REACH + 2)])

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
UNSEEN = frozenset("head select option input object applet canvas audio video map".split())
APART = frozenset("nav footer aside form button label menu dialog".split())
#: Start tags that end an open element of these kinds.
ENDS = {
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"}),
    "tbody": frozenset({"thead", "tbody", "tfoot", "tr", "td", "th"}), "tfoot": frozenset({"thead", "tbody", "tr", "td", "th"}),
}
LIST_SCOPE = frozenset("ul ol dl table select menu dir".split())
P_SCOPE = frozenset("table button object".split())
TABLE_PARTS = frozenset("tr td th tbody tfoot".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in a class, id or role that tell what isn't the article, words that may tell it, and words of layout, which tell nothing.
SURE_WORDS = frozenset("ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors sidebar menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr popup modal newsletter subscribe comment comments disqus pagination pager complementary contentinfo copyright skiplink".split())
PERHAPS_WORDS = frozenset("promo promos promotion banner notice alert overlay signup login share sharing social related recommend recommended recommendations respond replies widget widgets toolbar search".split())
LAYOUT_WORDS = frozenset("top bottom left right main site page global local primary secondary side header foot bar box wrap wrapper container content block section area list item items inner outer col column row group unit slot panel link links skip text body fixed sticky mobile desktop bg app form thread the".split())
_NAME_PARTS = re.compile(r"[A-Za-z][a-z]*|[0-9]+|[A-Z]+")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>?")
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡\"'()-]")


class Path:
    """A path of tags: a node of the page's tree of paths."""

    __slots__ = ("below", "depth", "factor", "parent")

    def __init__(self, parent: "Path | None" = None, factor: float = 1.0) -> None:
        self.parent, self.below, self.depth, self.factor = parent, {}, parent.depth + 1 if parent else 0, factor

    def step(self, tag: str, factor: float = 1.0) -> "Path":
        """The path on to a tag; of a factor under 1 apart from those to the same tag without."""
        key = (tag, factor)
        if key not in self.below:
            self.below[key] = Path(self, factor)
        return self.below[key]


def named_factor(names: str, article: bool) -> float:
    """The factor of an element's class, id and role names: whole words only, and a word beside one of another kind (recipe-menu) tells little."""
    least = 1.0
    for name in names.split():
        parts = [x.lower() for x in _NAME_PARTS.findall(name) if not x.isdigit()]
        sure, perhaps = any(x in SURE_WORDS for x in parts), any(x in PERHAPS_WORDS for x in parts)
        if sure or perhaps:
            plain = all(x in SURE_WORDS or x in PERHAPS_WORDS or x in LAYOUT_WORDS for x in parts)
            least = min(least, COMPOUND if not plain else SURELY_NOT if sure else PERHAPS_NOT if article else PERHAPS_OUTSIDE)
    return least


class Element:
    """An open element, and what its ancestors tell, so that no end tag needs a walk through them."""

    __slots__ = ("article", "block", "depth", "lists", "p", "parent", "path", "table", "tag", "unseen")

    def __init__(self, tag: str, parent: "Element | None", path: Path, unseen: bool) -> None:
        self.tag, self.parent, self.path, self.unseen = tag, parent, path, unseen
        self.depth: int = parent.depth + 1 if parent else 0
        # the p that a block would end, the depths of the nearest block, list or table around, and of the nearest table
        self.p: Element | None = self if tag == "p" else None if tag in P_SCOPE or parent is None else parent.p
        self.block: int = self.depth if tag in BLOCKS or parent is None else parent.block
        self.lists: int = self.depth if tag in LIST_SCOPE or parent is None else parent.lists
        self.table: int = self.depth if tag == "table" or parent is None else parent.table
        self.article: bool = tag in ("article", "main") or (parent is not None and parent.article)


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    pieces: list[tuple[Path, str]] = field(default_factory=list)


class _Page:
    """The blocks of a page that is being read. Each tag takes a bounded number of steps, but for the elements that it ends."""

    def __init__(self) -> None:
        self.now = self.root = Element("", None, Path(), False)
        self.blocks: list[Block] = []
        self.block = Block()
        self.open: dict[str, list[Element]] = {}  # by tag, outermost first

    def cut(self) -> None:
        if self.block.pieces:
            self.blocks.append(self.block)
        self.block = Block()

    def text(self, data: str) -> None:
        if data and not self.now.unseen:
            data = entities.unescape(data) if "&" in data else data
            self.block.parts.append(data)
            if not data.isspace():
                self.block.pieces.append((self.now.path, data))

    def close(self, element: Element) -> None:
        """End an element and those in it."""
        x = self.now
        while True:
            if x.tag in BLOCKS:
                self.cut()
            self.open[x.tag].pop()
            if x is element:
                break
            x = x.parent
        self.now = element.parent

    def end(self, tag: str) -> None:
        if tag == "br":
            self.text(" ")
        elif tag not in VOID:
            own = self.open.get(tag)
            if own and (tag in BLOCKS or own[-1].depth > self.now.block):  # an end inside a block doesn't end an inline element around it
                self.close(own[-1])
            elif tag in BLOCKS:
                self.cut()

    def start(self, tag: str, attributes: str) -> None:
        if tag in VOID:
            if tag == "hr":
                self.cut()
            elif tag == "br":
                self.text(" ")
            return
        if tag in BLOCKS:
            if self.now.p is not None:  # a block ends an open p
                self.close(self.now.p)
            if tag in ENDS:
                scope = self.now.table if tag in TABLE_PARTS else self.now.lists
                ended = [own[k] for x in ENDS[tag] if (own := self.open.get(x)) and (k := bisect_right(own, scope, key=lambda e: e.depth)) < len(own)]
                if ended:
                    self.close(min(ended, key=lambda e: e.depth))
            if tag in HEADINGS and self.now.tag in HEADINGS:
                self.close(self.now)
            self.cut()
        names = " ".join(a or b or c for a, b, c in _NAMED.findall(attributes)) if attributes else ""
        factor = LINK if tag == "a" else 1.0  # menus are links; a link within a sentence has the sentence's path beside it
        if tag in APART or (tag == "header" and not self.now.article):
            factor = SURELY_NOT
        elif names and tag not in ("body", "html", "article", "main"):
            factor = min(factor, named_factor(names, self.now.article))
        unseen = self.now.unseen or tag in UNSEEN or bool(attributes and _HIDDEN.search(attributes))
        self.now = Element(tag, self.now, self.now.path.step(tag, factor), unseen)
        self.open.setdefault(tag, []).append(self.now)


def blocks_of(html: str) -> list[Block]:
    """The blocks of a page with text that is seen, in page order. Takes a number of steps in proportion to the page."""
    page = _Page()
    raw_ends: dict[str, bool] = {}
    at, n = 0, len(html)
    while at < n:
        start = html.find("<", at)
        if start < 0:
            page.text(html[at:])
            break
        if start > at:
            page.text(html[at:start])
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), start):
            end = html.find(">", start)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(html, start)
        if not m:
            page.text("<")
            at = start + 1
            continue
        at = m.end()
        closing, tag, attributes = m.group(1), m.group(2).lower(), m.group(3)
        if closing:
            page.end(tag)
        elif tag not in RAW:
            page.start(tag, attributes)
        elif not (attributes.endswith("/") and tag in ("svg", "math")):  # all up to its end is no markup
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at) if raw_ends.get(tag, True) else None
            raw_ends[tag] = end is not None
            at = end.end() if end else n
    page.cut()
    return page.blocks


def fused_ratios(totals: dict[Path, tuple[int, int, float]]) -> dict[Path, float]:
    """Both ratios of each path, smoothed over all paths and fused. Sums by steps below each node of the tree stand for the pairs of paths."""
    nodes = set(totals)
    for p in totals:
        while p.parent is not None and p.parent not in nodes:
            p = p.parent
            nodes.add(p)
    # weight, characters and marks by steps below a node; then what they are from i steps away
    below, seen = {}, {}
    for p in sorted(nodes, key=lambda x: -x.depth):
        sums = below.pop(p, np.zeros((1, 3)))
        if p in totals:
            n, chars, marks = totals[p]
            sums[0] += math.log2(1 + n) * np.array([1.0, chars / n, marks / n])
        seen[p] = _GAUSSIAN[:, : len(sums)] @ sums
        if p.parent is not None:
            more = sums[:REACH]
            up = below.get(p.parent, np.zeros((1, 3)))
            if len(up) <= len(more):
                up = np.concatenate((up, np.zeros((len(more) + 1 - len(up), 3))))
            up[1 : len(more) + 1] += more
            below[p.parent] = up
    out = {}
    for p in totals:
        total, x, i = seen[p][0].copy(), p, 0
        while x.parent is not None and i < REACH:
            i += 1
            total += seen[x.parent][i] - seen[x][i + 1]
            x = x.parent
        weight, chars, marks = np.maximum(total, 0.0).tolist()
        out[p] = math.log2(1 + math.sqrt(chars * marks) / weight)
    return out


def priors(totals: dict[Path, tuple[int, int, float]]) -> dict[Path, float]:
    """The prior of each path: the least factor of the elements around it, and of what holds more than half of the page's text less the more it holds.

    So no name takes away a text by itself: an element that holds all text keeps it, whatever its name.
    """
    held: dict[Path, int] = {}
    nodes: set[Path] = set()
    for p in totals:
        while p is not None and p not in nodes:
            nodes.add(p)
            p = p.parent
    for p in sorted(nodes, key=lambda x: -x.depth):
        held[p] = held.get(p, 0) + (totals[p][1] if p in totals else 0)
        if p.parent is not None:
            held[p.parent] = held.get(p.parent, 0) + held[p]
    every = max(held.values(), default=0) or 1
    out: dict[Path, float] = {}
    for p in sorted(held, key=lambda x: x.depth):
        own = p.factor ** min(1.0, 2 * (1 - held[p] / every)) if p.factor < 1 else 1.0
        out[p] = own if p.parent is None else min(out[p.parent], own)
    return {p: out[p] for p in totals}


def content_paths(totals: dict[Path, tuple[int, int, float]]) -> set[Path]:
    """Of paths with pieces, characters and punctuation marks, those whose fused, smoothed ratios times their priors are over the threshold.

    Characters count for the mean as much as their prior says. Where every path's prior is low, those with the highest are judged alone.
    """
    prior = priors(totals)
    highest = max(prior.values(), default=1.0)
    fused = {p: x * prior[p] / highest for p, x in fused_ratios(totals).items()}
    weights = {p: totals[p][1] * prior[p] for p in totals}
    mean = sum(fused[p] * weights[p] for p in totals) / max(sum(weights.values()), 1e-9)
    return {p for p in totals if fused[p] >= THRESHOLD * mean}


def main_text(html: str) -> str:
    """The article of a page: the blocks that content paths select, each with single blanks, joined by a newline."""
    blocks = blocks_of(html)
    totals: dict[Path, list[float]] = {}
    for block in blocks:
        for path, text in block.pieces:
            t = totals.setdefault(path, [0, 0, 0.0])
            t[0] += 1
            t[1] += len(text) - text.count(" ")
            t[2] += 0.5 + len(_PUNCTUATION.findall(text))
    paths = content_paths({p: tuple(t) for p, t in totals.items()})
    lines = (" ".join("".join(block.parts).split()) for block in blocks if any(p in paths for p, _ in block.pieces))
    return "\n".join(line for line in lines if line)


TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text (empty if none) and n_chars (code points) of every row of pages."""
    ship(pages.sparkSession)

    def run(columns: dict[str, pa.Array]) -> dict[str, object]:
        texts = [main_text(x or "") for x in texts_of(columns["html"])]
        return {"page_id": columns["page_id"], "url": columns["url"], "text": [x.encode("utf-8", "replace").decode() for x in texts], "n_chars": [len(x) for x in texts]}

    own = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    return own.mapInArrow(by_row(run, TEXTS), "page_id long, url string, text string, n_chars long")
