"""Main text of web pages by tag-path ratios.

Every piece of text hangs on a root-to-leaf tag path. A page's paths are measured by the text
length and by the punctuation per node, the two series are smoothed over the page's order and
fused, and paths whose fused score passes a threshold give the content nodes. Regions that their
element, role or name marks as something else than the article are taken out before; inside an
element that names the article fewer names do so.

A page is read once from left to right, each tag up to its end. As in browsers, a tag or a quoted
value that never ends takes the rest of the page with it, and elements nest up to a fixed depth.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evidentia.llm.common import emit, ship, texts_of

#: Radius and width of the smoothing over a page's nodes, and the share of the best fused score that a path needs.
RADIUS, SIGMA, SHARE = 2, 1.0, 0.2
#: Part of that share that suffices inside an element that names the article, and what a path without any punctuation counts as.
MARKED, FLOOR = 0.5, 0.01
#: Elements that may be open at once; deeper ones are not opened, and their text is that of the element around them.
DEPTH = 512

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?>[^>=]+|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'\s])))*+)>""")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none|visibility\s*:\s*hidden""", re.I)
_TOKEN = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？·–—]")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_OUT = frozenset("head nav footer aside form button select option menu dialog label fieldset legend datalist noscript template svg math canvas object audio video".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_ARTICLE = frozenset("article main".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag on the left ends open elements on the right, up to the nearest of the boundary elements.
_ENDS = {"li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"}), "body": frozenset({"head"})}
_BOUNDARY = frozenset("ul ol dl table article section main body html div".split())
#: Words in class, id or role that mark something else than the article anywhere, and those that do so outside of it only.
_OTHER_WORDS = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager footer masthead banner contentinfo sidebar complementary aside "
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion promoted outbrain taboola dfp "
    "cookie cookies consent gdpr notice notices popup modal overlay lightbox newsletter subscribe subscription signup signin paywall "
    "social share sharing sharebar comment comments commentlist disqus respond searchbox".split()
)
_OUTER_WORDS = frozenset(
    "header rail widget widgets alert login register follow related recommended recommendations trending popular more readmore tags tagcloud "
    "reply replies search toolbar toc skip hidden sr screenreader copyright legal disclaimer".split()
)


@dataclass(slots=True)
class Node:
    """Text that one element holds directly, with its path's number, its block and whether a link holds it."""

    path: int
    block: int
    text: str
    linked: bool
    inside: bool
    heading: bool


@dataclass(slots=True)
class _Open:
    name: str
    path: int
    out: bool
    inside: bool
    linked: bool
    heading: bool


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    blocks: int = 0


def _named(attributes: str) -> tuple[list[str], bool]:
    """The words in class, id and role, and whether the element is hidden."""
    if not attributes:
        return [], False
    words = [w for m in _NAMES.finditer(attributes) for w in _TOKEN.findall(_CAMEL.sub(" ", m[1] or m[2] or m[3] or "").lower())]
    return words, bool(_HIDDEN.search(attributes))


def _after_raw(html: str, name: str, at: int) -> int:
    """Where the page goes on after the end tag of an element whose content is not markup."""
    close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
    end = html.find(">", close.end()) if close else -1
    return end + 1 if end >= 0 else len(html)


class _Reader:
    """One pass over a page. A path is a number for (the path around it, element and names), so it costs the same at any depth."""

    def __init__(self, html: str):
        self.html, self.page, self.block, self.filled = html, Page(), 0, False
        self.stack = [_Open("", 0, False, False, False, False)]
        self.paths: dict[tuple, int] = {}
        self.open: Counter[str] = Counter()

    def close(self, depth: int) -> None:
        self.open.subtract(e.name for e in self.stack[depth:])
        del self.stack[depth:]

    def text(self, begin: int, end: int) -> None:
        top = self.stack[-1]
        if end <= begin or top.out:
            return
        raw = self.html[begin:end]
        if not raw.isspace():
            self.page.nodes.append(Node(top.path, self.block, entities.unescape(raw) if "&" in raw else raw, top.linked, top.inside, top.heading))
            self.filled = True
        else:
            self.space()

    def space(self) -> None:
        if self.page.nodes and self.page.nodes[-1].block == self.block:
            self.page.nodes[-1].text += " "

    def end(self, name: str) -> None:
        if not self.open[name]:
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth].name == name:
                self.close(depth)
                break
            if self.stack[depth].name in _BOUNDARY and name in _INLINE:
                break

    def begin(self, name: str, attributes: str) -> None:
        stack = self.stack
        if name not in _INLINE:  # a block ends an open paragraph
            ends = _ENDS.get(name, frozenset())
            found = self.open["p"] or any(self.open[e] for e in ends)
            for depth in range(len(stack) - 1 if found else 0, 0, -1):
                if stack[depth].name == "p" or stack[depth].name in ends:
                    self.close(depth)
                    if stack[-1].name not in ends:
                        break
                elif stack[depth].name in _BOUNDARY:
                    break
        if attributes.endswith("/"):
            return
        top = stack[-1]
        words, hidden = _named(attributes)
        inside = top.inside or name in _ARTICLE
        other = hidden or not _OTHER_WORDS.isdisjoint(words) or not (top.inside or _OUTER_WORDS.isdisjoint(words))
        out = top.out or name in _OUT or (name == "header" and not top.inside) or (other and name not in ("html", "body", "article", "main", "h1"))
        if len(stack) > DEPTH and (top.out or not out):
            return
        self.open[name] += 1
        path = self.paths.setdefault((top.path, name, *words), len(self.paths) + 1)
        stack.append(_Open(name, path, out, inside, top.linked or name == "a", top.heading or name in _HEADING))

    def read(self) -> Page:
        html, at, look = self.html, 0, 0
        while (look := html.find("<", look)) >= 0:
            if html.startswith(("<!", "<?"), look):
                self.text(at, look)
                mark = "-->" if html.startswith("<!--", look) else ">"
                end = html.find(mark, look + 2)
                at = look = end + len(mark) if end >= 0 else len(html)
                continue
            if not (html[look + 1 : look + 2].isascii() and html[look + 1 : look + 2].isalpha() or html[look + 1 : look + 2] == "/" and html[look + 2 : look + 3].isascii() and html[look + 2 : look + 3].isalpha()):
                look += 1  # no tag, but text
                continue
            self.text(at, look)
            m = _TAG.match(html, look)
            at = look = m.end() if m else len(html)
            if not m:
                break
            name = m[2].lower()
            if name not in _INLINE and self.filled:
                self.block, self.filled = self.block + 1, False
            if m[1]:
                self.end(name)
            elif name == "br":
                self.space()
            elif name in _RAW:
                if not m[3].rstrip().endswith("/"):
                    at = look = _after_raw(html, name, at)
            elif name not in _VOID:
                self.begin(name, m[3])
        self.text(at, len(html))
        self.page.blocks = self.block + 1
        return self.page


def parse(html: str) -> Page:
    """The text nodes of a page in order; elements that need no end tag are ended as browsers do."""
    return _Reader(html).read()


def _smoothed(values: np.ndarray) -> np.ndarray:
    weights = np.array([math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-RADIUS, RADIUS + 1)])
    return np.convolve(values, weights, "full")[RADIUS : RADIUS + len(values)] / np.convolve(np.ones(len(values)), weights, "full")[RADIUS : RADIUS + len(values)]


def path_scores(nodes: list[Node]) -> dict[int, float]:
    """The fused score of each path, relative to the page's best."""
    if not nodes:
        return {}
    paths: dict[int, list[float]] = {}
    for node in nodes:
        measures = paths.setdefault(node.path, [0.0, 0.0, 0.0, 0.0])
        size = len(node.text)
        for i, x in enumerate((1.0, size, len(_PUNCTUATION.findall(node.text)), size if node.linked else 0)):
            measures[i] += x
    text = _smoothed(np.array([math.log1p(paths[n.path][1] / paths[n.path][0]) for n in nodes]))
    marks = _smoothed(np.array([math.log1p(paths[n.path][2] / paths[n.path][0]) for n in nodes]))
    if marks.max() > 0:
        fused = np.sqrt((text / max(text.max(), 1e-9)) * (FLOOR + (1 - FLOOR) * marks / marks.max()))
    else:  # without any punctuation on the page that series tells nothing
        fused = text / max(text.max(), 1e-9)
    sums: dict[int, list[float]] = {}
    for node, score in zip(nodes, fused.tolist(), strict=True):
        total = sums.setdefault(node.path, [0.0, 0])
        total[0] += score * (1 - paths[node.path][3] / max(paths[node.path][1], 1))
        total[1] += 1
    means = {p: s / n for p, (s, n) in sums.items()}
    best = max(means.values())
    return {p: s / best if best > 0 else 0.0 for p, s in means.items()}


def content_nodes(page: Page) -> list[Node]:
    """The nodes of the paths that pass the threshold, and with them the rest of their blocks.

    All paths of the page compete. Lying in an element that names the article is one signal more:
    such paths need MARKED of the share only. A heading goes with the content right behind it.
    """
    nodes = page.nodes
    scores = path_scores(nodes)
    chosen = [scores[n.path] >= (SHARE * MARKED if n.inside else SHARE) for n in nodes]
    for i in range(len(nodes) - 2, -1, -1):
        chosen[i] = chosen[i] or (nodes[i].heading and chosen[i + 1])
    held = {n.block for n, c in zip(nodes, chosen, strict=True) if c}
    return [n for n in nodes if n.block in held]


def extract(html: str | None) -> str:
    """The main text: blocks with white space made single spaces, joined by blank lines."""
    if not html:
        return ""
    blocks: dict[int, list[str]] = {}
    for node in content_nodes(parse(html)):
        blocks.setdefault(node.block, []).append(node.text)
    lines = [" ".join("".join(parts).split()) for parts in blocks.values()]
    return "\n\n".join([line for line in lines if line])


_ROWS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page; pages without html or content have an empty text.

    Repeated pages are extracted each, and missing ids and urls stay missing. A page of any length
    or nesting takes time and memory in proportion to its length. Other columns are ignored; an
    empty table gives no rows.
    """
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h) for h in texts_of(batch.column("html"))]
            yield from emit(_ROWS, [batch.column("page_id"), batch.column("url"), texts, [len(t) for t in texts]], 2_000)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
