"""Main text of web pages: a classifier's costs and a minimum cut separate content from boilerplate.

A page is cut into blocks, the runs of text between block-level tags. What a block costs
as content or as boilerplate comes from the elements around it and from its shape; an
edge between neighbours in the page, and between neighbours under one element, costs
where their labels differ, the less the further apart they are in the tree. The labels
of least total cost are the minimum cut.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import map_batches
from tickloom.llm.min_cut import min_cut

# Fixed values of HTML: elements that break a line of text, that have no content, and whose content is no text of the page.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("audio canvas datalist iframe math noembed noframes noscript object script style svg template textarea title video xmp".split())
#: Elements that a start tag of the key ends, and the elements that such an end does not pass. Fixed values of HTML.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

# What an element says of the text inside it: by its tag, by its role, and by words of its class and id.
CONTENT_TAGS = frozenset({"article", "main"})
OTHER_TAGS = frozenset("aside button dialog fieldset footer form head label legend menu nav search select".split())
CONTENT_ROLES, OTHER_ROLES = frozenset({"article", "main"}), frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search tablist toolbar".split())
CONTENT_WORDS = frozenset("article articlebody blog body content entry main maincontent post story text".split())
SOFT_WORDS = frozenset("author banner bottom byline copyright foot footer head header masthead menu meta nav navigation notice related tags title toolbar top".split())
HARD_WORDS = frozenset("ad ads advert advertisement adverts adsense alert breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus gdpr login modal navbar newsletter pager pagination popup promo promotion recommended recommendations reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser tracking widget widgets".split())
TITLES = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})

#: Costs, in hundredths: of content where elements say so, of boilerplate where they do, and of what is hidden.
CONTENT, OTHER, HIDDEN = 400, 800, 4000
#: Costs of labels that differ: between neighbours in the page, divided by one and their distance in the tree, and between neighbours under one element.
BESIDE, SIBLINGS = 150, 75
#: Part of the shape's evidence that counts, since its features depend on each other; how many labelled blocks weigh as much as the values below; bound of a value.
SHAPE, TRUST, MOST = 0.6, 200, 2.0
#: Evidence of a block's shape before any page has been seen, as logarithms of odds.
SHAPES = {
    "words": {"0": -1.5, "1": -1.0, "4": -0.5, "10": 0.5, "25": 1.5},
    "links": {"none": 0.3, "some": -0.7, "most": -2.0},
    "end": {"sentence": 0.5, "other": -0.4},
    "kind": {"text": 0.8, "title": 0.8, "item": -0.3, "cell": -0.5, "other": -0.2},
    "sign": {"copyright": -2.0, "none": 0.0},
}
Shapes = dict[str, dict[str, float]]

_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|</([a-zA-Z][^\s/>]*+)[^>]*+>?|<([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>?", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


@dataclass
class Node:
    tag: str
    up: int
    depth: int
    content: bool = False
    other: bool = False
    soft: bool = False  # boilerplate by words only, which a node around the article can't be
    hidden: bool = False
    chars: int = 0
    holds: bool = False  # an element of content


@dataclass
class Block:
    node: int
    text: str
    linked: int  # characters inside links
    lean: int | None = field(default=None)


def _named(attributes: dict[str, str]) -> tuple[bool, bool, bool]:
    """Whether class and id tell of content, of boilerplate, and of boilerplate whatever else they tell."""
    words = {w.lower() for w in _WORD.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}")}
    content, hard, soft = bool(words & CONTENT_WORDS), bool(words & HARD_WORDS), bool(words & SOFT_WORDS)
    return content and not (hard or soft), hard or (soft and not content), hard


def parse(page: str) -> tuple[list[Node], list[Block]]:
    """Elements and text blocks of a page, in its order; a page cut off anywhere has those up to there."""
    nodes, blocks = [Node("", -1, 0)], []
    open_, parts, linked, links = [0], [], 0, 0
    at, end = 0, len(page)

    def text(to: int) -> None:
        nonlocal linked
        if to > at:
            run = html.unescape(page[at:to]) if "&" in page[at:to] else page[at:to]
            parts.append(run)
            if links:
                linked += len(run.strip())

    def flush() -> None:
        nonlocal linked
        if parts:
            joined = " ".join("".join(parts).split())
            if joined:
                blocks.append(Block(open_[-1], joined, linked))
            parts.clear()
        linked = 0

    def close(tags: set[str], stop: set[str]) -> None:
        for k in range(len(open_) - 1, 0, -1):
            tag = nodes[open_[k]].tag
            if tag in tags:
                del open_[k:]
                return
            if tag in stop:
                return

    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            text(end)
            break
        text(m.start())
        at = m.end()
        ends, tag = m[1], (m[2] or "").lower()
        if ends:
            ends = ends.lower()
            if ends == "a":
                links = max(0, links - 1)
            elif ends in BLOCKS:
                flush()
                links = 0
                close({ends}, {"html"} if ends in ("body", "html") else {"table"} - {ends} if ends == "p" else set())
        elif tag in SKIPPED:
            if not m[0].endswith("/>") or tag in ("script", "style", "title", "textarea"):
                stop = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I).search(page, at)
                at = stop.end() if stop else end
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            links = 1
        elif tag in BLOCKS:
            flush()
            links = 0
            if tag in ENDS:
                close(*ENDS[tag])
            elif tag not in ("button", "label", "option", "select"):
                close({"p"}, BLOCKS - {"p"})
            if tag not in EMPTY:
                _open(nodes, open_, tag, m[3])
    flush()
    return nodes, blocks


def _open(nodes: list[Node], open_: list[int], tag: str, given: str) -> None:
    up = open_[-1]
    node = Node(tag, up, nodes[up].depth + 1)
    attributes = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(given)} if given.strip() else {}
    role = attributes.get("role", "").strip().lower()
    node.hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(_UNSEEN.search(attributes.get("style", "").lower()))
    node.content = tag in CONTENT_TAGS or role in CONTENT_ROLES
    node.other = tag in OTHER_TAGS or role in OTHER_ROLES
    if tag == "header":  # a heading's place inside an article, a page's head elsewhere
        node.other = not any(nodes[k].content for k in open_)
    if not node.content and not node.other and tag not in ("html", "body") and attributes:
        node.content, node.soft, _ = _named(attributes)
    nodes.append(node)
    open_.append(len(nodes) - 1)


def shape(block: Block, tag: str) -> dict[str, str]:
    """The features of a block's own look."""
    words = block.text.count(" ") + 1
    share = block.linked / len(block.text)
    kind = "text" if tag in ("p", "pre", "blockquote", "figcaption", "dd") else "title" if tag in TITLES else "item" if tag in ("li", "dt") else "cell" if tag in ("td", "th", "caption") else "other"
    return {
        "words": "25" if words >= 25 else "10" if words >= 10 else "4" if words >= 4 else "1",
        "links": "most" if share > 0.5 else "some" if share > 0.1 else "none",
        "end": "sentence" if block.text[-1] in ".!?…\"'»”)" else "other",
        "kind": kind,
        "sign": "copyright" if "©" in block.text else "none",
    }


def surroundings(nodes: list[Node], blocks: list[Block]) -> list[int]:
    """What the elements around each block say: above 0 content, below 0 boilerplate, 0 nothing.

    Boilerplate inside content is boilerplate, and so is content inside boilerplate. Words
    of a class tell nothing of an element that holds the article, or most of the page.
    """
    for b in blocks:
        nodes[b.node].chars += len(b.text)
    for node in reversed(nodes[1:]):
        up = nodes[node.up]
        up.chars += node.chars
        up.holds |= node.holds or node.content and node.tag in CONTENT_TAGS
    whole, said = nodes[0].chars, [0] * len(nodes)
    for k, node in enumerate(nodes[1:], 1):
        before = said[node.up]
        soft = node.soft and not node.holds and 2 * node.chars <= whole
        own = -HIDDEN if node.hidden and not node.holds else -OTHER if node.other or soft else CONTENT if node.content else 0
        said[k] = min(before, own) if before < 0 or own < 0 else max(before, own)
    return [said[b.node] for b in blocks]


def distance(nodes: list[Node], i: int, j: int) -> int:
    """Steps between two elements in the tree."""
    steps = 0
    while i != j:
        if nodes[i].depth < nodes[j].depth:
            i, j = j, i
        i, steps = nodes[i].up, steps + 1
    return steps


def labelled(page: str, shapes: Shapes = SHAPES) -> list[tuple[str, bool]]:
    """The text blocks of a page and whether each is content."""
    nodes, blocks = parse(page)
    leaning = []
    for b, around in zip(blocks, surroundings(nodes, blocks), strict=True):
        seen = sum(shapes[k][v] for k, v in shape(b, nodes[b.node].tag).items())
        leaning.append(around + round(100 * SHAPE * seen))
    edges, last = [], {}
    for k, b in enumerate(blocks):
        if k:
            edges.append((k - 1, k, BESIDE // (1 + distance(nodes, blocks[k - 1].node, b.node))))
        up = nodes[b.node].up
        if last.get(up, k - 1) < k - 1:
            edges.append((last[up], k, SIBLINGS))
        last[up] = k
    return [(b.text, content) for b, content in zip(blocks, min_cut(leaning, edges), strict=True)]


def main_text(page: str | None, shapes: Shapes = SHAPES) -> str:
    return " ".join(text for text, content in labelled(page or "", shapes) if content)


def learned_shapes(pages: DataFrame, base: Shapes = SHAPES) -> Shapes:
    """Evidence of shapes from all pages (html): blocks that their elements call content or boilerplate are the labels.

    A value is the logarithm of how much likelier it is in content, shrunk towards base
    as if that had been seen TRUST times; tables without such blocks give base itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, str, bool]] = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                nodes, blocks = parse(page or "")
                for b, around in zip(blocks, surroundings(nodes, blocks), strict=True):
                    if around and around > -HIDDEN:
                        seen.update((k, v, around > 0) for k, v in shape(b, nodes[b.node].tag).items())
        rows = [(*k, n) for k, n in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.bool_(), pa.int64()))], ["feature", "value", "content", "n"])

    counted = pages.select("html").mapInArrow(run, "feature string, value string, content boolean, n long").groupBy("feature", "value", "content").agg(F.sum("n").alias("n")).collect()
    n = {(r["feature"], r["value"], r["content"]): r["n"] for r in counted}
    out: Shapes = {}
    for feature, values in base.items():
        total = [sum(n.get((feature, v, c), 0) for v in values) for c in (False, True)]
        out[feature] = {}
        for value, start in values.items():
            has = [n.get((feature, value, c), 0) for c in (False, True)]
            odds = math.log((has[1] + 1) / (total[1] + len(values)) * (total[0] + len(values)) / (has[0] + 1))
            weight = sum(has) / (sum(has) + TRUST)
            out[feature][value] = (1 - weight) * start + weight * max(-MOST, min(MOST, odds))
    return out


def extract(pages: DataFrame, page: str = "page_id", shapes: Shapes | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages (page_id, url, html): its main text, and how many code points that has.

    Blocks of content stand in page order with a space between; inside one, white space
    is one space. A null or empty page has an empty text; repeated rows give repeated
    results; an empty table gives no rows; other columns are not read. A page of any
    length is parsed whole in one pass; memory is a small multiple of its length.
    """
    known = learned_shapes(pages) if shapes is None else shapes
    kind = pages.schema[page].dataType.simpleString()

    def make() -> Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]:
        def each(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            texts = [main_text(x, known) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

        return each

    return map_batches(pages.select(F.col(page).alias("page_id"), "url", "html"), make, f"page_id {kind}, url string, text string, n_chars long")
