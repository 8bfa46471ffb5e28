"""Main text of web pages by composite text density.

For every element of the page the characters per tag are adjusted by how much
of its text is links. The densities of an element's children are added up; the
element with the largest sum holds the main text. The least density on the way
from it to the body is the threshold by which further parts are taken in.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard, by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
NEVER_TEXT = frozenset(
    "applet audio button canvas datalist dialog embed frame frameset head iframe input link map menu meta noframes noscript "
    "object optgroup option output progress script select style svg template textarea title video".split()
)
PAGE_FURNITURE = frozenset("aside footer nav".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
# Words in class names and ids: of parts that are never the article, and of parts that seldom are.
REMOVED_WORDS = frozenset("comment comments consent cookie cookies discussion disqus gdpr replies reply respond".split())
FURNITURE_WORDS = frozenset(
    "ad ads adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs footer header login masthead menu menus modal nav navbar "
    "navigation newsletter notice notices notification pager pagination paywall popup promo promoted promotion related share sharing "
    "sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets".split()
)
NAMED_WEIGHT = 0.1
# An article beside the largest one is taken in if it has at least this share of its text.
SIBLING_SHARE = 0.25
#: A start tag closes these open elements, if they are above the listed borders.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, {"html"}),
}
SPLIT_NAME = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")
#: Names such as with-sidebar tell what a wrapper also holds.
HOLDS = re.compile(r"\b(?:with|has|have|no|without|show|hide)[-_]?[A-Za-z0-9]+")


class Element:
    """An element with its share of text, tags and links, filled in from below."""

    __slots__ = ("tag", "attrs", "parent", "children", "chars", "tags", "link_chars", "link_tags", "weight", "density", "total")

    def __init__(self, tag: str, attrs: dict, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.weight, self.density, self.total = 1.0, 0.0, 0.0

    def elements(self) -> Iterator["Element"]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(x for x in reversed(node.children) if not isinstance(x, str))


class _Builder(HTMLParser):
    """A tree from tags as they come; end tags may be missing or wrong."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("#root", {}, None)
        self.open = [self.root]

    def _close(self, tags: set[str], borders: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in borders:
                return

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag in BLOCKS and self.open[-1].tag != "#root":
            self._close({"p"}, {"button", "td", "th", "table", "object", "caption", "li", "blockquote", "div", "article", "section", "body"})
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.open.pop()
        if tag == "a":
            self._close({"a"}, {"td", "th", "table", "p", "li", "div", "article", "section", "body"})
        node = Element(tag, {k: v or "" for k, v in attrs}, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        borders = {"td", "th", "table", "body"} if tag not in BLOCKS else set()
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in borders:
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str) -> Element:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def _names(node: Element) -> set[str]:
    text = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}"
    return {x.lower() for x in SPLIT_NAME.split(HOLDS.sub(" ", text)) if x} if text != " " else set()


def _hidden(node: Element) -> bool:
    style = node.attrs.get("style", "").replace(" ", "").lower() if "style" in node.attrs else ""
    return "hidden" in node.attrs or "display:none" in style or "visibility:hidden" in style or node.attrs.get("aria-hidden") == "true"


def _never_main(node: Element, in_article: bool) -> bool:
    """Whether an element cannot be main text, by its role in the standard or as comments and the like."""
    if node.tag in NEVER_TEXT or node.tag in PAGE_FURNITURE or (node.tag == "header" and not in_article):
        return True
    if not node.attrs or node.tag in ("#root", "html", "body"):
        return False
    return _hidden(node) or bool(_names(node) & REMOVED_WORDS and not _encloses_article(node, REMOVED_WORDS))


def _encloses_article(node: Element, words: frozenset[str]) -> bool:
    return any(x.tag in ("main", "h1") or (x.tag == "article" and x is not node and not _names(x) & words) for x in node.elements())


def _named_otherwise(node: Element, in_article: bool) -> bool:
    """Whether its name or tag makes an element an unlikely place for the article."""
    if node.tag in ("form", "fieldset"):
        return True
    if not node.attrs or node.tag in ("#root", "html", "body", "main"):
        return False
    named = node.attrs.get("role", "").lower() in FURNITURE_ROLES or _names(node) & (FURNITURE_WORDS - {"header"} if in_article else FURNITURE_WORDS)
    # What encloses the article is no less likely.
    return bool(named) and not _encloses_article(node, FURNITURE_WORDS | REMOVED_WORDS)


def prune(root: Element) -> None:
    """Take out what is never main text, and set the weights of the rest."""
    stack = [(root, False)]
    while stack:
        node, in_article = stack.pop()
        in_article = in_article or node.tag in ("article", "main")
        node.children = [x for x in node.children if isinstance(x, str) or not _never_main(x, in_article)]
        for x in node.children:
            if not isinstance(x, str):
                x.weight = min(node.weight, NAMED_WEIGHT if _named_otherwise(x, in_article) else 1.0)
                stack.append((x, in_article))


def weigh(root: Element) -> None:
    """Fill in characters, tags, weighted densities and the sums of the children's densities.

    With C characters, T tags, LC characters and LT tags of links, and the
    page's share s of link characters, an element's density is
    C / T * log(C / LC * T / LT) / log(C / (C - LC) * LC + s * C + e), T
    and every divisor being 1 at least, times the element's weight.
    """
    order = list(root.elements())
    for node in reversed(order):
        link = node.tag == "a"
        for child in node.children:
            if isinstance(child, str):
                node.chars += len(child.strip())
            else:
                node.chars += child.chars
                node.tags += child.tags + 1
                node.link_chars += child.link_chars
                node.link_tags += child.link_tags + (child.tag == "a")
        if link:
            node.link_chars = node.chars
    share = root.link_chars / max(root.chars, 1)
    for node in order:
        if not node.chars:
            continue
        tags, link_chars, link_tags = max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        other = max(node.chars - node.link_chars, 1)
        base = math.log(node.chars / other * node.link_chars + share * node.chars + math.e)
        adjusted = math.log(max(node.chars / link_chars * tags / link_tags, 1.0)) / base
        node.density = node.chars / tags * adjusted * node.weight
    for node in order:
        node.total = sum(x.density for x in node.children if not isinstance(x, str))
        if not node.total and node.chars:
            node.total = node.density


def _largest(node: Element) -> Element:
    best = node
    for x in node.elements():
        if x.total > best.total:
            best = x
    return best


def _path(node: Element) -> list[Element]:
    found = []
    while node is not None and node.tag not in ("#root", "html"):
        found.append(node)
        node = node.parent
    return found


def _text_weight(node: Element) -> float:
    """The weight that most of an element's text has, as far as it weighs."""
    chars: dict[float, int] = {}
    for x in node.elements():
        chars[x.weight] = chars.get(x.weight, 0) + sum(len(c.strip()) for c in x.children if isinstance(c, str))
    return max(chars, key=lambda w: (chars[w] * w, w))


def _articles(node: Element) -> list[Element]:
    """The outermost articles inside an element, without small ones beside a large one."""
    found, stack = [], [x for x in node.children if not isinstance(x, str)]
    while stack:
        x = stack.pop()
        if x.tag in ("article", "main"):
            found.append(x)
        else:
            stack.extend(c for c in x.children if not isinstance(c, str))
    most = max((x.chars * x.weight for x in found), default=0)
    return [x for x in found if x.chars * x.weight >= SIBLING_SHARE * most]


def main_parts(root: Element) -> dict[int, float]:
    """Identities of the elements whose text is main text, each with the weight that its text has."""
    body = next((x for x in root.elements() if x.tag == "body"), root)
    if not body.chars:
        body = root
    best = _largest(body)
    # Around articles that hold most of the text, the rest is not the article.
    framed = _articles(best)
    if framed and 2 * sum(x.chars for x in framed) >= best.chars:
        best = max(framed, key=lambda x: x.chars * x.weight)
    path, weight = _path(best), _text_weight(best)
    threshold = min((x.density for x in path), default=0.0)
    frames = [x for x in path if x.tag == "article"] or [x for x in path if x.tag == "main"]
    beside = {id(x): x for x in (_articles(frames[0].parent) if frames and frames[0].parent is not None else framed)}
    marked: dict[int, Element] = {}
    stack = [body]
    while stack:
        node = stack.pop()
        if node.density >= threshold and node.chars and _text_weight(node) >= weight:
            found = _largest(node)
            # The article that encloses it is one text with its headings.
            frame = next((x for x in _path(found) if x.tag == "article"), None) or next((x for x in _path(found) if x.tag == "main"), None)
            marked[id(frame or found)] = frame or found
        stack.extend(x for x in node.children if not isinstance(x, str) and x.density >= threshold)
    # A smaller article has a lower density than the largest, whose logarithm grows with its size.
    marked |= {i: x for i, x in beside.items() if 2 * x.density >= threshold}
    if frames:
        inside = {id(x) for x in frames[0].elements()} | set(beside)
        marked = {i: x for i, x in marked.items() if i in inside} or marked
    else:
        # Headings in front of the way to the main text belong to it.
        for node in path:
            for sibling in node.parent.children if node.parent is not None else ():
                if sibling is node:
                    break
                if not isinstance(sibling, str) and sibling.tag in ("h1", "h2"):
                    marked[id(sibling)] = sibling
    return {i: _text_weight(x) for i, x in marked.items()}


def _link_list(node: Element) -> bool:
    return node.tag in ("ul", "ol", "div", "section", "table") and node.link_tags >= 3 and node.link_chars > 0.9 * node.chars


def blocks_of(root: Element, marked: dict[int, float]) -> list[str]:
    """Text blocks under the marked elements, in page order."""
    blocks: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = " ".join("".join(run).split())
        if text:
            blocks.append(text)
        run.clear()

    # (item, weight of the main text that it is inside of or 0, leaving): without recursion, as pages may nest deeply.
    stack: list[tuple] = [(root, 0.0, False)]
    while stack:
        item, inside, leaving = stack.pop()
        if isinstance(item, str):
            if inside:
                run.append(item)
            continue
        if leaving:
            end()
            continue
        if inside and id(item) not in marked and (_link_list(item) or item.weight < inside):
            continue
        if inside and item.tag in ("br", "wbr", "img"):
            run.append(" " if item.tag == "br" else "")
        begins = not inside and id(item) in marked
        inside = inside or (marked[id(item)] if begins else 0.0)
        if item.tag in BLOCKS or begins:
            end()
            stack.append((item, inside, True))
        stack.extend((x, inside, False) for x in reversed(item.children))
    end()
    return blocks


def main_text(html: str | None) -> str:
    """Blocks of the main text, joined by line feeds; empty if there is none."""
    if not html or not html.strip():
        return ""
    root = parse(html)
    prune(root)
    weigh(root)
    return "\n".join(blocks_of(root, main_parts(root)))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points of text).

    A null or blank page, one without text and one that is all menus has an
    empty text. Text without any markup is main text. Pages are read each for
    itself, so null or repeated ids and urls are returned as they are; other
    columns are not looked at. The whole page is read, however long.

    Removed by name are comments, replies, discussions and consent notices;
    parts with other names of furniture and forms yield to text of full
    weight, inside and outside the article, see the module's description. Of
    several articles those with a quarter of the largest one's text are taken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    columns = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return columns.mapInArrow(run, "page_id long, url string, text string, n_chars long")
