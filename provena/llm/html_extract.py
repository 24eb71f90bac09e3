"""HTML extraction by tree scoring.

A tolerant parser builds the tree of a page. Elements that are furniture by tag, role, hidden state or the words of their class and id
are cut. Every paragraph then passes points (one, one per comma, one per hundred characters up to three) to its ancestors, all to the parent
and a falling share further up; a container's points are discounted by its link density. The best container is kept with those of its
siblings that score near it or read like text; where it lies in an article or main element, that element is the container. In the kept part,
blocks of links are left out. The text is what remains, block by block.

Defined cases: a null or empty page, and one without text, give an empty text; unclosed, misnested and truncated markup is read as far as it
goes; repeated rows give the same text; other columns pass through. Time is in proportion to the page whatever its depth: open elements are kept by name, so no tag looks for its
partner along its ancestors, and what a subtree holds is summed up once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split())
CUT = frozenset("head script style noscript template iframe object embed canvas audio video svg math form button select option input textarea label nav footer aside menu dialog search applet map datalist title".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar tablist tooltip status".split())
#: An open element of the first kind ends where one of the second kind begins.
ENDS = {
    "p": BLOCK - {"body", "html"},
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "thead", "tfoot"}),
    "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "option": frozenset({"option", "optgroup"}),
    "head": frozenset({"body", "article", "main", "div", "p", "nav", "header", "section"}),
}
STOPS = {"li": frozenset({"ul", "ol", "menu", "dir"}), "dt": frozenset({"dl"}), "dd": frozenset({"dl"}), "tr": frozenset({"table"}), "td": frozenset({"table"}), "th": frozenset({"table"})}
#: For the beginning of an element: those that it ends, and those beyond which it ends nothing.
ENDED = {tag: frozenset(k for k, v in ENDS.items() if tag in v) for tag in frozenset().union(*ENDS.values())}
FENCED = {tag: STOPS.get(tag, frozenset()) | {"table", "body", "article", "main", "div", "section", "blockquote"} for tag in ENDED}
FURNITURE = frozenset(
    """ad ads advert advertisement adverts adsense adslot banner breadcrumb breadcrumbs byline comment comments commentlist cookie cookies consent disclaimer disqus
    dropdown footer gdpr hidden login masthead menu menubar modal nav navbar navigation newsletter notice notification outbrain overlay pager pagination paywall popup print
    promo promoted promotion rail recommended recommendation recommendations related replies reply respond search share sharing sidebar signup skip social sponsor
    sponsored subscribe subscription taboola tags teaser toc toolbar topbar widget widgets""".split()
)
GOOD = frozenset("article articlebody body content entry main post story text page prose".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PART = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")


class Node:
    __slots__ = ("tag", "attrs", "parent", "depth", "block", "children", "points", "chars", "links", "commas", "anchors", "page")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.depth = parent.depth + 1 if parent else 0
        self.block = self.depth if parent is None or tag in BLOCK else parent.block  # depth of the nearest block, itself included
        self.children: list[Node | str] = []
        self.points = 0.0
        self.chars = self.links = self.commas = self.anchors = 0
        self.page = False

    def attributes(self) -> dict[str, str]:
        return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(self.attrs)} if self.attrs else {}


def parse(html: str) -> Node:
    root = at = Node("html", "", None)
    open_: dict[str, list[Node]] = {}  # by name, the deepest last

    def last(tags) -> Node | None:
        found = None
        for t in tags:
            if (x := open_.get(t)) and (found is None or x[-1].depth > found.depth):
                found = x[-1]
        return found

    def close(x: Node) -> Node:
        """Close x and all within it. Each element is closed once."""
        y = at
        while True:
            open_[y.tag].pop()
            if y is x:
                return x.parent
            y = y.parent

    pos = 0
    while True:
        m = _TOKEN.search(html, pos)
        if m is None or m.start() > pos:
            at.children.append(html[pos : m.start() if m else len(html)])
        if m is None:
            return root
        pos = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            x = last((tag,))
            # a closing inline tag does not reach out of a block
            if x is not None and (tag in BLOCK or tag in ("td", "th") or x.depth > at.block):
                at = close(x)
            continue
        if tag == "html":
            root.attrs += m[3] or m[6] or ""
            continue
        if tag in ENDED:
            x = last(ENDED[tag])
            fence = last(FENCED[tag]) if x is not None else None
            if x is not None and (fence is None or x.depth >= fence.depth):
                at = close(x)
        given = m[3] or m[6] or ""
        node = Node(tag, given, at)
        at.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, pos)
            pos = end.end() if end else len(html)
        elif tag not in VOID and not given.rstrip().endswith("/"):
            open_.setdefault(tag, []).append(node)
            at = node


def _cut(x: Node, within: bool) -> bool:
    """Whether x is furniture. within: it stands in an article or main element."""
    if x.tag in CUT:
        return True
    if x.tag == "header":
        return not within
    if not x.attrs:
        return False
    a = x.attributes()
    style = a.get("style", "").replace(" ", "").lower()
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
        return True
    if a.get("role", "").lower() in CUT_ROLES:
        return True
    if x.tag in ("body", "main", "h1"):
        return False
    names = {n.lower() for key in ("class", "id", "itemprop") for n in _NAME_PART.findall(a.get(key, ""))}
    bad = names & FURNITURE
    if not bad:
        return False
    if x.tag == "article" or names & GOOD:
        return bool(bad & {"comment", "comments", "commentlist", "sidebar", "ad", "ads", "advert", "advertisement", "related", "teaser", "promo", "newsletter", "nav", "navigation", "menu", "footer", "replies", "reply", "disqus", "cookie", "share", "social", "sponsored"})
    return True


def _in_order(root: Node) -> list[Node]:
    """All nodes, parents first."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [c for c in x.children if isinstance(c, Node)]
    return order


def prune(root: Node) -> None:
    for x in reversed(_in_order(root)):
        x.page = any(isinstance(c, Node) and (c.page or c.tag in ("main", "h1") or c.tag == "article" and not _cut(c, False)) for c in x.children)
    todo = [(root, False)]
    while todo:
        x, within = todo.pop()
        within = within or x.tag in ("article", "main")
        x.children = [c for c in x.children if isinstance(c, str) or not _cut(c, within) or _holds_the_page(c)]
        todo += [(c, within) for c in x.children if isinstance(c, Node)]


def _holds_the_page(x: Node) -> bool:
    """A wrapper whose class has a furniture word (has-sidebar, ad-free) but which holds the article itself."""
    if not x.page or x.tag not in ("div", "section", "center", "table", "tr", "td", "span"):
        return False
    a = x.attributes()
    return not ("hidden" in a or a.get("aria-hidden", "").lower() == "true" or "none" in a.get("style", "").lower() or a.get("role", ""))


def measure(root: Node) -> list[Node]:
    """Characters, commas, links and characters in links below every node; all nodes, parents first."""
    order = _in_order(root)
    for x in reversed(order):
        x.anchors = int(x.tag == "a")
        for c in x.children:
            if isinstance(c, str):
                t = c.strip()
                x.chars += len(t)
                x.commas += t.count(",") + t.count("、") + t.count("，")
            else:
                x.chars += c.chars
                x.commas += c.commas
                x.anchors += c.anchors
                x.links += c.chars if c.tag == "a" else c.links
    return order


def density(x: Node) -> float:
    return x.links / x.chars if x.chars else 0.0


def container(order: list[Node]) -> list[Node]:
    """The best container and the siblings that go with it."""
    # all to the parent, half of what a node has got to the next: children before parents, so each node is done once
    for x in reversed(order):
        direct = x.tag in ("div", "td", "section", "article", "main", "body") and sum(len(c.strip()) for c in x.children if isinstance(c, str)) >= 25
        points = 0.0
        if (x.tag in ("p", "pre", "blockquote", "li", "dd") or direct) and x.chars >= 1:
            points = (1 + x.commas + min(x.chars / 100, 3)) * (1 - density(x))
        if direct:
            x.points += points
            points = 0.0
        if x.parent is not None:
            x.parent.points += points + x.points / 2
    scored = [(x.points * (1 - density(x)), -k, x) for k, x in enumerate(order) if x.points > 0]
    if not scored:
        return [order[0]]
    points, _, best = max(scored, key=lambda s: s[:2])
    x: Node | None = best
    while x is not None:
        if x.tag in ("article", "main"):
            best, points = x, max(points, x.points)
            break
        x = x.parent
    up = best.parent
    if up is None:
        return [best]
    kept = []
    for s in up.children:
        if isinstance(s, str):
            continue
        near = s.points * (1 - density(s)) >= max(4, 0.2 * points)
        prose = s.tag in ("p", "pre", "blockquote", "ul", "ol", "table", "dl", "h1", "h2", "h3", "h4") and s.chars and density(s) < 0.25
        headed = s.tag in ("div", "header", "section") and any(isinstance(c, Node) and c.tag == "h1" for c in s.children)
        if s is best or (near and s.tag not in ("article",) or near and best.tag != "article") or (prose and best.tag not in ("article", "main")) or (headed and best.tag not in ("article", "main")):
            kept.append(s)
    return kept


def blocks(tops: list[Node]) -> Iterator[str]:
    """Texts of blocks in page order, white space as one space."""
    line: list[str] = []

    def flush() -> Iterator[str]:
        t = " ".join("".join(line).split())
        line.clear()
        if t:
            yield t

    for top in tops:
        todo: list[Node | str | None] = [top]
        while todo:
            x = todo.pop()
            if x is None:
                yield from flush()
            elif isinstance(x, str):
                line.append(unescape(x))
            elif x.tag in ("ul", "ol", "table", "div", "section", "p") and x.chars and density(x) > 0.75 and x.anchors >= 3:
                yield from flush()
            else:
                if x.tag in BLOCK:
                    yield from flush()
                    todo.append(None)
                elif x.tag in ("br", "td", "th"):
                    line.append(" ")
                todo += reversed(x.children)
        yield from flush()


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root = parse(html)
    prune(root)
    return "\n".join(blocks(container(measure(root))))


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with main_text; a column of this name is replaced."""
    pages = pages.drop(*[c for c in pages.columns if c.lower() == "main_text"])
    k = pages.columns.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(k).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "main_text"])

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField("main_text", T.StringType())]))


def op3_html_extraction(spark, sf_dir):
    out = extract_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))
