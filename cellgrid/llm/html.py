"""Main text of web pages by composite text density.

Every node of the page's tree has its characters, tags, link characters and link tags.
Its composite density is characters per tag, weighted by how little of it is links, on a
scale set by the whole body.  The smallest density on the way from the node whose children's
densities have the largest sum up to the body is the threshold.  From the body down, every
subtree that reaches it gives its own node of largest sum (or the article or main around
that), loose texts are taken by the same measure, and headings that stand before such a
node belong to it.  In what is taken, link lists below the threshold are left out.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.store import arrow_map
from cellgrid.llm.words import slices

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - frozenset("body html caption dd dt legend li optgroup option tbody td tfoot th thead tr".split()) | {"li", "dd", "dt"}
SIBLINGS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
# Elements, roles and names of page furniture.
FURNITURE = frozenset("script style noscript template iframe nav footer aside form button select textarea input svg canvas object embed head title dialog menu".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion promotions banner banners cookie cookies consent gdpr"
    " notice notices alert alerts popup popups modal modals overlay overlays nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars footer footers"
    " header headers masthead comment comments disqus reply replies respond share sharing social related recommended newsletter subscribe subscription login signup search"
    " widget widgets pagination pager toolbar".split()
)
# Parts of names that say where or in what form something stands, not what it is.
LAYOUT = frozenset(
    "site page main global top bottom left right inner outer side sticky fixed floating inline mobile desktop primary secondary box bar block blocks wrapper wrap container"
    " content area panel section region row col column inc slot unit zone list links link items item buttons button icons form group strip text body title label"
    " posts post articles stories reader readers user users thread".split()
)
REFERENCES = frozenset("reference references refs reflist bibliography citation citations footnote footnotes endnotes sources".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())

_TOKEN = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]{0,63})")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(?<![^\s/\"'>])([^\s=/\"'>]++)\s*+=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_PARTS = re.compile(r"[_-]+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


class Node:
    __slots__ = ("tag", "parent", "items", "furniture", "inside", "open_p", "chars", "tags", "link_chars", "link_tags", "heading_chars", "density", "total", "references")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.inside = tag in ("article", "main") or (parent is not None and parent.inside)  # of an article
        self.open_p = self if tag == "p" else None if parent is None or tag in ("table", "button") else parent.open_p
        self.items: list[Node | str] = []
        self.furniture = 0
        self.references = tag == "ol" or (parent is not None and parent.references)  # may be a list of sources
        self.chars = self.tags = self.link_chars = self.link_tags = self.heading_chars = 0
        self.density = self.total = 0.0


def _furniture_names(token: str) -> set[str]:
    """Furniture that one name speaks of, if it speaks of nothing else: "ad-box" does, "related-work" and "search-results-analysis" do not."""
    parts = {x for x in _PARTS.split(token) if x and not x.strip("0123456789x") == ""}
    names = parts & NAMES
    return names if parts <= NAMES | LAYOUT else set()


def _is_furniture(tag: str, rest: str, parent: Node) -> int:
    """0: no; 1: by its kind; 2: by its name, which may also be that of a frame around everything."""
    if tag in FURNITURE:
        return 1
    inside = parent.inside
    if tag == "header" and not inside:
        return 1
    if not rest or tag in ("html", "body", "main"):
        return 0
    if _HIDDEN.search(rest):
        return 1
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)}
    if found.get("role", "").lower() in ROLES:
        return 1
    names = {n for k in ("class", "id") if k in found for token in found[k].lower().split() for n in _furniture_names(token)}
    if tag == "article":  # readers' comments often are articles of their own
        names = {n for n in names if n.startswith(("comment", "repl"))}
    elif inside:  # the article's own head
        names -= {"header", "headers"}
    return 2 * bool(tag in BLOCK and names)


def _within(node: Node | None, tags: tuple[str, ...]) -> Node | None:
    while node is not None and node.tag not in tags:
        node = node.parent
    return node


class _Tags:
    """Where tags end.  All searches together take time in proportion to the page, also if quotes or tags never close."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.next = -1  # first stop at or after the place asked for last
        self.failed: set[int] = set()  # stops outside quotes after which no tag ends

    def _stop(self, at: int) -> int:
        found = _STOP.search(self.page, at)
        return found.start() if found else len(self.page)

    def end(self, at: int) -> int:
        """Place of the ">" that closes the tag whose name ends at ``at``, -1 if there is none.  Places must ascend."""
        if at > self.last:
            return -1
        if self.next < at:
            self.next = self._stop(at)
        stop, seen = self.next, []
        while stop < len(self.page) and stop not in self.failed:
            if self.page[stop] == ">":
                return stop
            seen.append(stop)
            close = self.page.find(self.page[stop], stop + 1)
            if close < 0:
                break
            stop = self._stop(close + 1)
        self.failed.update(seen)
        return -1


def _tokens(page: str):
    """(start, end, is it a closing tag, its lower-case name or None, what follows the name) of each tag, comment and declaration; takes the place to go on from."""
    tags, at = _Tags(page), 0
    while found := _TOKEN.search(page, at):
        start, at = found.start(), found.end()
        if found[2]:
            stop = tags.end(at)
            if stop >= 0:
                at = (yield start, stop + 1, bool(found[1]), found[2].lower(), page[at:stop]) or stop + 1
            continue
        if found[0] == "<!--":
            stop = page.find("-->", at)
            stop = len(page) if stop < 0 else stop + 3
        else:
            stop = page.find(">", at) + 1 if at <= tags.last else 0
        if stop:
            at = (yield start, stop, False, None, "") or stop


def parse(page: str) -> Node:
    """The page's tree; texts have their character references decoded.  Unclosed and stray tags are taken as browsers do in the main."""
    root = Node("#root", None)
    at, node, end = 0, root, len(page)
    opened: Counter[str] = Counter()  # open elements by kind; each step's work is paid for by what it opens or closes

    def close(up_to: Node) -> Node:
        """Close elements until ``up_to`` is the innermost open one."""
        inner = node
        while inner is not up_to:
            opened[inner.tag] -= 1
            inner = inner.parent
        return up_to

    tokens, go_on = _tokens(page), None
    while True:
        try:
            start, stop, closes, tag, rest = tokens.send(go_on)
        except StopIteration:
            break
        go_on = None
        if start > at:
            node.items.append(entities.unescape(page[at:start]))
        at = stop
        if tag is None:
            continue
        if closes:
            if opened[tag]:
                node = close(_within(node, (tag,)).parent)
            continue
        if tag in CLOSES_P and node.open_p is not None:
            node = close(node.open_p.parent)
        if tag in SIBLINGS:
            left, above, outer = sum(opened[t] for t in SIBLINGS[tag]), node, None
            while left and above is not None and above.tag not in SCOPES[tag]:
                if above.tag in SIBLINGS[tag]:
                    left, outer = left - 1, above
                above = above.parent
            if outer is not None:
                node = close(outer.parent)
        made = Node(tag, node)
        made.furniture = _is_furniture(tag, rest, node)
        if not made.references and rest:
            made.references = any(x in REFERENCES for m in _ATTRIBUTE.finditer(rest) if m[1].lower() in ("class", "id") for x in re.split(r"[\s_-]+", (m[2] or m[3] or m[4] or "").lower()))
        if made.inside and not node.inside and not made.furniture:
            above = node
            while above is not None:  # a frame named for what else it holds
                above.furniture = above.furniture if above.furniture == 1 else 0
                above = above.parent
        node.items.append(made)
        if tag in RAW:
            closing = re.compile(rf"</{tag}\s*>|\Z", re.I).search(page, at)
            made.items.append(page[at : closing.start()])
            at = go_on = closing.end()
        elif tag not in VOID and not rest.endswith("/"):
            node = made
            opened[tag] += 1
    if at < end:
        node.items.append(entities.unescape(page[at:]))
    return root


def _order(root: Node, named: bool = False) -> list[Node]:
    """Nodes outside furniture (``named``: but for what only its name makes so), parents first."""
    out, open_ = [], [root]
    while open_:
        node = open_.pop()
        out.append(node)
        open_.extend(x for x in reversed(node.items) if isinstance(x, Node) and (not x.furniture or (named and x.furniture == 2)))
    return out


def _measure(nodes: list[Node]) -> None:
    for node in nodes:
        node.tags = node.link_chars = node.link_tags = node.heading_chars = 0
        node.chars = sum(len("".join(x.split())) for x in node.items if isinstance(x, str))
    for node in reversed(nodes):
        if node.tag == "a":
            node.link_chars = node.chars
        if node.tag in HEADINGS:
            node.heading_chars = node.chars
        if node.parent is not None:
            up = node.parent
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.heading_chars += node.heading_chars
            up.link_tags += node.link_tags + (node.tag == "a")


def _densities(nodes: list[Node], body: Node) -> None:
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in nodes:
        c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        if c:
            base = math.log(c / max(c - node.link_chars, 1) * node.link_chars + share * c + math.e)
            node.density = max(c / t * math.log(max(c / lc * t / lt, 1.0)) / math.log(max(base, 1.0 + 1e-9)) if base > 1.0 + 1e-9 else c / t * math.log(max(c / lc * t / lt, 1.0)) * 1e9, 0.0)
    for node in nodes:
        node.total = sum(x.density for x in node.items if isinstance(x, Node) and not x.furniture)


def _taken(nodes: list[Node], body: Node, threshold: float) -> set[Node]:
    """Nodes that are taken whole: of each subtree that reaches the threshold, together with all above it, the one of largest sum."""
    top = {n: n for n in nodes}  # node of largest sum in each subtree, of equal sums the first
    for node in reversed(nodes):
        for x in node.items:
            if isinstance(x, Node) and not x.furniture and top[x].total > top[node].total:
                top[node] = top[x]
    heads: dict[Node, Node] = {}
    taken: set[Node] = set()
    inside = {body: False}  # nodes to look at: those whose parents reach the threshold; in a taken one or not
    for node in nodes:
        if node not in inside or (node is not body and node.density < threshold):
            continue
        best = top[node]
        if not inside[node]:
            if best not in heads:
                up = best
                while up is not body and up.tag not in BLOCK:
                    up = up.parent
                heads[best] = _within(best, ("article", "main")) or up
            taken.add(heads[best])
        within = inside[node] or node in taken
        inside.update((x, within) for x in node.items if isinstance(x, Node) and not x.furniture)
    return taken


def article(page: str) -> tuple[Node, set[Node], float] | None:
    """The body, the nodes that make up the article, and the threshold; None if there is no text."""
    root = parse(page)
    nodes = _order(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    nodes = _order(body)
    _measure(nodes)
    if not body.chars:  # names alone don't empty a page
        for node in _order(root, named=True):
            node.furniture = node.furniture if node.furniture == 1 else 0
        nodes = _order(body)
        _measure(nodes)
    if not body.chars:
        return None
    _densities(nodes, body)
    best = max(nodes, key=lambda n: n.total)  # of equal sums the first
    if not best.total:
        best = body
    threshold, up = best.density, best
    while up is not body and up.parent is not None:
        up = up.parent
        threshold = min(threshold, up.density)
    return body, _taken(nodes, body, threshold), threshold


def main_text(page: str | None) -> str:
    """Blocks of the article joined by newlines, white space inside a block made single blanks."""
    found = article(page or "")
    if found is None:
        return ""
    body, taken, threshold = found
    above: set[Node] = set()  # nodes around taken ones
    for node in taken:
        while node is not body and node.parent not in above:
            node = node.parent
            above.add(node)
    blocks: list[list[str]] = [[]]

    def links_only(node: Node) -> bool:
        return not node.references and node.tag in ("ul", "ol", "div", "section", "table") and node.link_tags > 1 and 2 * node.link_chars > node.chars and node.density < threshold

    def parts(node: Node) -> list[Node | str]:
        """Of a node around taken ones: those, nodes around others, loose texts that reach the threshold, and headings before them."""
        out, followed = [], False
        for x in reversed(node.items):
            if isinstance(x, str):
                n = len("".join(x.split()))
                if n and n * math.log(n) >= threshold:
                    out.append(x)
            elif x in taken or x in above:
                out.append(x)
                followed = True
            elif followed and not x.furniture and 0 < x.chars == x.heading_chars:
                out.append(x)
        return out

    open_: list[tuple[Node | str | None, bool]] = [(body, body in taken)]  # (None: a block ends, is it in a taken node)
    while open_:
        item, whole = open_.pop()
        if item is None:
            blocks.append([])
        elif isinstance(item, str):
            blocks[-1].append(item)
        elif item in taken or item in above or not (item.furniture or links_only(item)):
            if item.tag == "br":
                blocks[-1].append(" ")
            if item.tag in BLOCK:
                blocks.append([])
                open_.append((None, whole))
            whole = whole or item in taken or item not in above
            open_.extend((x, whole) for x in (reversed(item.items) if whole else parts(item)))
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text (empty if none), n_chars.  A null or empty html has no text; rows that repeat are taken singly."""

    def each(batch: pa.RecordBatch):
        for piece in slices(batch, "html"):
            texts = [main_text(x) for x in piece.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return arrow_map(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), each, "page_id long, url string, text string, n_chars long")
