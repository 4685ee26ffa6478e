"""Main text of web pages by minimum-cut labelling.

A page is read into blocks of text (runs between block-level tags) with their place in the element tree. A
linear classifier over tags, names, link density and length gives every block the cost of either label; these
costs are the capacities to the two terminals. Edges between neighbouring blocks and between blocks of one parent
charge for labelling them differently, less the further apart they are in the tree. The maximum flow
separates content from boilerplate at the least total cost. Pages are independent; nothing is shuffled.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe object canvas audio video noembed noframes".split())
# Foreign content that is not read, tags that end it if it was left open, and elements in it that hold HTML again.
FOREIGN = {"svg", "annotation", "annotation-xml"}
BREAKOUT = set(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby "
    "s small span strong strike sub sup table tt u ul var".split())
HTML_INSIDE = {"foreignobject", "desc", "title", "annotation-xml"}
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "select summary table tbody td tfoot th thead tr ul xmp".split())
# A tag closes these open ones, within the given borders.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "tbody", "thead"}, {"table"}), "tfoot": ({"tr", "td", "th", "tbody", "thead"}, {"table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
LABELS = {"label", "legend", "option", "optgroup", "output"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

# Elements and roles that are never part of an article.
OUTSIDE = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "head", "search"}
OUTSIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "menu", "menubar", "toolbar", "alert", "form"}
# Words of classes and ids that name such parts: readers' comments, which are out whatever their share of the page; parts that are out inside
# an article too; parts whose name says little inside an article.
COMMENT_WORDS = set("comment comments commentlist disqus reply replies respond responses".split())
NEVER_WORDS = set(
    "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr newsletter subscribe "
    "subscription signup login nav navbar navigation breadcrumb breadcrumbs sidebar share sharing related recommended widget pagination pager "
    "skip".split())
OUTSIDE_WORDS = COMMENT_WORDS | NEVER_WORDS | set(
    "banner notice notices notification popup modal overlay menu aside footer header masthead topbar toolbar social copyright "
    "disclaimer".split())
# Words that may stand beside these in a name without changing what it names.
PLAIN_WORDS = set(
    "site page main global top bottom left right upper lower primary secondary list box section wrapper wrap container block area buttons button "
    "links link bar inner outer content contents item items post posts article articles user users reader readers visitor form slot unit zone panel row "
    "col column group text body title heading icons icon mobile desktop sticky fixed js id thread area module region holder media".split())
INSIDE_WORDS = set("article articlebody content post entry story main".split())

# A tag whose quotes are closed; any tag. Neither looks back, so each is linear in what it reads.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ANY_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<[!?/][^>]*+>|[^<]++|<", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_SKIPPED = re.compile(r"<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style)\b[^>]*(?<!/)>.*?(?:</\1\b[^>]*>|\Z)", re.I | re.S)
_XMP_END = re.compile(r"</xmp\b[^>]*>", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

# Open elements that a new tag closes: the outermost of some tags inside the next of some borders.
_SCOPES = [({"p"}, {"button", "table", "td", "th"}), ({"a"}, {"td", "th", "table"}), *dict.fromkeys(
    (frozenset(t), frozenset(b)) for t, b in CLOSES.values())]
_SCOPE_OF = {tag: next(i for i, s in enumerate(_SCOPES) if s == scope) for tag, scope in CLOSES.items()}
_NO_SCOPE = (None,) * len(_SCOPES)
_SCOPED = set().union(*(t | b for t, b in _SCOPES))


class Tokens:
    """The markup of a page, piece by piece, in linear time."""

    def __init__(self, page: str):
        self.page, self._last, self._quotes = page, page.rfind(">"), True

    def at(self, at: int) -> tuple[int, str | None, str, str, str]:
        """(end, tag or None, its slash or "", its attributes, the whole) of the piece that begins at ``at``.

        After a tag with a quote that is never closed, quotes protect nothing on the rest of the page.
        """
        page = self.page
        if page[at] == "<" and at < self._last and page[at + 1] not in "!?":
            match = _TAG.match(page, at) if self._quotes else None
            if match is None and (match := _ANY_TAG.match(page, at)) is not None:
                self._quotes = False
            if match is not None:
                return match.end(), match[2].lower(), match[1], match[3], match[0]
        match = _OTHER.match(page, at)
        return match.end(), None, "", "", match[0]


@dataclass(eq=False, slots=True)
class Node:
    """An element. What holds for everything below it is handed down when it is opened or, where it depends on the whole
    page, in one pass over all elements (``settle``)."""

    tag: str
    parent: Node | None
    depth: int
    scopes: tuple = _NO_SCOPE
    outside: bool = False  # by its tag, role or visibility
    form: bool = False  # outside as a form only, which a form around most of the page is not
    comments: bool = False  # named as readers' comments
    named_never: bool = False  # named as a part that is out inside an article too
    named_outside: bool = False  # by its class or id
    named_inside: bool = False
    holds_main: bool = False  # an article or main element is below
    in_main: bool = False
    heading: bool = False  # itself or above, as the next three
    label: bool = False
    headers: int = 0
    inside: bool = False
    shut: bool = False  # outside for certain
    named: float = 0.0  # what the names above cost
    chars: int = 0  # of text below, without what is outside by its tag or role
    plain: int = 0  # of a form, without labels
    labels: int = 0


@dataclass
class Block:
    node: Node
    parts: list[str] = field(default_factory=list)
    linked: int = 0  # characters inside links

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def _names(value: str) -> tuple[bool, bool, bool, bool]:
    """(comments, never, outside, inside): what the classes and ids in a value say. A name counts as a whole: one that holds a word of another
    kind beside (share-price, social-policy, has-sidebar) says nothing."""
    comments = never = outside = inside = False
    for name in value.split():
        words = {w.lower() for w in _NAME.findall(name)}
        inside |= bool(words & INSIDE_WORDS)
        if words & OUTSIDE_WORDS and all(w in OUTSIDE_WORDS or w in PLAIN_WORDS or len(w) == 1 or w.isdigit() for w in words):
            outside = True
            comments |= bool(words & COMMENT_WORDS)
            never |= bool(words & NEVER_WORDS)
    return comments, never, outside, inside


def _open(tag: str, raw: str, parent: Node) -> Node:
    node = Node(tag, parent, parent.depth + 1, parent.scopes, in_main=parent.in_main or tag in ("article", "main"))
    if tag in _SCOPED:
        node.scopes = tuple(
            None if tag in borders and tag not in tags else (node if tag in borders or held is None else held) if tag in tags else held
            for held, (tags, borders) in zip(parent.scopes, _SCOPES))
    node.heading = parent.heading or tag in HEADINGS
    node.label = parent.label or tag in LABELS
    node.headers = parent.headers + (tag == "header")
    if raw.strip():
        found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}
        role = found.get("role", "").lower()
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*+:\s*+none", found.get("style", ""))
        node.outside = role in OUTSIDE_ROLES - {"form"} or bool(hidden)
        node.form = role == "form"
        node.in_main = node.in_main or role == "main" or found.get("itemprop", "").lower() == "articlebody"
        node.comments, node.named_never, node.named_outside, node.named_inside = _names(found.get("class", "") + " " + found.get("id", ""))
    node.inside = parent.inside or node.named_inside
    node.outside = node.outside or tag in OUTSIDE - {"form"} or tag == "header" and not parent.in_main
    node.form = (node.form or tag == "form") and not node.outside
    node.outside = node.outside or node.form
    if node.in_main and not parent.in_main:
        above = parent
        while above is not None and not above.holds_main:
            above.holds_main = True
            above = above.parent
    return node


def _foreign_end(tokens: Tokens, at: int, tag: str) -> int:
    """Where the foreign element opened before ``at`` ends: at its own end tag, nested ones matched, or before the
    HTML that ends an open one."""
    depth, html_inside, size = 1, int(tag in HTML_INSIDE), len(tokens.page)
    while at < size:
        if skipped := _SKIPPED.match(tokens.page, at):
            at = skipped.end()
            continue
        end, name, closing, _, whole = tokens.at(at)
        if name == tag and (closing or not whole.endswith("/>")):
            depth += -1 if closing else 1
            if not depth:
                return end
        elif name in HTML_INSIDE and (closing or not whole.endswith("/>")):
            html_inside = max(0, html_inside + (-1 if closing else 1))
        elif name and not html_inside and (name in BLOCK or name == "p" if closing else name in BREAKOUT):
            return at
        at = end
    return size


def blocks_of(page: str) -> tuple[list[Block], list[Node]]:
    """The non-empty blocks of a page and all its elements, both in order; unclosed and misplaced tags are mended as browsers do."""
    here = root = Node("", None, 0)
    nodes = [root]
    opened: dict[str, list[Node]] = {}  # open elements by tag, the innermost last
    found: list[Block] = []
    current: Block | None = None
    links, at, tokens, size = 0, 0, Tokens(page), len(page)

    def enter(tag: str, raw: str) -> Node:
        node = _open(tag, raw, here)
        nodes.append(node)
        return node

    def leave(node: Node) -> None:
        nonlocal here, links
        while here is not node.parent:
            links -= here.tag == "a"
            opened[here.tag].pop()
            here = here.parent

    while at < size:
        start = at
        at, tag, closing, raw, data = tokens.at(start)
        if tag is None:
            if data[0] != "<" or data == "<":
                if current is None:
                    current = Block(here)
                    found.append(current)
                data = html.unescape(data)
                current.parts.append(data)
                if links:
                    current.linked += len(data.strip())
            continue
        if closing:
            if opened.get(tag):
                leave(opened[tag][-1])
            if tag in BLOCK:
                current = None
            continue
        if tag in FOREIGN and (tag == "svg" or opened.get("math")):
            if not data.endswith("/>"):
                at = _foreign_end(tokens, at, tag)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag == "br":
            if current is not None:
                current.parts.append(" ")
            continue
        if tag in BLOCK:
            current = None
            if tag not in ("option", "html", "body") and (hit := here.scopes[0]):
                leave(hit)
        if tag in CLOSES and (hit := here.scopes[_SCOPE_OF[tag]]):
            leave(hit)
        if tag == "a" and (hit := here.scopes[1]):
            leave(hit)
        if tag == "xmp":  # its text is neither markup nor references
            end = _XMP_END.search(page, at)
            found.append(Block(enter(tag, raw), [page[at : end.start() if end else size]]))
            found[-1].linked = len(found[-1].parts[0].strip()) if links else 0
            at = end.end() if end else size
            continue
        if tag not in VOID and not data.endswith("/>"):
            here = enter(tag, raw)
            opened.setdefault(tag, []).append(here)
            links += tag == "a"
    return [b for b in found if b.text()], nodes


@dataclass
class Page:
    """What the classifier knows of the whole page."""

    blocks: int  # that may be content
    chars: int
    has_main: bool
    named: bool  # a good part of the text is in elements named as content

    @classmethod
    def of(cls, blocks: list[Block], nodes: list[Node], texts: list[str]) -> Page:
        """Hands down and adds up over all elements what depends on the whole page. Parents come before their children."""
        _open_forms(blocks, nodes, texts)
        for n in nodes:
            n.shut = n.parent is not None and n.parent.shut or (n.outside or n.comments and n.tag not in ("body", "html")) and not n.holds_main
        open_blocks = 0
        for block, text in zip(blocks, texts):
            if not block.node.shut:
                block.node.chars += len(text)
                open_blocks += 1
        for n in reversed(nodes):
            if n.parent is not None:
                n.parent.chars += n.chars
        total = nodes[0].chars
        for n in nodes:
            # A name says nothing about an element that holds the page's main part, and inside an article most names say less than the text.
            said = n.named_outside and not n.holds_main and n.tag != "body" and n.chars <= 0.6 * total
            own = (8.0 if n.named_never or not n.in_main else 3.0) if said else 0.0
            n.named = max(own, n.parent.named if n.parent is not None else 0.0)
        named = any(n.named_inside and 0 < n.chars >= 0.3 * total for n in nodes)
        return cls(open_blocks, total, any(b.node.in_main for b in blocks), named and total > 0)


def _open_forms(blocks: list[Block], nodes: list[Node], texts: list[str]) -> None:
    """Forms with over half of the page's text are plain containers, unless most of their text is labels."""
    if not any(n.form for n in nodes):
        return
    for n in nodes:
        n.shut = n.parent is not None and n.parent.shut or n.outside and not n.form and not n.holds_main
    total = 0
    for block, text in zip(blocks, texts):
        if not block.node.shut:
            if block.node.label:
                block.node.labels += len(text)
            else:
                block.node.plain += len(text)
                total += len(text)
    for n in reversed(nodes):
        if n.parent is not None:
            n.parent.plain += n.plain
            n.parent.labels += n.labels
        if n.form and n.plain > max(0.5 * total, n.labels):
            n.form = n.outside = False


def label_costs(block: Block, text: str, page: Page) -> tuple[float, float]:
    """(cost of calling it boilerplate, cost of calling it content)."""
    node = block.node
    if node.shut:
        return 0.0, 1e6
    words, links = text.count(" ") + 1, block.linked / max(1, len(text))
    score = -2.0 * node.headers - node.named
    if page.has_main:
        score += 3.0 if node.in_main else -3.0
    elif page.named:
        score += 1.5 if node.inside else -1.5
    else:  # with nothing beside it a text is the page's text
        score += -0.5 if page.blocks > 1 else 0.5
    # Lists of links belong to an article oftener than to what is around it.
    score += min(3.0, 0.6 * math.log2(words)) - (2.5 if node.in_main else 4.0) * links * (links > 0.3)
    score += 0.5 * (text[-1] in ".!?…:;\"'»”)") + (2.5 if node.heading else 0.0)
    return math.log1p(math.exp(min(score, 30))), math.log1p(math.exp(min(-score, 30)))


def _distance(a: Node, b: Node) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


class Flow:
    """Maximum flow between two terminals of a small graph (Dinic)."""

    def __init__(self, nodes: int):
        self.edges: list[list] = []  # [to, rest]; the reverse edge is its neighbour
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def add(self, a: int, b: int, there: float, back: float = 0.0) -> None:
        self.out[a].append(len(self.edges))
        self.edges.append([b, there])
        self.out[b].append(len(self.edges))
        self.edges.append([a, back])

    def levels(self, source: int) -> list[int]:
        level = [-1] * len(self.out)
        level[source] = 0
        queue = deque([source])
        while queue:
            node = queue.popleft()
            for e in self.out[node]:
                to, rest = self.edges[e]
                if rest > 1e-9 and level[to] < 0:
                    level[to] = level[node] + 1
                    queue.append(to)
        return level

    def reachable(self, source: int, sink: int) -> list[bool]:
        """The side of the source in a minimum cut."""
        while True:
            level = self.levels(source)
            if level[sink] < 0:
                return [x >= 0 for x in level]
            at = [0] * len(self.out)
            path: list[int] = []
            node = source
            while True:
                if node == sink:
                    least = min(self.edges[e][1] for e in path)
                    for e in path:
                        self.edges[e][1] -= least
                        self.edges[e ^ 1][1] += least
                    path, node = [], source
                elif at[node] < len(self.out[node]):
                    e = self.out[node][at[node]]
                    to, rest = self.edges[e]
                    if rest > 1e-9 and level[to] == level[node] + 1:
                        path.append(e)
                        node = to
                    else:
                        at[node] += 1
                elif node == source:
                    break
                else:  # a dead end: step back
                    e = path.pop()
                    node = self.edges[e ^ 1][0]
                    at[node] += 1


def main_text(page: str | None, smoothness: float = 1.0) -> str:
    """The content blocks of a page, joined by line ends."""
    blocks, nodes = blocks_of(page) if page else ([], [Node("", None, 0)])
    texts = [b.text() for b in blocks]
    whole = Page.of(blocks, nodes, texts)
    n = len(blocks)
    graph, source, sink = Flow(n + 2), n, n + 1
    last_of: dict[int, int] = {}
    for i, block in enumerate(blocks):
        lose, keep = label_costs(block, texts[i], whole)
        both = min(lose, keep)  # passes straight through
        graph.add(source, i, lose - both)
        graph.add(i, sink, keep - both)
        if i:
            weight = smoothness / _distance(blocks[i - 1].node, block.node) if blocks[i - 1].node is not block.node else smoothness
            graph.add(i - 1, i, weight, weight)
        sibling = last_of.get(id(block.node.parent))
        if sibling is not None and sibling < i - 1:
            graph.add(sibling, i, smoothness / 2, smoothness / 2)
        last_of[id(block.node.parent)] = i
    side = graph.reachable(source, sink)
    return "\n".join(t for i, t in enumerate(texts) if side[i])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", smoothness: float = 1.0) -> DataFrame:
    """page_id, url, text, n_chars of every page from its whole source.

    Null, empty and textless pages have the empty text. Repeated rows give a row each; other columns are not
    read. References are decoded, white space inside a block becomes one space, blocks are joined by one line
    end in page order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = [main_text(p.as_py(), smoothness) for p in part.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
