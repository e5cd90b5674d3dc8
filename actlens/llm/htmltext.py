"""Main text of HTML pages by composite text density.

Every node of the DOM has characters, tags, link characters and link tags in its subtree, and from
them a link-adjusted number of characters for each tag. The subtree with the largest sum of its
block children's densities is the core of the text; of those with half that sum or more, an ``article`` or
``main`` element goes first. On its path up to ``body``, the lowest density below ``body`` is the threshold: siblings of
the path that reach it are text as well, if they are elements of the same name or have a quarter of the core's sum, and
so are headings before the path. Where the core is ``body`` itself, the text's blocks stand in it directly, and all
of them are taken but lists of links.

What an element's name or class says is a weight of nothing or one on top of that: ``nav``, ``aside``, ``footer``, ``form`` and
containers named as adverts, menus, notices and the like count as empty, unless they hold an ``article`` or ``main``
element; so do those that only a class or ``form`` marks where a page without such an element has most of its text in them. :func:`main_text` without ``hints`` leaves these names out of account.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of HTML elements by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is no text of the page.
UNSEEN = frozenset("head script style noscript template iframe object embed applet svg canvas audio video noembed noframes select textarea input datalist title".split())
#: Elements that surround the text or serve the page.
AROUND = frozenset("nav aside footer button label menu dialog search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements that a class or id may name as something around the text; others are parts of it, but for adverts.
CONTAINERS = frozenset("div section ul ol dl aside header footer nav form center span details fieldset table td figure iframe".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: Open elements that a start tag ends, and those beyond which it doesn't look.
ENDS = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "table tr"), "th": ("td th", "table tr"), "tbody": ("tbody thead tfoot tr td th", "table"), "thead": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table"), "option": ("option", "select datalist"), "body": ("head", "html")}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
#: Elements that an end tag of an inline element doesn't reach beyond.
WALLS = frozenset("td th table article main body".split())
DEPTH = 512  # elements nested deeper are taken as ended at once

#: Words in a class, id or role that mark adverts, readers' comments, and other things around the text.
ADVERTS = frozenset("ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promos promotion promotions".split())
COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
OTHERS = frozenset(
    "banner banners sidebar sidebars menu menus nav navigation navbar breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert alerts footer footers masthead siteheader pageheader topbar toolbar "
    "share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay pagination pager skiplink widget widgets copyright contentinfo complementary search".split()
)
PAIRS = (("side", "bar"), ("site", "header"), ("page", "header"), ("top", "bar"), ("skip", "link"))
#: Words with which a class tells of something that the element has or lacks, not what it is.
ABOUT = frozenset("has have with without no not is hide hidden show open closed".split())
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/>"']|\Z)""", re.I)

NOTHING, WEAK, STRONG = 0, 1, 2


class Node:
    __slots__ = ("block", "chars", "density", "drop", "has_core", "items", "link_chars", "link_tags", "mark", "name", "parent", "parts", "tags", "top", "total")

    def __init__(self, name: str, parent: Node | None, drop: bool = False, mark: int = NOTHING):
        self.name, self.parent, self.drop, self.mark = name, parent, drop, mark
        self.items: list = []  # texts and nodes in order


def named(value: str, adverts_only: bool) -> int:
    """The mark that a class, id or role gives."""
    out = NOTHING
    for token in value.lower().split():
        parts = [x for x in re.split(r"[-_]+", token) if x]
        if not parts or parts[0] in ABOUT or parts[-1] in ABOUT:
            continue
        if any(x in ADVERTS for x in parts):
            out = max(out, WEAK)
        elif adverts_only:
            continue
        elif parts[0] in COMMENTS and len(parts) <= 2:
            out = STRONG
        elif any(x in OTHERS or x in COMMENTS for x in parts) or any(p in zip(parts, parts[1:]) for p in PAIRS):
            out = max(out, WEAK)
    return out


def judge(name: str, attributes: str, inside: bool) -> tuple[bool, int]:
    """Whether an element is unseen, and its mark. ``inside``: it stands in an ``article`` or ``main``."""
    if name in UNSEEN:
        return True, NOTHING
    mark = STRONG if name in AROUND or name == "header" and not inside else WEAK if name == "form" else NOTHING
    if attributes and name not in ("html", "body"):
        for key, value in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                return True, NOTHING
            if key in ("class", "id", "role"):
                mark = max(mark, named(value, name not in CONTAINERS))
    return False, mark


def parse(page: str) -> Node:
    """The DOM of a page; elements that end nowhere, or whose ends are missing, are closed as browsers do."""
    root = Node("#root", None)
    stack, open_names = [root], Counter({"#root": 1})
    at, n = 0, len(page)

    def close(i: int) -> None:
        for x in stack[i:]:
            open_names[x.name] -= 1
        del stack[i:]

    while at < n:
        found = TOKEN.search(page, at)
        if found is None:
            stack[-1].items.append(page[at:])
            break
        if found.start() > at:
            stack[-1].items.append(page[at : found.start()])
        at = found.end()
        if found[2] is None:
            continue
        name = found[2].lower()
        if found[1]:
            if open_names[name]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name == name:
                        close(i)
                        break
                    if stack[i].name in WALLS and name not in BLOCK:
                        break
            continue
        if name in CLOSES_P and open_names["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p":
                    close(i)
                    break
                if stack[i].name in ("td", "th", "table", "button"):
                    break
        elif name in ENDS:
            ends, stop = ENDS[name]
            last = 0
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in stop:
                    break
                if stack[i].name in ends:
                    last = i
            if last:
                close(last)
        top = stack[-1]
        node = Node(name, top, *judge(name, found[3], bool(open_names["article"] or open_names["main"])))
        top.items.append(node)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            node.items.append(page[at : end.start() if end else n])
            node.drop = True
            at = end.end() if end else n
        elif name not in VOID and not found[3].endswith("/") and len(stack) < DEPTH:
            stack.append(node)
            open_names[name] += 1
    return root


def seen(node: Node) -> list[Node]:
    return [x for x in node.items if not isinstance(x, str) and not x.drop]


def in_order(root: Node) -> list[Node]:
    """All nodes that aren't dropped, parents first."""
    nodes, todo = [], [root]
    while todo:
        node = todo.pop()
        nodes.append(node)
        todo += reversed(seen(node))
    return nodes


def count(nodes: list[Node]) -> None:
    for node in reversed(nodes):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        node.has_core = node.name in ("article", "main")
        node.parts = int(node.name == "p" or node.name in HEADINGS)
        for x in node.items:
            if isinstance(x, str):
                node.chars += len("".join(x.split()))
            elif not x.drop:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags + (x.name == "a")
                node.has_core |= x.has_core
                node.parts += x.parts
        if node.name == "a":
            node.link_chars = node.chars


def body_of(nodes: list[Node]) -> Node:
    return next((x for x in nodes if x.name == "body"), nodes[0])


def density(node: Node, ratio: float) -> float:
    """Characters for each tag, adjusted by links; ``ratio`` is the share of characters in links of the whole body."""
    c, lc, t, lt = node.chars, node.link_chars, max(1, node.tags), max(1, node.link_tags)
    if not c:
        return 0.0
    base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
    return c / t * math.log(max(c / max(1, lc) * t / lt, 1.0000001)) / base


def measure(root: Node, hints: bool = True) -> list[Node]:
    """Drops what is marked, if ``hints``, and fills in all other nodes' counts and densities; returns them, parents first."""
    nodes = in_order(root)
    count(nodes)
    if hints:
        for mark in (STRONG, WEAK):  # comments and such first, as they may hold most of the text
            body = body_of(nodes)
            for x in nodes:
                most = (x.chars - x.link_chars) * 2 > body.chars - body.link_chars and x.parts > 1 and not body.has_core
                x.drop = x.mark == mark and not x.has_core and not (mark == WEAK and most)
            nodes = in_order(root)
            count(nodes)
    body = body_of(nodes)
    ratio = body.link_chars / max(1, body.chars)
    for node in reversed(nodes):
        inner = seen(node)
        node.block = node.name in BLOCK or any(x.block for x in inner)
        node.density = density(node, ratio)
        node.total = sum(x.density for x in inner if x.block)
        # The subtree's node with the largest sum; of equal ones the outermost.
        node.top = max([node, *(x.top for x in inner)], key=lambda x: x.total)
    return nodes


def core(nodes: list[Node]) -> Node:
    """The subtree with the largest sum, or an ``article`` or ``main`` with half of it."""
    best = nodes[0].top
    if best.total and best.name not in ("article", "main"):
        marked = [x for x in nodes if x.name in ("article", "main") and x.total * 2 >= best.total]
        up = best.parent
        while up is not None and marked:  # a part of such an element is not widened to it by this
            marked = [x for x in marked if x is not up]
            up = up.parent
        if marked:
            return max(marked, key=lambda x: x.total)
    return best


def chosen(nodes: list[Node]) -> tuple[Node, set[int] | None]:
    """The node in which the text lies, and which of its inner nodes (by id) hold it; None: all."""
    best = core(nodes)
    if best.name in ("#root", "html", "body") or not best.total:
        return body_of(nodes) if best.name in ("#root", "html", "body") else best, None
    path = [best]
    while path[-1].parent is not None and path[-1].name != "body":
        path.append(path[-1].parent)
    below = [x for x in path if x.name not in ("body", "html", "#root")]
    threshold = min(x.density for x in below)
    parts: set[int] = {id(best)}
    high = 0
    for k, (x, up) in enumerate(zip(path, path[1:], strict=False)):
        before = True
        for s in seen(up):
            if s is x:
                before = False
                continue
            titled = before and s.chars and (s.name in HEADINGS or s.name == "header" and any(y.name == "h1" for y in seen(s)))
            alike = s.block and s.density >= threshold and s.link_chars * 2 <= s.chars and (s.name == x.name and s.name in BLOCK or s.total * 4 >= best.total)
            if titled or alike:
                parts.add(id(s))
                high = k + 1
    return path[high], parts if high else None


def main_text(page: str, hints: bool = True) -> str:
    """The main text: blocks in page order joined by one line feed; empty if there is none.

    Without ``hints`` only densities decide, not the names of classes and of elements around the text.
    """
    if not page:
        return ""
    nodes = measure(parse(page), hints)
    best, parts = chosen(nodes)
    flat = best.name in ("#root", "html", "body") and parts is None
    holding: set[int] = set()  # nodes above the parts
    for x in nodes if parts else ():
        if id(x) in parts:
            while x is not best:
                x = x.parent
                holding.add(id(x))
    blocks: list[str] = []
    piece: list[str] = []

    def flush() -> None:
        if piece and (text := " ".join(html.unescape("".join(piece)).split())):
            blocks.append(text)
        piece.clear()

    todo: list = [(best, parts is None)]
    while todo:
        x, taken = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            if taken:
                piece.append(x)
        elif not x.drop:
            taken = taken or id(x) in parts
            if not taken and id(x) not in holding:
                continue
            if flat and x.parent is best and x.name not in HEADINGS and x.link_tags > 1 and x.link_chars * 2 > x.chars:
                flush()  # a list of links
                continue
            if x.name in BLOCK:
                flush()
                todo.append((None, taken))
            elif x.name == "br":
                piece.append(" ")
            todo += ((y, taken) for y in reversed(x.items))
    flush()
    return "\n".join(blocks)


def extract_text(pages: DataFrame, content: str = "html") -> DataFrame:
    """Adds ``text`` and ``n_chars`` (its code points) to every row, from the whole of ``content``.

    A null or empty page, or one without main text, has an empty text. Broken markup is closed as
    browsers do and never fails; time and memory grow in proportion to a page's length. Columns already named so are
    replaced, others stay whatever their names. Equal pages have equal texts, repeated rows stay repeated, and an empty
    table stays empty. Only ``content`` goes to Python.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([main_text(x.as_py() or "").encode("utf-8", "replace").decode() for x in b], pa.string())

    rows = pages.withColumn("text", F.arrow_udf(run, T.StringType())(F.col(content).cast("string")))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
