"""Main text of web pages by composite text density.

Every node of a page's tree gets a density: its characters per tag, raised or lowered by the share of link characters
and link tags below it and in the whole body. A node's density sum adds up its children's densities, and the node with
the largest sum heads the main text. The threshold is the least density on the path from the body down to that node.
The node with the largest sum of every other branch whose density reaches the threshold is a head too, if the branch hangs on
that path below the body or has at least SHARE of the largest sum, and so are paragraphs on that path; the main text is that of all heads and of the headings and bare text between them. A head inside an
<article> stands for all of it. Below the heads, containers of mostly links whose density is under the threshold are left
out, but not in an <article>; other nodes under it are short paragraphs, which belong to the text.

Densities are measured on all text that a page shows. Elements that the page names as something else than its text
(menus, sidebars, notices, adverts, forms, reader comments, page headers and footers, by their element or by the words
of class, id or role) are no heads, and inside the heads they are left out. An id of a section, or one with other words in an <article>
or <main>, names a place of the text as often: it counts only for an element under the threshold and without a heading."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from math import e, log

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from dimtrail.llm.common import append_columns

# Element names and the words that mark page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math noembed xmp".split())
UNSEEN = frozenset("head script style textarea title noscript iframe template svg math select object canvas audio video noembed xmp datalist".split())
ASIDE = frozenset("nav footer aside form button dialog menu".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
KEPT = frozenset("html body main".split())
FURNITURE = frozenset("ad ads adbox adsense advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar share sharing social related recommended comment comments disqus respond replies widget pagination pager copyright legal disclaimer search complementary contentinfo dialog form hidden skip".split())
READERS = frozenset("comment comments disqus respond replies".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CONTENT = frozenset("article content post entry story main body text".split())
ITEMS = ("li", "option", "tr", "dt", "dd", "td", "th")
SAME_CLOSES = {"li": ("li", ("ul", "ol", "menu")), "option": ("option", ("select",)), "tr": ("tr", ("table",)), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}

#: Share of the largest density sum from which another branch of the body itself belongs to the main text; a branch of what
#: holds the largest one does anyway.
SHARE = 0.1

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)""", re.S)
MARKS = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|[\s"'])(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
SPACE = re.compile(r"\s+")


class Node:
    """An element; out: it shows no text; aside: it, or one it is in, is page furniture; weak: its id may say so; article, main: it, or one it is in, is an article, or an article or main; headed: it has a heading in it."""

    __slots__ = ("article", "aside", "chars", "density", "headed", "inside_link", "link_chars", "link_tags", "main", "out", "parent", "parts", "tag", "tags", "weak")

    def __init__(self, tag: str, parent: Node | None, out: bool, aside: bool = False, weak: bool = False):
        self.tag, self.parent, self.out, self.aside, self.weak = tag, parent, out, aside, weak
        self.article = tag == "article" or (parent is not None and parent.article)
        self.main = tag == "main" or self.article or (parent is not None and parent.main)
        self.headed = tag in HEADINGS
        self.parts: list = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = 0.0
        self.inside_link = tag == "a" or (parent is not None and parent.inside_link)


def furniture(tag: str, attributes: str, node: Node) -> tuple[bool, bool]:
    """Whether an element that starts below `node` is page furniture, and whether its id may say so."""
    if tag in KEPT:
        return False, False
    if tag in ASIDE:
        return True, False
    if tag == "header":
        while node is not None and node.tag not in ("article", "main"):
            node = node.parent
        return node is None, False
    if not attributes:
        return False, False
    if HIDDEN.search(attributes):
        return True, False
    weak = False
    for found in MARKS.finditer(attributes):
        for word in (found[2] or found[3] or found[4] or "").lower().split():
            bits = [b for b in re.split(r"[^a-z]+", word) if b]
            if CONTENT.intersection(bits) or not FURNITURE.intersection(bits):
                continue
            if found[1].lower() != "id":
                return True, False
            if tag in HEADINGS or tag in INLINE or tag == "p":
                continue
            whole = FURNITURE.issuperset(bits)
            if not READERS.issuperset(bits) and (tag == "section" and (node.main or not whole) or node.main and not whole):
                weak = True
            else:
                return True, False
    return False, weak


def parse(html: str) -> list[Node]:
    """The nodes of a page in page order, the root first. Unclosed and stray tags are forgiven."""
    here = root = Node("html", None, False)
    nodes, at, end = [root], 0, len(html)
    opened: Counter = Counter()  # tags from here up, so that a stray end tag walks nowhere

    def close(node: Node) -> None:
        nonlocal here
        while here is not node.parent:
            opened[here.tag] -= 1
            here = here.parent

    def text(piece: str) -> None:
        if piece and not here.out:
            piece = unescape(piece) if "&" in piece else piece
            here.parts.append(piece)
            n = len(SPACE.sub(" ", piece).strip())
            here.chars += n
            if here.inside_link:
                here.link_chars += n

    while at < end:
        m = TOKEN.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            node = here if opened[tag] else None
            while node is not None and node.tag != tag:
                if tag in INLINE and node.tag not in INLINE:
                    node = None
                    break
                node = node.parent
            if node is not None:
                close(node)
            continue
        if tag in ("html", "body"):
            if tag == "body" and here is root:
                here = Node("body", root, False)
                opened["body"] += 1
                root.parts.append(here)
                nodes.append(here)
            continue
        if tag in CLOSES_P and opened["p"]:
            node = here
            while node is not None and node.tag != "p" and (node.tag in INLINE):
                node = node.parent
            if node is not None and node.tag == "p":
                close(node)
        if tag in SAME_CLOSES and any(opened[n] for n in ITEMS):
            names, stops = SAME_CLOSES[tag]
            node = here
            while node is not None and node.tag not in names and node.tag not in stops:
                node = node.parent
            if node is not None and node.tag in names and node.parent is not None:
                close(node)
        named, weak = (False, False) if here.aside else furniture(tag, m[3], here)
        child = Node(tag, here, here.out or tag in UNSEEN, here.aside or named, weak)
        here.parts.append(child)
        nodes.append(child)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = stop.end() if stop else end
        elif tag not in VOID:
            opened[tag] += 1
            here = child
    return nodes


def measure(nodes: list[Node]) -> None:
    """Counts and densities; children come after their parents in `nodes`."""
    for node in reversed(nodes):
        up = node.parent
        if up is not None and not node.out:
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags + (node.tag == "a")
            up.headed |= node.headed
    body = nodes[0]
    ratio = body.link_chars / max(body.chars, 1)
    for node in nodes:
        c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        if c == 0 or node.out:
            continue
        base = log(c / max(c - node.link_chars, 1) * node.link_chars + ratio * c + e)
        node.density = c / t * log(max(c / lc * t / lt, 1.0)) / log(max(base, 1 + 1e-9)) if base > 1 else c / t * log(max(c / lc * t / lt, 1.0))


def main_nodes(nodes: list[Node]) -> tuple[list[Node], float]:
    """The heads of the main text in page order and the threshold."""
    sums = {id(n): 0.0 for n in nodes}
    for n in nodes[1:]:
        if not n.out:
            sums[id(n.parent)] += n.density
    best = max((n for n in nodes if not n.out and not n.aside), key=lambda n: sums[id(n)])
    while best.tag in INLINE or best.tag == "p":
        best = best.parent
    least, node = best.density, best
    while node.parent is not None:
        node = node.parent
        if node.tag != "html":
            least = min(least, node.density)
    top = {id(n): n for n in nodes}  # the node with the largest sum at or below a node
    for n in reversed(nodes[1:]):
        if not n.out and not n.aside and sums[id(top[id(n)])] > sums[id(top[id(n.parent)])]:
            top[id(n.parent)] = top[id(n)]
    above, inside, marked = _above(best), set(), {id(best)}  # nodes come after their parents
    for n in nodes:
        if n.out or n.aside or n.chars == 0 or n.tag in INLINE:
            continue
        if n.parent is not None and id(n.parent) in inside or id(n) in marked:
            inside.add(id(n))
        elif n.parent is not None and n.density >= least and (sums[id(top[id(n)])] >= SHARE * sums[id(best)] or id(n.parent) in above and n.parent.tag not in ("html", "body") or n.tag == "p" and id(n.parent) in above):
            head = top[id(n)] if n.tag != "p" else n
            while head is not n and (head.tag in INLINE or head.tag == "p"):
                head = head.parent
            up = head
            while up is not None and id(up) not in marked:
                up = up.parent
            if up is None and id(n) not in above:
                marked.add(id(head))
                if head is n:
                    inside.add(id(n))
    for n in nodes:  # a head in an article stands for the outermost one
        if id(n) in marked and n.article:
            marked.discard(id(n))
            marked.add(id(_article(n)))
    return [n for n in nodes if id(n) in marked], least


def _article(node: Node) -> Node:
    out = node
    while node is not None:
        out = node if node.tag == "article" else out
        node = node.parent
    return out


def _above(node: Node) -> set[int]:
    out = set()
    while node is not None:
        out.add(id(node))
        node = node.parent
    return out


def blocks(heads: list[Node], threshold: float) -> list[str]:
    """The text of each block of the heads, and of the headings and bare text between them, in page order, white space inside a block turned into one space."""
    marked, paths = {id(n) for n in heads}, Counter()
    for head in heads:
        paths.update(_above(head))
    head = heads[0]
    while paths[id(head)] < len(heads):  # up to the node that all heads have above them
        head = head.parent
    found, held, todo = [], [], [(head, False)]

    def flush() -> None:
        line = SPACE.sub(" ", "".join(held)).strip()
        if line:
            found.append(line)
        held.clear()

    while todo:
        part, whole = todo.pop()
        if part is None:
            flush()
        elif isinstance(part, str):
            held.append(part)
        elif id(part) in paths or ((whole or part.tag in HEADINGS or part.tag in INLINE) and not (part.out or part.aside or (part.density < threshold and (part.weak and not part.headed or not part.article and part.tags > 1 and 2 * part.link_chars > part.chars)))):
            inline = part.tag in INLINE
            if not inline:
                flush()
                todo.append((None, False))
            below = whole or id(part) in marked or part.tag in HEADINGS
            todo.extend((x, below) for x in reversed(part.parts))
    flush()
    return found


def main_text(html: str | None) -> str:
    """The main text of a page; '' for a null or empty page or one without any."""
    if not html:
        return ""
    nodes = parse(html)
    measure(nodes)
    return " ".join(blocks(*main_nodes(nodes)))


def with_main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds text and n_chars (code points) to every page; rows, ties and other columns stay as they are."""

    def make():
        def compute(pages):
            texts = [main_text(p) for p in pages]
            return [texts, [len(t) for t in texts]]

        return compute

    return append_columns(pages, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], make, html)
