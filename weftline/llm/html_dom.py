"""A small forgiving DOM, and simple tree matching."""

from __future__ import annotations

import re
import sys
from html import unescape

#: trees are walked by recursion in Python alone, as deep as a page goes
sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000_000))

#: fixed values: element kinds of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: what an opening tag closes by itself
_CLOSED_BY = {
    **dict.fromkeys("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split(), frozenset(["p"])),
    "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]),
    "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"]),
}
_FENCE = frozenset("table ul ol dl article section div body html main aside nav header footer form blockquote".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)|<([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_JOINT = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs="", parent=None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def get(self, *names) -> str:
        """The values of the attributes named, lower-cased, joined by a space."""
        if not self.attrs:
            return ""
        return " ".join(unescape(b or c or d or a) for a, b, c, d in _ATTRIBUTE.findall(self.attrs) if a.lower() in names).lower()

    def words(self) -> str:
        """Class and id with the parts of joined words (pageFooter) set apart, lower-cased."""
        if not self.attrs:
            return ""
        found = (b or c or d for a, b, c, d in _ATTRIBUTE.findall(self.attrs) if a.lower() in ("class", "id"))
        return _JOINT.sub("-", unescape(" ".join(found))).lower()


def parse(html: str | None) -> Node:
    """The tree of ``html`` (None: empty); text is held as str among the children.  Never fails: what isn't a tag is text."""
    root = Node("#")
    top, at, text = root, 0, html or ""
    while True:
        m = _TOKEN.search(text, at)
        between = text[at : m.start() if m else len(text)]
        if between:
            top.children.append(unescape(between))
        if not m:
            return root
        at = m.end()
        if m[2]:
            tag = m[2].lower()
            closed = _CLOSED_BY.get(tag)
            if closed:
                walk = top
                while walk.parent is not None and (walk.tag in closed or walk.tag not in _FENCE):
                    if walk.tag in closed:
                        top = walk.parent
                    walk = walk.parent
            node = Node(tag, m[3], top)
            top.children.append(node)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(text, at)
                node.children.append(text[at : end.start() if end else len(text)])
                at = end.end() if end else len(text)
            elif tag not in VOID and not m[3].endswith("/"):
                top = node
        elif m[1]:
            tag, walk = m[1].lower(), top
            while walk.parent is not None and walk.tag != tag:
                walk = walk.parent
            if walk.parent is not None:
                top = walk.parent
        elif m[0].startswith("<![CDATA["):
            top.children.append(m[0][9:].removesuffix("]]>"))


def text_of(node) -> str:
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.tag not in RAW:
            if n.tag in BLOCK or n.tag == "br":
                out.append(" ")
                todo.append(" ")
            todo += reversed(n.children)
    return "".join(out)


def outline(node: Node) -> list:
    """[tag, names, own text, children, characters, characters in links, digest of all text]: what matching and counting need of a
    page; the last three of the whole subtree, without what is not text."""

    def build(n: Node, linked: bool) -> list:
        linked = linked or n.tag == "a"
        own = " ".join("".join(c for c in n.children if isinstance(c, str)).split()) if n.tag not in RAW else ""
        made = [n.tag, n.get("class", "id"), own, [], len(own), len(own) if linked else 0, 0]
        digest = [own]
        for c in n.children:
            if not isinstance(c, str):
                kid = build(c, linked)
                made[3].append(kid)
                made[4] += kid[4]
                made[5] += kid[5]
                digest.append(kid[6])
        made[6] = hash(tuple(digest))
        return made

    return build(node, False)


def preorder(tree: list) -> list[list]:
    """The nodes of an outline by their number."""
    out, todo = [], [tree]
    while todo:
        t = todo.pop()
        out.append(t)
        todo += reversed(t[3])
    return out


def match(a: list, b: list) -> dict[int, int]:
    """Simple tree matching of two outlines: the largest order-keeping mapping between nodes of equal tag whose parents are
    mapped too.  Returns preorder number in ``a`` -> preorder number in ``b``.

    Ends of two lists of children that are leaves of equal tags are mapped at once, which costs no node of any larger mapping."""
    size: dict[tuple[int, int], tuple[int, list]] = {}

    def best(x, y) -> int:
        """Nodes matched under x and y, x and y included."""
        if x[0] != y[0]:
            return 0
        if not x[3] or not y[3]:
            return 1
        at = (id(x), id(y))
        if at in size:
            return size[at][0]
        p, q, low, end = x[3], y[3], 0, 0
        room = min(len(p), len(q))
        while low < room and p[low][0] == q[low][0] and not p[low][3] and not q[low][3]:
            low += 1
        while end < room - low and p[-1 - end][0] == q[-1 - end][0] and not p[-1 - end][3] and not q[-1 - end][3]:
            end += 1
        pairs = [*zip(p[:low], q[:low]), *zip(p[len(p) - end :], q[len(q) - end :])]
        p, q = p[low : len(p) - end], q[low : len(q) - end]
        m = [[0] * (len(q) + 1)]
        for c in p:
            above, row, left = m[-1], [0], 0
            for j, d in enumerate(q):
                left = max(left, above[j + 1], above[j] + best(c, d) if c[0] == d[0] else 0)
                row.append(left)
            m.append(row)
        i, j = len(p), len(q)
        while i and j:
            if m[i][j] == m[i - 1][j]:
                i -= 1
            elif m[i][j] == m[i][j - 1]:
                j -= 1
            else:
                pairs.append((p[i - 1], q[j - 1]))
                i, j = i - 1, j - 1
        size[at] = (1 + low + end + m[-1][-1], pairs)
        return size[at][0]

    number = {id(t): i for tree in (a, b) for i, t in enumerate(preorder(tree))}
    out: dict[int, int] = {}
    if best(a, b):
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            out[number[id(x)]] = number[id(y)]
            todo += size.get((id(x), id(y)), (1, ()))[1]
    return out
