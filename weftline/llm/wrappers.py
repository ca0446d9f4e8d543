"""Main text of web pages by wrapper induction.

The pages of one host share a template.  One page of each host is its pattern; every other page of the host is aligned with
it by simple tree matching, and for each node of the pattern all pages together say how often it was found, how often with
the same text, and how much of its text lies in links.  From those figures the host's wrapper is made (:func:`induce`): nodes
that keep their text or are made of links are template, and the node that holds most of the text that varies is the content.
A page's text is what stands in the node that is aligned with the content, less the template.

Kinds of elements that hold no article (scripts, forms, nav, footer) never count.  Names and roles are a hint: inside a host's
wrapper they cannot outvote the figures of a node that holds half of the varying text; pages without a wrapper (hosts of one
or two pages, pages on which the content was not found) are read by kinds and names alone.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import written
from weftline.llm.html_dom import BLOCK, RAW, Node, match, outline, parse, preorder, text_of

#: a longer page (in characters) is its host's pattern only where all others are blank or longer too
PATTERN_CHARS = 200_000
#: pages that a host must have for a template; share of them with the node, and with the same text
MIN_PAGES, FOUND, SAME = 3, 0.3, 0.9
#: share of text in links from which a node is a menu; share of the varying text with which a child stands for its parent, with
#: which an article element is the content, and from which neither names nor sameness make a node template
LINKS, HEIR, ARTICLE, MAIN = 0.6, 0.6, 0.3, 0.5
#: a host with more than this share of all pages is hot: there are 200 such hosts at most; bytes of patterns that are broadcast, larger ones meet by shuffle
HOT_SHARE, BROADCAST_BYTES = 1 / 200, 64 << 20

_DROP = frozenset("head nav aside footer form script style noscript template iframe svg canvas audio video object button select textarea input dialog menu label title map".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist status".split())
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|submenu|header|masthead|topbar|footer|bottombar|sidebar|side|rail|ad|ads|adv|advert|adverts|advertisement|adsense|adbox|banner|sponsor|"
    r"sponsored|promo|promotion|cookie|cookies|consent|notice|notices|gdpr|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|search|searchbox|share|sharing|social|related|"
    r"recommended|recommendations|trending|popular|breadcrumb|breadcrumbs|pagination|pager|paging|toolbar|widget|widgets|comment|comments|commentlist|discussion|disqus|replies|reply|respond|"
    r"copyright|disclaimer|skip|hidden|screen-reader-text|toc|alert|alerts|announcement|subnav|topnav|sidenav|crumbs|paywall|feedback|responses|outbrain|taboola|promoted|teaser|teasers|donate)(?=$|[\s_-]|\d+(?:$|[\s_-]))"
)
_ARTICLE_NAMES = re.compile(r"(?:^|[\s_-])(?:comment|comments|reply|replies|ad|ads|advert|advertisement|sponsored|promo|related|recommended|teaser)(?=$|[\s_-]|\d+(?:$|[\s_-]))")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def kind_says_no(n: Node, inside: bool) -> bool:
    """Whether the element is of a kind that is not part of an article; ``inside``: it stands in the article."""
    return n.tag in _DROP or n.tag in RAW or n.tag == "header" and not inside or bool(n.attrs and (re.search(r"(?:^|\s)hidden(?:\s|=|$)", n.attrs) or _HIDDEN.search(n.get("style"))))


def boilerplate(n: Node, inside: bool) -> bool:
    """Whether the element is not part of an article by its kind, role or names."""
    if kind_says_no(n, inside):
        return True
    if not n.attrs or n.tag in ("html", "body"):
        return False
    names = n.words()
    if names and (_ARTICLE_NAMES if n.tag in ("article", "main") else _NAMES).search(names):
        return True
    return n.get("role") in _ROLES or n.get("aria-hidden") == "true"


def _roots(top: Node) -> list[Node]:
    """The outermost article elements, or else main ones, that are not boilerplate; the whole tree if there are none."""
    found: dict[str, list[Node]] = {"article": [], "main": []}

    def walk(n: Node, within: frozenset) -> None:
        for c in n.children:
            if isinstance(c, Node) and not boilerplate(c, bool(within)):
                kind = "article" if c.tag == "article" or c.get("itemprop") == "articlebody" else "main" if c.tag == "main" or c.get("role") == "main" else ""
                if kind and kind not in within:
                    found[kind].append(c)
                walk(c, within | {kind} if kind else within)

    walk(top, frozenset())
    for kind in ("article", "main"):
        if any(text_of(n).strip() for n in found[kind]):
            return found[kind]
    return [top]


def blocks(top: Node, roots: list[Node] | None = None, dropped: frozenset | set = frozenset(), constant: frozenset | set = frozenset(), trusted: frozenset | set = frozenset()) -> list[str]:
    """The texts of the page's blocks, in order: those in ``roots``, or in the page's article elements.

    Identities of nodes: ``dropped`` are left out whole, of ``constant`` the own text; names say nothing about ``trusted``."""
    out: list[str] = []

    def run(roots, plain: bool):
        line: list[str] = []
        links = [0]

        def end():
            text = " ".join("".join(line).split())
            # outside an article, a block that is nearly all links is a menu
            if text and not (plain and links[0] >= 0.8 * len(text)):
                out.append(text)
            line.clear()
            links[0] = 0

        def walk(n: Node, linked: bool, inside: bool):
            for c in n.children:
                if isinstance(c, str):
                    if id(n) not in constant:
                        line.append(c)
                        links[0] += len(c) if linked else 0
                elif c.tag == "br":
                    line.append(" ")
                elif id(c) not in dropped and not (kind_says_no(c, inside) if id(c) in trusted else boilerplate(c, inside)):
                    if c.tag in BLOCK:
                        end()
                        walk(c, linked, inside or c.tag in ("article", "main"))
                        end()
                    else:
                        walk(c, linked or c.tag == "a", inside)

        for r in roots:
            walk(r, r.tag == "a", not plain)
            end()

    if roots is None:
        roots = _roots(top)
        run(roots, roots == [top])
    else:
        run(roots, False)
    return out


def _nodes(top: Node) -> list[Node]:
    """Nodes in the preorder of :func:`outline`."""
    out, todo = [], [top]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [c for c in reversed(n.children) if isinstance(c, Node)]
    return out


#: what is counted of each node of a pattern: pages with it, with the same text in it, with own text, with the same own text; characters in it,
#: of those in links, and own ones
COUNTS = ("found", "alike", "owning", "same", "chars", "links", "own")


def induce(pattern: str, counts: dict[int, tuple], pages: int) -> tuple[list[int], list[int], list[int]]:
    """A host's wrapper: the pattern's nodes (by number) that are content, those that are template as a whole, and those of which the own
    text is; empty if no text varies."""
    top = parse(pattern)
    nodes, need = _nodes(top), max(MIN_PAGES, FOUND * pages)
    at = {id(n): i for i, n in enumerate(nodes)}
    total = counts.get(0, (0,) * len(COUNTS))[4]
    dropped, constant, mass = set(), set(), [0.0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        found, alike, owning, same, chars, links, own = counts.get(i, (0,) * len(COUNTS))
        sure = found >= need
        if sure and owning >= need and same >= SAME * owning and own < MAIN * total:
            constant.add(i)
            own = 0
        mass[i] = sum(mass[at[id(c)]] for c in n.children if isinstance(c, Node)) + (own if n.tag != "a" else 0)
        if kind_says_no(n, True) or sure and chars and (links >= LINKS * chars or alike >= SAME * found and chars < MAIN * total):
            dropped.add(i)
            mass[i] = 0.0
    for i, n in enumerate(nodes):  # from the outside in
        if i and i not in dropped and mass[i] < MAIN * mass[0] and boilerplate(n, any(a.tag in ("article", "main") for a in _above(n))):
            dropped.add(i)
            lost, up = mass[i], n
            while up is not None:
                mass[at[id(up)]] -= lost
                up = up.parent
    if mass[0] <= 0:
        return [], [], []
    content = [at[id(n)] for kind in ("article", "main") for n in _outermost(top, kind) if at[id(n)] not in dropped and mass[at[id(n)]] >= ARTICLE * mass[0]][:1]
    if content:
        kind = nodes[content[0]].tag
        content = [at[id(n)] for n in _outermost(top, kind) if at[id(n)] not in dropped and mass[at[id(n)]] > 0]
    else:
        here = 0
        while True:
            heirs = [at[id(c)] for c in nodes[here].children if isinstance(c, Node) and c.tag in _HOLDERS and at[id(c)] not in dropped and counts.get(at[id(c)], (0,))[0] >= need]
            heir = max(heirs, key=lambda k: mass[k], default=None)
            if heir is None or mass[heir] < HEIR * mass[here]:
                break
            here = heir
        content = [here]
    return content, sorted(dropped), sorted(constant)


#: elements that hold blocks rather than being one
_HOLDERS = frozenset("html body div section main article center table tbody tr td form fieldset details dialog".split())


def _above(n: Node):
    while n.parent is not None:
        n = n.parent
        yield n


def _outermost(top: Node, tag: str) -> list[Node]:
    out, todo = [], [top]
    while todo:
        n = todo.pop()
        if n.tag == tag:
            out.append(n)
        else:
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]
    return out


def extract(html: str | None, pattern: list | None = None, wrapper: tuple | None = None) -> str:
    """The article's text, by the wrapper (content, template, own text that is template) where there is one and it finds the content."""
    top = parse(html)
    if pattern is not None and wrapper is not None and wrapper[0]:
        nodes, own = _nodes(top), outline(top)
        found = match(pattern, own)
        roots, dropped = ([nodes[found[k]] for k in ks if k in found] for ks in wrapper[:2])
        if roots:
            known, mine = preorder(pattern), preorder(own)
            constant = {id(nodes[found[k]]) for k in wrapper[2] if k in found and known[k][2] == mine[found[k]][2]}
            text = "\n".join(blocks(top, roots, {id(n) for n in dropped}, constant, {id(nodes[k]) for k in found.values()}))
            if text:
                return text
    return "\n".join(blocks(top))


class _Patterns(dict):
    """Pattern page -> its outline, a few hundred at most."""

    def __missing__(self, html: str) -> list:
        if len(self) > 300:
            self.clear()
        self[html] = made = outline(parse(html))
        return made


def _with_patterns(pages: DataFrame, patterns: DataFrame) -> DataFrame:
    """Pages beside their host's pattern; hot hosts' patterns (a bounded number) are broadcast behind a check of their size, the rest meets by host."""
    if (patterns.where("hot").agg(F.sum(F.octet_length("pattern"))).first()[0] or 0) > BROADCAST_BYTES:
        plain = patterns.drop("hot", "pages").withColumnRenamed("host", "h")
        return pages.join(plain, F.col("host") == F.col("h"), "left").drop("h")
    hot, rest = F.broadcast(patterns.where("hot")).drop("hot", "pages"), patterns.where(~F.col("hot")).drop("hot", "pages")
    named = pages.join(hot.select(F.col("host").alias("h"), *(F.col(c).alias(f"{c}_1") for c in hot.columns if c != "host")), F.col("host") == F.col("h"), "left").drop("h")
    extra = [c for c in rest.columns if c != "host"]
    found = named.where(F.col(f"{extra[0]}_1").isNotNull()).select(*pages.columns, *(F.col(f"{c}_1").alias(c) for c in extra))
    others = named.where(F.col(f"{extra[0]}_1").isNull()).select(*pages.columns).join(rest.withColumnRenamed("host", "h"), F.col("host") == F.col("h"), "left").drop("h")
    return found.unionByName(others.select(*found.columns))


def patterns_of(pages: DataFrame) -> DataFrame:
    """(host, pages, hot, pattern) of hosts with enough pages; the pattern is the page of the smallest id that is neither blank nor long, or
    else the shortest that is not blank."""
    total = pages.count()
    long = F.length("html") > PATTERN_CHARS
    fit = F.when(F.col("html").rlike(r"\S"), F.struct(long, F.when(long, F.length("html")), F.col("page_id").isNull(), "page_id", F.xxhash64("html")))
    made = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.min_by("html", fit).alias("pattern"))
    return written(made.where((F.col("pages") >= MIN_PAGES) & F.col("pattern").isNotNull() & (F.col("host") != "")).withColumn("hot", F.col("pages") > total * HOT_SHARE), "patterns")


def templates_of(pages: DataFrame, patterns: DataFrame) -> DataFrame:
    """``patterns`` with the host's wrapper: content, dropped and constant (numbers of the pattern's nodes)."""

    def align(batches):
        known, counts = _Patterns(), {}

        def flush():
            hosts = [h for h, c in counts.items() for _ in range(len(c))]
            whole = np.concatenate([*counts.values(), np.zeros((0, len(COUNTS)), np.int64)])
            numbers = np.concatenate([*(np.arange(len(c)) for c in counts.values()), np.zeros(0, np.int64)])
            some = np.flatnonzero(whole[:, 0])
            return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()).take(pa.array(some)), pa.array(numbers[some].astype(np.int32)), *(pa.array(whole[some, k]) for k in range(len(COUNTS)))], names=["host", "node", *COUNTS])

        for b in batches:
            for host, html, pattern in zip(*(c.to_pylist() for c in b.columns)):
                tree, own = known[pattern], outline(parse(html))
                if host not in counts:
                    counts[host] = np.zeros((len(preorder(tree)), len(COUNTS)), np.int64)
                theirs, mine = preorder(tree), preorder(own)
                rows = [(x, 1, t[6] == m[6], bool(t[2]), bool(t[2]) and t[2] == m[2], m[4], m[5], len(m[2])) for x, y in match(tree, own).items() for t, m in ((theirs[x], mine[y]),)]
                told = np.array(rows, np.int64)
                counts[host][told[:, 0]] += told[:, 1:]
            if sum(map(len, counts.values())) > 200_000:
                yield flush()
                counts.clear()
        yield flush()

    kinds = ", ".join(f"{c} long" for c in COUNTS)
    beside = _with_patterns(pages.select("host", "html"), patterns).where(F.col("pattern").isNotNull() & F.col("html").rlike(r"\S"))
    seen = beside.select("host", "html", "pattern").mapInArrow(align, f"host string, node int, {kinds}").groupBy("host", "node").agg(*(F.sum(c).alias(c) for c in COUNTS))
    lists = seen.groupBy(F.col("host").alias("h")).agg(F.collect_list(F.struct("node", *COUNTS)).alias("nodes"))  # as many as the pattern has

    def wrap(batches):
        for b in batches:
            made = [induce(p, {n["node"]: tuple(n[c] for c in COUNTS) for n in nodes}, max(n["found"] for n in nodes)) for p, nodes in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *(pa.array([m[k] for m in made], pa.list_(pa.int32())) for k in range(3))], names=["host", "pages", "hot", "pattern", "content", "dropped", "constant"])

    both = patterns.join(lists, F.col("host") == F.col("h")).select("host", "pages", "hot", "pattern", "nodes")
    return written(both.mapInArrow(wrap, "host string, pages long, hot boolean, pattern string, content array<int>, dropped array<int>, constant array<int>"), "templates")


def main_text(pages: DataFrame, keep_columns: list[str]) -> DataFrame:
    """``keep_columns`` with ``text`` and ``n_chars`` (its code points) for each row of ``pages`` (page_id, url, html).

    Null and empty pages give the empty text.  Pages whose url has no host, and those of hosts with few pages, are read
    without a template.  Repeated rows are extracted alike.  Broken markup never fails.  An empty table gives no rows."""
    order = [f for f in pages.schema if f.name in keep_columns and f.name not in ("text", "n_chars")]
    names = [f.name for f in order]
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    keyed = pages.select(F.struct(*names).alias("__row"), host.alias("host"), "page_id", "html")
    patterns = patterns_of(keyed)
    templates = templates_of(keyed, patterns)

    def run(batches):
        known = _Patterns()
        for b in batches:
            made = [extract(h, known[p] if p is not None else None, w) for h, p, *w in zip(*(b.column(i).to_pylist() for i in range(1, 6)))]
            row = b.column(0).flatten()
            yield pa.RecordBatch.from_arrays([*row, pa.array(made, pa.string()), pa.array([len(t) for t in made], pa.int64())], names=[*names, "text", "n_chars"])

    beside = _with_patterns(keyed.select("__row", "host", "html"), templates).select("__row", "html", "pattern", "content", "dropped", "constant")
    return beside.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in order), "text string, n_chars long"]))
