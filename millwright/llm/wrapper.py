"""Main text of web pages by wrapper induction over the pages of a host.

Pages become trees of their block elements, from the article (or main element) on where a page has one, else from the
root. Every distinct tree of a host is aligned by simple tree matching with one reference tree of its layout, and the
counts of aligned nodes with and without the reference's text, added up over all of them, tell the constant nodes, the
template, from the varying ones, the slots. Constant nodes of all layouts of a host are no content on any of its pages,
and neither is what has a role of its own (menus, forms, adverts, comments and the like, by element, role or class).
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, staged, texts

LEAST_PAGES = 3
"""Distinct trees that must agree before a node is taken for template."""
LEAST_ARTICLES = 6
"""The same inside an article or main element, which is content unless shown otherwise."""
CONSTANT = 0.9
"""Share of the aligned trees in which a template node has the text of the reference."""
COMMON = 0.5
"""Share of a layout's trees that a template node must be aligned in; rarer nodes tell too little."""
LOOP = 1000
"""Lists of children with more pairs of nodes than this, all below them counted, are matched row by row instead of pair by pair."""
CELLS = 1 << 24
"""Cells of such a table whose way back is held at once, 1 byte each."""
KEPT = 1 << 18
"""Values of one level, 8 bytes each, kept for equal trees met again."""

DEPTH = 150
"""Elements nested deeper are empty siblings, with their content in the deepest one, as browsers do."""

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)", re.S
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
BLOCKS = set(
    "address article aside blockquote body button canvas center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup html legend li main map menu nav noscript ol optgroup option p pre search section select summary"
    " svg table tbody td template tfoot th thead tr ul video audio object".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - set("button canvas map noscript object option optgroup select svg template video audio td th tr tbody thead tfoot body html head".split())
#: An element that ends open ones of the second set, up to one of the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
NO_CONTENT = set(
    "aside audio button canvas dialog dir fieldset footer form head header iframe legend map menu nav noscript object optgroup option search select"
    " svg template video".split()
)
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar tooltip".split())
NAMES = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus dropdown"
    " footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pagination pager popup"
    " promo promoted promotion recommended related reply respond responses search share sharing sidebar signup skip social sponsor sponsored"
    " subscribe subscription toolbar widget".split()
)
PROSE = set("p ul ol li dl dt dd h1 h2 h3 h4 h5 h6 blockquote pre table thead tbody tfoot tr td th figure figcaption caption".split())
"""Elements whose presence depends on what is written, not on the layout."""
INSIDE_ARTICLE = {"header", "banner"}
"""Names that inside an article stand for its own head."""


class Node:
    __slots__ = ("tag", "label", "names", "children", "linked")

    def __init__(self, tag: str, label: str, names: set[str]):
        self.tag, self.label, self.names, self.children, self.linked = tag, label, names, [], 0

    def blocks(self) -> list:
        """Children with neighbouring text as one normalised string; empty strings left out."""
        out, run = [], []
        for x in [*self.children, None]:
            if isinstance(x, str):
                run.append(x)
                continue
            text = " ".join("".join(run).split())
            run = []
            if text:
                out.append(text)
            if isinstance(x, Node):
                out.append(x)
        return out


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)} if source.strip(" /") else {}


def _node(tag: str, source: str) -> Node:
    a = _attributes(source)
    words = f"{a.get('class', '')} {a.get('id', '')}"
    names = set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", words).lower())) & NAMES if words != " " else set()
    if a.get("role", "").lower() in ROLES:
        names.add("banner" if a["role"].lower() == "banner" else "form")
    if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", ""):
        names.add("overlay")
    if a.get("role", "").lower() == "main" and tag != "article":
        tag = "main"
    return Node(tag, f"{tag}.{a['class']}" if a.get("class") else tag, names)


def parse(source: str) -> Node:
    """Tree of block elements of tolerant HTML; inline elements are part of the text around them."""
    root = Node("#root", "#root", set())
    stack, at, links = [root], 0, 0

    def text(piece: str) -> None:
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            stack[-1].children.append(piece)
            if links:
                stack[-1].linked += len(piece.strip())

    while at < len(source):
        m = TOKEN.search(source, at)
        if not m:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:  # an end tag
            if tag == "a":
                links = max(0, links - 1)
            elif tag == "br":
                text(" ")
            elif tag in BLOCKS and any(x.tag == tag or x.label.split(".")[0] == tag for x in stack[1:]):
                while stack.pop().label.split(".")[0] != tag and len(stack) > 1:
                    pass
                links = 0
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|$)", re.I).search(source, at)
            at = end.end() if end else len(source)
        elif tag == "a":
            links += 1
        elif tag in VOID:
            if tag == "hr":
                stack[-1].children.append(None)
            elif tag in ("br", "wbr"):
                text(" " if tag == "br" else "")
        elif tag in BLOCKS:
            if tag in CLOSES_P and any(x.tag == "p" for x in stack):
                while stack.pop().tag != "p":
                    pass
                links = 0
            if tag in IMPLIED:
                ends, scope = IMPLIED[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in scope:
                        break
                    if stack[i].tag in ends:
                        del stack[i:]
                        break
            if tag in ("html", "body") and len(stack) > 1 and any(x.tag == tag for x in stack):
                continue
            if tag == "body":
                del stack[1 + any(x.tag == "html" for x in stack) :]
            node = _node(tag, m[3] or m[6] or "")
            stack[-1].children.append(node)
            if len(stack) < DEPTH:
                stack.append(node)
    return root


def own_text(node: Node) -> str:
    return "\n".join(x for x in node.blocks() if isinstance(x, str))


def skeleton(node: Node) -> list:
    """[label, text hash, children]"""
    return [node.label, hash_text(own_text(node)), [skeleton(x) for x in node.blocks() if isinstance(x, Node)]]


def page_tree(root: Node) -> list:
    """The tree that is aligned: what the content is taken from."""
    parts = _chosen(root)
    return ["#part" if parts else "#page", 0, [skeleton(x) for x in parts or [root]]]


def layout(tree: list) -> int:
    """Hash of the scaffolding: which labels but those of prose stand where, four levels deep."""
    found = set()

    def go(x: list, path: str, depth: int) -> None:
        path = f"{path}/{x[0]}"
        found.add(path)
        for c in x[2] if depth else ():
            if c[0].split(".")[0] not in PROSE:
                go(c, path, depth - 1)

    go(tree, "", 4)
    return hash_text("\n".join(sorted(found)))


def hash_text(text: str) -> int:
    data = text.encode("utf-8", "surrogatepass")
    return zlib.crc32(data) << 20 | len(data) & 0xFFFFF


def _prepared(tree: list, other: set[int], alone: int, labels: dict, ids: dict) -> tuple:
    """(label, text, children, size, number of all below); `alone` stands for every text that the other tree has nowhere."""
    children = [_prepared(c, other, alone, labels, ids) for c in tree[2]]
    label, text = labels.setdefault(tree[0], len(labels)), tree[1] if tree[1] in other else alone
    number = ids.setdefault((label, text, *(c[4] for c in children)), len(ids))
    return label, text, children, 1 + sum(c[3] for c in children), number


def _starts(children: list, at: int) -> list[int]:
    return list(accumulate((c[3] for c in children), initial=at + 1))[:-1]


def _row(above: np.ndarray, values: np.ndarray, first: np.ndarray | int, least: np.ndarray | int) -> np.ndarray:
    """Next row of the tables of lists that stand one after the other, each beginning at `first` with `least`."""
    row = np.empty_like(above)
    row[1:] = above[:-1]
    row[first] = least
    row += values
    return np.maximum.accumulate(np.maximum(row, above, out=row))


def _count(nodes, alike, texts, bits: int):
    """What a match is worth: matched nodes first, then those in equal elements with children, then equal texts."""
    return (nodes << bits | alike) << bits | texts


def _whole(tree: tuple, bits: int) -> int:
    return _count(tree[3], tree[3] if tree[2] else 0, tree[3], bits)


class _Level:
    """Trees of a list, and all their children as the next level, for matches counted as in `match`."""

    def __init__(self, trees: list, bits: int):
        whole = lambda values: np.fromiter(values, np.int64, len(trees))
        self.label, self.text, self.number = whole(t[0] for t in trees), whole(t[1] for t in trees), whole(t[4] for t in trees)
        self.bits = bits
        self.rows: dict[int, np.ndarray] = {}
        children = [c for t in trees for c in t[2]]
        self.below = _Level(children, bits) if children else None
        if children:
            counts, sizes = whole(len(t[2]) for t in trees), whole(t[3] for t in trees)
            self.parents = np.flatnonzero(counts)
            ends = np.cumsum(counts)[self.parents]
            self.first, self.last = ends - counts[self.parents], ends - 1
            # every list counts from more than the one before it can reach, so one running maximum serves them all
            reach = _count(sizes, sizes, sizes, bits)
            self.least = (np.cumsum(reach) - reach)[self.parents]
            self.start = np.repeat(self.least, counts[self.parents])

    def against(self, tree: tuple) -> np.ndarray:
        """The largest match of the tree with each of this level."""
        out = self.rows.get(tree[4])
        if out is not None:
            return out
        same = self.label == tree[0]
        out = same * _count(1, 0, self.text == tree[1], self.bits)
        if tree[2] and self.below and same.any():
            row = self.start
            for c in tree[2]:
                row = _row(row, self.below.against(c), self.first, self.least)
            out[self.parents] += same[self.parents] * (row[self.last] - self.least)
            out[self.number == tree[4]] = _whole(tree, self.bits)
        if (len(self.rows) + 1) * len(out) > KEPT:
            self.rows.clear()
        self.rows[tree[4]] = out
        return out


def _chain(x: list, y: list, bits: int) -> list[tuple[int, int]]:
    """The pairs of two lists that the largest match takes, a row of the table at a time.

    Rows are kept at the borders of blocks, and a block is filled again when the way back comes to it.
    """
    level, width = _Level(y, bits), max(CELLS // len(y), isqrt(8 * len(x))) + 1
    blocks, borders = range(0, len(x), width), [np.zeros(len(y), np.int64)]
    for at in blocks[:-1]:
        row = borders[-1]
        for tree in x[at : at + width]:
            row = _row(row, level.against(tree), 0, 0)
        borders.append(row)
    out, p, q = [], len(x) - 1, len(y) - 1
    for at in reversed(blocks):
        row, ways = borders.pop(), []
        for tree in x[at : min(at + width, p + 1)]:
            above, row = row, _row(row, level.against(tree), 0, 0)
            way = (row != above).astype(np.int8)  # 0: as above, 1: as to the left, 2: by a pair
            way[1:] += way[1:] & (row[1:] != row[:-1])
            way[0] *= 2
            ways.append(way)
        while p >= at and q >= 0:
            way = ways[p - at][q]
            if way == 2:
                out.append((p, q))
            p, q = p - (way != 1), q - (way != 0)
    return out[::-1]


def match(a: list, b: list) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: (size, pairs of preorder numbers) of the largest order-preserving match of two trees.

    Of the largest matches one with the most nodes in equal elements with children is taken, so that few values of cells do
    not outweigh equal rows, of those one with the most equal texts, and of those the one whose table, filled in order, is left
    upwards before sideways. Lists of whatever length are matched so; LOOP decides how a table is filled, not what it holds.
    """
    texts_of = [set(hashes_of(t)) for t in (a, b)]
    labels: dict[str, int] = {}
    ids: dict[tuple, int] = {}
    first, second = _prepared(a, texts_of[1], -1, labels, ids), _prepared(b, texts_of[0], -2, labels, ids)
    bits = min(first[3], second[3]).bit_length()

    def by_row(x: list, y: list) -> bool:
        """Not where all the work is in one pair of children: what lies below is then done once, however deep it is nested."""
        if sum(c[3] for c in x) * sum(c[3] for c in y) <= LOOP or second[3].bit_length() + 2 * bits > 60:
            return False
        return len(x) * len(y) > LOOP or sum(c[0] == d[0] and c[3] * d[3] > LOOP for c in x for d in y) > 1

    def children(x: list, xs: list[int], y: list, ys: list[int]) -> tuple[int, list]:
        """Best (count, pairs) of two lists of trees that begin at these numbers."""
        low, high = 0, 0
        while low < min(len(x), len(y)) and x[low][4] == y[low][4]:
            low += 1
        while high < min(len(x), len(y)) - low and x[-1 - high][4] == y[-1 - high][4]:
            high += 1
        # equal trees lose nothing by being matched with each other
        found = [go(x[i], xs[i], y[j], ys[j]) for i, j in [*((i, i) for i in range(low)), *((-k, -k) for k in range(1, high + 1))]]
        x, xs, y, ys = x[low:len(x) - high], xs[low:len(xs) - high], y[low:len(y) - high], ys[low:len(ys) - high]
        if x and y and by_row(x, y):
            found += [go(x[i], xs[i], y[j], ys[j]) for i, j in _chain(x, y, bits)]
        elif x and y:
            best = [[(0, None)] * (len(y) + 1) for _ in range(len(x) + 1)]
            for p, c in enumerate(x, 1):
                for q, d in enumerate(y, 1):
                    up, left = best[p - 1][q], best[p][q - 1]
                    option = up if up[0] >= left[0] else left
                    if c[0] == d[0]:
                        own = go(c, xs[p - 1], d, ys[q - 1])
                        before = best[p - 1][q - 1]
                        if before[0] + own[0] > option[0]:
                            option = (before[0] + own[0], (before[1], own))
                    best[p][q] = option
            link = best[-1][-1][1]
            while link:
                link, own = link
                found.append(own)
        return sum(n for n, _ in found), [pair for _, pairs in found for pair in pairs]

    def go(x: tuple, i: int, y: tuple, j: int) -> tuple[int, list]:
        if x[4] == y[4]:
            return _whole(x, bits), [(i + k, j + k) for k in range(x[3])]
        if x[0] != y[0]:
            return 0, []
        n, pairs = children(x[2], _starts(x[2], i), y[2], _starts(y[2], j)) if x[2] and y[2] else (0, [])
        return n + _count(1, 0, x[1] == y[1], bits), [(i, j), *pairs]

    pairs = go(first, 0, second, 0)[1]
    return len(pairs), pairs


def hashes_of(tree: list) -> list[int]:
    return [tree[1], *(h for c in tree[2] for h in hashes_of(c))]


def step(path: int, label: str) -> int:
    return zlib.crc32(label.encode("utf-8", "surrogatepass"), path)


def mark(path: int, text: int) -> int:
    """Number of a node by the labels on its path and the hash of its text."""
    return (path * 0x9E3779B97F4A7C15 ^ text) & (1 << 63) - 1


def marks_of(tree: list, path: int = 0) -> list[int]:
    """Marks in preorder; 0 for a node without own text."""
    here = step(path, tree[0])
    return [mark(here, tree[1]) if tree[1] else 0, *(m for c in tree[2] for m in marks_of(c, here))]


@lru_cache(maxsize=64)
def _reference(source: str) -> tuple[list, list[int], list[int]]:
    tree = json.loads(source)
    return tree, hashes_of(tree), marks_of(tree)


def _no_content(node: Node, inside: bool) -> bool:
    if inside:
        return node.tag in NO_CONTENT - INSIDE_ARTICLE or bool(node.names - INSIDE_ARTICLE)
    return node.tag in NO_CONTENT or bool(node.names)


def _articles(node: Node, tag: str) -> list[Node]:
    """Topmost elements of a tag outside what is no content."""
    out = []
    for x in node.children:
        if isinstance(x, Node) and not _no_content(x, x.tag in ("article", "main")):
            out += [x] if x.tag == tag else _articles(x, tag)
    return out


def _menu(node: Node) -> bool:
    """A list, table or division that is links and little else."""
    total = linked = 0
    todo = [node]
    while todo:
        x = todo.pop()
        linked += x.linked
        for c in x.children:
            if isinstance(c, Node):
                todo.append(c)
            elif c:
                total += len(c.strip())
    return linked > 0 and linked >= 0.8 * total and node.tag in ("ul", "ol", "dl", "table", "div", "section", "p", "li")


def _chosen(root: Node) -> list[Node]:
    """The elements that hold the content, none if the page does not name them."""
    articles, mains = _articles(root, "article"), _articles(root, "main")
    return articles if len(articles) == 1 else mains or articles


def content(root: Node, constant: set[int] = frozenset()) -> list[str]:
    """Blocks of the main text in page order. constant: marks of the nodes that are template on this host."""
    chosen = _chosen(root)
    out: list[str] = []

    def walk(node: Node, inside: bool, path: int, constant: set[int]) -> None:
        if _no_content(node, inside) or (not inside and _menu(node)):
            return
        path = step(path, node.label)
        fixed = bool(constant) and mark(path, hash_text(own_text(node))) in constant
        for x in node.blocks():
            if isinstance(x, Node):
                walk(x, inside, path, constant)
            elif not fixed:
                out.append(x)

    for x in chosen:
        walk(x, True, step(0, "#part"), constant)
    if chosen and constant and not out:  # an article that all pages repeat is still one
        for x in chosen:
            walk(x, True, step(0, "#part"), frozenset())
    if not chosen:
        walk(root, False, step(0, "#page"), constant)
    return out


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def templates(pages: DataFrame) -> DataFrame:
    """(host, template): the marks of the constant nodes of each host."""

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            rows = [page_tree(parse(x)) for x in texts(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(layout, rows), pa.int64()), pa.array(map(json.dumps, rows), pa.string())], ["host", "layout", "tree"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, list[int]] = {}
            for name, group, tree, reference in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, (b, y, marks) = json.loads(tree), _reference(reference)
                x = hashes_of(a)
                for i, j in match(a, b)[1]:
                    if marks[j] or not j:
                        n = found.setdefault((name, group, j, marks[j], b[0] == "#part"), [0, 0])
                        n[0] += 1
                        n[1] += x[i] == y[j]
            keys = list(zip(*found, strict=True)) or [[]] * 5
            sums = list(zip(*found.values(), strict=True)) or [[]] * 2
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*keys, *sums], kinds, strict=True)], ["host", "layout", "node", "mark", "part", "n", "same"])

    distinct = staged(pages.select("host", "html").mapInArrow(trees, "host string, layout bigint, tree string").distinct(), "trees")
    least = F.min(F.struct(F.xxhash64("tree").alias("h"), "tree"))
    reference = staged(distinct.groupBy("host", "layout").agg(least.alias("r")).select("host", "layout", F.col("r.tree").alias("reference")), "references")
    beside = distinct.join(reference, ["host", "layout"]).select("host", "layout", "tree", "reference")
    counts = beside.mapInArrow(count, "host string, layout bigint, node int, mark bigint, part boolean, n bigint, same bigint")
    counts = counts.groupBy("host", "layout", "node", "mark", "part").agg(F.sum("n").alias("n"), F.sum("same").alias("same"))
    # the roots always match, so the largest count is that of all trees of the layout
    counts = counts.withColumn("all", F.max("n").over(Window.partitionBy("host", "layout"))).filter("mark != 0")
    constant = counts.filter(
        (F.col("n") >= F.when(F.col("part"), LEAST_ARTICLES).otherwise(LEAST_PAGES)) & (F.col("same") >= CONSTANT * F.col("n")) & (F.col("n") >= COMMON * F.col("all"))
    )
    return staged(constant.groupBy("host").agg(F.collect_set("mark").alias("template")), "templates")


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every row.

    Null html is an empty page; a page without content has an empty text; a null or odd url belongs to the host without a
    name. Repeated pages of a host count once towards its template and each come out. An empty table gives an empty result.
    """
    rows = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url"), F.col(f"`{source}`").alias("html"), host(F.col(f"`{url}`")).alias("host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            found = zip(texts(part.column("html")), part.column("template").to_pylist(), strict=True)
            out = ["\n\n".join(content(parse(x), frozenset(template or ()))) for x, template in found]
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), part.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["key", "url", "text", "n_chars"]
            )

    kind = pages.schema[key].dataType.simpleString()
    # the templates are a written table: a small one is sent to the pages, whose html then stays where it is
    joined = rows.join(templates(rows), "host", "left").select("key", "url", "html", "template")
    return joined.mapInArrow(run, f"key {kind}, url string, text string, n_chars bigint").withColumnRenamed("key", key)
