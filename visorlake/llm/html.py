"""Main text of web pages by wrapper induction over pages of one host."""
from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from visorlake.session import settle

#: Elements whose text is never content.
NEVER = frozenset("head script style noscript template iframe object svg math nav footer aside form button select datalist textarea dialog "
                  "menu canvas audio video".split())
#: Roles, and words of a class or id, that mark what is not the article.
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar status form".split())
OUTSIDE = frozenset("nav navbar navigation menu submenu sidebar aside footer masthead topbar ad ads adv advert adverts advertisement advertising "
                    "sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification disclaimer popup modal overlay "
                    "newsletter subscribe subscription signup login search share sharing social related recommended recommendations breadcrumb "
                    "breadcrumbs pagination pager comment comments disqus reply replies respond toolbar widget skip".split())
#: Words of what readers add, which may hold elements like the article's own.
READERS = frozenset("comment comments disqus reply replies respond".split())
#: Elements and words that mark the article itself, in order of trust.
LANDMARKS = (frozenset({"article"}), frozenset({"main"}))
CONTENT = frozenset("article articlebody content post entry story main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp")}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike "
                   "strong sub sup time tt u var wbr br img input".split())
#: Which open elements the start of an element closes, and the elements that stop the search for them.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"},
          "thead": {"table"}, "tbody": {"table"}, "option": {"select", "datalist"}}
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Levels that take part in the alignment. Text nested deeper counts to the last one; elements there that tell what is content are kept beside the tree.
DEEPEST = 100
TELLING = NEVER | LANDMARKS[0] | LANDMARKS[1] | HEADINGS | {"header"}
TELLING_WORDS = OUTSIDE | READERS | CONTENT | {"header", "\0outside"}
#: A text is template if it stands at its node in every page that has the node, at least LEAST_PAGES different ones and this share of the host's.
LEAST_PAGES, SHARE = 3, 0.5
#: Nodes of partial templates a task holds before it sends them on.
HELD_NODES = 200_000
SALTS = 16


# ---------------------------------------------------------------- pages as trees
class Node:
    """A block element; siblings with equal labels are one node. `pages` are up to LEAST_PAGES page hashes that have the node, `n` counts
    pages, `common` the texts that stand here in all of them, `told` whether any page has text here."""
    __slots__ = ("label", "tag", "words", "kids", "n", "pages", "common", "told")

    def __init__(self, label: str, tag: str, words: frozenset):
        self.label, self.tag, self.words = label, tag, words
        self.kids: list[Node] = []
        self.n, self.pages, self.common, self.told = 1, frozenset(), set(), False

    def kid(self, label: str, tag: str, words: frozenset) -> Node:
        for k in self.kids:
            if k.label == label:
                return k
        k = Node(label, tag, words)
        self.kids.append(k)
        return k


@lru_cache(20_000)
def _marks(tag: str, attributes: str) -> tuple[str, frozenset]:
    """Label of an element for the alignment, and the words that tell what it is for."""
    found = {}
    for m in ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), unescape((m[2] or "").strip("\"'")))
    names = f"{found.get('class', '')} {found.get('id', '')}"
    words = {w.lower() for w in WORD.findall(names)}
    role = found.get("role", "").lower()
    if role in ROLES or "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        words.add("\0outside")
    if role in ("main", "article") or "articlebody" in found.get("itemprop", "").lower():
        words.add("main")
    special = "!" * ("\0outside" in words) + "*" * ("main" in words)
    return f"{tag}{special} {' '.join(sorted(set(re.sub(r'[0-9]+', '', names).lower().split())))}", frozenset(words)


class Page:
    """Blocks of text in page order, each with the nodes above it, and the tree of block elements."""

    def __init__(self, html: str):
        self.root = Node("#", "#", frozenset())
        self.blocks: list[tuple[tuple[Node, ...], str, int]] = []
        self.deep: dict[int, list[Node]] = {}
        self._text: list[str] = []
        self._linked = 0
        self._stack: list[tuple[str, tuple[Node, ...]]] = [("#", (self.root,))]
        self._links = 0
        self._read(html)

    def _flush(self) -> None:
        if self._text:
            line = " ".join(unescape("".join(self._text)).split())
            if line:
                self.blocks.append((self._stack[-1][1], line, self._linked))
            self._text.clear()
            self._linked = 0

    def _close(self, depth: int) -> None:
        for tag, _ in self._stack[depth:]:
            if tag not in INLINE:
                self._flush()
                break
        self._links -= sum(tag == "a" for tag, _ in self._stack[depth:])
        del self._stack[depth:]

    def _find(self, tags, stop=frozenset()) -> int:
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] in tags:
                return i
            if self._stack[i][0] in stop:
                return 0
        return 0

    def _start(self, tag: str, attributes: str) -> None:
        if tag in INLINE:
            if tag not in VOID:
                self._stack.append((tag, self._stack[-1][1]))
                self._links += tag == "a"
            else:
                self._text.append(" ")
            return
        self._flush()
        open_p = self._find({"p"}, {"table", "td", "th", "article", "section", "div", "body", "button"})
        if open_p:
            self._close(open_p)
        if tag in CLOSES:
            old = self._find(CLOSES[tag], SCOPES[tag])
            if old:
                self._close(old)
        above = self._stack[-1][1]
        if tag in VOID:
            return
        label, words = _marks(tag, attributes)
        if len(above) < DEEPEST:
            nodes = (*above, above[-1].kid(label, tag, words))
        elif (tag in TELLING or words & TELLING_WORDS) and not any(n.label == label for n in above[DEEPEST:]):
            nodes = (*above, Node(label, tag, words))
            self.deep.setdefault(id(above[-1]), []).append(nodes[-1])
        else:
            nodes = above
        self._stack.append((tag, nodes))

    def _end(self, tag: str) -> None:
        if tag in INLINE:
            for at in range(len(self._stack) - 1, 0, -1):                      # no further than the innermost block
                if self._stack[at][0] == tag:
                    self._links -= tag == "a"
                    del self._stack[at]
                    return
                if self._stack[at][0] not in INLINE:
                    return
            return
        at = self._find({tag})
        if at:
            self._flush()
            self._close(at)

    def _say(self, text: str) -> None:
        if text:
            self._text.append(text)
            if self._links > 0:
                self._linked += len(text)

    def _read(self, html: str) -> None:
        at = 0
        while True:
            m = TAG.search(html, at)
            if m is None:
                break
            self._say(html[at:m.start()])
            at = m.end()
            end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if end:
                self._end(tag)
            elif tag in RAW:
                close = RAW[tag].search(html, at)
                at = close.end() if close else len(html)
            else:
                self._start(tag, attributes)
                if attributes.endswith("/") and tag in ("svg", "math", "object", "canvas"):
                    self._end(tag)
        self._say(html[at:])
        self._flush()

    def template(self) -> Node:
        """The tree as a template of one page."""
        page = frozenset({crc32("\n".join(t for _, t, _ in self.blocks).encode())})
        for nodes, text, _ in self.blocks:
            node = nodes[:DEEPEST][-1]
            node.common.add(text_hash(text))
            node.told = True
        todo = [self.root]
        while todo:
            node = todo.pop()
            node.pages = page
            todo += node.kids
        return self.root


def text_hash(text: str) -> int:
    data = text.encode()
    return crc32(data) << 32 | crc32(data, 0x5EED)


# ---------------------------------------------------------------- simple tree matching
def match_size(a: Node, b: Node, known: dict | None = None) -> int:
    """Nodes in the largest order-preserving match of two trees with equal roots."""
    return _matched(a, b, {} if known is None else known)[0]


def _matched(a: Node, b: Node, known: dict) -> tuple[int, list[tuple[int, int]]]:
    """Size of the match of two nodes and the pairs of their children; each two nodes are compared once."""
    at = id(a), id(b)
    if at not in known:
        pairs = align(a.kids, b.kids, known)
        known[at] = 1 + sum(_matched(a.kids[i], b.kids[j], known)[0] for i, j in pairs), pairs
    return known[at]


def align(left: list[Node], right: list[Node], known: dict | None = None) -> list[tuple[int, int]]:
    """Simple tree matching of two lists of siblings: pairs (i, j) in order that match the most nodes. `known` keeps what was compared."""
    known = {} if known is None else known
    if [k.label for k in left] == [k.label for k in right]:
        return [(i, i) for i in range(len(left))]
    table = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            own = _matched(a, b, known)[0] if a.label == b.label else 0
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + own)
    i, j, out = len(left), len(right), []
    while i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def merge(into: Node, other: Node, known: dict | None = None) -> None:
    """Align two templates of a host and join them: aligned nodes keep what is common, the others are put in at their place.

    Children are joined before a node gets new ones, so what was compared further up still holds for them.
    """
    known = {} if known is None else known
    into.n += other.n
    into.pages = frozenset(sorted(into.pages | other.pages)[:LEAST_PAGES])
    into.common &= other.common
    into.told |= other.told
    pairs = _matched(into, other, known)[1]
    for i, j in pairs:
        merge(into.kids[i], other.kids[j], known)
    if len(pairs) == len(other.kids):
        return
    place, kids, done = {j: i for i, j in pairs}, [], 0
    for j, k in enumerate(other.kids):
        if j in place:
            kids += into.kids[done:place[j] + 1]
            done = place[j] + 1
        else:
            kids.append(k)
    into.kids = kids + into.kids[done:]


def _size(node: Node) -> int:
    return 1 + sum(map(_size, node.kids))


def _varies(node: Node) -> bool:
    return (node.told and not node.common and len(node.pages) >= LEAST_PAGES) or any(map(_varies, node.kids))


# ---------------------------------------------------------------- what is content
def _outside(node: Node) -> bool:
    if node.tag in ("html", "body", "article", "main"):
        return "\0outside" in node.words or bool(node.words & {"comment", "comments", "ad", "advert", "related", "promo"})
    return node.tag in NEVER or bool(node.words & OUTSIDE) or "\0outside" in node.words


def _holds(node: Node, tags: frozenset, deep: dict[int, list[Node]]) -> bool:
    todo = [node]
    while todo:
        node = todo.pop()
        for k in (*node.kids, *deep.get(id(node), ())):
            if k.tag in tags and not _outside(k):
                return True
            todo.append(k)
    return False


def main_text(html: str, template: Node | None = None) -> str:
    """The article of a page. `template`, if given, is what the page's host has in common."""
    page = Page(html)
    wrap = _constants(page.root, template) if template is not None else {}
    marks = LANDMARKS[0] | LANDMARKS[1]
    dropped: dict[int, bool] = {}

    def gone(nodes: tuple[Node, ...]) -> bool:
        """Whether a node above the block is outside. One around the article as a whole is not, and of the elements that never hold content only a form may be."""
        if id(nodes[-1]) not in dropped:
            out = within = False
            for n in nodes:
                if id(n) not in dropped:
                    around = ((n.tag not in NEVER or n.tag == "form") and not n.words & READERS and not within and _outside(n)
                              and _holds(n, marks, page.deep))
                    dropped[id(n)] = out or (_outside(n) and not around)
                out, within = dropped[id(n)], within or n.tag in marks
        return dropped[id(nodes[-1])]

    live = [b for b in page.blocks if not gone(b[0])]
    region = []
    for tags in LANDMARKS:
        region = [b for b in live if any(n.tag in tags or (tags is LANDMARKS[1] and "main" in n.words) for n in b[0])]
        if region:
            break
    if not region:
        region = [b for b in live if any(n.words & CONTENT for n in b[0])]
    loose = not region
    out = []
    for nodes, text, linked in region or live:
        if text_hash(text) in wrap.get(id(nodes[:DEEPEST][-1]), ()):
            continue
        if loose and 2 * linked > len(text):
            continue
        heads = [i for i, n in enumerate(nodes) if n.tag == "header" or "header" in n.words]
        if heads and not (nodes[-1].tag in HEADINGS and any(n.tag in ("article", "main") for n in nodes[:heads[0]])):
            continue
        out.append(text)
    return "\n".join(out)


def _constants(root: Node, template: Node) -> dict[int, set[int]]:
    """Texts that are template, by the node of the page where they stand.

    An article is never template as a whole: below a landmark texts count only if something else there varies.
    """
    out: dict[int, set[int]] = {}
    least, seen = template.n * SHARE, {}
    todo = [(root, template, True)]
    while todo:
        node, known, free = todo.pop()
        if known.tag in ("article", "main") or "main" in known.words:
            free = _varies(known)
        if free and known.common and len(known.pages) >= LEAST_PAGES and known.n >= least:
            out[id(node)] = known.common
        todo += [(node.kids[i], known.kids[j], free) for i, j in align(node.kids, known.kids, seen)]
    return out


# ---------------------------------------------------------------- Spark
def _host(url: str):
    return F.lower(F.try_parse_url(F.col(url), F.lit("HOST")))


def host_templates(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, template (a pickled tree): every page of a host aligned.

    Each task aligns the pages it reads and sends a tree per host, in pieces if they get large; the trees are aligned in two steps, first within
    SALTS groups, so a host with a third of all pages is never a group of pages. Trees stream through the tasks.
    """
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Node] = {}
        for b in batches:
            for host, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                one = Page(body.as_py() or "").template()
                if host in held:
                    merge(held[host], one)
                else:
                    held[host] = one
            if sum(map(_size, held.values())) > HELD_NODES:
                yield _rows(held)
                held = {}
        if held:
            yield _rows(held)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, tree = None, None
        for b in batches:
            for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if h == host:
                    merge(tree, pickle.loads(t))
                else:
                    if tree is not None:
                        yield _rows({host: tree})
                    host, tree = h, pickle.loads(t)
        if tree is not None:
            yield _rows({host: tree})

    kind = "host string, template binary"
    some = pages.select(_host(url).alias("host"), F.col(html).alias("html")).where("host <> ''").mapInArrow(learn, kind)
    salted = some.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).repartition("host", "_salt")
    fewer = salted.sortWithinPartitions("host", "_salt", "template").drop("_salt").mapInArrow(join, kind)
    return fewer.repartition("host").sortWithinPartitions("host", "template").mapInArrow(join, kind)


def _rows(trees: dict[str, Node]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(trees), pa.string()), pa.array([pickle.dumps(t, 5) for t in trees.values()], pa.binary())],
                                      ["host", "template"])


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", broadcast_bytes: int = 32_000_000) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars, host.

    Wrapper induction: the trees of block elements of a host's pages are aligned by simple tree matching, equal siblings as one node. What stands at
    a node in every page that has it is template; what varies is content, unless its element, role or class says that it is a
    menu, header, footer, sidebar, notice, advert, form or comment. If there is an article (or main, or content) element, only its
    text counts; otherwise blocks that are mostly links are dropped. Pages without a host or with few siblings are judged without a template.

    A null html is an empty text, a null url has no host. Repeated rows give repeated rows; ids are passed on. Very long pages are read in one pass.
    An empty table gives none. Other columns are ignored. Templates are broadcast if they take at most `broadcast_bytes`.
    """
    templates = settle(host_templates(pages, url, html))
    size = templates.agg(F.sum(F.octet_length("template"))).first()[0] or 0
    rows = pages.select(F.col(id).alias("page_id"), F.col(url).alias("url"), _host(url).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    joined = rows.join(F.broadcast(templates) if size <= broadcast_bytes else templates, "host", "left").select("page_id", "url", "host", "html", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = lru_cache(1_000)(pickle.loads)
        for b in batches:
            texts = [main_text(h.as_py(), tree(t) if t else None) for h, t in zip(b.column("html"), b.column("template").to_pylist(), strict=True)]
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(size), b.column("host")],
                                             ["page_id", "url", "text", "n_chars", "host"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, host string")
