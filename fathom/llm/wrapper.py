"""Main text of web pages by wrapper induction.

For each host and layout a few different pages are aligned by simple tree matching: trees of blocks,
whose leaves are runs of text. Texts that are alike in all aligned pages are template, those that
vary are slots. The content root is the deepest container that holds nearly all slot text, and all
its headings, outside menus, headers, footers, adverts and the like. The wrapper is that root's path
and the template texts inside it. Every page is then cut by the wrapper of its layout, by its host's
where the layout has a single page, or by its own article or main element where the wrapper doesn't
fit. Pages are read in one pass, whatever their markup: nothing recurses, and no tag is looked at
twice.
"""

from __future__ import annotations

import hashlib
import heapq
import html
import json
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.langid import host_of
from fathom.llm.shared import cut

#: Different pages that a wrapper is fitted on.
PAGES = 6
#: Pairs of containers, and pairs of their children, that matching two trees may take; where it would take more,
#: texts are aligned by their paths.
CONTAINER_PAIRS, CHILD_PAIRS = 20_000, 20_000_000
#: Share of slot text that a container must hold to be descended into.
SHARE = 0.8
#: Wrappers are broadcast up to so many bytes; beyond, they are joined by host and layout.
BROADCAST_BYTES = 32 << 20
#: Bytes of pages that a task holds while it looks for those to fit on, before it passes them on.
HELD = 64 << 20
SALT = 16

# fixed values of HTML: elements without content, with raw text, that make blocks, that end open items
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noframes".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
ITEMS = set().union(*CLOSES.values())
LISTS = {"ul", "ol", "dl", "table", "select"}
SCOPE = set("table ul ol dl div article section body html main td th blockquote".split())
CONTAINERS = set("article blockquote body center div main section table tbody td tr".split())
REGIONS = set("article center div main section".split())
#: Menus, page footers, sidebars, forms and their controls, scripts, styles, and what browsers show only if something fails.
DROPPED = set("nav footer aside form script style noscript template iframe button select textarea canvas audio video embed head title dialog menu input xmp noframes".split())
ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
#: Words of a class or id that mark a region as something else than the article.
NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsbygoogle banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus footer gdpr header masthead menu menus modal nav navbar navigation "
    "newsletter notice notices notification pager pagination popup promo promotion related replies respond share sharing sidebar sidebars social sponsor sponsored subscribe tags toolbar topbar widget widgets".split()
)

#: Words of a class or id that only say whose, where or of what form a region is: reader-comments are comments, advert-slot is an advert.
FORMS = set(
    "area article articles bar big block body bottom box button buttons center column container desktop fixed float floating global group holder icon icons inner item items js large left link links list mobile outer "
    "page panel placeholder post posts primary reader readers region right row secondary section site slot small sticky story stories top unit user users visitor visitors wrap wrapper zone".split()
)
#: Of a header, only these make the page's: a section-header is a heading.
OF_PAGES = set("bar container fixed global inner outer page primary site sticky top wrap wrapper".split())
HEADERS = {"header", "masthead"}
#: Names that articles use for parts of their own too. There such a region goes only if most of its text is links or buttons.
SHARED_NAMES = set("banner menu menus notice notices promo social tags toolbar widget widgets".split())
#: Blocks of running text, where a button may be a word of a sentence.
SENTENCES = set("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p td th".split())
HEADINGS = {f"h{k}": k for k in range(1, 7)}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_PLAIN = re.compile(r"[^\"'>]*+")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?")
_ASKED = re.compile("class|id|role|hidden|style", re.IGNORECASE)
_UNSEEN = re.compile(r"(?:^|;)\s*+(?:display\s*+:\s*+none|visibility\s*+:\s*+hidden)\s*+(?:!|;|$)", re.IGNORECASE)


class Node:
    """An element or a run of text; the last four are used while the element is open."""

    __slots__ = ("tag", "name", "words", "parent", "children", "text", "kept", "linked", "paragraph", "item", "frame", "inline")

    def __init__(self, tag: str, name: str = "", parent=None, text: str = "", words=frozenset()):
        self.tag, self.name, self.parent, self.text, self.words = tag, name, parent, text, words
        self.children: list[Node] = []
        self.kept = self.linked = False
        if tag == "#text":
            return
        #: the innermost open p, and the innermost open list item, cell or row, that a start tag may end
        self.paragraph = None if tag in SCOPE or parent is None else self if tag == "p" else parent.paragraph
        self.item = None if tag in LISTS or parent is None else self if tag in ITEMS else parent.item
        #: the innermost block, and how many inline elements of each tag are open right inside it
        self.frame = self if tag in BLOCK or parent is None else parent.frame
        self.inline = {} if self.frame is self else None

    @property
    def label(self) -> str:
        return f"{self.tag}.{self.name}" if self.name else self.tag


def _tag_end(page: str, pos: int, lost: set[str]) -> int:
    """Where the tag ends whose name ends at pos; a > inside a quoted value doesn't count. -1 if nowhere."""
    while True:
        pos = _PLAIN.match(page, pos).end()
        if pos == len(page):
            return -1
        mark = page[pos]
        if mark == ">":
            return pos
        before = pos - 1
        while page[before].isspace():
            before -= 1
        # only a value may be quoted, and a quote that nothing closes is none
        close = page.find(mark, pos + 1) if page[before] == "=" and mark not in lost else -1
        if close < 0 and page[before] == "=":
            lost.add(mark)
        pos = close + 1 if close >= 0 else pos + 1


def _named(attributes: str) -> tuple[str, set[str]]:
    """(name, words) of an element: its class or id, and what marks it as another part of the page than the article."""
    name, words = "", set()
    if not _ASKED.search(attributes):
        return name, words
    for kind, *values in _ATTRIBUTE.findall(attributes):
        kind, value = kind.lower(), "".join(values)
        if kind == "role":
            words.add("role=" + value.strip().lower())
        elif kind == "hidden":
            words.add("hidden")
        elif kind == "style":
            if _UNSEEN.search(html.unescape(value)):
                words.add("hidden")
        elif kind in ("class", "id"):
            name = name or re.sub(r"\d+", "0", value.strip().lower())
            for token in value.split():
                # a class counts as a whole: has-sidebar says nothing of its element, cookie-banner does
                parts = {w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token).lower()) if w}
                if parts == {"hidden"} or (parts & NAMES and parts <= NAMES | (OF_PAGES if parts & HEADERS else FORMS)):
                    words |= parts & (NAMES | {"hidden"})
    return name, words


class _Builder:
    """The tree of a page while it is read: opening and closing elements as browsers bear the common faults."""

    def __init__(self):
        self.root = self.at = Node("#root")
        self.opened: Counter[str] = Counter()
        self.pieces: list[str] = []

    def flush(self) -> None:
        if self.pieces:
            self.at.children.append(Node("#text", parent=self.at, text="".join(self.pieces)))
            self.pieces = []

    def pop(self) -> None:
        x = self.at
        self.opened[x.tag] -= 1
        if x.frame is not x:
            x.frame.inline[x.tag] -= 1
        self.at = x.parent

    def pop_with(self, node: Node) -> None:
        while self.at is not node.parent:
            self.pop()

    def end(self, tag: str) -> None:
        # an inline end tag doesn't close a block
        if not (self.opened[tag] if tag in BLOCK else self.at.frame.inline.get(tag)):
            return
        self.flush()
        while self.at.tag != tag:
            self.pop()
        self.pop()

    def start(self, tag: str, attributes: str, content: bool) -> None:
        self.flush()
        if tag in BLOCK and self.at.paragraph is not None:
            self.pop_with(self.at.paragraph)
        if tag in CLOSES:
            x = self.at.item
            while x is not None and x.tag not in CLOSES[tag]:
                x = x.parent.item
            if x is not None:
                self.pop_with(x)
                while tag in ("tr", "tbody") and self.at.tag in CLOSES[tag]:
                    self.pop()
        name, words = _named(attributes)
        node = Node(tag, name, self.at, words=words)
        self.at.children.append(node)
        if content:
            self.at = node
            self.opened[tag] += 1
            if node.frame is not node:
                node.frame.inline[tag] = node.frame.inline.get(tag, 0) + 1


def parse(page: str) -> Node:
    """A small tree of a page. Unclosed and stray tags are borne; what follows an unfinished tag or comment is lost, as in browsers."""
    tree, pos, n, lost = _Builder(), 0, len(page), set()
    last = page.rfind(">")
    while pos < n:
        at = page.find("<", pos)
        if at < 0:
            tree.pieces.append(page[pos:])
            break
        if at > pos:
            tree.pieces.append(page[pos:at])
        mark = page[at + 1 : at + 2]
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            pos = end + 3 if end >= 0 else n
            continue
        m = _NAME.match(page, at + 1 + (mark == "/"))
        if m is None:
            if mark in ("!", "?", "/") and mark and at < last:
                pos = page.find(">", at) + 1
            else:
                tree.pieces.append("<")
                pos = at + 1
            continue
        end = _tag_end(page, m.end(), lost) if at < last else -1
        if end < 0:
            break
        tag, pos = m[0].lower(), end + 1
        if mark == "/":
            if tag not in VOID:
                tree.end(tag)
            continue
        tree.start(tag, page[m.end() : end], tag not in RAW and tag not in VOID)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*+>", re.IGNORECASE).search(page, pos)
            pos = close.end() if close else n
    tree.flush()
    _keep(tree.root)
    return tree.root


def _keep(root: Node) -> None:
    """Marks what no name may drop: the page's article or main and what holds it, what holds nearly all text, and buttons that
    are words of a sentence; and regions whose text is mostly links. One pass each way."""
    nodes = list(walk(root))
    if not any(x.words & NAMES or x.tag == "button" for x in nodes):
        return
    size, links, under = {}, {}, {}
    for x in nodes:
        under[id(x)] = bool(x.words & NAMES) or (x.parent is not None and under[id(x.parent)])
    articles = [x for x in nodes if x.tag in ("article", "main")]
    hidden = articles and all(under[id(x)] for x in articles)
    if articles and not hidden and not any(x.words & SHARED_NAMES or x.tag == "button" for x in nodes):
        return  # no size matters
    for x in reversed(nodes):
        if x.tag == "#text":
            size[id(x)], links[id(x)] = len(x.text.strip()), 0
            continue
        own = held = plain = linked = 0
        for c in x.children:
            n = size[id(c)]
            linked += links[id(c)]
            if c.tag == "button":
                held += n
            else:
                own += n
                plain += n if c.tag == "#text" else 0
        if held and plain > held and x.tag in SENTENCES:
            own += held
            for c in x.children:
                c.kept |= c.tag == "button"
        n = size[id(x)] = own if x.tag not in DROPPED or x.tag == "button" else 0
        links[id(x)] = n if x.tag in ("a", "button") else linked
        x.linked = 2 * links[id(x)] > n
    if hidden:
        x = max(articles, key=lambda x: size[id(x)])
        while x is not None:
            x.kept, x = True, x.parent
    for x in nodes:
        x.kept |= x.tag not in DROPPED and not articles and size[id(x)] >= SHARE * max(1, size[id(root)])


def dropped(node: Node, in_article: bool) -> bool:
    if (node.tag in DROPPED and not (node.tag == "button" and node.kept)) or (node.tag == "header" and not in_article):
        return True
    if node.tag in ("body", "html") or not node.words:
        return False
    named = node.words & NAMES
    if in_article:
        named -= HEADERS if node.linked else HEADERS | SHARED_NAMES
    return bool(named) and not node.kept or "hidden" in node.words or any(w[5:] in ROLES for w in node.words if w.startswith("role="))


def blocks(node: Node, in_article: bool = False) -> list[str]:
    """Texts of the blocks under a node, without what is dropped."""
    out: list[str] = []
    piece: list[str] = []

    def flush():
        text = " ".join(html.unescape("".join(piece)).split())
        if text:
            out.append(text)
        piece.clear()

    stack: list[tuple[Node | None, bool]] = [(node, in_article)]
    while stack:
        x, inside = stack.pop()
        if x is None:
            flush()
        elif x.tag == "#text":
            piece.append(x.text)
        elif x.tag == "br":
            piece.append(" ")
        elif x is node or not dropped(x, inside):
            inside |= x.tag in ("article", "main")
            if x.tag in BLOCK:
                flush()
                stack.append((None, inside))
            stack.extend((c, inside) for c in reversed(x.children))
    flush()
    return out


def walk(node: Node):
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack.extend(reversed(x.children))


def _clean(text: str) -> str:
    return " ".join(html.unescape(text).split())


class Unit:
    """A block with what it holds in order, or a run of text: the tree that is aligned."""

    __slots__ = ("label", "text", "nodes", "children", "kinds", "marks")

    def __init__(self, label: str):
        self.label, self.text, self.nodes, self.children, self.kinds, self.marks = label, "", [], [], None, None

    def plain(self) -> bool:
        """A run of text, or a block that holds nothing else: what needs no look at its children."""
        return not self.children or (len(self.children) == 1 and not self.children[0].children and self.children[0].label == "#text")

    def leaf(self) -> Unit:
        return self.children[0] if self.children else self


def outline(tree: Node) -> Unit:
    """Blocks of a page; inline elements are transparent, and runs of text without a word are left out."""
    top = Unit(tree.label)
    opened, run = [top], []

    def flush():
        text = _clean("".join(x.text for x in run))
        if text:
            leaf = Unit("#text")
            leaf.text, leaf.nodes = text, list(run)
            opened[-1].children.append(leaf)
        run.clear()

    stack: list[Node | None] = list(reversed(tree.children))
    while stack:
        x = stack.pop()
        if x is None:
            flush()
            opened.pop()
        elif x.tag == "#text":
            run.append(x)
        else:
            if x.tag in BLOCK:
                flush()
                unit = Unit(x.label)
                opened[-1].children.append(unit)
                opened.append(unit)
                stack.append(None)
            stack.extend(reversed(x.children))
    flush()
    return top


def _coded(unit: Unit, codes: dict[str, int]) -> None:
    """Labels and texts of the children as numbers: negative labels are those of blocks that must be matched inside."""
    code = lambda x: codes.setdefault(x, len(codes) + 1)
    unit.kinds = np.array([code(c.label) if c.plain() else -code(c.label) for c in unit.children], np.int64)
    unit.marks = np.array([code("text " + c.leaf().text) if c.plain() else 0 for c in unit.children], np.int64)


def simple_tree_matching(a: Unit, b: Unit) -> list[tuple[Unit, Unit]] | None:
    """Matched runs of text of a largest order-preserving matching, in which matched units have equal labels and matched parents.

    Equal texts weigh half as much again as different ones. A block of nothing but text matches only such a block. None if
    the trees are so large and alike in labels that more than CONTAINER_PAIRS or CHILD_PAIRS would have to be compared.
    """
    if a.label != b.label:
        return []
    codes: dict[str, int] = {}
    for x in (a, b):
        stack = [x]
        while stack:
            y = stack.pop()
            _coded(y, codes)
            stack.extend(c for c in y.children if not c.plain())
    # pairs in an order in which parents come before children; sizes are then found from the end
    order, found, cells = [(a, b)], {}, 0
    for x, y in order:
        cells += len(x.children) * len(y.children)
        if len(order) > CONTAINER_PAIRS or cells > CHILD_PAIRS:
            return None
        i, j = np.nonzero((x.kinds[:, None] == y.kinds[None, :]) & (x.kinds[:, None] < 0))
        order.extend((x.children[k], y.children[m]) for k, m in zip(i.tolist(), j.tolist(), strict=True))
    for x, y in reversed(order):
        same = x.kinds[:, None] == y.kinds[None, :]
        value = np.where(same, 1 + 0.5 * (x.marks[:, None] == y.marks[None, :]), -1.0)
        for i, j in zip(*(k.tolist() for k in np.nonzero(same & (x.kinds[:, None] < 0))), strict=True):
            value[i, j] = found[id(x.children[i]), id(y.children[j])][0]
        best = np.zeros((len(x.children) + 1, len(y.children) + 1))
        for i, row in enumerate(value):
            best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + np.where(row > 0, row, -1.0)))
        pairs, i, j = [], len(x.children), len(y.children)
        while i and j:
            if best[i, j] == best[i - 1, j]:
                i -= 1
            elif best[i, j] == best[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((i, j))
        found[id(x), id(y)] = 1 + float(best[-1, -1]), pairs
    out, stack = [], [(a, b)]
    while stack:
        x, y = stack.pop()
        for i, j in found[id(x), id(y)][1]:
            u, v = x.children[i], y.children[j]
            if u.plain():
                if u.leaf().text and v.leaf().text:
                    out.append((u.leaf(), v.leaf()))
            else:
                stack.append((u, v))
    return out


def _leaves(unit: Unit) -> list[tuple[tuple, Unit]]:
    """(hash of the label path, run of text) in order."""
    out, stack = [], [(unit, ())]
    while stack:
        x, path = stack.pop()
        if x.label == "#text":
            out.append((path, x))
        else:
            path = hash((path, x.label))
            stack.extend((c, path) for c in reversed(x.children))
    return out


def layout(tree: Node) -> str:
    """A digest of a page's skeleton: the label paths of its regions, three levels under the body."""
    paths, stack = set(), [(tree, "", 0)]
    while stack:
        x, path, depth = stack.pop()
        for c in x.children:
            if c.tag in ("html", "body"):
                stack.append((c, path, depth))
            elif c.tag in REGIONS and depth < 3:
                paths.add(f"{path}/{c.label}")
                stack.append((c, f"{path}/{c.label}", depth + 1))
    return hashlib.md5("\n".join(sorted(paths)).encode()).hexdigest()


def constant_texts(trees: list[Node]) -> tuple[set[int], list[Unit]]:
    """Text nodes of the first tree (by identity) whose run is alike in all others, and all its runs."""
    outlines = [outline(t) for t in trees]
    runs = [u for _, u in _leaves(outlines[0])]
    alike = Counter()
    for other in outlines[1:]:
        pairs = simple_tree_matching(outlines[0], other)
        if pairs is None:
            known = {(path, u.text) for path, u in _leaves(other)}
            alike.update(id(u) for path, u in _leaves(outlines[0]) if (path, u.text) in known)
        else:
            alike.update(id(u) for u, v in pairs if u.text == v.text)
    return {id(x) for u in runs if alike[id(u)] == len(trees) - 1 for x in u.nodes}, runs


def induce(pages: list[str]) -> dict | None:
    """The wrapper of some pages of one host: path of the content root and template texts in it; None for under two."""
    trees = [parse(p) for p in dict.fromkeys(pages)]
    if len(trees) < 2:
        return None
    constant, runs = constant_texts(trees)
    nodes = list(walk(trees[0]))
    slot: dict[int, int] = {}
    heads: dict[int, int] = {}
    for x in reversed(nodes):
        if x.tag == "#text":
            slot[id(x)], heads[id(x)] = 0 if id(x) in constant else len(_clean(x.text)), 0
            continue
        inner = [c for c in x.children if c.tag == "#text" or not dropped(c, True)]
        slot[id(x)] = sum(slot[id(c)] for c in inner)
        heads[id(x)] = slot[id(x)] if x.tag in ("h1", "h2") else sum(heads[id(c)] for c in inner)
    root = trees[0]
    while slot[id(root)]:
        inner = [c for c in root.children if c.tag in CONTAINERS | {"html"} and not dropped(c, True)]
        best = max(inner, key=lambda c: slot[id(c)], default=None)
        # a heading is never left behind
        if best is None or slot[id(best)] < SHARE * slot[id(root)] or heads[id(best)] < heads[id(root)]:
            break
        root = best
    if root.tag in ("#root", "html", "body"):
        return None
    path, x = [], root
    while x is not None and x.tag not in ("#root", "html", "body"):
        path.append(x.label)
        x = x.parent
    inside = {id(x) for x in walk(root)}
    held = [u for u in runs if id(u.nodes[0]) in inside]
    alike = [all(id(x) in constant for x in u.nodes) for u in held]
    fixed = [u.text for u, same, leads in zip(held, alike, _leading(held, alike), strict=True) if same and not leads]
    # near copies of one article agree in most of their text: then what agrees is no template
    template = fixed if len(trees) >= 4 and sum(map(len, fixed)) <= 0.2 * max(1, sum(len(u.text) for u in held)) else []
    return {"path": path[::-1], "template": sorted(set(template))}


def _leading(runs: list[Unit], alike: list[bool]) -> list[bool]:
    """Whether a run is a heading with text under it that varies, before the next heading of its level or above. Pages of one kind
    share such headings (their parts are called alike), which are no template."""
    varies, out = [False] * 7, []
    for u, same in zip(reversed(runs), reversed(alike), strict=True):
        level = HEADINGS.get(u.nodes[0].parent.frame.tag)
        out.append(level is not None and varies[level])
        if not same:
            varies = [True] * (level or 7) + varies[level or 7 :]
        if level is not None:
            varies[level:] = [False] * (7 - level)
    return out[::-1]


def _at_path(tree: Node, path: list[str]) -> list[Node]:
    tops = [x for x in walk(tree) if x.tag in ("html", "body", "#root")]
    level = [c for t in tops for c in t.children]
    for k, label in enumerate(path):
        level = [x for x in level if x.tag != "#text" and x.label == label]
        if k < len(path) - 1:
            level = [c for x in level for c in x.children]
    return level


def _outermost(tree: Node, tag: str) -> list[Node]:
    out, stack = [], [(tree, False)]
    while stack:
        x, inside = stack.pop()
        if x.tag == tag and not dropped(x, True):
            out.append(x)
        elif x.tag != "#text" and not (x.tag not in ("#root", "html", "body") and dropped(x, inside)):
            stack.extend((c, inside) for c in reversed(x.children))
    return out


def _inside(node: Node, outer: set[int]) -> bool:
    while node is not None:
        if id(node) in outer:
            return True
        node = node.parent
    return False


def extract(page: str | Node, wrapper: dict | None) -> str:
    """Main text of a page: blocks joined by an empty line. The wrapper's root counts, unless the page has articles that don't hold it."""
    tree = parse(page) if isinstance(page, str) else page
    articles = _outermost(tree, "article")
    roots = _at_path(tree, wrapper["path"]) if wrapper else []
    outer = {id(x) for x in articles}
    if articles and not all(_inside(r, outer) for r in roots):
        roots = []
    template = set(wrapper["template"]) if wrapper and roots else set()
    roots = roots or articles or _outermost(tree, "main") or [tree]
    return "\n\n".join(b for r in roots for b in blocks(r, r.tag != "#root") if b not in template)


def _chosen(batches):
    """For each host, whole ("") and by layout, the PAGES different pages of a task with the smallest digests."""
    held: dict[tuple[str, str], list[tuple[int, str]]] = {}
    size = 0

    def told():
        for (host, shape), heap in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([host] * len(heap)), pa.array([shape] * len(heap)), pa.array([-d for d, _ in heap], pa.int64()), pa.array([p for _, p in heap], pa.string())], ["host", "layout", "digest", "html"])

    for batch in batches:
        for host, page, digest, shape in zip(*(batch.column(x).to_pylist() for x in ("host", "html", "digest", "layout")), strict=True):
            if not host:
                continue
            for key in ((host, ""), (host, shape)):
                heap = held.setdefault(key, [])
                item = -digest, page
                if item in heap:
                    continue
                if len(heap) < PAGES:
                    heapq.heappush(heap, item)
                    size += len(page)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
            if size > HELD:  # fewer are kept of what is passed on; the window behind takes the rest away
                yield from told()
                held, size = {}, 0
    yield from told()


def _laid_out(batches):
    for batch in batches:
        yield batch.append_column("layout", pa.array([layout(parse(p)) for p in batch.column("html").to_pylist()], pa.string()))


def _induced(batches):
    group, pages = None, []
    done: list[tuple[str, str, str]] = []

    def close():
        if group is not None and (w := induce(pages)):
            done.append((*group, json.dumps(w, ensure_ascii=False)))

    for batch in batches:
        for *key, page in zip(*(batch.column(x).to_pylist() for x in ("host", "layout", "html")), strict=True):
            if key != group:
                close()
                group, pages = key, []
            pages.append(page)
    close()
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.string()) for k in range(3)], ["host", "layout", "wrapper"])


def _extracted(known):
    """Texts of pages: wrappers come as a table by host and layout, or with the row."""

    def run(batches):
        loaded: dict[str, dict] = {}
        for batch in batches:
            texts = []
            joined = batch.column("wrapper").to_pylist() if known is None else [None] * batch.num_rows
            for page, host, w in zip(batch.column("html").to_pylist(), batch.column("host").to_pylist(), joined, strict=True):
                tree = parse(page)
                if known is not None:
                    w = known.value.get((host, layout(tree))) or known.value.get((host, ""))
                if w is not None and w not in loaded:
                    loaded = {} if len(loaded) > 1000 else loaded
                    loaded[w] = json.loads(w)
                texts.append(extract(tree, loaded.get(w)))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def _rows(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"), F.coalesce(host_of(F.col(url_col)), F.lit("")).alias("host"))


def _with_layout(rows: DataFrame) -> DataFrame:
    return rows.mapInArrow(_laid_out, ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", layout string")


def wrappers(pages: DataFrame, html_col="html", url_col="url", id_col="page_id") -> DataFrame:
    """(host, layout, wrapper as JSON) of layouts with at least two different pages to align; layout "" is the whole host.

    Copies count once. Each map task keeps PAGES pages a layout before the shuffle, so a hot host
    costs no more than others.
    """
    rows = _with_layout(_rows(pages, id_col, url_col, html_col).where("host <> ''").select("html", "host", F.xxhash64("html").alias("digest")))
    rows = rows.mapInArrow(_chosen, "host string, layout string, digest long, html string")
    first = Window.partitionBy("host", "layout").orderBy("digest")
    chosen = rows.withColumn("k", F.dense_rank().over(first)).where(F.col("k") <= PAGES).select("host", "layout", "html")
    return chosen.sortWithinPartitions("host", "layout", "html").mapInArrow(_induced, "host string, layout string, wrapper string")


def main_text(pages: DataFrame, id_col="page_id", url_col="url", html_col="html", broadcast: int = BROADCAST_BYTES) -> DataFrame:
    """One row per page: page_id, url, text (empty if none), n_chars.

    A null html has no text. Pages without a host, of hosts with a single page, or that the wrapper
    doesn't fit are cut by their own article, main or body element. Rows that repeat an id, or have
    none, are each returned; no rows give no rows; other columns are ignored. Wrappers are broadcast
    only if all together are small; else pages meet them by host and layout, salted.
    """
    found = cut(wrappers(pages, html_col, url_col, id_col))
    size = found.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host") + F.octet_length("layout"))).first()[0] or 0
    rows, schema = _rows(pages, id_col, url_col, html_col), "page_id long, url string, text string, n_chars long"
    if size <= broadcast:
        known = {(r.host, r.layout): r.wrapper for r in found.toLocalIterator()}
        return rows.mapInArrow(_extracted(pages.sparkSession.sparkContext.broadcast(known)), schema)
    own, whole = found.where("layout <> ''"), found.where("layout = ''").select("host", F.col("wrapper").alias("whole"))
    salts = F.explode(F.array(*map(F.lit, range(SALT)))).alias("salt")
    rows = _with_layout(rows).withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALT)).cast("int"))
    rows = rows.join(own.select("*", salts), ["host", "layout", "salt"], "left").join(whole.select("*", salts), ["host", "salt"], "left")
    return rows.select("page_id", "url", "html", "host", F.coalesce("wrapper", "whole").alias("wrapper")).mapInArrow(_extracted(None), schema)
