"""HTML extraction by wrapper induction (operator 7).

All distinct pages of a host are aligned, as DOM trees with their boilerplate, by simple tree matching: each with one
page of its layout that stands for it. Pages of a host with the same classes of containers are a layout; a layout of
fewer than LEAST_PAGES pages is read with the host's most common one. Sums over the pages tell which blocks have
the same text in nearly all of them and are template; blocks whose text varies are slots. The wrapper of a layout is
the path of its main node: the smallest node around the slots that are prose. Template blocks never count, whatever
they are called, and a page with no text of its own counts as a copy. What stands outside the main node goes, but for
paragraphs, headings and the like that few pages have there: these stay in the texts of those pages. Of the body's
parts one that holds nearly all of the slots' text is preferred where the rest is bare text, in no paragraph or
heading. Where slots lie so far apart that only the body holds them all, the wrapper also lists its constant parts,
and its parts that are nothing but links.

Names decide only what alignment leaves open. Slots in elements, roles, classes or ids that tell a menu, header,
footer, sidebar, notice, advert, form or reader comments do not make the main node unless all slots lie in such; an
article or main element that holds nearly all slots is preferred to what is around it. Within the main node only
parts that are told so are left out, and nothing is cut for being the same on many pages.

A page that lacks the main node, or whose layout has one distinct page, is read by the landmarks of its own tree.

Matching is iterative and bounded: subtrees of equal structure are matched once, equal ends of two rows of children
are paired off first, and CELLS bounds the rest of a pair of pages, beyond which equal labels are paired in order.
The sums of a page are a few numbers for each block of its layout's page, added up where the page is read; the
wrapper is a short string. Pages are read where they are; only pages with copies are shuffled, one copy of a task.

Defined cases: null or empty html gives an empty text; a null url counts as a host of its own; repeated rows are
extracted each; an empty table gives no rows; a null page_id is passed on. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import batches_of, cut_lineage

#: Distinct pages that make a layout of their own, and that confirm a constant part, at least.
LEAST_PAGES = 4
#: Share of the slots' text that an article or main element must hold to be the main node, if slots lie outside of it.
MAIN_SHARE = 0.9
#: Share of a layout's distinct pages that have the same text in a constant block, at least; fewer than the rest are few pages.
TEMPLATE_SHARE = 0.9
#: Share of a block's text from which it is links.
LINK_SHARE = 0.5
#: Cells of the tables of two pages' matching at most.
CELLS = 4_000_000
#: Sums that a task holds before it hands them on.
SUMS = 1 << 20
#: Bytes of all wrappers or pages of layouts up to which they are broadcast; beyond it they are joined by host.
BROADCAST_BYTES = 8 << 20

#: Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SKIPPED = frozenset(
    "head script style noscript template iframe svg math object embed canvas audio video nav footer aside form button select textarea input label menu dialog xmp noembed noframes title".split()
)
BLOCKS = frozenset(
    "html body p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th section article main header footer nav aside blockquote pre figure figcaption address hr form fieldset details summary center hgroup".split()
)
CLOSES_P = BLOCKS - {"html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "summary"}
#: An open element of these ends when one of the same group starts within the given parents.
SIBLINGS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words of class and id names and roles.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager "
    "footer masthead sidebar sidebars side aside rail widget widgets cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login "
    "comment comments discussion disqus replies respond reply share sharing social related recommended recommendations toolbar skip contentinfo complementary search searchbox form".split()
)
#: Names of a page's header, which only count outside a main node: within one they hold its title.
HEADERS = frozenset("header topbar masthead".split())
#: Blocks that are prose or lists of it, in which no main node is sought, and elements without any text to read.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption address hr caption summary".split())
UNSEEN = frozenset("head script style noscript template iframe svg math object embed canvas audio video select textarea input xmp noembed noframes title".split())
MAIN_NAMES = frozenset("content article post entry story main articlebody maincontent".split())

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMES = re.compile(r"[a-z]+|[0-9]+")


class Node:
    """An element of a page's tree; children are nodes and strings."""

    __slots__ = ("boiler", "children", "label", "main", "parent", "tag")

    def __init__(self, tag: str, parent: Node | None, attrs: str = ""):
        self.tag, self.parent, self.children = tag, parent, []
        names, role = "", ""
        if attrs:
            for m in _ATTR.finditer(attrs):
                key = m[1].lower()
                if key in ("class", "id"):
                    names += " " + (m[2] or m[3] or m[4] or "")
                elif key in ("role", "itemprop"):
                    role += " " + (m[2] or m[3] or m[4] or "").lower()
                elif key in ("hidden",):
                    role += " hidden"
        words = set(_NAMES.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", names).lower())) | set(role.split()) if names or role else set()
        self.label = tag + ("." + ".".join(sorted(x for x in set(names.lower().split()) if not any(c.isdigit() for c in x))) if names else "")
        self.main = tag in ("article", "main") or "main" in role.split() or "articlebody" in role
        self.boiler = (
            tag in SKIPPED
            or (tag not in ("html", "body", "main") and bool(words & BOILERPLATE) and not (self.main and not words & {"comment", "comments", "ad", "ads", "sponsored", "promo", "related", "reply"}))
            or "hidden" in role.split()
            or ((tag == "header" or tag in ("div", "section", "table", "ul", "p") and bool(words & HEADERS)) and not self.main and not _within_main(parent))
        )


def _within_main(node: Node | None) -> bool:
    while node is not None:
        if node.main or set(_NAMES.findall(node.label)) & MAIN_NAMES:
            return True
        node = node.parent
    return False


def parse(page: str) -> Node:
    """The tree of a page, as forgiving as browsers are about missing and stray tags."""
    root = here = Node("#root", None)
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            here.children.append(page[at:])
            break
        if lt > at:
            here.children.append(page[at:lt])
        m = _TAG.match(page, lt)
        if not m:
            here.children.append("<")
            at = lt + 1
            continue
        at = m.end()
        closing, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if at == n and page[n - 1] != ">":  # a tag that the page breaks off in
            break
        if closing:
            up = here
            while up is not root and up.tag != tag:
                if up.tag in ("table", "article", "main", "section") and tag not in BLOCKS:
                    up = root  # a stray inline end closes nothing beyond
                    break
                up = up.parent
            if up is not root:
                here = up.parent
            continue
        if tag in ("html", "body") and (old := _open(here, tag)) is not None:
            del old
            continue
        if tag in CLOSES_P and (p := _open(here, "p", stop=frozenset({"table", "button", "td", "th", "object", "article", "section", "div"}))) is not None:
            here = p.parent
        if tag in SIBLINGS:
            ends, within = SIBLINGS[tag]
            up, last = here, None
            while up is not root and up.tag not in within:
                if up.tag in ends:
                    last = up
                up = up.parent
            if last is not None:
                here = last.parent
        if tag == "body" and (head := _open(here, "head")) is not None:
            here = head.parent
        node = Node(tag, here, attrs)
        here.children.append(node)
        if tag in VOID or attrs.rstrip().endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            node.children.append(page[at : end.start() if end else n])
            at = page.find(">", end.end()) + 1 if end else n
            if end and not at:
                at = n
            continue
        here = node
    return root


def _open(node: Node, tag: str, stop: frozenset[str] = frozenset()) -> Node | None:
    while node is not None and node.tag not in stop:
        if node.tag == tag:
            return node
        node = node.parent
    return None


def _squeeze(parts: list[str]) -> str:
    return " ".join(entities.unescape("".join(parts)).split())


def _blocks(top: Node, left_out: frozenset[int] = frozenset()) -> Iterator[tuple[Node, str]]:
    """(block node, text) of every block below top outside boilerplate and the parts left out, in page order; without recursion."""
    parts: list[str] = []
    owner = top
    stack: list[tuple[Node, int]] = [(top, 0)]

    def flush():
        nonlocal parts
        text, parts = _squeeze(parts), []
        return text

    while stack:
        node, k = stack.pop()
        if k == len(node.children):
            if node.tag in BLOCKS or node is top:
                if text := flush():
                    yield owner, text
                owner = next((s for s, _ in reversed(stack) if s.tag in BLOCKS), top)
            continue
        stack.append((node, k + 1))
        child = node.children[k]
        if isinstance(child, str):
            parts.append(child)
        elif child.tag == "br":
            parts.append("\n")
        elif child.boiler or id(child) in left_out:
            if child.tag in BLOCKS or child.tag not in ("script", "style", "noscript", "template"):
                if text := flush():
                    yield owner, text
        elif child.tag in VOID:
            if child.tag == "hr" and (text := flush()):
                yield owner, text
        else:
            if child.tag in BLOCKS:
                if text := flush():
                    yield owner, text
                owner = child
            stack.append((child, 0))
    if text := flush():
        yield owner, text


def _path(node: Node) -> tuple[str, ...]:
    out = []
    while node.parent is not None:
        out.append(node.label)
        node = node.parent
    return tuple(reversed(out))


def _elements(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack.extend(c for c in reversed(x.children) if isinstance(c, Node))


def own_landmarks(root: Node) -> list[Node]:
    """The main nodes of a page by its own tree: articles, else main, else the named node with most text, else the body."""
    nodes = [x for x in _elements(root) if not _in_boilerplate(x)]
    for pick in (lambda x: x.tag == "article", lambda x: x.main, lambda x: bool(set(_NAMES.findall(x.label)) & MAIN_NAMES)):
        found = [x for x in nodes if pick(x)]
        kept = set(map(id, found))
        found = [x for x in found if not _ancestor_in(x, kept)]
        if any(next(_blocks(x), None) for x in found):
            return found
    return [root]


def _in_boilerplate(node: Node | None) -> bool:
    while node is not None:
        if node.boiler:
            return True
        node = node.parent
    return False


def _ancestor_in(node: Node, ids: set[int]) -> bool:
    node = node.parent
    while node is not None:
        if id(node) in ids:
            return True
        node = node.parent
    return False


class Block:
    """A block of a page with the blocks below it: what simple tree matching compares. Inline elements belong to their block."""

    __slots__ = ("below", "kind", "linked", "node", "parent", "text")

    def __init__(self, node: Node, parent: Block | None):
        self.node, self.parent, self.below, self.text, self.linked, self.kind = node, parent, [], "", 0, -1

    @property
    def links(self) -> bool:
        return self.linked > LINK_SHARE * len(self.text)


def blocks_of(root: Node) -> Block:
    """The tree of all blocks of a page, boilerplate included."""
    top = Block(root, None)
    parts: dict[int, list[str]] = {id(top): []}
    links: dict[int, list[str]] = {id(top): []}
    stack: list[tuple[Node, int, Block, bool]] = [(root, 0, top, False)]
    made = [top]
    while stack:
        node, k, block, linked = stack.pop()
        if k == len(node.children):
            continue
        stack.append((node, k + 1, block, linked))
        child = node.children[k]
        if isinstance(child, str):
            parts[id(block)].append(child)
            if linked:
                links[id(block)].append(child)
        elif child.tag in BLOCKS:
            new = Block(child, block)
            block.below.append(new)
            made.append(new)
            parts[id(new)], links[id(new)] = [], []
            parts[id(block)].append("\n")
            stack.append((child, 0, new, linked))
        elif child.tag == "br":
            parts[id(block)].append("\n")
        elif child.tag not in UNSEEN and child.tag not in VOID:
            stack.append((child, 0, block, linked or child.tag == "a"))
    for b in made:
        b.text = _squeeze(parts[id(b)])
        b.linked = len(_squeeze(links[id(b)])) if links[id(b)] else 0
    return top


def _all(block: Block) -> Iterator[Block]:
    stack = [block]
    while stack:
        x = stack.pop()
        yield x
        stack.extend(reversed(x.below))


class Matcher:
    """Simple tree matching of two pages: the largest set of equally labelled pairs that keeps order and descent.

    Blocks whose subtrees have the same structure are of one kind; kinds are matched once each.
    """

    def __init__(self, a: Block, b: Block, cells: int = CELLS):
        self.a, self.b, self.cells = a, b, cells
        self.number: dict[tuple, int] = {}
        self.label: list[str] = []
        self.rows: list[tuple[int, ...]] = []
        self.size: list[int] = []
        for top in (a, b):
            for x in reversed(list(_all(top))):  # children before their parent
                row = tuple(c.kind for c in x.below)
                key = (x.node.label, row)
                if (k := self.number.get(key)) is None:
                    k = self.number[key] = len(self.label)
                    self.label.append(x.node.label)
                    self.rows.append(row)
                    self.size.append(1 + sum(self.size[c] for c in row))
                x.kind = k
        self.known: dict[tuple[int, int], int] = {}

    def _trim(self, x: tuple[int, ...], y: tuple[int, ...]) -> tuple[int, int]:
        """How many kinds are the same at the start and, of the rest, at the end; pairing these off loses nothing."""
        most, head, tail = min(len(x), len(y)), 0, 0
        while head < most and x[head] == y[head]:
            head += 1
        while tail < most - head and x[-1 - tail] == y[-1 - tail]:
            tail += 1
        return head, tail

    def _open(self, x: int, y: int) -> list[tuple[int, int]]:
        """Pairs of kinds below x and y whose match is needed and not known."""
        p, q = self.rows[x], self.rows[y]
        head, tail = self._trim(p, q)
        ys = set(q[head : len(q) - tail])
        return [(i, j) for i in set(p[head : len(p) - tail]) for j in ys if i != j and self.label[i] == self.label[j] and (i, j) not in self.known]

    def _weights(self, x: tuple[int, ...], y: tuple[int, ...]) -> np.ndarray:
        ux, uy = ({k: n for n, k in enumerate(dict.fromkeys(row))} for row in (x, y))
        table = np.array([[self.size[i] if i == j else self.known.get((i, j), 0) for j in uy] for i in ux], np.float64)
        return table[[ux[k] for k in x]][:, [uy[k] for k in y]]

    def _within(self, n: int, m: int) -> bool:
        if n * m > self.cells:
            return False
        self.cells -= n * m
        return True

    def match(self, x: int, y: int) -> int:
        """The size of the match of two kinds; 0 where labels differ."""
        if self.label[x] != self.label[y]:
            return 0
        if x == y:
            return self.size[x]
        stack = [(x, y, False)]
        while stack:
            i, j, opened = stack.pop()
            if (i, j) in self.known:
                continue
            p, q = self.rows[i], self.rows[j]
            head, tail = self._trim(p, q)
            same = 1 + sum(self.size[k] for k in p[:head]) + sum(self.size[k] for k in p[len(p) - tail :])
            p, q = p[head : len(p) - tail], q[head : len(q) - tail]
            if not p or not q:
                self.known[i, j] = same
                continue
            if not opened:
                if not self._within(len(p), len(q)):
                    left = defaultdict(int)
                    for k in q:
                        left[self.label[k]] += 1
                    for k in p:  # equal labels, in whatever order
                        if left[self.label[k]]:
                            left[self.label[k]] -= 1
                            same += 1
                    self.known[i, j] = same
                    continue
                stack.append((i, j, True))
                stack.extend((u, v, False) for u, v in self._open(i, j))
                continue
            self.known[i, j] = same + int(_table(self._weights(p, q))[-1, -1])
        return self.known[x, y]

    def _row(self, p: list[Block], q: list[Block]) -> Iterator[tuple[Block, Block]]:
        """The pairs of two rows of children."""
        head, tail = self._trim(tuple(c.kind for c in p), tuple(c.kind for c in q))
        yield from zip(p[:head], q[:head], strict=True)
        yield from zip(p[len(p) - tail :], q[len(q) - tail :], strict=True)
        p, q = p[head : len(p) - tail], q[head : len(q) - tail]
        if not p or not q:
            return
        if not self._within(len(p), len(q)):
            at: dict[str, list[int]] = defaultdict(list)
            for k in range(len(q) - 1, -1, -1):
                at[q[k].node.label].append(k)
            last = -1
            for x in p:  # each takes the next of its label
                places = at[x.node.label]
                while places and places[-1] <= last:
                    places.pop()
                if places:
                    last = places.pop()
                    yield x, q[last]
            return
        for i in {c.kind for c in p}:
            for j in {c.kind for c in q}:
                if i != j:
                    self.match(i, j)
        w = self._weights(tuple(c.kind for c in p), tuple(c.kind for c in q))
        left, right = (np.array([hash(c.text) for c in row]) for row in (p, q))
        filled = np.array([bool(c.text) for c in p])
        w += 1e-6 * ((w > 0) & filled[:, None] & (left[:, None] == right[None]))  # of equal matches, the one that finds equal texts
        best, i, j = _table(w), len(p), len(q)
        while i and j:
            if best[i, j] == best[i - 1, j]:
                i -= 1
            elif best[i, j] == best[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                yield p[i], q[j]

    def pairs(self) -> list[tuple[Block, Block]]:
        out, stack = [], [(self.a, self.b)]
        while stack:
            x, y = stack.pop()
            out.append((x, y))
            if x.kind == y.kind:
                stack.extend(zip(x.below, y.below, strict=True))
            elif x.below and y.below:
                stack.extend(self._row(x.below, y.below))
        return out


def _table(w: np.ndarray) -> np.ndarray:
    """The best total of each pair of leading parts of two rows, for the weights of their pairs."""
    best = np.zeros((w.shape[0] + 1, w.shape[1] + 1))
    for i in range(w.shape[0]):
        np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + w[i]), out=best[i + 1, 1:])
    return best


def _digest(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()[:16]


def whole_text(block: Block) -> str:
    return "\n".join(x.text for x in _all(block) if x.text)


def _told(block: Block | None) -> bool:
    """Whether a block stands in boilerplate by name."""
    while block is not None:
        if block.node.boiler:
            return True
        block = block.parent
    return False


class Layout:
    """The page that stands for a layout, with its blocks in page order, and what other pages' alignments with it add up."""

    def __init__(self, tree: Block):
        self.own = list(_all(tree))
        self.number = {id(x): k for k, x in enumerate(self.own)}
        self.up = [self.number[id(x.parent)] if x.parent is not None else -1 for x in self.own]

    def nothing(self) -> np.ndarray:
        """Sums over no page: for each block the pages with the same text, then SLOTS without those told boilerplate by name, then with them."""
        return np.zeros((len(self.own), 1 + 2 * len(SLOTS)), np.int64)

    def add(self, sums: np.ndarray, other: Block) -> bool:
        """Aligns another page and adds what it says about each block; a page without a text of its own is a copy, and says nothing."""
        to = {id(y): x for x, y in Matcher(self.own[0], other).pairs()}
        slots: list[tuple[int, bool, bool, int]] = []
        same: list[int] = []
        for y in _all(other):
            x, is_one = to.get(id(y)), True
            if x is not None and x.text == y.text:
                if x.text:
                    same.append(self.number[id(x)])
                continue
            if not y.text or y.links:
                continue
            up = y
            while x is None:  # a block that only this page has
                up, is_one = up.parent, False
                x = to.get(id(up))
            slots.append((self.number[id(x)], is_one, _told(y), len(y.text)))
        if slots:
            sums[same, 0] += 1
            self.count(sums, slots)
        return bool(slots)

    def count(self, sums: np.ndarray, slots: list[tuple[int, bool, bool, int]]) -> None:
        """Adds the slots of one page: the block that each is or lies in, whether it is, boilerplate by name, size."""
        for side in (False, True):
            first = 1 + side * len(SLOTS)
            held: dict[int, bool] = {}
            for k, is_one, told, n in slots:
                if side or not told:
                    sums[k, first] += n
                    x = self.own[k]
                    held[k] = held.get(k, False) or not (is_one and (x.parent is None or x.node.tag in PROSE))
            below: dict[int, set[int]] = defaultdict(set)
            touched: set[int] = set()
            for k in held:
                while k >= 0 and k not in touched:
                    touched.add(k)
                    below[self.up[k]].add(k)
                    k = self.up[k]
            sums[[k for k in held if held[k]], first + 1] += 1
            sums[list(touched), first + 2] += 1
            sums[[next(iter(c)) for k, c in below.items() if len(c) == 1 and k not in held], first + 3] += 1

    def wrapper(self, sums: np.ndarray, others: int, copies: int = 0) -> dict:
        """The path of the main node, what is left out of a main node that is the body, and what is template outside of another."""
        own, number = self.own, self.number
        pages = others + 1

        def some(part: int) -> bool:
            """Whether so many pages are more than a few."""
            return part > (1 - TEMPLATE_SHARE) * pages

        # where nearly all pages are copies, what one or two others change need not be the text
        if not others or pages < LEAST_PAGES and others <= (1 - TEMPLATE_SHARE) * (pages + copies):
            return {}
        constant = {id(x) for k, x in enumerate(own) if x.text and not some(others - sums[k, 0])}
        sums = sums.copy()
        self.count(sums, [(k, True, _told(x), len(x.text)) for k, x in enumerate(own) if x.text and not x.links and id(x) not in constant])
        side = 1 if some(sums[0, 3]) else 1 + len(SLOTS)  # names count only where they leave something
        mass, direct, touched, only = (sums[:, side + k].tolist() for k in range(len(SLOTS)))
        if not touched[0]:
            return {}
        pages = touched[0]  # few or not is told among the pages that have slots
        for k in range(len(own) - 1, 0, -1):
            mass[self.up[k]] += mass[k]
        slot = lambda x: some(touched[number[id(x)]])
        total = mass[0]
        named = main = next((x for k, x in enumerate(own) if x.node.main and mass[k] >= MAIN_SHARE * total), None)
        if main is None:
            main = own[0]  # down to the smallest block that holds all slots, but for a few pages, and is no prose itself
            while True:
                most = max(main.below, key=lambda c: mass[number[id(c)]], default=None)
                if some(direct[number[id(main)]]) or most is None or most.node.tag in PROSE:
                    break
                at = number[id(most)]
                # of the body's parts one may also hold nearly all slots, if the rest is bare text that stands in no element of prose
                bare = main.node.tag in ("#root", "html", "body") and mass[at] >= MAIN_SHARE * total and most.below and not any(s.node.tag in PROSE for c in main.below if c is not most and slot(c) for s in _all(c) if s.text)
                if some(touched[number[id(main)]] - only[at]) and not bare:
                    break
                main, total = most, mass[at]
        path = _path(main.node)
        left_out: set[tuple[tuple[str, ...], str]] = set()

        def constant_part(x: Block) -> bool:
            return all(id(b) in constant for b in _all(x) if b.text) and any(b.text for b in _all(x))

        beside: set[str] = set()
        if main.node.tag in ("#root", "html", "body"):
            stack = [main]
            while stack:
                x = stack.pop()
                for c in x.below:
                    if c.node.boiler or c.node.tag in PROSE - {"ul", "ol", "dl"}:
                        continue
                    if constant_part(c):
                        left_out.add((_path(c.node), _digest(whole_text(c))))
                    elif not slot(c) and any(b.text for b in _all(c)) and all(b.links for b in _all(c) if b.text):
                        left_out.add((_path(c.node), LINKS))
                    elif slot(c) and not some(direct[number[id(c)]]) and c.node.tag not in PROSE and not any(b.node.tag in PROSE and slot(b) for b in c.below):
                        stack.append(c)
        elif named is None:
            within = {id(x) for x in _all(main)}
            beside = {_at(x) for x in own if id(x) in constant and id(x) not in within and x.node.tag in PROSE}
        if others + 1 < LEAST_PAGES:
            left_out = {x for x in left_out if x[1] == LINKS}
        alike = [x for x in own if x.node.label == main.node.label and _path(x.node) == path]
        place = [next(k for k, x in enumerate(alike) if x is main), len(alike)]  # others of its path are not the main node
        out = {"main": list(path), "place": place, "parts": [[list(p), digest] for p, digest in sorted(left_out)]}
        return out | ({"beside": sorted(beside)} if named is None and others + 1 >= LEAST_PAGES else {})


#: What is added up of slots for each block: their size, pages with some directly in it, pages with some in or below it, pages where it holds all of its parent's.
SLOTS = ("mass", "direct", "touched", "only")


def induce(pages: list[str]) -> dict:
    """The wrapper of pages of one layout: the path of its main node, and what is template beside it."""
    trees = sorted((blocks_of(parse(p)) for p in sorted(set(pages))), key=lambda t: sum(1 for _ in _all(t)))
    if len(trees) < 2:
        return {}
    layout = Layout(trees.pop(len(trees) // 2))  # the page of middle size stands for all
    sums = layout.nothing()
    others = sum(layout.add(sums, other) for other in trees)
    return layout.wrapper(sums, others, len(trees) - others)


def _at(block: Block) -> str:
    """A digest of a block's text and path."""
    return _digest("\0".join((*_path(block.node), block.text)))


#: Stands in the place of a part's digest where the part is nothing but links.
LINKS = "links"


def _read(wrapper: dict) -> dict[tuple[str, ...], set[str]]:
    parts: dict[tuple[str, ...], set[str]] = defaultdict(set)
    for path, digest in wrapper.get("parts", ()):
        parts[tuple(path)].add(digest)
    return parts


def _top(root: Node, wrapper: dict) -> Node | None:
    """The main node of a page: of several of its path the one at its place, or where their number differs the one with most text."""
    path = tuple(wrapper["main"])
    found = [x for x in _elements(root) if x.label == path[-1] and _path(x) == path] if path else [root]
    if len(found) < 2:
        return found[0] if found else None
    place, count = wrapper["place"]
    return found[place] if len(found) == count else max(found, key=lambda x: sum(len(text) for _, text in _blocks(x)))


def _parts(root: Node, parts: dict[tuple[str, ...], set[str]]) -> Iterator[Node]:
    """Nodes of a page that are parts of the wrapper."""
    if not parts:
        return
    ends = {path[-1] for path in parts if path}
    for block in _all(blocks_of(root)):
        if block.node.label not in ends or not (kinds := parts.get(_path(block.node))):
            continue
        filled = [b for b in _all(block) if b.text]
        if _digest(whole_text(block)) in kinds or LINKS in kinds and filled and all(b.links for b in filled):
            yield block.node


def _outside(root: Node, top: Node, template: frozenset[str]) -> Iterator[tuple[bool, Node]]:
    """The main node, and before and after it blocks of prose that are the page's own: (whether it is the main node, node)."""
    stack = [(blocks_of(root), False)]
    while stack:
        block, told = stack.pop()
        if block.node is top:
            yield True, top
            continue
        told = told or block.node.boiler
        if block.text and not told and block.node.tag in PROSE and not block.links and _at(block) not in template:
            yield False, block.node
        stack.extend((c, told) for c in reversed(block.below))


def extract(page: str, wrapper: dict | None = None) -> str:
    """The main text of a page: its blocks joined by two line ends."""
    if not page:
        return ""
    root = parse(page)
    top = _top(root, wrapper) if wrapper else None
    if top is None:
        return "\n\n".join(text for x in own_landmarks(root) for _, text in _blocks(x))
    left_out = frozenset(map(id, _parts(root, _read(wrapper))))
    if top is root or "beside" not in wrapper or top.tag in ("html", "body"):
        return "\n\n".join(text for _, text in _blocks(top, left_out))
    found = _outside(root, top, frozenset(wrapper["beside"]))
    return "\n\n".join(text for whole, x in found for owner, text in _blocks(x) if whole or owner is x)


def _beside(rows: DataFrame, side: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined to a checkpointed side, which is broadcast if it is small."""
    size = side.agg(F.sum(sum(F.length(c) if kind == "string" else F.lit(8) for c, kind in side.dtypes))).first()[0] or 0
    return rows.join(F.broadcast(side) if size <= BROADCAST_BYTES else side, keys, how)


def layout_of(page: Column) -> Column:
    """A hash of the containers of a page and their classes, up to the first digit of these."""
    tags = F.regexp_extract_all(page, F.lit("(?i)<((?:div|main|article|header|footer|nav|aside|form)(?=[\\s/>])[^<>]*)"), F.lit(1))
    name = lambda t: F.lower(F.concat_ws(" ", F.regexp_extract(t, "^[A-Za-z]+", 0), F.regexp_extract(t, "(?i)\\sclass\\s*=\\s*[\"']?([^\"'0-9]*)", 1)))
    return F.xxhash64(F.array_sort(F.array_distinct(F.transform(tags, name))))


def layouts(hashed: DataFrame, distinct: DataFrame) -> DataFrame:
    """(host, layout, common, first, html): each layout's page of smallest hash, from pages (host, layout, h, html) and their distinct (host, layout, h)."""
    sizes = distinct.groupBy("host", "layout").agg(F.count("*").alias("n"), F.min("h").alias("h"))
    common = sizes.groupBy("host").agg(F.max(F.struct("n", "layout")).alias("most")).select("host", F.col("most.layout").alias("common"))
    known = sizes.join(common, "host").filter((F.col("n") >= LEAST_PAGES) | (F.col("layout") == F.col("common")))
    known = cut_lineage(known.select("host", "layout", "h", (F.col("layout") == F.col("common")).alias("common")))
    return cut_lineage(_beside(hashed, known, ["host", "layout", "h"]).dropDuplicates(["host", "layout"]).select("host", "layout", "common", "html"))


def _with_layout(pages: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Pages with their layout, or their host's most common one where theirs is rare, and the given column of it."""
    common = known.filter("common").select("host", F.col("layout").alias("__common"))
    kinds = known.select("host", "layout", F.lit(1).alias("__own"))
    pages = _beside(_beside(pages, common, ["host"], "left"), kinds, ["host", "layout"], "left")
    pages = pages.withColumn("layout", F.when(F.col("__own").isNull(), F.col("__common")).otherwise(F.col("layout"))).drop("__own", "__common")
    return _beside(pages, known.select("host", "layout", column), ["host", "layout"], "left")


def sums_of(pages: DataFrame) -> DataFrame:
    """(host, layout, sums): what all pages (host, layout, html, first) say together about the blocks of first, as rows of block number and sums.

    Block -1 has the number of pages aligned, without copies of the first and of these.
    """
    width = 1 + 2 * len(SLOTS)
    names = [f"s{k}" for k in range(width)]

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        layout_at = lru_cache(256)(lambda first: Layout(blocks_of(parse(first))))
        seen: dict[tuple, tuple[np.ndarray, list[int]]] = {}
        size = 0

        def rows() -> pd.DataFrame:
            out = [(*key, -1, *count, *[0] * (width - 2)) for key, (_, count) in seen.items()]
            for key, (sums, _) in seen.items():
                out.extend((*key, k, *sums[k].tolist()) for k in np.flatnonzero(sums.any(axis=1)).tolist())
            return pd.DataFrame(out, columns=["host", "layout", "k", *names])

        for b in batches:
            for host, layout, page, first in zip(b["host"], b["layout"], b["html"], b["first"], strict=True):
                if page == first:
                    continue
                known = layout_at(first)
                if (host, layout) not in seen:
                    seen[host, layout] = known.nothing(), [0, 0]
                    size += len(known.own) * width
                sums, count = seen[host, layout]
                count[0 if known.add(sums, blocks_of(parse(page))) else 1] += 1
                if size > SUMS:
                    yield rows()
                    seen.clear()
                    size = 0
        if seen:
            yield rows()

    parts = pages.select("host", "layout", "html", "first").mapInPandas(align, "host string, layout long, k int, " + ", ".join(f"{x} long" for x in names))
    total = parts.groupBy("host", "layout", "k").agg(*(F.sum(x).alias(x) for x in names))
    return total.groupBy("host", "layout").agg(F.collect_list(F.array(F.col("k").cast("long"), *names)).alias("sums"))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, layout, common, wrapper) from pages (host, layout, html): all distinct pages are aligned with their layout's."""
    hashed = pages.filter("length(html) > 0").withColumn("h", F.xxhash64("html"))
    distinct = cut_lineage(hashed.groupBy("host", "layout", "h").agg(F.count("*").alias("copies")))
    known = layouts(hashed, distinct)
    # copies of a page count once; pages without any are aligned where they are
    copied = distinct.filter("copies > 1").select("host", "layout", "h")
    single = hashed
    if not copied.isEmpty():
        single = _beside(hashed, copied, ["host", "layout", "h"], "left_anti").unionByName(_beside(hashed, copied, ["host", "layout", "h"]).dropDuplicates(["host", "layout", "h"]))
    sums = sums_of(_with_layout(single, known.withColumnRenamed("html", "first"), "first"))

    @F.pandas_udf("string")
    def conclude(first: pd.Series, sums: pd.Series) -> pd.Series:
        out = []
        for page, rows in zip(first, sums, strict=True):
            layout, others, copies = Layout(blocks_of(parse(page))), 0, 0
            total = layout.nothing()
            for k, *values in rows if rows is not None else ():
                if k < 0:
                    others, copies = int(values[0]), int(values[1])
                else:
                    total[int(k)] = values
            out.append(json.dumps(layout.wrapper(total, others, copies)))
        return pd.Series(out)

    return known.join(sums, ["host", "layout"], "left").select("host", "layout", "common", conclude("html", "sums").alias("wrapper"))


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text for every row of df."""
    url = df[url_col].cast("string")
    host = F.lower(F.coalesce(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    html = F.coalesce(df[html_col].cast("string"), F.lit(""))
    pages = df.select(df[id_col].cast("long").alias("page_id"), url.alias("url"), html.alias("html"), host.alias("host"), layout_of(html).alias("layout"))
    known = cut_lineage(wrappers(pages.select("host", "layout", "html")))
    read = _with_layout(pages, known, "wrapper").select("page_id", "url", "html", "wrapper")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrapper_of = lru_cache(4096)(lambda w: json.loads(w) if w else {})

        def rows():
            for batch in batches:
                for page_id, link, page, wrapper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield page_id, link, extract(page, wrapper_of(wrapper))

        yield from batches_of(rows(), schema)

    return read.mapInArrow(run, "page_id long, url string, text string")
