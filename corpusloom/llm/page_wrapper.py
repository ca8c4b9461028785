"""Main text of web pages by wrapper induction over the pages of each host.

Every page becomes an outline: its element tree with runs of equal siblings
folded into one node. The outlines of a host are aligned with that of one of its
pages by simple tree matching, and for each node of it all pages vote: how often
it is there, how often with the same text, how much text and link text it holds.
Nodes of constant text are template, varying ones are slots. The content slots
are the articles if these hold most of the varying text outside links and outside
chrome, else the deepest container that holds all of it. Forms and elements with
a name of chrome aren't chrome if hardly any varying text stands elsewhere. Each
page is then aligned with the wrapper, and the blocks of its content slots,
without template nodes, are its main text.

Outlines and wrappers are small. The pages of the LARGE largest hosts are dealt to
groups of about GROUP_PAGES, each with a copy of the wrapper, so that a host of any
size is spread over tasks; any other host has at most a thousandth of all pages.
"""

from __future__ import annotations

import html as html_lib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

LARGE, GROUP_PAGES, MOSTLY, SAME, LEAST_PAGES = 1000, 256, 0.7, 0.9, 5
#: Share of the varying text that must stand outside forms and names of chrome, or else the largest of them is no chrome.
ELSEWHERE = 0.2
#: Cells of an alignment, and of a table of weights, that are kept; larger alignments are halved until they fit, weights made again. Distinct pairs of siblings' structures up to which each is matched by itself to weigh it, more are weighed row by row.
CELLS, WEIGHED = 1 << 22, 1 << 12
#: What an element is: content, chrome by its tag or as it is hidden, chrome unless the text stands there (forms, names), readers' comments.
PLAIN, HARD, NAMED, COMMENTS = range(4)
#: Elements by the part they play in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp svg".split())
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul xmp".split())
CONTAINERS = frozenset("html body div section main article table tbody tr td center".split())
CHROME = frozenset("nav footer aside head script style noscript template iframe svg button select menu dialog title textarea".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
CLOSE_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul xmp".split())
CHROME_WORDS = re.compile(r"(?:^|[-_\s])(?:ads?|advert\w*|banner|side-?bar|menu|nav\w*|breadcrumbs?|footer|cookies?|notices?|consent|popup|modal|promo\w*|sponsor\w*|share|social|related|newsletter|subscribe|toolbar|pagination|pager|login|navigation|contentinfo|complementary|search|alert)(?:[-_\s]|$)", re.I)
COMMENT_WORDS = re.compile(r"(?:^|[-_\s])(?:comments?|disqus)(?:[-_\s]|$)", re.I)
#: A quote opens a value only after an equals sign; a comment can end at once.
_TAG = re.compile(r"<(?:!--(?:-?>|.*?(?:--!?>|$))|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)((?>[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)>)", re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_BLANK = re.compile(r"\s+")


class Node:
    __slots__ = ("chrome", "label", "parts", "tag")

    def __init__(self, tag: str, attributes: str, in_article: bool):
        self.tag, self.parts = tag, []
        names = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in _NAMED.finditer(attributes)] if attributes else []
        self.label = " ".join([tag, *sorted(v for k, v in names if k == "class")])
        frame = tag in ("html", "body", "article", "main")
        if tag in CHROME or (tag == "header" and not in_article) or attributes and _HIDDEN.search(attributes):
            self.chrome = HARD
        elif not frame and any(COMMENT_WORDS.search(v) for _, v in names):
            self.chrome = COMMENTS
        else:
            self.chrome = NAMED if tag == "form" or not frame and any(CHROME_WORDS.search(v) for _, v in names) else PLAIN


def tree(page: str) -> Node:
    """The element tree of a page; text parts are strings with character references still in them."""
    root = Node("#root", "", False)
    stack, at, articles = [root], 0, 0
    while True:
        found = _TAG.search(page, at)
        if not found:
            stack[-1].parts.append(page[at:])
            return root
        if found.start() > at:
            stack[-1].parts.append(page[at : found.start()])
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    articles -= sum(n.tag == "article" for n in stack[depth:])
                    del stack[depth:]
                    break
                if stack[depth].tag in BLOCKS and tag not in BLOCKS:
                    break  # an end tag of running text doesn't leave its block
            continue
        if tag in CLOSE_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    del stack[depth:]
                    break
                if stack[depth].tag in BLOCKS:
                    break
        if tag in CLOSES:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in CLOSES[tag]:
                    del stack[depth:]
                    if tag not in ("tr", "tbody"):
                        break
                elif stack[depth].tag in ("ul", "ol", "dl", "table", "select", "div", "article"):
                    break
        node = Node(tag, found[3], articles > 0)
        stack[-1].parts.append(node)
        closed = found[3].endswith("/")
        if tag in RAW and not (closed and tag == "svg"):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            if tag == "xmp":  # shown as it stands
                node.parts.append(html_lib.escape(page[at : end.start() if end else len(page)]))
            at = end.end() if end else len(page)
        elif tag not in VOID and not closed:
            stack.append(node)
            articles += tag == "article"


def text_of(parts: list) -> str:
    return _BLANK.sub(" ", html_lib.unescape("".join(p for p in parts if isinstance(p, str)))).strip()


class Outline:
    """A page's elements with runs of equal siblings folded, in page order, parents before children.

    Of each node: label, hash of the own text, chars of it, chars of it in links, what
    it is, its parent's number, the number after its last descendant, a number of its
    labels' structure, its children, and the page's elements (if made from a page).
    """

    __slots__ = ("chars", "chrome", "end", "hashes", "kids", "labels", "links", "members", "parent", "shape")

    def __init__(self, labels: list, hashes: list, chars: list, links: list, chrome: list, parent: list, members: list | None = None):
        self.labels, self.hashes, self.chars, self.links, self.chrome, self.parent, self.members = labels, hashes, chars, links, chrome, parent, members
        n = len(labels)
        self.end, self.kids, self.shape = list(range(1, n + 1)), [[] for _ in range(n)], [0] * n
        for i in range(n - 1, -1, -1):
            self.kids[i].reverse()
            self.shape[i] = xxhash.xxh64_intdigest(labels[i] + "(" + ",".join(str(self.shape[k]) for k in self.kids[i]))
            if i:
                self.kids[parent[i]].append(i)
                self.end[parent[i]] = max(self.end[parent[i]], self.end[i])

    def told(self) -> str:
        return json.dumps([self.labels, self.hashes, self.chars, self.links, self.chrome, self.parent], separators=(",", ":"))

    @staticmethod
    def read(x: str) -> Outline:
        return Outline(*json.loads(x))


def outline(root: Node) -> Outline:
    """The outline of an element tree."""
    columns: list[list] = [[] for _ in range(7)]
    waiting = [([root], False, -1)]
    while waiting:
        nodes, linked, parent = waiting.pop()
        linked = linked or nodes[0].tag == "a"
        texts = [t for n in nodes if (t := text_of(n.parts))]
        chars = sum(map(len, texts))
        number = len(columns[0])
        for column, x in zip(columns, (nodes[0].label, xxhash.xxh32_intdigest("\n".join(texts)), chars, chars if linked else 0, nodes[0].chrome, parent, nodes), strict=True):
            column.append(x)
        runs: list[list[Node]] = []
        for n in nodes:
            for p in n.parts:
                if isinstance(p, Node) and p.tag not in VOID:
                    if runs and runs[-1][0].label == p.label:
                        runs[-1].append(p)
                    else:
                        runs.append([p])
        # what repeats in one member after another is one sequence, not many
        if len(nodes) > 1:
            merged: dict[str, list[Node]] = {}
            for r in runs:
                merged.setdefault(r[0].label, []).extend(r)
            runs = list(merged.values())
        waiting += [(r, linked, number) for r in reversed(runs)]
    return Outline(*columns)


def aligned(left: list[int], right: list[int], weight: np.ndarray | Callable[[int], np.ndarray] | None = None) -> list[tuple[int, int]]:
    """The heaviest order-keeping match of two sequences of kinds, as pairs of places; weight[kind, kind], or weight(kind)[kind], is 0 where two may not meet (1 for equal kinds if not given).

    Row after row of the table of best sums, each in one step for all columns. A
    table of more than CELLS cells is halved at its best middle until it fits.
    """
    a, b, out = np.array(left, np.int64), np.array(right, np.int64), []
    waiting = [(0, len(a), 0, len(b))]

    def worth(kind: int, columns: np.ndarray) -> np.ndarray:
        if weight is None:
            return (columns == kind).astype(np.int64)
        return (weight(kind) if callable(weight) else weight[kind])[columns]

    def row(before: np.ndarray, worths: np.ndarray) -> np.ndarray:
        now = before.copy()
        now[1:] = np.maximum(before[1:], before[:-1] + worths)
        return np.maximum.accumulate(now)

    while waiting:
        top, bottom, lo, hi = waiting.pop()
        if top == bottom or lo == hi:
            continue
        columns = b[lo:hi]
        if (bottom - top) * (hi - lo) > CELLS and bottom - top > 1:
            middle = (top + bottom) // 2
            first, last = np.zeros(hi - lo + 1, np.int64), np.zeros(hi - lo + 1, np.int64)
            for i in range(top, middle):
                first = row(first, worth(a[i], columns))
            for i in range(bottom - 1, middle - 1, -1):
                last = row(last, worth(a[i], columns)[::-1])
            at = lo + int(np.argmax(first + last[::-1]))
            waiting += [(top, middle, lo, at), (middle, bottom, at, hi)]
            continue
        best, worths = [np.zeros(hi - lo + 1, np.int64)], []
        for i in range(top, bottom):
            worths.append(worth(a[i], columns))
            best.append(row(best[-1], worths[-1]))
        i, j = bottom - top, hi - lo
        while i and j:
            w = int(worths[i - 1][j - 1])
            if w and best[i][j] == best[i - 1][j - 1] + w:
                i, j = i - 1, j - 1
                out.append((top + i, lo + j))
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return sorted(out)


class Weights:
    """Sizes of the largest matches of the subtrees at some nodes of x with those at some nodes of y, for a node of x at a time with all of y; below has them for the nodes' children, if both sides have any."""

    def __init__(self, x: Outline, y: Outline, left: list[int], right: list[int], below: Weights | None):
        self.x, self.left, self.below, self.rows, self.width = x, left, below, {}, len(right)
        self.left_at, self.right_at = {x.shape[a]: n for n, a in enumerate(left)}, {y.shape[b]: n for n, b in enumerate(right)}
        most = max(x.end[a] - a for a in left)
        named: dict[str, list[int]] = {}
        for n, b in enumerate(right):
            named.setdefault(y.labels[b], []).append(n)
        self.alike = {}
        for label, own in named.items():
            # the children of all nodes of a label one after another, each node's after an empty place
            kids = [[below.right_at[y.shape[k]] for k in y.kids[right[n]]] if below else [] for n in own]
            size = np.array([len(k) for k in kids], np.int64)
            last = np.cumsum(size + 1) - 1
            inner = np.ones(last[-1] + 1, bool)
            inner[last - size] = False
            places = np.flatnonzero(inner)
            # sums of a node lie above those of the node before
            floor = np.repeat(np.arange(len(own)) * (most + 1), size + 1)
            self.alike[label] = (np.array(own), places, np.array([x for k in kids for x in k], np.int64), last, floor)

    def row(self, n: int) -> np.ndarray:
        """The sizes for the n-th node of x."""
        if n not in self.rows:
            if len(self.rows) * self.width >= CELLS:
                self.rows.clear()
            self.rows[n] = self._made(n)
        return self.rows[n]

    def _made(self, n: int) -> np.ndarray:
        a, out = self.left[n], np.zeros(self.width, np.int32)
        if self.x.labels[a] in self.alike:
            own, places, kids, last, floor = self.alike[self.x.labels[a]]
            best = floor
            for k in self.x.kids[a] if len(kids) else ():
                now = best.copy()
                now[places] = np.maximum(best[places], best[places - 1] + self.below.row(self.below.left_at[self.x.shape[k]])[kids])
                best = np.maximum.accumulate(now)
            out[own] = 1 + (best - floor)[last]
        return out


def weights(x: Outline, y: Outline, left: list[int], right: list[int]) -> Weights:
    """Weights of nodes of distinct structures, from their deepest descendants up. A level of at most CELLS pairs is made at once, the rows of a larger one as they are asked for."""
    levels = [(left, right)]
    while all(levels[-1]):
        levels.append(tuple(list({o.shape[k]: k for n in side for k in o.kids[n]}.values()) for o, side in zip((x, y), levels[-1], strict=True)))
    made = None
    for some, others in reversed(levels[:-1]):
        made = Weights(x, y, some, others, made)
        if len(some) * len(others) <= CELLS:
            for n in range(len(some)):
                made.row(n)
            made.below = None
    return made


class Matching:
    """Simple tree matching of two outlines. What two structures give is remembered: their children meet at the same places wherever they stand."""

    def __init__(self, x: Outline, y: Outline):
        self.x, self.y, self.known, self.ways = x, y, {}, {}

    def size(self, i: int = 0, j: int = 0) -> int:
        """The size of the largest top-down, order-keeping match of the subtrees at i and j."""
        x, y, known = self.x, self.y, self.known
        waiting = [(i, j)]
        while waiting:
            a, b = waiting[-1]
            key = (x.shape[a], y.shape[b])
            if key in known:
                waiting.pop()
            elif x.labels[a] != y.labels[b]:
                known[key] = 0
            elif key[0] == key[1]:
                known[key] = x.end[a] - a
            else:
                missing = [] if key in self.ways else self._align(a, b, key)
                met = [(x.kids[a][p], y.kids[b][q]) for p, q in self.ways.get(key, ())]
                missing = missing or [(p, q) for p, q in met if (x.shape[p], y.shape[q]) not in known]
                if missing:
                    waiting += missing
                else:
                    known[key] = 1 + sum(known[x.shape[p], y.shape[q]] for p, q in met)
        return known[x.shape[i], y.shape[j]]

    def _align(self, i: int, j: int, key: tuple[int, int]) -> list[tuple[int, int]]:
        """Finds the places at which children of i and j meet; first returns the pairs of them whose sizes this needs."""
        x, y = self.x, self.y
        p, q = x.kids[i], y.kids[j]
        # equal structures at both ends meet in some best match
        head, most = 0, min(len(p), len(q))
        while head < most and x.shape[p[head]] == y.shape[q[head]]:
            head += 1
        tail = 0
        while tail < most - head and x.shape[p[-1 - tail]] == y.shape[q[-1 - tail]]:
            tail += 1
        left, right = p[head : len(p) - tail], q[head : len(q) - tail]
        kinds = [{o.shape[k]: k for k in reversed(side)} for o, side in ((x, left), (y, right))]
        number = [{shape: n for n, shape in enumerate(k)} for k in kinds]
        if len(kinds[0]) * len(kinds[1]) <= WEIGHED:
            alike: dict[str, list[int]] = {}
            for b in kinds[1].values():
                alike.setdefault(y.labels[b], []).append(b)
            pairs = [(a, b) for a in kinds[0].values() for b in alike.get(x.labels[a], ())]
            if missing := [(a, b) for a, b in pairs if (x.shape[a], y.shape[b]) not in self.known]:
                return missing
            weight = np.zeros((max(1, len(kinds[0])), max(1, len(kinds[1]))), np.int64)
            for a, b in pairs:
                weight[number[0][x.shape[a]], number[1][y.shape[b]]] = self.known[x.shape[a], y.shape[b]]
            met = aligned([number[0][x.shape[a]] for a in left], [number[1][y.shape[b]] for b in right], weight)
        else:
            row = weights(x, y, list(kinds[0].values()), list(kinds[1].values())).row
            met = aligned([number[0][x.shape[a]] for a in left], [number[1][y.shape[b]] for b in right], row)
        ends = [(n, n) for n in range(head)] + [(len(p) - 1 - n, len(q) - 1 - n) for n in range(tail)]
        self.ways[key] = ends + [(head + a, head + b) for a, b in met]
        return []

    def pairs(self) -> list[tuple[int, int]]:
        """The numbers of matched nodes."""
        x, y, out, waiting = self.x, self.y, [], [(0, 0)]
        while waiting:
            i, j = waiting.pop()
            if not self.size(i, j):
                continue
            if x.shape[i] == y.shape[j]:
                out += zip(range(i, x.end[i]), range(j, y.end[j]), strict=True)
            else:
                out.append((i, j))
                waiting += [(x.kids[i][p], y.kids[j][q]) for p, q in self.ways[x.shape[i], y.shape[j]]]
        return out


def _masses(o: Outline, mass: list[int], chrome: list[int], least: int) -> list[int]:
    """The mass under each node, none under those that are chrome of kind least or more."""
    out = list(mass)
    for i in range(len(out) - 1, -1, -1):
        if chrome[i] >= least:
            out[i] = 0
        if i:
            out[o.parent[i]] += out[i]
    return out


def rescued(o: Outline, mass: list[int]) -> set[int]:
    """Forms and elements named as chrome that are none: mass is each node's own varying text.

    While hardly any of the text that isn't chrome for sure stands outside them, or
    an article stands only in them, the one with most of it is taken for content.
    Readers' comments and hard chrome stay what they are.
    """
    out: set[int] = set()
    # kinds in the order of their strength: a name is the weakest
    strength = [(0, 2, 1, 3)[x] for x in o.chrome]
    while True:
        all_of, rest = (_masses(o, mass, strength, least) for least in (2, 1))
        inside = [0] * len(strength)
        shown, hidden = 0, set()
        for i, s in enumerate(strength):
            inside[i] = max(s, inside[o.parent[i]] if i else 0)
            if o.labels[i].split(" ", 1)[0] == "article" and all_of[i]:
                shown |= inside[i] == 0
                if inside[i] == 1:
                    hidden.add(i)
        if not all_of[0] or rest[0] >= ELSEWHERE * all_of[0] and (shown or not hidden):
            return out
        named = [i for i, s in enumerate(strength) if s == 1 and inside[i] == 1]
        if rest[0] >= ELSEWHERE * all_of[0]:
            named = [i for i in named if any(i <= h < o.end[i] for h in hidden)]
        best = max(named, key=lambda i: (all_of[i], -i), default=None)
        if best is None or not all_of[best]:
            return out
        strength[best] = 0
        out.add(best)


def _paragraph(o: Outline, i: int, mass: int) -> int:
    """A node's mass if it is a paragraph's: what else varies isn't known from a few pages."""
    return mass if o.labels[i].split(" ", 1)[0] in ("p", "article") else 0


def content_slots(o: Outline, votes: dict[int, tuple[int, int, int, int]]) -> tuple[set[int], set[int], set[int]]:
    """(content slots, template nodes, nodes rescued from chrome) of a wrapper; votes: node number to pages, pages with equal text, chars, link chars.

    Articles are the slots if most of the varying text stands in them, else the
    deepest container that holds all of it is. Authors' text can be alike on
    many pages, so what is constant in an article is template only under an
    element that has a class, and beside text that varies.
    """
    n = len(o.labels)
    own, known, template, fixed = [0] * n, [0] * n, set(), [False] * n
    for i in range(n - 1, -1, -1):
        pages, same, chars, links = votes.get(i, (0, 0, 0, 0))
        if o.chars[i] and pages >= LEAST_PAGES and same >= SAME * pages:
            template.add(i)
            chars = links = 0
        own[i] = max(0, chars - links)
        known[i] = own[i] if pages >= LEAST_PAGES else _paragraph(o, i, own[i])
        fixed[i] = (not o.chars[i] or i in template) and all(fixed[k] for k in o.kids[i])
    freed = rescued(o, known)
    chrome = [PLAIN if i in freed else x for i, x in enumerate(o.chrome)]
    mass = _masses(o, own, chrome, HARD)
    articles, i = [], 0
    while i < n:
        if i and chrome[i]:
            i = o.end[i]
        elif i and o.labels[i].split(" ", 1)[0] == "article":
            articles.append(i)
            i = o.end[i]
        else:
            i += 1
    for article in articles:
        i = article
        while i < o.end[article]:
            # an author's text is no template; under a class it can be
            if mass[article] and i > article and fixed[i] and " " in o.labels[i]:
                i = o.end[i]
            else:
                template.discard(i)
                i += 1
    total = mass[0]
    if articles and sum(mass[x] for x in articles) >= MOSTLY * total:
        return set(articles), template, freed
    at = 0
    while total:
        inner = [k for k in o.kids[at] if mass[k] == total and (k in freed or o.labels[k].split(" ", 1)[0] in CONTAINERS)]
        if not inner:
            break
        at = inner[0]
    return {at}, template, freed


def marked(root: Node, tag: str) -> tuple[list[Node], list[Node]]:
    """The outermost nodes of a tag in page order: those outside chrome, and those in it, though not in comments."""
    found: tuple[list[Node], list[Node]] = ([], [])
    waiting = [(root, 0)]
    while waiting:
        node, inside = waiting.pop()
        if node is not root and node.tag == tag and not node.chrome:
            found[inside].append(node)
        else:
            inside = inside or int(node.chrome != PLAIN)
            waiting += [(p, inside) for p in reversed(node.parts) if isinstance(p, Node) and p.chrome != COMMENTS]
    return found


def own_slots(root: Node) -> list[Node]:
    """The content slots of a page that fits no wrapper: its articles, else its main parts, else its body."""
    return next((found for name in ("article", "main", "body") if (found := max(marked(root, name), key=bool))), [root])


def in_order(root: Node, wanted: set[int]) -> list[Node]:
    """The outermost of the wanted nodes, in page order."""
    out, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        if id(node) in wanted:
            out.append(node)
        else:
            waiting += [p for p in reversed(node.parts) if isinstance(p, Node)]
    return out


def blocks(nodes: list[Node], left_out: set[int]) -> list[str]:
    """The texts of the blocks under nodes, in page order, without chrome and the nodes left out."""
    out, run = [], []

    def close() -> None:
        text = _BLANK.sub(" ", html_lib.unescape("".join(run))).strip()
        if text:
            out.append(text)
        run.clear()

    for n in nodes:
        # None stands for the end of a block
        waiting: list = [None, *reversed(n.parts)]
        while waiting:
            p = waiting.pop()
            if p is None:
                close()
            elif isinstance(p, str):
                run.append(p)
            elif p.tag == "br":
                run.append("\n")
            elif p.chrome or id(p) in left_out:
                if p.tag in BLOCKS:
                    close()
            elif p.tag in BLOCKS:
                close()
                waiting += [None, *reversed(p.parts)]
            else:
                waiting += reversed(p.parts)
    return out


def _free(members: list[Node]) -> None:
    """Takes those of some equal siblings for content that hold at least half as much text as the one with most."""
    sizes = []
    for m in members:
        size, waiting = 0, [m]
        while waiting:
            node = waiting.pop()
            size += sum(len(p) for p in node.parts if isinstance(p, str))
            waiting += [p for p in node.parts if isinstance(p, Node) and p.tag != "a" and p.chrome not in (HARD, COMMENTS)]
        sizes.append(size)
    for m, size in zip(members, sizes, strict=True):
        if 2 * size >= max(sizes):
            m.chrome = PLAIN


def main_text(page: str, wrapper: tuple[Outline, set[int], set[int], set[int]] | None) -> str:
    """The main text of a page under a wrapper (outline, content slots, template nodes, nodes rescued from chrome), or by its own structure."""
    root = tree(page)
    own = outline(root)
    wanted, left_out = set(), set()
    if wrapper is not None:
        of_host, content, template, freed = wrapper
        pairs = Matching(of_host, own).pairs()
        for w, p in pairs:
            if w in freed:
                _free(own.members[p])
        for w, p in pairs:
            if w in content:
                wanted |= {id(m) for m in own.members[p] if not m.chrome}
            if w in template and of_host.hashes[w] == own.hashes[p] and own.members[p][0].tag in BLOCKS:
                left_out |= {id(m) for m in own.members[p]}
    # a page's articles are content also where the wrapper has no place for them
    if wanted:
        return "\n".join(blocks(in_order(root, wanted | {id(n) for n in marked(root, "article")[0]}), left_out))
    # by itself a page's form is content if it holds its paragraphs
    for i in rescued(own, [_paragraph(own, i, c - a) for i, (c, a) in enumerate(zip(own.chars, own.links, strict=True))]):
        _free(own.members[i])
    return "\n".join(blocks(own_slots(root), set()))


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def _dealt(rows: DataFrame, hosts: DataFrame, number: Column) -> DataFrame:
    """rows with salt, one of their host's groups by number; hosts(host, pages), which must be stored, has how many pages each host has."""
    groups = hosts.orderBy(F.desc("pages"), "host").limit(LARGE).select("host", F.ceil(F.col("pages") / GROUP_PAGES).cast("int").alias("groups"))
    return rows.join(F.broadcast(groups), "host", "left").withColumn("groups", F.coalesce("groups", F.lit(1))).withColumn("salt", number).drop("groups")


def _each() -> Column:
    return F.explode(F.sequence(F.lit(0), F.col("groups") - 1))


def _of(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.col("groups")).cast("int")


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, pages, outline, votes) for each host of pages(page_id, url, html): one page's outline as JSON, and all pages' votes on its nodes."""

    def outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [outline(tree(p)) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([len(o.labels) for o in found], pa.int32()), pa.array([o.told() for o in found], pa.string())], ["host", "size", "outline"])

    page = pages.select(_host(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    seen = page.mapInArrow(outlines, "host string, size int, outline string")
    # small beside the pages, and read three times
    seen = cut(seen.groupBy("host", "outline").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("n")))
    model = cut(seen.groupBy("host").agg(F.max_by("outline", F.struct("size", F.xxhash64("outline"))).alias("outline"), F.sum("n").alias("pages")))
    first = _dealt(model, model, _each()).select("host", "salt", F.lit(0).cast("long").alias("n"), "outline")
    dealt = first.unionByName(_dealt(seen, model, _of("outline")).select("host", "salt", "n", "outline"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, model, sums = None, None, {}

        def told() -> pa.RecordBatch:
            rows = [(host, i, *s) for i, s in sums.items()]
            kinds = (pa.string(), pa.int32(), *[pa.int64()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["host", "node", "pages", "same", "chars", "links"])

        for batch in batches:
            for h, n, x in zip(*(batch.column(c).to_pylist() for c in ("host", "n", "outline")), strict=True):
                if not n:
                    if sums:
                        yield told()
                    host, model, sums = h, Outline.read(x), {}
                    continue
                page = Outline.read(x)
                for w, p in Matching(model, page).pairs():
                    s = sums.setdefault(w, [0, 0, 0, 0])
                    # copies of one page, whose outlines are equal, are one voice
                    s[0] += 1
                    s[1] += model.hashes[w] == page.hashes[p]
                    s[2] += page.chars[p]
                    s[3] += page.links[p]
        if sums:
            yield told()

    votes = dealt.repartition("host", "salt").sortWithinPartitions("host", "salt", "n").mapInArrow(vote, "host string, node int, pages long, same long, chars long, links long")
    summed = votes.groupBy("host", "node").agg(*(F.sum(c).alias(c) for c in ("pages", "same", "chars", "links")))
    return model.join(summed.groupBy("host").agg(F.to_json(F.collect_list(F.array("node", "pages", "same", "chars", "links"))).alias("votes")), "host")


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), a row per row of pages(page_id, url, html).

    A null or empty page, or one without main text, has an empty text; a null url
    counts as a host of its own; repeated rows come back as often. A host with a
    single page is judged by its structure alone.
    """
    small, plain = zstandard.ZstdCompressor, zstandard.ZstdDecompressor

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = small(level=3).compress
        for batch in batches:
            blobs = pa.array([press(h.encode()) for h in batch.column("html").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("host", "salt", "page_id", "url")), blobs], ["host", "salt", "page_id", "url", "blob"])

    own = pages.select(_host(F.col("url")).alias("host"), F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    known = cut(wrappers(pages))
    rows = _dealt(own, known, _of("page_id", "html")).select("host", "salt", "page_id", "url", "html").mapInArrow(packed, "host string, salt int, page_id long, url string, blob binary")
    given = _dealt(known, known, _each()).select("host", "salt", "outline", "votes")
    dealt = given.unionByName(rows, allowMissingColumns=True).repartition("host", "salt").sortWithinPartitions("host", "salt", F.col("outline").asc_nulls_last())

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, wrapper = plain().decompress, None
        for batch in batches:
            out = []
            for given, votes, page, url, blob in zip(*(batch.column(c).to_pylist() for c in ("outline", "votes", "page_id", "url", "blob")), strict=True):
                if given is not None:
                    model = Outline.read(given)
                    wrapper = (model, *content_slots(model, {v[0]: tuple(v[1:]) for v in json.loads(votes)}))
                else:
                    text = main_text(unpack(blob).decode(), wrapper)
                    out.append((page, url, text, len(text)))
            columns = zip(*out, strict=True) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "url", "text", "n_chars"])

    return dealt.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
