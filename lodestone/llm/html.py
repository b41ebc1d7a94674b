"""Main text of web pages with wrappers that are inferred per host and template as union-free regular expressions.

A page is read as a stream of block tags and texts. Streams of a bounded sample of the pages of one host and template are aligned
one after the other: repeats fold into groups, a mismatch of texts becomes a slot, a mismatch of tags an optional or a repeated group.
A text that most of the sampled pages share is a constant of the template. Every page is then matched with its wrapper: the
wrapper says in which container the article lies, boxes of constants (notices, adverts) in it are dropped,
and the rest is the text, constants in its own flow included. Elements that by HTML's own meaning hold no article (navigation, forms, scripts) are left
out, and so are those whose class names say so, unless the article itself lies in them: names are evidence, and an element that holds
the page's article or most of its text is the page's frame. Names with two meanings give way to what the wrapper has seen.
A page that has no wrapper, or does not fit it, is read by a rule on the page alone, where all class names count.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.arrow import map_batches, stored, table

#: Pages that a wrapper is inferred from, at most; bytes of wrappers, or of sampled ids, that are sent to all executors (more are joined by a shuffle).
PAGES, BROADCAST_BYTES = 8, 64 << 20
#: A text is a constant if at least so many of the sampled pages have it, and this share of them; a page fits if this share of its elements is
#: matched; most of a page's article, and of the page, that may be constants (beyond that they are the article itself, as on hosts of near copies).
CONSTANT_PAGES, CONSTANT_SHARE, FIT, MOST_CONSTANT, MOST_OF_PAGE = 3, 0.6, 0.5, 0.3, 0.6
#: Elements nested deeper are taken as part of the one at this depth.
DEPTH = 150

# Fixed values of HTML: elements without an end tag, with raw text, that break lines, and that hold no article text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
_CONTAINER = frozenset("article body center div main section table td blockquote".split())
_NOISE = frozenset("aside button datalist dialog fieldset footer form head input label menu nav option search select".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus "
    "dropdown footer gdpr masthead menu modal nav navbar navigation navigator newsletter pagination pager respond sidebar sponsor sponsored subscribe subscription toolbar".split()
)
# Those of readers' comments, which have articles of their own.
_COMMENTS = frozenset("comment comments commentlist disqus respond".split())
# Class names of boxes beside the article that articles use as well.
_DOUBTFUL = frozenset("alert notice notices notification overlay popup promo promotion recommended related replies reviews share sharing skip social widget widgets".split())
_CONTENT = frozenset("article articlebody content entry main post story text body".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|title|textarea|noscript|iframe|template|svg|annotation|annotation-xml|object|audio|video|canvas)\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>.*?(?:</\1\s*>|\Z)"
    r"|</?([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<>]*\Z",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACES = re.compile(r"\s+")
_PARTS = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: int = 0
    doubtful: bool = False


@dataclass
class Node:
    """An element, or a text (label "#"). In a wrapper: text is None for a slot, opt and rep say how often it may come."""

    label: str
    kids: list[Node] = field(default_factory=list)
    text: str | None = None
    block: int = -1
    opt: bool = False
    rep: bool = False
    doubtful: bool = False
    #: Of the texts seen here: pages, characters, those in links.
    seen: int = 1
    chars: int = 0
    linked: int = 0


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    root: Node = field(default_factory=lambda: Node(""))


#: How sure a mark is that an element holds no article: a word inside a longer class name, a whole name or the element's own meaning, one of
#: readers' comments, a head.
WEAK, STRONG, COMMENTS, HEAD = 1, 2, 3, 4


@dataclass
class Mark:
    """An article element, one that may hold no article (kind over 0), or a doubtful one: the mark around it, characters outside links, those of the largest article in it."""

    over: int
    kind: int = 0
    doubtful: bool = False
    article: bool = False
    chars: int = 0
    largest: int = 0


def _label(tag: str, attrs: str) -> tuple[str, int, bool]:
    """The element's name with its first class, how sure it is to hold no article text (0: not at all), whether its class may say so."""
    kind, doubtful, mark = HEAD if tag == "head" else STRONG if tag in _NOISE else 0, False, ""
    if attrs and "=" in attrs or "hidden" in attrs:
        for name, a, b, c in _ATTRIBUTE.findall(attrs):
            name, value = name.lower(), a or b or c
            if name in ("class", "id"):
                for part in value.split() if tag not in ("body", "html", "article", "main") else ():
                    words = {w.lower() for w in _PARTS.split(part) if w}
                    if words & _WORDS:
                        kind = max(kind, COMMENTS if words & _COMMENTS else STRONG if part.lower() in _WORDS else WEAK)
                    doubtful |= bool(words & _DOUBTFUL)
                mark = mark or (re.sub(r"\d+", "0", value.split()[0]) if value.split() else "")
            elif name == "role":
                kind = max(kind, STRONG * (value.lower() in _ROLES))
            elif name == "style":
                kind = max(kind, STRONG * ("display:none" in value.replace(" ", "").lower()))
            else:
                kind = max(kind, STRONG * (value.lower() != "false"))
    return f"{tag}.{mark}" if mark else tag, max(kind, WEAK * (doubtful and tag not in _BLOCK)), doubtful


def _resolve(marks: list[Mark]) -> tuple[list[bool], list[bool], list[bool]]:
    """For each mark: whether it is silent itself, whether it lies in a silent one or is one, whether it lies in a doubtful one or is one.

    The page's frame is neither: a weak mark gives way to an article element that is no teaser (a fifth of the text without surely other elements) or to half of the page's text outside links; a
    strong one to half of the text where no article element is outside, or to nearly all of it; comments only to nearly all.
    """
    above = [0] * len(marks)
    for k, m in enumerate(marks[1:], 1):
        above[k] = max(above[m.over], marks[m.over].kind)
    for k in range(len(marks) - 1, 0, -1):
        m, o = marks[k], marks[marks[k].over]
        if m.article:
            m.largest = max(m.largest, m.chars)
        o.chars += m.chars
        o.largest = max(o.largest, m.largest)
    articles = [k for k, m in enumerate(marks) if m.article and m.chars]
    best = max((marks[k].chars for k in articles if above[k] <= WEAK), default=0)
    free = any(above[k] == 0 for k in articles)
    total = max(1, marks[0].chars)
    plain = marks[0].chars - sum(m.chars for k, m in enumerate(marks) if m.kind >= STRONG > above[k])
    own, silent, doubtful = ([False] * len(marks) for _ in range(3))
    for k, m in enumerate(marks[1:], 1):
        half, nearly = 2 * m.chars > total, 10 * m.chars >= 9 * total
        frame = m.kind <= WEAK and (half or m.largest and 2 * m.largest >= best and 5 * m.largest >= plain) or m.kind == STRONG and half and m.largest and not free or m.kind < HEAD and nearly
        own[k] = bool(m.kind and not frame)
        silent[k] = silent[m.over] or own[k]
        doubtful[k] = doubtful[m.over] or m.doubtful and not frame
    return own, silent, doubtful


def read(source: str) -> Page:
    """Blocks of text outside elements that hold none of the article, and the tree of block elements and those texts."""
    page = Page()
    marks = [Mark(0)]  # the first is the page, which is in no mark
    stack: list[tuple[str, str, int, bool, bool]] = []  # tag, label, the mark outside, container, has a node
    nodes = [page.root]
    within = links = articles = 0
    marked: dict[int, int] = {}  # of nodes
    raw: list[tuple[list[tuple[str, bool, int]], tuple[str, ...], int, Node]] = []
    text: list[tuple[str, bool, int]] = []

    def flush() -> None:
        if text:
            node = Node("#", block=len(raw))
            nodes[-1].kids.append(node)
            raw.append((text.copy(), tuple(x[1] for x in stack if x[3]), within, node))
            text.clear()

    def close(depth: int) -> None:
        nonlocal links, within, articles
        while len(stack) > depth:
            tag, _, within, _, has_node = stack.pop()
            links -= tag == "a"
            articles -= tag in ("article", "main")
            if has_node:
                nodes.pop()

    def add(part: str) -> None:
        if part:
            text.append((part, links > 0, within))
            if not links:
                marks[within].chars += len(part.strip())

    at = 0
    for m in _TOKEN.finditer(source):
        add(source[at : m.start()])
        at = m.end()
        token = m.group(0)
        if token.startswith("<![CDATA["):
            add(token[9:].removesuffix("]]>"))
        if m.group(2) is None:
            continue
        tag = m.group(2).lower()
        if token[1] == "/":
            if tag in _BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if stack[k][0] in _BLOCK and tag not in _BLOCK:
                    break
            continue
        if tag in _BLOCK:
            flush()
            # A block ends an open paragraph; items end items, and cells cells.
            ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(tag, ())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or stack[k][0] in ends:
                    close(k)
                    break
                if stack[k][0] in _BLOCK:
                    break
        elif tag == "br":
            add(" ")
        if tag in _VOID:
            continue
        label, kind, doubtful = _label(tag, m.group(3) or "")
        if tag == "header" and not articles:
            kind = max(kind, STRONG)
        if tag == "body":  # a head that was not closed ends here
            while stack and stack[-1][0] != "html":
                close(len(stack) - 1)
        article, outside = tag in ("article", "main"), within
        if kind or doubtful or article:
            marks.append(Mark(outside, kind, doubtful, article))
            within = len(marks) - 1
        has_node = tag in _BLOCK and len(nodes) <= DEPTH
        if has_node:
            node = Node(label)
            marked[id(node)] = within if within != outside else 0
            nodes[-1].kids.append(node)
            nodes.append(node)
        stack.append((tag, label, outside, tag in _CONTAINER, has_node))
        links += tag == "a"
        articles += article
    add(source[at:])
    flush()
    close(0)
    own, silent, doubtful = _resolve(marks)
    kept: set[int] = set()
    for parts, path, around, node in raw:
        said = [x for x in parts if not silent[x[2]]]
        if said and (whole := _SPACES.sub(" ", entities.unescape("".join(x[0] for x in said))).strip()):
            block = Block(whole, path, min(sum(len(x[0].strip()) for x in said if x[1]), len(whole)), doubtful[around])
            node.text, node.block, node.doubtful, node.chars, node.linked = whole, len(page.blocks), block.doubtful, len(whole), block.linked
            page.blocks.append(block)
            kept.add(id(node))
    work = [page.root]
    while work:
        node = work.pop()
        node.kids = [k for k in node.kids if (id(k) in kept if k.label == "#" else not own[marked[id(k)]])]
        work += node.kids
    return page


# --- wrappers -------------------------------------------------------------------------------------------------------------


def common(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """The places of a longest common subsequence.

    Bit-parallel: bit i of a row is 0 where x[: i + 1] has one more in common than x[:i]. Only every k-th row is kept, the others are
    worked out again on the way back, so memory is that of 2 sqrt(len(y)) rows of len(x) bits.
    """
    lo = 0
    while lo < min(len(x), len(y)) and x[lo] == y[lo]:
        lo += 1
    hi = 0
    while hi < min(len(x), len(y)) - lo and x[-1 - hi] == y[-1 - hi]:
        hi += 1
    a, b = x[lo : len(x) - hi], y[lo : len(y) - hi]
    ends = [(len(x) - hi + k, len(y) - hi + k) for k in range(hi)]
    out = [(k, k) for k in range(lo)]
    if not a or not b:
        return out + ends
    where: dict[str, int] = {}
    for i, v in enumerate(a):
        where[v] = where.get(v, 0) | 1 << i
    full, step = (1 << len(a)) - 1, max(1, int(len(b) ** 0.5))

    def after(row: int, v: str) -> int:
        some = row & where.get(v, 0)
        return ((row + some) | (row - some)) & full

    kept, row = [full], full
    for j, v in enumerate(b):
        row = after(row, v)
        if (j + 1) % step == 0:
            kept.append(row)
    found, i, j = [], len(a), len(b)
    rows: list[int] = []
    base = -1
    while i and j:
        if j // step != base:
            base = j // step
            rows = [kept[base]]
            for v in b[base * step : min((base + 1) * step, len(b))]:
                rows.append(after(rows[-1], v))
        if rows[j - base * step] >> (i - 1) & 1:
            i -= 1
        elif a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            found.append((lo + i, lo + j))
        else:
            j -= 1
    return out + found[::-1] + ends


def _key(node: Node, constants: frozenset[str]) -> str:
    """What two nodes must share to be aligned: texts that are constants, and elements that hold nothing else, go by their text."""
    if node.label == "#":
        return "#" + node.text if node.text in constants else "#"
    if node.kids and all(k.label == "#" and k.text in constants for k in node.kids):
        return f"<{node.label}>" + "|".join(k.text for k in node.kids)
    return f"<{node.label}>"


def _shape(node: Node, constants: frozenset[str]) -> str:
    return _key(node, constants) if node.label == "#" else f"<{node.label}>{''.join(_shape(k, constants) + ('?' if k.opt else '') + ('+' if k.rep else '') for k in node.kids)}</>"


def _joined(a: Node, b: Node, constants: frozenset[str]) -> Node:
    text = a.text if a.text == b.text else None
    kids = align(a.kids, b.kids, constants)
    return Node(a.label, kids, text, -1, a.opt or b.opt, a.rep or b.rep, a.doubtful or b.doubtful, a.seen + b.seen, a.chars + b.chars, a.linked + b.linked)


def fold(node: Node, constants: frozenset[str]) -> Node:
    """Neighbouring elements of one shape become a repeated group. The texts of a page are slots, except constants."""
    kids: list[Node] = []
    last = ""
    for kid in node.kids:
        kid = fold(kid, constants)
        shape = _shape(kid, constants)
        if kids and shape == last and kid.label != "#":
            was = kids[-1]
            kids[-1] = _joined(was, kid, constants)
            kids[-1].rep, kids[-1].seen = True, was.seen
        else:
            kids.append(kid)
        last = shape
    return Node(node.label, kids, node.text if node.text in constants else None, -1, False, False, node.doubtful, 1, node.chars, node.linked)


def align(a: list[Node], b: list[Node], constants: frozenset[str]) -> list[Node]:
    """One list widened so that it also fits the other: what only one has becomes optional."""
    out: list[Node] = []
    i = j = 0
    for x, y in [*common([_key(n, constants) for n in a], [_key(n, constants) for n in b]), (len(a), len(b))]:
        for n in (*a[i:x], *b[j:y]):
            n.opt = True
            out.append(n)
        if x < len(a) and y < len(b):
            out.append(_joined(a[x], b[y], constants))
        i, j = x + 1, y + 1
    return out


@dataclass
class Wrapper:
    """The expression of one template, the container of its article, and its constant texts."""

    root: tuple[str, ...] | None
    constants: frozenset[str]
    tree: Node

    def dumps(self) -> str:
        def of(n: Node) -> list:
            return [n.label, n.text, n.opt * 1 + n.rep * 2 + n.doubtful * 4, n.seen, n.chars, n.linked, [of(k) for k in n.kids]]

        return json.dumps([self.root, sorted(self.constants), of(self.tree)], ensure_ascii=False)

    @staticmethod
    def loads(text: str) -> Wrapper:
        def of(x: list) -> Node:
            return Node(x[0], [of(k) for k in x[6]], x[1], -1, bool(x[2] & 1), bool(x[2] & 2), bool(x[2] & 4), x[3], x[4], x[5])

        root, constants, tree = json.loads(text)
        return Wrapper(tuple(root) if root else None, frozenset(constants), of(tree))


def infer(sources: list[str]) -> Wrapper:
    """The wrapper of pages of one template. Repeated pages count once."""
    pages = [read(s) for s in dict.fromkeys(sources)]
    texts = Counter(t for p in pages for t in {b.text for b in p.blocks})
    least = max(CONSTANT_PAGES, CONSTANT_SHARE * len(pages))
    constants = frozenset(t for t, n in texts.items() if n >= least)
    wrapper = _inferred(pages, constants)
    # Pages that share much of their article are copies of each other; what they share is no template.
    top = wrapper.root or ()
    for page in pages:
        inside = [b for b in page.blocks if top and _inside(b.path, top)]
        if _share(page.blocks, constants) > MOST_OF_PAGE or _share(inside, constants) > MOST_CONSTANT:
            return _inferred(pages, frozenset())
    return wrapper


def _share(blocks: list[Block], constants: frozenset[str]) -> float:
    return sum(len(b.text) for b in blocks if b.text in constants) / max(1, sum(len(b.text) for b in blocks))


def _inferred(pages: list[Page], constants: frozenset[str]) -> Wrapper:
    tree: Node | None = None
    for page in pages:
        own = fold(page.root, constants)
        tree = own if tree is None else _joined(tree, own, constants)
    tree = tree or Node("")
    return Wrapper(_root(_weights(tree)), constants, tree)


def pattern(node: Node) -> str:
    """The wrapper as text: # a slot, (…)? an optional and (…)+ a repeated group."""
    if node.label == "#":
        own = "#" if node.text is None else entities.escape(node.text, False)
    else:
        inner = "".join(map(pattern, node.kids))
        own = f"<{node.label}>{inner}</{node.label}>" if node.label else inner
    return f"({own}){'+' if node.rep else ''}{'?' if node.opt else ''}" if node.opt or node.rep else own


def _weights(tree: Node) -> dict[tuple[str, ...], float]:
    """For each container the characters of the slots in it that are not links; constants count nothing."""
    out: dict[tuple[str, ...], float] = {}

    def walk(node: Node, path: tuple[str, ...]) -> None:
        if node.label == "#":
            if node.text is None and not node.doubtful:
                for k in range(1, len(path) + 1):
                    out[path[:k]] = out.get(path[:k], 0) + max(0, node.chars - 2 * node.linked)
        else:
            path = (*path, node.label) if node.label.split(".")[0] in _CONTAINER else path
            for kid in node.kids:
                walk(kid, path)

    walk(tree, ())
    return {p: w for p, w in out.items() if w > 0}


def _root(weights: dict[tuple[str, ...], float]) -> tuple[str, ...] | None:
    """The container of the article: an article or main element, or one whose class says so, if much of the text is there; else the deepest with most of the weight."""
    if not weights:
        return None
    most = max(weights.values())
    names = {p: p[-1].split(".") for p in weights}
    for test in (lambda n: n[0] == "article", lambda n: n[0] == "main", lambda n: len(n) > 1 and bool({w.lower() for w in _PARTS.split(n[1])} & _CONTENT)):
        if found := [p for p, n in names.items() if test(n)]:
            best = min(found, key=lambda p: (-weights[p], len(p), p))
            if weights[best] >= 0.3 * most:
                return best
    return max((p for p in weights if weights[p] >= 0.7 * most), key=lambda p: (len(p), weights[p], p))


def _own_root(page: Page) -> tuple[str, ...] | None:
    """The same rule on one page: text that is not in links takes the place of slots."""
    weights: dict[tuple[str, ...], float] = {}
    for b in page.blocks:
        if not b.doubtful:
            for k in range(1, len(b.path) + 1):
                weights[b.path[:k]] = weights.get(b.path[:k], 0) + max(0, len(b.text) - 2 * b.linked)
    return _root({p: w for p, w in weights.items() if w > 0})


def _inside(path: tuple[str, ...], top: tuple[str, ...]) -> bool:
    """Several article or main elements may follow each other, wherever they are; other containers are one place."""
    return top[-1] in path if top[-1].split(".")[0] in ("article", "main") else path[: len(top)] == top


def matched(page: Page, wrapper: Wrapper) -> tuple[float, dict[int, Node]]:
    """The share of the page's elements that the wrapper has, and the wrapper's text node of each block that has one."""
    found: dict[int, Node] = {}
    hit = all_ = 0

    def count(node: Node) -> int:
        return sum(1 + count(k) for k in node.kids if k.label != "#")

    def walk(theirs: Node, mine: Node) -> None:
        nonlocal hit
        runs: list[tuple[str, list[Node]]] = []
        for kid in mine.kids:
            key = _key(kid, wrapper.constants)
            if runs and runs[-1][0] == key:
                runs[-1][1].append(kid)
            else:
                runs.append((key, [kid]))
        for x, y in common([_key(n, wrapper.constants) for n in theirs.kids], [r[0] for r in runs]):
            node = theirs.kids[x]
            for kid in runs[y][1]:
                if kid.label == "#":
                    found[kid.block] = node
                else:
                    hit += 1
                    walk(node, kid)

    all_ = count(page.root)
    walk(wrapper.tree, page.root)
    return hit / all_ if all_ else 1.0, found


def by_wrapper(page: Page, wrapper: Wrapper) -> list[str] | None:
    """The article's blocks as the wrapper sees them; None where the page does not fit it."""
    if wrapper.root is None:
        return None
    fit, nodes = matched(page, wrapper)
    if fit < FIT:
        return None
    inside = [k for k, b in enumerate(page.blocks) if _inside(b.path, wrapper.root)]
    # Constants in the flow of the article belong to it, and so do headings; those in a box of their own, or of doubtful names, don't.
    flow = _flow(wrapper) if wrapper.constants else set()
    constant = {k for k in inside if k in nodes and nodes[k].text is not None and (page.blocks[k].doubtful or "." in page.blocks[k].path[-1] and page.blocks[k].path not in flow and page.blocks[k].path != wrapper.root)}
    constant -= _headings(page) if constant else set()
    if sum(len(page.blocks[k].text) for k in constant) > MOST_CONSTANT * sum(len(page.blocks[k].text) for k in inside):
        constant = set()

    def kept(k: int) -> bool:
        if k in constant:
            return False
        if not page.blocks[k].doubtful:
            return True
        # A box with a doubtful class is the article's if several pages have it, each with its own text, not mostly links.
        node = nodes.get(k)
        return node is not None and node.text is None and node.seen >= 2 and 2 * node.linked <= node.chars

    return [page.blocks[k].text for k in inside if kept(k)] or None


def _flow(wrapper: Wrapper) -> set[tuple[str, ...]]:
    """The paths of containers that hold a slot directly: what changes from page to page is no box of the template."""
    out: set[tuple[str, ...]] = set()
    work: list[tuple[Node, tuple[str, ...]]] = [(wrapper.tree, ())]
    while work:
        node, path = work.pop()
        for kid in node.kids:
            if kid.label != "#":
                work.append((kid, (*path, kid.label) if kid.label.split(".")[0] in _CONTAINER else path))
            elif kid.text is None:
                out.add(path)
    return out


def _headings(page: Page) -> set[int]:
    """The blocks that are headings."""
    out: set[int] = set()
    work = [page.root]
    while work:
        node = work.pop()
        for kid in node.kids:
            if kid.label == "#":
                if node.label[:2] in ("h1", "h2", "h3", "h4", "h5", "h6"):
                    out.add(kid.block)
            else:
                work.append(kid)
    return out


def by_page(page: Page) -> list[str]:
    """The article's blocks by the rule on the page alone."""
    sure = [b for b in page.blocks if not b.doubtful]
    own = _own_root(page)
    return [b.text for b in sure if own and _inside(b.path, own)] or [b.text for b in sure] or [b.text for b in page.blocks]


def main_text(source: str, wrapper: Wrapper | None) -> str:
    """The article's blocks, in page order, joined by two line feeds."""
    page = read(source)
    return "\n\n".join((by_wrapper(page, wrapper) if wrapper else None) or by_page(page))


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _template(html):
    """A hash of the kinds of containers that a page has, with their first class or id: pages of one template have it in common."""
    tags = F.regexp_extract_all(F.lower(html), F.lit(r"<((?:article|main|section|div|table)\b(?:[^>]*?\b(?:class|id)\s*=\s*[\"']?[a-z_-]*)?)"), F.lit(1))
    return F.xxhash64(F.array_sort(F.array_distinct(F.transform(tags, lambda t: F.regexp_replace(t, r"^(\w+).*?(?:=\s*[\"']?([a-z_-]*))?$", "$1.$2")))))


def wrappers(pages: DataFrame, most: int = PAGES) -> DataFrame:
    """(host, template, wrapper as JSON) of each host and template, from at most `most` of its pages, which a hash of the page chooses.

    Only ids are shuffled to choose the pages; a group of the inference is `most` pages. Pages without a page_id are not sampled.
    """
    slim = pages.where("page_id is not null and html is not null").select("page_id", F.coalesce("url", F.lit("")).alias("url"), _host(F.col("url")).alias("host"), _template(F.col("html")).alias("template"), F.xxhash64("page_id", "url").alias("h"))
    place = F.pmod("h", F.lit(most)).alias("place")
    chosen = slim.groupBy("host", "template", place).agg(F.min_by(F.struct("page_id", "url"), "h").alias("one")).select("host", "template", "place", "one.*")
    chosen = stored(chosen, "chosen")
    size = chosen.agg(F.sum(F.octet_length("url") + F.octet_length("host") + 32)).first()[0] or 0
    chosen = F.broadcast(chosen) if size <= BROADCAST_BYTES else chosen
    sources = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), "html").where("html is not null")
    # One page a place even where a page is repeated.
    sample = sources.join(chosen, ["page_id", "url"]).groupBy("host", "template", "place").agg(F.min("html").alias("html"))

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        wrapper = infer(group.sort_values("place")["html"].tolist())
        return pd.DataFrame({"host": [key[0]], "template": [key[1]], "wrapper": [wrapper.dumps()]})

    return sample.groupBy("host", "template").applyInPandas(one, "host string, template long, wrapper string")


@lru_cache(4096)
def _loaded(text: str) -> Wrapper:
    return Wrapper.loads(text)


def extract(pages: DataFrame, most: int = PAGES) -> DataFrame:
    """page_id, url, text and n_chars of every row.

    Null and empty pages give an empty text; pages without a host share the wrappers of the host ''. Repeated rows give equal rows, very long
    pages are read and matched whole, an empty table gives an empty one, other columns are not read. Wrappers are broadcast up to BROADCAST_BYTES,
    beyond that joined by host and template, where AQE can split a large host.
    """
    known = stored(wrappers(pages, most), "wrappers")
    size = known.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host") + 8)).first()[0] or 0
    slim = pages.select(F.col("page_id"), "url", "html", _host(F.col("url")).alias("host"), _template(F.col("html")).alias("template"))
    joined = slim.join(F.broadcast(known) if size <= BROADCAST_BYTES else known, ["host", "template"], "left").select("page_id", "url", "html", "wrapper")

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = []
        for source, wrapper in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
            texts.append(main_text(source, _loaded(wrapper) if wrapper else None) if source else "")
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_batches(joined, one, f"page_id {kind}, url string, text string, n_chars long")


def op6_html(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
