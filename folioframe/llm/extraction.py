"""Main-text extraction by wrapper induction.

Every page becomes a tree of blocks. Trees of pages from one host are aligned
by simple tree matching and folded into a wrapper, whose nodes count the pages
they were matched on and keep their text while it is the same on all of them.
A node whose text is constant is template; a slot whose text varies can hold
content. Pages are dealt by a hash of what they are and folded in its order, in
groups of ``FOLD``, until a host has one wrapper: no task sees more than a
group, and reruns agree.

The wrapper decides for all pages of its host. Its smallest node that holds
nearly all varying text outside links is the container of the content; the
blocks that a page has there, without template nodes and boilerplate, are the
page's text. Varying text weighs less where a slot is marked as boilerplate (by
element, role or class), and more where it is marked as article or main, so
that a long column of comments does not outweigh an article; marks that are
absent or wrong do not change a clear majority.

Only where a host has fewer than ``TEMPLATE_PAGES`` pages, or its text does not
vary (copies of an article that fill a host), a page's own marks decide, and
without them its own text.

Edge cases: null or empty html gives an empty text; html without elements is
one block; any markup is accepted, however broken, in linear time; elements
nested deeper than ``DEPTH`` become siblings of the deepest, none of their text
is lost; a null URL is a host of its own; repeated rows give repeated results.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, looked_up, saved, small_side, table
from .url_rules import host_of

#: Pages, or wrappers, that are folded into one wrapper; open elements at once.
FOLD, DEPTH = 48, 200
#: A wrapper of more nodes than this loses those that fewer than this share of its pages have.
NODES, RARE = 1_000, 0.02
#: A constant text is template once so many pages have shown it; hosts of fewer pages have no template.
TEMPLATE_PAGES = 3
#: The share of varying text that a child must hold to be the container in its parent's place.
HOLDS = 2 / 3
#: How marks weigh a slot's varying text.
CUE_WEIGHT, MAIN_WEIGHT = 0.4, 2.5
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template iframe object svg canvas math head title select textarea option datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog button fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
MAIN_TAGS, MAIN_ROLES = frozenset(("article", "main")), frozenset(("main", "article"))
_WORDS = (
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside footer header masthead cookie cookies consent notice gdpr newsletter subscribe signup popup modal overlay comment comments "
    "respond disqus related recommended share sharing social widget pagination pager toolbar login"
)
CUES = frozenset(_WORDS.split())
_BEGIN = re.compile(r"<(?=[a-zA-Z!?]|/[a-zA-Z])")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[\"'>]")
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_BREAK = re.compile(r"[^a-z0-9]+")
#: Elements that an opening tag closes when they are open, within the nearest of the third set.
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul tr td th".split())
_SCOPE = frozenset("article section main div td th li body html button aside nav header footer form blockquote table".split())


#: Elements that are single blocks, never a container.
LEAVES = frozenset("p li dt dd td th h1 h2 h3 h4 h5 h6 pre blockquote figcaption caption summary".split())


class Node:
    """An element: ``runs`` are its own texts, each before the child of that number."""

    __slots__ = ("tag", "cue", "main", "children", "texts", "link")

    def __init__(self, tag: str, cue: bool = False, main: bool = False, link: bool = False):
        self.tag, self.cue, self.main, self.link = tag, cue, main, link
        self.children: list[Node] = []
        self.texts: list[tuple[int, str, bool]] = []


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(text)} if text.strip(" /\n\t\r") else {}


class _TagEnds:
    """Where tags end: at the first ``>`` outside quotes, or, where a quote is never closed, at the first one.

    From an opening quote on, scanning always ends alike; each is followed once,
    so that all tags of a page together take linear time, however broken it is.
    """

    def __init__(self, html: str):
        self.html, self.known, self.next = html, {}, (0, -1)
        self.last = html.rfind(">")

    def stop(self, at: int) -> int:
        low, high = self.next
        if not low <= at <= high:
            found = _STOP.search(self.html, at)
            high = found.start() if found else len(self.html)
            self.next = (at, high)
        return high

    def __call__(self, start: int) -> int:
        if start > self.last:
            return -1
        html, path, at = self.html, [], start
        while True:
            at = self.stop(at)
            if at == len(html):
                end = -1
            elif html[at] == ">":
                end = at
            elif at in self.known:
                end = self.known[at]
            else:
                path.append(at)
                close = html.find(html[at], at + 1)
                if close >= 0:
                    at = close + 1
                    continue
                end = -1
            break
        for quote in path:
            self.known[quote] = end
        return end if end >= 0 else html.find(">", start)


def parse(html: str | None) -> Node:
    """The block tree of a page; inline elements are part of their block's text."""
    root = Node("#root")
    if not html:
        return root
    stack: list[Node] = [root]
    names: list[str] = ["#root"]  # of open elements, inline ones as well
    nodes_at: list[int] = [0]
    open_, displaced = Counter(), Counter()  # elements by name; those that gave way to deeper ones
    links, at, lower, end_of = 0, 0, None, _TagEnds(html)

    def put(text: str) -> None:
        if text:
            node = stack[-1]
            node.texts.append((len(node.children), unescape(text), links > 0))

    def close_to(depth: int) -> None:
        nonlocal links
        while len(names) > depth:
            name = names.pop()
            open_[name] -= 1
            if name == "a":
                links -= 1
            if nodes_at.pop():
                stack.pop()

    while True:
        found = _BEGIN.search(html, at)
        while found and found.start() > end_of.last and not html.startswith("<!--", found.start()):
            found = _BEGIN.search(html, found.end())  # nothing ends a tag from here on
        if not found:
            put(html[at:])
            break
        begin = found.start()
        put(html[at:begin])
        if html.startswith("<!--", begin):
            end = html.find("-->", begin + 4)
            at = end + 3 if end >= 0 else len(html)
            continue
        if html[begin + 1] in "!?":
            at = html.find(">", begin) + 1
            continue
        closing = html[begin + 1] == "/"
        found = _NAME.match(html, begin)
        name, end = found[1].lower(), end_of(found.end())
        rest, at = html[found.end() : end], end + 1
        if closing:
            if displaced[name] and not (len(names) == DEPTH and names[-1] == name):
                displaced[name] -= 1
            elif open_[name]:
                for k in range(len(names) - 1, 0, -1):
                    if names[k] == name:
                        close_to(k)
                        break
                    if names[k] in MAIN_TAGS and name not in ("body", "html", "main", "article"):
                        break
            continue
        if name in HIDDEN and name not in VOID:
            if name != "head":
                lower = html.lower() if lower is None else lower
                if len(lower) != len(html):  # some characters change length; then search without folding
                    end = re.compile(rf"</{re.escape(name)}", re.I).search(html, at)
                    end = end.start() if end else -1
                else:
                    end = lower.find(f"</{name}", at)
                at = len(html) if end < 0 else html.find(">", end) + 1 or len(html)
            continue
        if name in VOID:
            if name == "br":
                put(" ")
            elif name == "hr":
                stack[-1].children.append(Node("hr"))
            continue
        if name in _ENDS_P and open_["p"]:
            for k in range(len(names) - 1, 0, -1):
                if names[k] == "p":
                    close_to(k)
                    break
                if names[k] in _SCOPE:
                    break
        if name in _CLOSES:
            closed, scope = _CLOSES[name]
            for k in range(len(names) - 1, 0, -1):
                if names[k] in closed:
                    close_to(k)
                    if name != "tr":
                        break
                elif names[k] in scope:
                    break
        if rest.rstrip().endswith("/") and name in ("svg", "path"):
            continue
        if len(names) == DEPTH:
            displaced[names[-1]] += 1
            close_to(DEPTH - 1)
        names.append(name)
        open_[name] += 1
        if name == "a":
            links += 1
        if name in INLINE:
            nodes_at.append(0)
            continue
        attributes = _attributes(rest)
        role = attributes.get("role", "").lower()
        spoken = set(_BREAK.split(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()))
        cue = (name in BOILERPLATE and not (name == "header" and open_["article"])) or role in ROLES or bool(spoken & CUES and name not in ("body", "html", *MAIN_TAGS))
        cue = cue or "hidden" in attributes or attributes.get("aria-hidden") == "true"
        node = Node(name, cue, name in MAIN_TAGS or role in MAIN_ROLES)
        stack[-1].children.append(node)
        stack.append(node)
        nodes_at.append(1)
    return root


def blocks(node: Node, template: frozenset[int] | set[int] = frozenset()) -> list[str]:
    """Texts of a container's blocks in page order, without boilerplate or the nodes in ``template``."""
    out: list[str] = []
    stack: list[tuple[Node, int, int]] = [(node, 0, 0)]
    while stack:
        here, child, run = stack.pop()
        texts: list[str] = []
        while run < len(here.texts) and here.texts[run][0] <= child:
            texts.append(here.texts[run][1])
            run += 1
        joined = " ".join("".join(texts).split())
        if joined:
            out.append(joined)
        if child < len(here.children):
            stack.append((here, child + 1, run))
            below = here.children[child]
            if not below.cue and id(below) not in template:
                stack.append((below, 0, 0))
    return out


# A wrapper node is a list: tag, pages seen, pages with text, text while constant (else None), characters, characters in links, cue, main, children.
TAG, SEEN, TEXTED, TEXT, CHARS, LINKED, CUE, MAIN, CHILDREN = range(9)


def slots(node: Node) -> tuple[list, dict[int, list[Node]]]:
    """The wrapper of one page, and the page's nodes of each wrapper node. Neighbouring children of one shape are one repeated slot."""
    order: list[tuple[Node, list]] = []
    members: dict[int, list[Node]] = {}
    todo: list[tuple[Node, list | None]] = [(node, None)]
    while todo:
        here, parent = todo.pop()
        text = " ".join("".join(t for _, t, _ in here.texts).split())
        linked = sum(len(t.strip()) for _, t, l in here.texts if l)
        made = [here.tag, 1, int(bool(text)), text if len(text) <= 200 else f"#{hash_text(text)}", len(text), linked, here.cue, here.main, []]
        if parent is not None:
            parent[CHILDREN].append(made)
        order.append((here, made))
        members[id(made)] = [here]
        todo += [(child, made) for child in reversed(here.children)]
    shapes: dict[tuple, int] = {}
    shape: dict[int, int] = {}
    for _, made in reversed(order):
        children: list[list] = []
        for child in made[CHILDREN]:
            if children and shape[id(children[-1])] == shape[id(child)]:
                _merge(children[-1], child, members)
            else:
                children.append(child)
        made[CHILDREN] = children
        shape[id(made)] = shapes.setdefault((*_kind(made), *(shape[id(c)] for c in children)), len(shapes))
    return order[0][1], members


def _merge(a: list, b: list, members: dict[int, list[Node]]) -> None:
    """Adds a node of one page to a neighbour of the same shape."""
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        if x[TEXT] != y[TEXT]:
            x[TEXT] = None
        x[TEXTED] = max(x[TEXTED], y[TEXTED])
        x[CHARS] += y[CHARS]
        x[LINKED] += y[LINKED]
        members[id(x)] += members[id(y)]
        todo += zip(x[CHILDREN], y[CHILDREN], strict=True)


def as_wrapper(node: Node) -> list:
    """The wrapper of one page."""
    return slots(node)[0]


def hash_text(text: str) -> str:
    import hashlib

    return hashlib.sha1(text.encode("utf-8", "surrogatepass")).hexdigest()[:16]


def _kind(node: list) -> tuple:
    return node[TAG], node[CUE], node[MAIN]


def match(a: list, b: list) -> int:
    """Simple tree matching: the size of the largest common top-down subtree with order kept."""
    if _kind(a) != _kind(b):
        return 0
    x, y = a[CHILDREN], b[CHILDREN]
    if not x or not y:
        return 1
    weights = _weights(x, y)
    row = np.zeros(len(y) + 1, np.int64)
    for line in weights:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + line))
    return 1 + int(row[-1])


def _shape(node: list) -> tuple:
    return (*_kind(node), tuple(map(_shape, node[CHILDREN])))


def _weights(x: list, y: list) -> np.ndarray:
    """How well each two children match; children of one shape are looked at once."""
    shapes_x, shapes_y = [_shape(n) for n in x], [_shape(n) for n in y]
    places_x, places_y = {s: k for k, s in enumerate(dict.fromkeys(shapes_x))}, {s: k for k, s in enumerate(dict.fromkeys(shapes_y))}
    first_x, first_y = {s: n for s, n in zip(reversed(shapes_x), reversed(x), strict=True)}, {s: n for s, n in zip(reversed(shapes_y), reversed(y), strict=True)}
    few = np.array([[match(first_x[s], first_y[t]) for t in places_y] for s in places_x], np.int64)
    return few[np.ix_([places_x[s] for s in shapes_x], [places_y[t] for t in shapes_y])]


def _best(weights: np.ndarray) -> list[tuple[int, int]]:
    """The heaviest alignment of rows with columns in order; halved, so that space stays linear in what is aligned."""
    out, todo = [], [(0, weights.shape[0], 0, weights.shape[1])]
    while todo:
        top, bottom, left, right = todo.pop()
        if top == bottom or left == right:
            continue
        block = weights[top:bottom, left:right]
        if bottom - top == 1:
            at = int(block[0].argmax())
            if block[0, at] > 0:
                out.append((top, left + at))
            continue
        middle = (bottom - top) // 2
        ahead = np.zeros(right - left + 1, np.int64)
        for line in block[:middle]:
            ahead[1:] = np.maximum.accumulate(np.maximum(ahead[1:], ahead[:-1] + line))
        behind = np.zeros(right - left + 1, np.int64)
        for line in block[middle:][::-1, ::-1]:
            behind[1:] = np.maximum.accumulate(np.maximum(behind[1:], behind[:-1] + line))
        cut = int((ahead + behind[::-1]).argmax())
        todo += [(top, top + middle, left, left + cut), (top + middle, bottom, left + cut, right)]
    return sorted(out)


def _pairs(x: list, y: list) -> list[tuple[int, int]]:
    """Matched children: ends of one shape directly, which is never worse, the rest by tree matching."""
    shapes_x, shapes_y, head, tail = list(map(_shape, x)), list(map(_shape, y)), 0, 0
    while head < min(len(x), len(y)) and shapes_x[head] == shapes_y[head]:
        head += 1
    while tail < min(len(x), len(y)) - head and shapes_x[-1 - tail] == shapes_y[-1 - tail]:
        tail += 1
    inner_x, inner_y = x[head : len(x) - tail], y[head : len(y) - tail]
    inner = [(head + i, head + j) for i, j in _best(_weights(inner_x, inner_y))] if inner_x and inner_y else []
    return [(k, k) for k in range(head)] + inner + [(len(x) - k, len(y) - k) for k in range(tail, 0, -1)]


def _union(a: list, b: list) -> list:
    """Two aligned nodes as one; what is not matched stays as optional."""
    text = a[TEXT] if a[TEXT] == b[TEXT] else None
    pairs, children, i, j = _pairs(a[CHILDREN], b[CHILDREN]), [], 0, 0
    for p, q in [*pairs, (len(a[CHILDREN]), len(b[CHILDREN]))]:
        children += a[CHILDREN][i:p] + b[CHILDREN][j:q]
        if p < len(a[CHILDREN]):
            children.append(_union(a[CHILDREN][p], b[CHILDREN][q]))
        i, j = p + 1, q + 1
    return [a[TAG], a[SEEN] + b[SEEN], a[TEXTED] + b[TEXTED], text, a[CHARS] + b[CHARS], a[LINKED] + b[LINKED], a[CUE], a[MAIN], children]


def _pruned(top: list) -> list:
    """A wrapper of many nodes without those that few of its pages have."""
    count, todo = 0, [top]
    while todo:
        node = todo.pop()
        count += 1
        todo += node[CHILDREN]
    if count > NODES:
        todo = [top]
        while todo:
            node = todo.pop()
            node[CHILDREN] = [c for c in node[CHILDREN] if c[SEEN] >= RARE * top[SEEN]]
            todo += node[CHILDREN]
    return top


def fold(wrappers: Iterable[list]) -> list | None:
    """One wrapper of many, in the order given."""
    out = None
    for wrapper in wrappers:
        out = wrapper if out is None else _pruned(_union(out, wrapper))
    return out


def _marked(node: Node) -> list[Node]:
    """The outermost nodes marked as article or main, in page order, outside boilerplate; articles within a main win."""
    out, todo = [], [node]
    while todo:
        here = todo.pop()
        if here.main:
            inner = [x for c in here.children if not c.cue for x in _marked(c)] if here.tag != "article" else []
            out += inner or [here]
        else:
            todo += [c for c in reversed(here.children) if not c.cue]
    return out


def _linked(node: list) -> bool:
    return node[LINKED] > 0.6 * node[CHARS]


class Wrapper:
    """A host's wrapper with what it decides: ``container``, the node that holds the content, and ``template``, its constant nodes.

    ``container`` is None where the host has too few pages, or too little text that varies.
    """

    def __init__(self, top: list):
        self.top, self.container, self.template = top, None, set()
        order, todo = [], [top]
        while todo:
            node = todo.pop()
            order.append(node)
            todo += node[CHILDREN]
        if top[SEEN] < TEMPLATE_PAGES:
            return
        weight, raw, whole = {}, 0, 0  # of varying text below each node
        for node in reversed(order):
            varies = node[TEXT] is None or node[SEEN] < TEMPLATE_PAGES
            own = max(0, node[CHARS] - node[LINKED]) if node[CHARS] and not _linked(node) else 0
            whole += own
            raw += own if varies else 0
            if node[TEXT] and not varies and node[TAG] not in HEADINGS or node[CHARS] and _linked(node):
                self.template.add(id(node))
            factor = (CUE_WEIGHT if node[CUE] else 1.0) * (MAIN_WEIGHT if node[MAIN] else 1.0)
            weight[id(node)] = factor * ((own if varies else 0) + sum(weight[id(c)] for c in node[CHILDREN]))
        if raw < whole / 3:  # copies of a few pages: what varies is not the article
            self.template.clear()
            return
        here = top
        while True:
            best = max(here[CHILDREN], key=lambda c: weight[id(c)], default=None)
            within = sum(weight[id(c)] for c in here[CHILDREN]) + (max(0, here[CHARS] - here[LINKED]) if here[TEXT] is None else 0)
            if best is None or not weight[id(best)] or weight[id(best)] < HOLDS * within or best[TAG] in LEAVES:
                break
            here = best
        self.container = here


def align(root: Node, wrapper: list) -> dict[int, list]:
    """The wrapper node that each page node is matched with, by its identity; unmatched nodes are left out."""
    out: dict[int, list] = {}
    top, members = slots(root)
    todo = [(top, wrapper)]
    while todo:
        own, known = todo.pop()
        out.update((id(node), known) for node in members[id(own)])
        todo += [(own[CHILDREN][i], known[CHILDREN][j]) for i, j in _pairs(own[CHILDREN], known[CHILDREN])]
    return out


def _alone(root: Node) -> list[Node]:
    """What a page's own marks, or else its own text outside boilerplate, give as containers."""
    marked = _marked(root)
    if marked:
        return marked
    order, todo, chars = [], [root], {}
    while todo:
        node = todo.pop()
        order.append(node)
        todo += node.children
    for node in reversed(order):
        text = sum(len(t.strip()) for _, t, linked in node.texts if not linked)
        chars[id(node)] = 0 if node.cue else text + sum(chars[id(c)] for c in node.children)
    here = root
    while True:
        best = max(here.children, key=lambda c: chars[id(c)], default=None)
        if best is None or not chars[id(best)] or chars[id(best)] < 0.8 * chars[id(here)] or best.tag in LEAVES or sum(c.tag == best.tag for c in here.children) > 1:
            return [here]
        here = best


def extract(html: str | None, wrapper: Wrapper | None) -> str:
    """The main text of a page, given its host's wrapper."""
    root = parse(html)
    found: list[Node] = []
    template: set[int] = set()
    if wrapper is not None and wrapper.container is not None:
        known = align(root, wrapper.top)
        todo = [root]
        while todo:
            node = todo.pop()
            slot = known.get(id(node))
            if slot is wrapper.container:
                found.append(node)
            elif slot is not None:
                todo += reversed(node.children)
        template = {k for k, slot in known.items() if id(slot) in wrapper.template}
    return "\n\n".join(text for node in found or _alone(root) for text in blocks(node, template))


def _page_wrappers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wrapper of each page."""
    for batch in batches:
        made = [json.dumps(as_wrapper(parse(html.as_py())), separators=(",", ":")) for html in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string())], names=["host", "place", "wrapper"])


def _fold_wrappers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A wrapper for each group; rows arrive by (host, part, place)."""
    key, now, hosts, parts, made = None, None, [], [], []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(parts, pa.int64()), pa.array(made, pa.string())], names=["host", "place", "wrapper"])

    for batch in batches:
        for host, part, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (host, part) != key:
                if key is not None:
                    hosts.append(key[0])
                    parts.append(key[1])
                    made.append(json.dumps(now, separators=(",", ":")))
                key, now = (host, part), json.loads(text)
            else:
                now = _pruned(_union(now, json.loads(text)))
        yield out()
        hosts, parts, made = [], [], []
    if key is not None:
        hosts, parts, made = [key[0]], [key[1]], [json.dumps(now, separators=(",", ":"))]
        yield out()


def wrappers(pages: DataFrame, fan: int = FOLD) -> DataFrame:
    """``(host, wrapper)``: one wrapper for each host, as JSON; ``pages`` has ``host``, ``url`` and ``html``.

    A page's place among those of its host is a hash of its URL and html; equal
    places are equal pages, or as good as.
    """
    schema = "host string, place bigint, wrapper string"
    state = saved(pages.select("host", F.xxhash64("url", "html").alias("place"), "html").mapInArrow(_page_wrappers, schema), "wrappers")
    while True:
        counts = saved(state.groupBy("host").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "wrapper-counts")
        if counts.isEmpty():
            return state.select("host", "wrapper")
        many = looked_up(state, counts, ["host"], "_n").withColumn("_part", F.pmod("place", F.ceil(F.col("_n") / fan).cast("long")))
        folded = many.select("host", "_part", "place", "wrapper").repartition("host", "_part").sortWithinPartitions("host", "_part", "place", "wrapper")
        folded = folded.select("host", "_part", "wrapper").mapInArrow(_fold_wrappers, schema)
        after = saved(state.join(small_side(counts.select("host")), "host", "left_anti").unionByName(folded), "wrappers")
        discard(state, counts)
        state = after


#: Wrappers may be broadcast up to so many characters; beyond that, so many pages of a host are dealt to one task.
BROADCAST_CHARS, DEALT_PAGES = 16_000_000, 5_000


def _paired(own: DataFrame, known: DataFrame) -> DataFrame:
    """Every page with its host's wrapper. Where these are too many to broadcast, the pages of a large host are dealt to several keys, and its wrapper to each."""
    size = known.agg(F.sum(F.length("wrapper"))).first()[0] or 0
    if size <= BROADCAST_CHARS:
        return own.join(F.broadcast(known), "host")
    deals = F.ceil(F.get_json_object("wrapper", f"$[{SEEN}]").cast("long") / DEALT_PAGES)
    large = saved(known.select("host", deals.alias("_deals")).where("_deals > 1"), "wrapper-deals")
    dealt = own.join(small_side(large), "host", "left").withColumn("_deal", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("_deals", F.lit(1))))
    spread = known.withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(deals, F.lit(1)) - 1)))
    return dealt.join(spread, ["host", "_deal"])


def extracted(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text)`` for every page."""
    own = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    known = wrappers(own)
    paired = _paired(own, known).select("page_id", "url", "html", "wrapper")
    id_type = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str, Wrapper] = {}
        for batch in batches:
            texts = []
            for html, wrapper in zip(batch.column(2), batch.column(3), strict=True):
                text = wrapper.as_py()
                if text not in parsed:
                    if len(parsed) > 500:
                        parsed.clear()
                    parsed[text] = Wrapper(json.loads(text))
                texts.append(extract(html.as_py(), parsed[text]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return paired.mapInArrow(run, f"page_id {id_type}, url string, text string")


def op5_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of every page and its length."""
    return extracted(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
