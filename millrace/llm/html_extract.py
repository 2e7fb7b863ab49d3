"""Main text of web pages by wrapper induction.

Pages become small trees of block elements: inline markup is flattened, and siblings of one label fold into one node. Trees of one host that are alike
add up; unlike ones are aligned by simple tree matching and merged, all of them, into the host's wrapper. As folded siblings have different labels and stand in the order
of these, a matching may pair all that have one label: two nodes match just if the labels from the root down to them are the same. So trees merge to the same wrapper in any
order, in one task or in many, and parts of wrappers add up by these paths. A wrapper's nodes remember on how many
pages they had text, how much of it, how much of that in links, and a sketch of the different texts: one text on all pages is template, varying ones are slots. The
content region is where the varying text outside links lies: from the root, the wrapper is followed into the child that holds most of it, as long as there is one. A page's
text is what lies in its slots of that region, but for template and for slots of links; menus, adverts and footers go as they lie elsewhere. Hosts of few pages
use a wrapper of all hosts, and pages that their wrapper does not fit one of their own.
"""

from __future__ import annotations

import json
import pickle
import re
from collections.abc import Iterable, Iterator
from html import unescape
from itertools import groupby, islice

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import prepare, small, written

# A quote opens a value only behind an equals sign; whatever is left open ends with the page.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

# Element names of the HTML standard.
SKIPPED = frozenset("script style template noscript head title svg math iframe object canvas audio video select option textarea button datalist".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br nobr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 hgroup header pre blockquote figure figcaption ul ol li dl dt dd table thead tbody tfoot tr td th caption details summary address".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header".split())
MAIN = frozenset(("article", "main"))
ASIDE = frozenset("nav footer aside form menu dialog address".split())
ASIDE_WORDS = frozenset("ad ads advert advertisement adverts adv banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer form header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup popular promo promotion related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split())

MIN_PAGES = 3
"""A host has a wrapper of its own, and a text is template, only with so many pages."""
DEPTH = 150
"""Elements nested deeper are parts of their ancestor at this depth; no text is lost."""
MOST_HELD = 100_000
"""Nodes of trees that a task holds before it hands them on."""
MANY_SLOTS = 1000
"""A wrapper with more slots to leave out is not sent along with each page: the page's own nodes are joined with them."""
MOST_BROADCAST = 500_000
"""Slots to leave out in all wrappers that are broadcast at once; more are joined by a shuffle."""
TEXTS = 4
"""Hashes in the sketch of a node's texts."""
DOMINANT, DOMINANT_MAIN = 0.6, 0.3
"""Share of a node's varying text that a child must hold to be followed; less is asked of the standard's article and main elements."""
BESIDE = 0.05
"""Share of it that may stand beside such a child in paragraphs, lists or tables."""


class Node:
    __slots__ = ("children", "label", "links", "runs", "size")

    def __init__(self, label: str) -> None:
        self.label, self.children, self.runs, self.links, self.size = label, [], [], 0, 0


def _label(tag: str, attributes: str) -> str:
    """Element name and the words of class, id and role; numbers in them do not tell nodes apart."""
    if not attributes:
        return tag
    words = []
    for name, *values in ATTRIBUTE.findall(attributes):
        words += [f"{name.lower()[0]}={re.sub('[0-9]+', '0', w.lower())}" for w in " ".join(values).split()]
    return " ".join([tag, *sorted(set(words))]) if words else tag


def parse(html: str) -> Node:
    """The tree of block elements; a node's runs are its own pieces of text and its children, in page order. Time is in proportion to the page."""
    root = Node("page")
    stack: list[tuple[str, Node]] = [("page", root)]
    opened: dict[str, int] = {}
    last_end: dict[str, int] = {}
    anchors, position, skip = 0, 0, ""
    lower = html.lower() if len(html.lower()) == len(html) else re.sub("[A-Z]", lambda m: m[0].lower(), html)

    def put(piece: str) -> None:
        if piece and not skip:
            top = stack[-1][1]
            if top.runs and isinstance(top.runs[-1], list):
                top.runs[-1].append(piece)
            else:
                top.runs.append([piece])
            top.size += len(piece)
            top.links += len(piece) * bool(anchors)

    def pop() -> None:
        tag, node = stack.pop()
        opened[tag] -= 1
        if node is stack[-1][1]:
            node.runs.append(None)

    n = len(html)
    while position < n:
        m = TOKEN.search(html, position)
        if m is None:
            put(unescape(html[position:]))
            break
        if m.start() > position:
            put(unescape(html[position : m.start()]))
        position = m.end()
        if m[1] is not None:
            put(m[1])
        if not m[3]:
            continue
        tag, closing = m[3].lower(), bool(m[2])
        if skip:
            if closing and tag == skip:
                skip = ""
            continue
        if tag in SKIPPED:
            if not closing and not m[4].endswith("/"):
                if tag not in last_end:
                    last_end[tag] = lower.rfind(f"</{tag}")
                if last_end[tag] < position:
                    position = n if tag in RAW else position
                elif tag in RAW:
                    at = lower.find(f"</{tag}", position)
                    end = html.find(">", at)
                    position = end + 1 if end >= 0 else n
                else:
                    skip = tag
            continue
        if tag in INLINE:
            if tag == "br":
                put(" ")
            elif tag == "a":
                anchors = max(0, anchors + (-1 if closing else 1))
            continue
        if tag in VOID:
            if tag == "hr":
                stack[-1][1].runs.append(None)
            continue
        if closing:
            if opened.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
                anchors = 0
            else:
                stack[-1][1].runs.append(None)
            continue
        if tag in CLOSES_P and stack[-1][0] == "p" or tag in ("li", "dt", "dd", "tr", "td", "th") and stack[-1][0] == tag:
            pop()
        if tag in ("html", "body"):
            continue
        anchors = 0
        top = stack[-1][1]
        if len(stack) > DEPTH:
            top.runs.append(None)
            node = top
        else:
            node = Node(_label(tag, m[4]))
            top.runs.append(node)
            top.children.append(node)
        stack.append((tag, node))
        opened[tag] = opened.get(tag, 0) + 1
    return root


def _text(run: list[str]) -> str:
    return " ".join("".join(run).split())


# a shape: [label, sketch of texts, pages with text, characters, of these in links, children]


def shape(node: Node) -> list:
    """The shape of a page; siblings of one label are one node of it, with one text, in the order of the labels."""

    def build(nodes: list[Node]) -> list:
        own = [t for x in nodes for r in x.runs if isinstance(r, list) and (t := _text(r))]
        sizes, links = sum(map(len, own)), 0
        for x in nodes:
            links += x.links * sum(len(_text(r)) for r in x.runs if isinstance(r, list)) // x.size if x.links else 0
        groups: dict[str, list[Node]] = {}
        for x in nodes:
            for c in x.children:
                groups.setdefault(c.label, []).append(c)
        children = [build(g) for _, g in sorted(groups.items())]
        return [nodes[0].label, [xxhash.xxh3_64_intdigest("\n".join(own).encode("utf-8", "surrogatepass")) >> 12] if own else [], int(bool(own)), sizes, links, children]

    return build([node])


def skeleton(s: list) -> list:
    return [s[0], [skeleton(c) for c in s[5]]]


def _joined(a: list[int], b: list[int]) -> list[int]:
    return sorted({*a, *b})[:TEXTS]


def add(a: list, b: list) -> None:
    """Add what b knows to a, of the same skeleton; the order of adding does not matter."""
    a[1], a[2], a[3], a[4] = _joined(a[1], b[1]), a[2] + b[2], a[3] + b[3], a[4] + b[4]
    for x, y in zip(a[5], b[5], strict=True):
        add(x, y)


def pairs_of(a: list, b: list) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: size of the largest order-keeping match of two trees, and the pairs of their children in it."""
    if a[0] != b[0]:
        return 0, []
    # only children whose label the other has can match
    left, right = {c[0] for c in a[5]}, {c[0] for c in b[5]}
    rows = [(i, c) for i, c in enumerate(a[5]) if c[0] in right]
    columns = [(j, c) for j, c in enumerate(b[5]) if c[0] in left]
    if len(rows) == len(columns) and all(x[0] == y[0] for (_, x), (_, y) in zip(rows, columns, strict=True)) and len({c[0] for _, c in rows}) == len(rows):
        return 1 + sum(pairs_of(x, y)[0] for (_, x), (_, y) in zip(rows, columns, strict=True)), [(i, j) for (i, _), (j, _) in zip(rows, columns, strict=True)]
    w = [[pairs_of(x, y)[0] if x[0] == y[0] else 0 for _, y in columns] for _, x in rows]
    best = [[0] * (len(columns) + 1) for _ in range(len(rows) + 1)]
    for i in range(len(rows)):
        for j in range(len(columns)):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + w[i][j])
    found, i, j = [], len(rows), len(columns)
    while i and j:
        if w[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + w[i - 1][j - 1]:
            found.append((rows[i - 1][0], columns[j - 1][0]))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return 1 + best[-1][-1], found[::-1]


def merge(a: list, b: list) -> list:
    """Wrapper of what two wrappers cover: matched nodes join, unmatched ones stay beside them, in the order of their labels."""
    children, done_a, done_b = [], 0, 0
    for i, j in pairs_of(a, b)[1]:
        children += a[5][done_a:i] + b[5][done_b:j] + [merge(a[5][i], b[5][j])]
        done_a, done_b = i + 1, j + 1
    return [a[0], _joined(a[1], b[1]), a[2] + b[2], a[3] + b[3], a[4] + b[4], sorted(children + a[5][done_a:] + b[5][done_b:], key=lambda c: c[0])]


def _nodes(s: list) -> int:
    return 1 + sum(map(_nodes, s[5]))


def wrapper_of(shapes: list[list]) -> list:
    """The wrapper folded from all different trees of a host, in pairs; any order of the same trees gives the same one."""
    while len(shapes) > 1:
        shapes = [merge(*shapes[i : i + 2]) if i + 1 < len(shapes) else shapes[i] for i in range(0, len(shapes), 2)]
    return shapes[0]


def _aside(label: str) -> bool:
    tag, *words = label.split(" ")
    if tag in ASIDE or (tag == "header" and not words):
        return True
    return any(part in ASIDE_WORDS for w in words for part in re.split(r"[=_\-]+", w)[1:])


def _aside_inside(label: str) -> bool:
    """As _aside, but an article may have a header and an address."""
    return label not in ("header", "address") and _aside(label)


# A path is the codes of the labels from the root down: one byte of what the label says, seven of its hash. Sorted paths are in an order of the tree.
CODE = 8
IS_HEADING, IS_ASIDE, IS_ASIDE_INSIDE, IS_MAIN, IS_ARTICLE, IS_BLOCK = 1, 2, 4, 8, 16, 32


def _code(label: str, codes: dict[str, bytes]) -> bytes:
    if label not in codes:
        if len(codes) > MOST_HELD:
            codes.clear()
        tag = label.split(" ", 1)[0]
        says = (tag in HEADINGS, _aside(label), _aside_inside(label), tag in MAIN, tag in MAIN - {"main"}, tag in TEXT_BLOCKS)
        codes[label] = bytes([sum(bit << i for i, bit in enumerate(says))]) + xxhash.xxh3_64_digest(label.encode("utf-8", "surrogatepass"))[1:]
    return codes[label]


def _spot(path: bytes) -> str:
    return xxhash.xxh3_64_hexdigest(path)


def rows_of(wrapper: list, codes: dict[str, bytes]) -> Iterator[tuple]:
    """(path, least and greatest hash of the texts, pages, characters, of these in links) of the wrapper's nodes with text; a node comes before those below it, and these follow at once."""
    below = [(b"", wrapper)]
    while below:
        path, s = below.pop()
        if s[1]:
            yield path, s[1][0], s[1][-1], *s[2:5]
        below += [(path + _code(c[0], codes), c) for c in s[5]]


class _Open:
    """What is known of a node while its rows are read. Pairs are for places outside and inside the article."""

    __slots__ = ("beside", "best", "code", "mass", "own", "reach", "varied")

    def __init__(self, code: bytes) -> None:
        self.code, self.own, self.varied, self.reach = code, False, False, 0
        self.mass, self.beside = [0, 0], [0, 0]
        self.best: list[list] = [[None, None], [None, None]]

    @classmethod
    def of(cls, row: tuple) -> _Open:
        """What a node's own row says."""
        path, low, high, pages, chars, links = row
        out = cls(path[-CODE:] or bytes(CODE))
        out.own, out.reach = low != high, pages
        if not (low == high and pages >= MIN_PAGES or links > 0.5 * chars):
            out.mass = [chars - links] * 2
        return out

    def join(self, other: _Open) -> None:
        """Add what is known of the same node from other rows."""
        self.own, self.varied, self.reach = self.own or other.own, self.varied or other.varied, max(self.reach, other.reach)
        for x in (0, 1):
            self.mass[x] += other.mass[x]
            self.beside[x] += other.beside[x]
            for k, c in enumerate(other.best[x]):
                self._follow(x, k, c)

    def _follow(self, x: int, k: int, c: tuple | None) -> None:
        best = self.best[x]
        if c and (best[k] is None or (-c[0], c[1]) < (-best[k][0], best[k][1])):
            best[k] = c

    def close(self) -> list[tuple[bytes, bool]]:
        """The content region seen from here, as the path down to it, and whether text varies there: into the child that holds most of the varying text, while there is one and no text stands beside it."""
        out = []
        for x in (0, 1):
            fit = [c for c, share in zip(self.best[x], (DOMINANT, DOMINANT_MAIN), strict=True) if c and c[0] >= share * self.mass[x]]
            if not fit or self.beside[x] > BESIDE * self.mass[x] or self.code[0] & IS_ARTICLE:
                out.append((b"", self.own or self.varied))
            else:
                _, code, (steps, varied) = min(fit, key=lambda c: (-c[0], c[1]))
                out.append((code + steps, varied))
        return out

    def take(self, child: _Open) -> None:
        """Varying text outside links counts, but for asides."""
        found, says = child.close(), child.code[0]
        for x in (0, 1):
            m = 0 if says & (IS_ASIDE_INSIDE if x else IS_ASIDE) else child.mass[x]
            self.mass[x] += m
            if says & IS_BLOCK:
                self.beside[x] += 0 if says & IS_HEADING else m
            elif m:
                main = bool(says & IS_MAIN)
                self._follow(x, main, (m, child.code, found[x or main]))
        self.varied, self.reach = self.varied or child.own or child.mass[0] > 0, max(self.reach, child.reach)


def open_nodes(items: Iterable[tuple[bytes, _Open]], whole: bool) -> Iterator[tuple[bytes, _Open]]:
    """Nodes that sorted items leave open, these summed up: the root if they are the whole tree, else all that have the first or the last item in them, as the rest of their items may be elsewhere. Only the nodes above the present item are held."""
    stack: list[tuple[bytes, _Open]] = [(b"", _Open(bytes(CODE)))]
    first, at = None, b""
    for path, known in items:
        first = path if first is None else first
        same, least = 0, min(len(at), len(path))
        while same < least and at[same : same + CODE] == path[same : same + CODE]:
            same += CODE
        while len(stack) > same // CODE + 1:
            place, child = stack.pop()
            if not whole and first.startswith(place):
                yield place, child
            else:
                stack[-1][1].take(child)
        for i in range(same, len(path), CODE):
            stack.append((path[: i + CODE], _Open(path[i : i + CODE])))
        stack[-1][1].join(known)
        at = path
    while whole and len(stack) > 1:
        _, child = stack.pop()
        stack[-1][1].take(child)
    yield from stack


def region_of(items: Iterable[tuple[bytes, _Open]]) -> tuple[bytes, bool, int]:
    """The content region of a wrapper, whether text varies there, and the most pages that a node had text on."""
    ((_, root),) = open_nodes(items, True)
    return *root.close()[0], root.reach


def _heading(code: bytes, above: bytes) -> bool:
    """Headings beside the way to the region, above, may come along."""
    inside = any(above[i] & IS_MAIN for i in range(0, len(above), CODE))
    return bool(code[0] & IS_HEADING) and not code[0] & (IS_ASIDE_INSIDE if inside else IS_ASIDE)


def left_out(row: tuple, steps: bytes, varied: bool) -> bool:
    """A slot of the region, or of headings beside the way to it, that is template or links."""
    path, low, high, pages, chars, links = row
    constant, linked = low == high and pages >= MIN_PAGES, links > 0.5 * chars
    if not constant and not linked:
        return False
    if path.startswith(steps):
        if path == steps or pages < MIN_PAGES or not (linked or varied):
            return False
        start = len(steps)
    else:
        start = 0
        while path[start : start + CODE] == steps[start : start + CODE]:
            start += CODE
        if start == len(path) or not _heading(path[start : start + CODE], steps[:start]):
            return False
        start += CODE
    return not any(path[i] & IS_ASIDE_INSIDE for i in range(start, len(path), CODE))


def _places(root: Node, steps: bytes, codes: dict[str, bytes]) -> Iterator[tuple[bytes, list[str]]]:
    """(path, piece of text) of the page in the region and in headings before it, in page order."""

    def region(node: Node, path: bytes) -> Iterator[tuple[bytes, list[str]]]:
        for run in node.runs:
            if isinstance(run, list):
                yield path, run
            elif run is not None and not (code := _code(run.label, codes))[0] & IS_ASIDE_INSIDE:
                yield from region(run, path + code)

    def way(node: Node, path: bytes) -> Iterator[tuple[bytes, list[str]]]:
        if len(path) == len(steps):
            yield from region(node, path)
            return
        step = steps[len(path) : len(path) + CODE]
        before: set[bytes] = set()
        for c in node.children:
            code = _code(c.label, codes)
            if code == step:
                break
            before.add(code)
        for c in node.children:
            code = _code(c.label, codes)
            if code == step:
                yield from way(c, path + code)
            elif code in before and _heading(code, path):
                yield from region(c, path + code)

    return way(root, b"")


def _words_in(root: Node, steps: bytes, out_of: frozenset[str], codes: dict[str, bytes]) -> list[str]:
    """Text of the page in the region's slots, block by block, in page order."""
    seen: dict[bytes, bool] = {}
    out: list[str] = []
    for path, run in _places(root, steps, codes):
        if out_of and path not in seen:
            seen[path] = _spot(path) in out_of
        if not seen.get(path) and (text := _text(run)):
            out.append(text)
    return out


def slots_of(wrapper: list, codes: dict[str, bytes]) -> tuple[bytes, frozenset[str]]:
    """The content region of a wrapper, and the slots to leave out of it."""
    rows = list(rows_of(wrapper, codes))
    steps, varied, _ = region_of((r[0], _Open.of(r)) for r in rows)
    return steps, frozenset(_spot(r[0]) for r in rows if left_out(r, steps, varied))


def _extracted(html: str, steps: bytes | None, out_of: frozenset[str], codes: dict[str, bytes]) -> str:
    root = parse(html)
    if steps is not None and (out := _words_in(root, steps, out_of, codes)):
        return "\n".join(out)
    return "\n".join(_words_in(root, *slots_of(shape(root), codes), codes))


def extract(html: str, wrapper: list | None) -> str:
    """The page's text in the wrapper's content region; without a wrapper, or where it does not fit, that in the page's own."""
    codes: dict[str, bytes] = {}
    return _extracted(html, *(slots_of(wrapper, codes) if wrapper is not None else (None, frozenset())), codes)


ALL_HOSTS = "/"
"""No host has such a name."""
_NODES = "host string, path binary, low long, high long, pages long, chars long, links long"


def _collect(found: dict[tuple[str, int], list], host: str, key: int, s: list) -> bool:
    """Whether the tree is a new one."""
    if (host, key) in found:
        add(found[host, key], s)
        return False
    found[host, key] = s
    return True


def _packed(found: dict[tuple[str, int], list], codes: dict[str, bytes]) -> Iterator[pa.RecordBatch]:
    """The trees of each host folded, as rows."""
    hosts: dict[str, list] = {}
    for (host, _), s in found.items():
        hosts.setdefault(host, []).append(s)
    rows = ((host, *r) for host, shapes in hosts.items() for r in rows_of(wrapper_of(shapes), codes))
    while part := list(islice(rows, 10_000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), [pa.string(), pa.binary(), *[pa.int64()] * 5], strict=True)], names=["host", "path", "low", "high", "pages", "chars", "links"])


def _nodes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages of one host and skeleton added up, those of one host folded."""
    found: dict[tuple[str, int], list] = {}
    codes: dict[str, bytes] = {}
    held = 0
    for batch in batches:
        for host, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            s = shape(parse(html))
            if _collect(found, host, xxhash.xxh3_64_intdigest(json.dumps(skeleton(s))), s):
                held += _nodes(s)
            if held > MOST_HELD:
                yield from _packed(found, codes)
                found, held = {}, 0
    yield from _packed(found, codes)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in ranges, sorted by host and path: the nodes that a range leaves open."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for host, own in groupby(rows, key=lambda r: r[0]):
        left = [(path, pickle.dumps(n)) for path, n in open_nodes(((r[1], _Open.of(r[1:])) for r in own), False)]
        yield pa.RecordBatch.from_arrays([pa.array([host] * len(left), pa.string()), pa.array([p for p, _ in left], pa.binary()), pa.array([n for _, n in left], pa.binary())], names=["host", "path", "known"])


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by host and path: a region for each host."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for host, own in groupby(rows, key=lambda r: r[0]):
        steps, varied, pages = region_of((path, pickle.loads(known)) for _, path, known in own)
        yield pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([steps], pa.binary()), pa.array([varied], pa.bool_()), pa.array([pages], pa.int64())], names=["host", "steps", "varied", "reach"])


def _left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
        kept = [(host, _spot(row[0])) for host, *row, steps, varied in rows if left_out(tuple(row), steps, varied)]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in kept], pa.string()), pa.array([s for _, s in kept], pa.string())], names=["host", "spot"])


def _added(by: list[str], nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(*by).agg(F.min("low").alias("low"), F.max("high").alias("high"), *[F.sum(c).alias(c) for c in ("pages", "chars", "links")])


def wrappers_of(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, steps, slots, out_of) of every host of MIN_PAGES pages, and of all hosts together: the way to the region, the number of slots to leave out, and these, but for wrappers of MANY_SLOTS; and (host, spot), all of these slots.

    Each task folds the trees of its pages; the folded nodes add up by host and path. They are read in sorted ranges, and what a range leaves open, the nodes above its
    first and its last row, is put together by host. So neither a hot host's pages nor its different trees or nodes are ever in one task.
    """
    own = written(_added(["host", "path"], pages.select("host", "html").mapInArrow(_nodes_of, _NODES)), "nodes")
    every = written(_added(["path"], own).select(F.lit(ALL_HOSTS).alias("host"), "path", "low", "high", "pages", "chars", "links"), "nodes")
    nodes = own.unionByName(every)
    parts = nodes.repartitionByRange("host", "path").sortWithinPartitions("host", "path").mapInArrow(_parts, "host string, path binary, known binary")
    regions = written(parts.repartition("host").sortWithinPartitions("host", "path").mapInArrow(_regions, "host string, steps binary, varied boolean, reach long"), "regions").where((F.col("host") == ALL_HOSTS) | (F.col("reach") >= MIN_PAGES))
    template = nodes.where(((F.col("low") == F.col("high")) & (F.col("pages") >= MIN_PAGES)) | (2 * F.col("links") > F.col("chars")))
    out = written(template.join(small(regions.select("host", "steps", "varied")), "host").mapInArrow(_left_out, "host string, spot string"), "slots")
    counts = out.groupBy("host").agg(F.count("*").alias("slots"))
    lists = out.join(counts.where(F.col("slots") <= MANY_SLOTS).select("host"), "host", "left_semi").groupBy("host").agg(F.array_join(F.sort_array(F.collect_list("spot")), "").alias("out_of"))
    return written(regions.join(counts, "host", "left").join(lists, "host", "left").select("host", "steps", F.coalesce("slots", F.lit(0)).alias("slots"), F.coalesce("out_of", F.lit("")).alias("out_of")), "wrappers"), out


def _spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of each page's text in its region."""
    codes: dict[str, bytes] = {}
    for batch in batches:
        asked: list[tuple] = []
        for host, steps, page, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            asked += [(host, page, _spot(path)) for path in {path for path, _ in _places(parse(html), steps, codes)}]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in asked], pa.string()) for i in range(3)], names=["host", "page", "spot"])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, frozenset[str]] = {}
    codes: dict[str, bytes] = {}
    for batch in batches:
        ids, urls, pages, ways, outs = (c.to_pylist() for c in batch.columns)
        texts = []
        for html, steps, out_of in zip(pages, ways, outs, strict=True):
            if out_of not in known:
                if len(known) > 500:
                    known.clear()
                known[out_of] = frozenset(out_of[i : i + 16] for i in range(0, len(out_of), 16))
            texts.append(_extracted(html, steps, known[out_of], codes))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """Main text of each page: page_id, url, text, n_chars.

    Null html is an empty page with an empty text; pages without a host (null or odd url) share one
    wrapper; repeated pages are extracted one by one; further columns, whatever their names, are ignored; an empty table
    gives no rows. Hosts of fewer than MIN_PAGES pages use the wrapper of all hosts together. Reruns agree: a wrapper is the same in any order of its trees.
    """
    prepare(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit("")).alias("host"))
    known, out = wrappers_of(rows)
    wrapper = F.struct("host", "steps", "slots", "out_of")
    own = known.where(F.col("host") != ALL_HOSTS).select("host", wrapper.alias("own"))
    every = known.where(F.col("host") == ALL_HOSTS).select(wrapper.alias("every"))  # one row
    size, most = known.agg(F.sum(1 + F.length("out_of") / 16), F.max("slots")).first()
    joined = rows.join(F.broadcast(own) if (size or 0) <= MOST_BROADCAST else own, "host", "left").join(F.broadcast(every), F.lit(True), "left")
    joined = joined.select("page_id", "url", "html", F.coalesce("own", "every").alias("w")).select("page_id", "url", "html", "w.*")
    few = joined
    if (most or 0) > MANY_SLOTS:
        # equal pages of a host leave out the same slots
        many = joined.where(F.col("slots") > MANY_SLOTS).withColumn("page", F.sha2("html", 256))
        asked = many.select("host", "steps", "page", "html").mapInArrow(_spots, "host string, page string, spot string").distinct()
        found = asked.join(out, ["host", "spot"]).groupBy("host", "page").agg(F.array_join(F.sort_array(F.collect_list("spot")), "").alias("found"))
        named = many.join(found, ["host", "page"], "left").withColumn("out_of", F.coalesce("found", F.lit("")))
        few = joined.where(F.coalesce("slots", F.lit(0)) <= MANY_SLOTS).select("page_id", "url", "html", "steps", "out_of").union(named.select("page_id", "url", "html", "steps", "out_of"))
    return few.select("page_id", "url", "html", "steps", F.coalesce("out_of", F.lit(""))).mapInArrow(_apply, "page_id long, url string, text string, n_chars long")
