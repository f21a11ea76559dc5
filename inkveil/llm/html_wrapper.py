"""Main text of web pages by wrapper induction.

Pages are parsed to trees. Each page is aligned by simple tree matching with its host's reference, one page for the whole
table (the one whose content has the least hash, so no split of the input changes it): two nodes match if their tags do,
and children are matched in order so that most nodes match. A matched node whose own text is the same in both pages is
constant, another one varies. The varying characters of (host, path) are added up over all pages; they tell which part
of a host's template is its slot for content, and the slot decides what a page's text is. Article and main tags are a
check (the slot isn't cut narrower than one that holds half of the varying text) and the fallback for pages without a
slot: hosts of one content, pages without a host, hosts without a common part below body, and pages that lack the slot.

A second pass finds what repeats inside the slot: a leaf node of the reference's slot that nearly all other texts of the
host's slot have too is template. Texts are counted once, however many pages hold them, so copies are no evidence.

References are broadcast while they are small, so no page is moved; only sums, and the repeated nodes, are shuffled.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.session import Scratch, ship

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed", "noframes"))
#: Elements that are never article text.
OTHER = frozenset("head nav footer aside form script style noscript iframe template textarea select button object canvas svg dialog menu title".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: What a start tag closes: the open elements of the second kind, up to the limits of the third.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}
ENDS_P = BLOCK - {"br", "body", "html", "head", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option"}
#: Words of class names, ids and roles that mark something other than the article.
MARKS = frozenset("ad ads advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices popup promo promotion related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
ARTICLE = ("article", "main")
#: A constant node is taken for template inside the slot only on hosts of so many different texts, in so many of them.
TEMPLATE_PAGES, TEMPLATE_SHARE = 20, 0.98
#: Characters of all references together up to which they are broadcast.
BROADCAST_CHARS = 32 << 20
#: Levels of elements that paths name; deeper elements go by the path of the one at that level.
PATH_LEVELS = 100
#: Pairs of tree shapes whose best alignment a worker remembers before it starts anew.
REMEMBERED = 200_000
#: Pairs of children up to which plain loops are quicker than arrays.
FEW_PAIRS = 1024

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_STOP = re.compile(r"[>\"']")
_MARK = re.compile(r"""\b(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORDS = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("children", "level", "marked", "path", "tag")

    def __init__(self, tag: str, marked: bool, path: str, level: int = 0) -> None:
        self.tag, self.marked, self.path, self.level = tag, marked, path, level
        self.children: list[Node | str] = []

    def own_text(self) -> str:
        return " ".join(" ".join(c for c in self.children if isinstance(c, str)).split())

    def elements(self) -> list[Node]:
        return [c for c in self.children if not isinstance(c, str)]


def _marked(tag: str, attributes: str) -> tuple[bool, str]:
    """Whether attributes mark something other than the article, and the class by which its path is named."""
    name = ""
    if not attributes:
        return False, name
    for key, value in _MARK.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "class":
            name = ".".join(value.split()[:1])
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True, name
        if key in ("class", "id", "role") and tag not in ("html", "body", *ARTICLE) and not MARKS.isdisjoint(_WORDS.findall(value)):
            return True, name
    return False, name


class _Finder:
    """Places of substrings in a page; one that isn't there any more is not looked for again."""

    def __init__(self, page: str) -> None:
        self.page, self.gone = page, set()

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """Where the tag ends whose attributes begin at a place: at the first > that isn't quoted; a quote that is never closed is none."""
        begin = at
        while (m := _STOP.search(self.page, at)) is not None:
            if m[0] == ">":
                return m.start()
            at = self.find(m[0], m.end()) + 1
            if not at:
                return self.find(">", begin)
        return self.find(">", begin)


def _tokens(page: str) -> Iterator[tuple]:
    """("text", text), ("open", tag, attributes) and ("close", tag), in one pass over a page; raw elements' text is theirs as it is."""
    finder, at, size, text = _Finder(page), 0, len(page), 0
    while at < size:
        start = page.find("<", at)
        if start < 0:
            break
        after = page[start + 1 : start + 2]
        close = after == "/"
        name = _NAME.match(page, start + 1 + close)
        if name is None and after not in ("!", "?", "/"):
            at = start + 1  # a lone sign is text
            continue
        if start > text:
            yield "text", html.unescape(page[text:start])
        if name is None:
            if page.startswith("<!--", start):
                end = finder.find("-->", start + 4)
                at = size if end < 0 else end + 3
            elif page.startswith("<![CDATA[", start) and (end := finder.find("]]>", start)) >= 0:
                yield "text", page[start + 9 : end]
                at = end + 3
            else:
                end = finder.find(">", start)
                at = size if end < 0 else end + 1
            text = at
            continue
        end = finder.tag_end(name.end())
        if end < 0:  # a tag that never ends
            return
        tag = name[0].lower()
        at = text = end + 1
        if close:
            yield "close", tag
            continue
        yield "open", tag, page[name.end() : end]
        if tag in RAW:
            m = re.compile(rf"</{tag}\b[^>]*+>", re.I).search(page, at)
            inner = page[at : m.start() if m else size]
            if inner:
                yield "text", html.unescape(inner) if tag in ("title", "textarea") else inner
            yield "close", tag
            at = text = m.end() if m else size
    if text < size:
        yield "text", html.unescape(page[text:])


def parse(page: str) -> Node:
    """The tree of a page; whatever it leaves open or closes too often is put right as browsers do, roughly.

    The work is in proportion to the page: closing tags of what isn't open are passed over by a count of what is. A slash
    at the end of a start tag means nothing, as in browsers.
    """
    root = Node("#", False, "")
    open_, count = [root], defaultdict(int)

    def shut(k: int) -> None:
        for n in open_[k:]:
            count[n.tag] -= 1
        del open_[k:]

    for kind, tag, *rest in _tokens(page):
        if kind == "text":
            open_[-1].children.append(tag)
            continue
        if kind == "close":
            if count[tag]:
                for k in range(len(open_) - 1, 0, -1):
                    if open_[k].tag == tag:
                        shut(k)
                        break
                    if open_[k].tag in ("td", "th", "table", "article", "main") and tag in ("p", "b", "i", "a", "span", "em", "strong", "div"):
                        break
            continue
        if tag in ENDS_P and count["p"]:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == "p":
                    shut(k)
                    break
                if open_[k].tag in BLOCK:
                    break
        if tag in CLOSES and any(count[t] for t in CLOSES[tag][0]):
            ends, limits = CLOSES[tag]
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag in ends:
                    shut(k)
                    break
                if open_[k].tag in limits:
                    break
        marked, name = _marked(tag, rest[0])
        above = open_[-1]
        path = f"{above.path}/{tag}" + (f".{name}" if name and tag not in ARTICLE else "") if above.level < PATH_LEVELS else above.path
        node = Node(tag, marked or tag in OTHER, path, above.level + 1)
        above.children.append(node)
        if tag not in VOID:
            open_.append(node)
            count[tag] += 1
    return root


class Aligner:
    """Simple tree matching. Subtrees are told apart by their shapes (tags only), and the best alignment of two shapes is worked out once."""

    def __init__(self) -> None:
        self._empty()

    def _empty(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.shapes: list[tuple] = []
        self.known: dict[tuple[int, int], int] = {}
        self.pairs: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def shape(self, root: Node) -> dict[int, int]:
        """The shape number of each node of a tree, by its identity; children come before their parents."""
        order, todo, found = [], [root], {}
        while todo:
            x = todo.pop()
            order.append(x)
            todo += x.elements()
        for x in reversed(order):
            key = (x.tag, tuple([found[id(c)] for c in x.elements()]))
            if key not in self.numbers:
                self.numbers[key] = len(self.shapes)
                self.shapes.append(key)
            found[id(x)] = self.numbers[key]
        return found

    def weight(self, a: int, b: int) -> int:
        """Most pairs of nodes that match if two shapes' roots do (their tags are the same); the pairs below are worked out first."""
        todo = [(a, b)]
        while todo:
            pair = todo[-1]
            if pair in self.known:
                todo.pop()
                continue
            one, two = (self.shapes[k][1] for k in pair)
            need = [(p, q) for p in dict.fromkeys(one) for q in dict.fromkeys(two) if self.shapes[p][0] == self.shapes[q][0] and (p, q) not in self.known]
            if need:
                todo += need
                continue
            todo.pop()
            self.known[pair] = 1 + sum(self._gain(one[p], two[q]) for p, q in self.matched(*pair))
        return self.known[a, b]

    def _gain(self, p: int, q: int) -> int:
        return self.weight(p, q) if self.shapes[p][0] == self.shapes[q][0] else 0

    def _gains(self, one: tuple, two: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights of all pairs of distinct shapes (0 where tags differ), and which of them each child is."""
        left, i = np.unique(one, return_inverse=True)
        right, j = np.unique(two, return_inverse=True)
        table = np.array([[self._gain(int(p), int(q)) for q in right] for p in left], np.int32)
        return table, i, j

    @staticmethod
    def _next_row(above: np.ndarray, gain: np.ndarray) -> np.ndarray:
        """The row of best sums behind another, in one go: what ends at each child, then the maximum so far."""
        row = above.copy()
        np.maximum(row[1:], np.where(gain > 0, above[:-1] + gain, 0), out=row[1:])
        return np.maximum.accumulate(row)

    def matched(self, a: int, b: int) -> list[tuple[int, int]]:
        """Places of the children of two shapes that match in the best alignment.

        Equal children at both ends match each other, which is never worse; the rest is aligned by sums of weights.
        """
        if (a, b) in self.pairs:
            return self.pairs[a, b]
        one, two = self.shapes[a][1], self.shapes[b][1]
        n, head, tail = min(len(one), len(two)), 0, 0
        while head < n and one[head] == two[head]:
            head += 1
        while tail < n - head and one[-1 - tail] == two[-1 - tail]:
            tail += 1
        inner, other = one[head : len(one) - tail], two[head : len(two) - tail]
        found = (self._few if len(inner) * len(other) <= FEW_PAIRS else self._many)(inner, other) if inner and other else []
        out = [(k, k) for k in range(head)] + [(head + x, head + y) for x, y in found] + [(len(one) - k, len(two) - k) for k in range(tail, 0, -1)]
        self.pairs[a, b] = out
        return out

    def _few(self, one: tuple, two: tuple) -> list[tuple[int, int]]:
        best = [[0] * (len(two) + 1)]
        for p in one:
            row, above = [0], best[-1]
            for j, q in enumerate(two):
                gain = self._gain(p, q)
                row.append(max(above[j + 1], row[j], above[j] + gain if gain else 0))
            best.append(row)
        out, x, y = [], len(one), len(two)
        while x and y:
            gain = self._gain(one[x - 1], two[y - 1])
            if gain and best[x][y] == best[x - 1][y - 1] + gain:
                x, y = x - 1, y - 1
                out.append((x, y))
            elif best[x][y] == best[x - 1][y]:
                x -= 1
            else:
                y -= 1
        return out[::-1]

    def _many(self, one: tuple, two: tuple) -> list[tuple[int, int]]:
        """The same for long lists, a row at a time. Only every so many rows are held; those between are made again."""
        table, i, j = self._gains(one, two)
        step = max(1, int(len(one) ** 0.5))
        marks, row = [np.zeros(len(two) + 1, np.int32)], np.zeros(len(two) + 1, np.int32)
        for k, c in enumerate(i.tolist(), 1):
            row = self._next_row(row, table[c][j])
            if k % step == 0:
                marks.append(row)
        out, x, y = [], len(one), len(two)
        while x and y:
            first = (x - 1) // step * step
            rows = [marks[first // step]]
            for c in i[first:x].tolist():
                rows.append(self._next_row(rows[-1], table[c][j]))
            while x > first and y:
                here, above, gain = rows[x - first], rows[x - first - 1], int(table[i[x - 1]][j[y - 1]])
                if gain and here[y] == above[y - 1] + gain:
                    x, y = x - 1, y - 1
                    out.append((x, y))
                elif here[y] == above[y]:
                    x -= 1
                else:
                    y -= 1
        return out[::-1]

    def align(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        """Matching nodes of two trees."""
        if max(len(self.known), len(self.shapes), len(self.pairs)) > REMEMBERED:
            self._empty()
        shape = self.shape(a) | self.shape(b)
        out, todo = [], [(a, b)]
        while todo:
            x, y = todo.pop()
            out.append((x, y))
            one, two = x.elements(), y.elements()
            if one and two:
                todo += [(one[p], two[q]) for p, q in self.matched(shape[id(x)], shape[id(y)])]
        return out


_aligner = Aligner()


def align(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Matching nodes of two trees by simple tree matching."""
    return _aligner.align(a, b)


def _code(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def votes(page: Node, other: Node) -> tuple[dict[str, int], list[tuple[str, int]]]:
    """Of a page held against another of its host: varying characters by path, and constant nodes (path, hash)."""
    varying, constant = defaultdict(int), []
    matched = {id(x): y for x, y in align(page, other)}
    todo = [page]
    while todo:
        x = todo.pop()
        if x.marked:
            continue
        text = x.own_text()
        if text:
            y = matched.get(id(x))
            if y is not None and y.own_text() == text:
                constant.append((x.path, _code(text)))
            else:
                varying[x.path] += len(text)
        todo += x.elements()
    return varying, constant


def slot_path(varying: dict[str, int]) -> str:
    """The deepest path that holds nine tenths of the varying characters, or else an article that holds half; empty if that is the page."""
    total, at = sum(varying.values()), ""
    while total:
        below = defaultdict(int)
        for path, n in varying.items():
            if path.startswith(at + "/"):
                below[path[: (path + "/").index("/", len(at) + 1)]] += n
        best = max(below, key=lambda p: (below[p], p), default=None)
        if best is None or below[best] < 0.9 * total or best.rsplit("/", 1)[-1].split(".")[0] in ("p", "b", "i", "a", "span", "em", "strong", "h1", "h2", "h3", "ul", "ol", "li", "pre", "blockquote"):
            break
        at = best
    held = defaultdict(int)
    for path, n in varying.items():
        for tag in ARTICLE:
            if m := re.match(rf".*?/{tag}(?=/|\Z)", path):
                held[m[0]] += n
                break
    best = max(held, key=lambda p: (held[p], p), default=None)
    if best is not None and 2 * held[best] >= total:
        return best
    return "" if at.rsplit("/", 1)[-1].split(".")[0] in ("", "html", "body") else at


def _found(root: Node, wanted) -> list[Node]:
    """The outermost nodes that are wanted, in order, without what is marked as something else."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.marked:
            continue
        if wanted(x):
            out.append(x)
        else:
            todo += reversed(x.elements())
    return out


def _in_article(node: Node) -> bool:
    return any(x.tag in ("h1", "h2") for x in _found(node, lambda x: x.tag in ("h1", "h2")))


def _rendered(parts: list[Node], template: frozenset[tuple[str, int]], leaves: set[tuple[str, int]] | None = None) -> str:
    """The text of some nodes without the template; their leaf nodes are added to leaves."""
    inside = bool(parts) and parts[0].tag not in ("body", "html", "#")
    out: list[str] = []
    todo: list[Node | str] = list(reversed(parts))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        if x.marked or x.tag == "header" and not (inside and _in_article(x)):
            continue
        if (template or leaves is not None) and not x.elements():
            key = (x.path, _code(x.own_text()))
            if key in template:
                continue
            if leaves is not None and x.children and x.path:
                leaves.add(key)
        if x.tag in BLOCK:
            out.append(" ")
            todo.append(" ")
        todo += reversed(x.children)
    return " ".join("".join(out).split())


def parts_of(root: Node, slot: str = "") -> list[Node]:
    """The nodes a page's text stands in: its host's slot; without one that has text its article or main elements, else the page."""
    seen = []
    for wanted in (lambda x: bool(slot) and x.path == slot, lambda x: x.tag == "article", lambda x: x.tag == "main"):
        parts = _found(root, wanted)
        if parts and _rendered(parts, frozenset()):
            return parts
        seen = seen or parts
    return seen or _found(root, lambda x: x.tag == "body") or _found(root, lambda x: x is root)


def text_of(root: Node, slot: str = "", template: frozenset[tuple[str, int]] = frozenset()) -> str:
    """The text of a page's article: what its host's slot holds, without the template; see parts_of for pages without a slot."""
    return _rendered(parts_of(root, slot), template)


def _slot_text(root: Node, slot: str) -> tuple[int, set[tuple[str, int]]]:
    """A 64-bit hash of the text in a page's slot, and the slot's leaf nodes (path, hash)."""
    leaves: set[tuple[str, int]] = set()
    text = _rendered(parts_of(root, slot), frozenset(), leaves)
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True), leaves


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; null and malformed URLs share an empty one."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def _record(rows: list[tuple], names: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), names.values(), strict=True)], names=list(names))


def _vote_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, path, n) from (host, html, reference): varying characters of pages held against their host's reference."""
    known: dict[str, Node] = {}
    for batch in batches:
        amounts = defaultdict(int)
        for host, page, other in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if page == other:
                continue
            if host not in known:
                if len(known) > 2000:
                    known.clear()
                known[host] = parse(other)
            for path, n in votes(parse(page), known[host])[0].items():
                amounts[host, path] += n
        if amounts:
            yield _record([(*k, n) for k, n in amounts.items()], {"host": pa.string(), "path": pa.string(), "n": pa.int64()})


def _repeated_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (host, html, reference, slot): a row (host, "", 0, text) for each text that isn't the reference's, and one for each leaf node (path, code) it shares with it."""
    known: dict[str, tuple] = {}
    for batch in batches:
        rows: set[tuple] = set()
        for host, page, other, slot in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if page == other:
                continue
            if host not in known:
                if len(known) > 2000:
                    known.clear()
                known[host] = _slot_text(parse(other), slot or "")
            mine, leaves = _slot_text(parse(page), slot or "")
            theirs, shared = known[host]
            if mine != theirs:
                rows.add((host, "", 0, mine))
                rows.update((host, *leaf, mine) for leaf in leaves & shared)
        if rows:
            yield _record(list(rows), {"host": pa.string(), "path": pa.string(), "code": pa.int64(), "text": pa.int64()})


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [slot_path(dict(v or [])) for v in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["host", "slot"])


def induce(pages: DataFrame, scratch: Scratch, broadcast_rows: int = 200_000) -> DataFrame:
    """(host, slot, template) for each host of several contents: its content slot, and its template nodes as strings path TAB hash."""
    hosted = pages.filter("host <> '' and trim(html) <> ''").select("host", "html", F.xxhash64("html").alias("h"))
    least = scratch.save(hosted.groupBy("host").agg(F.min("h").alias("h"), F.max("h").alias("most")).filter("h < most").select("host", "h"), "least")
    few = least.limit(broadcast_rows + 1).count() <= broadcast_rows
    references = scratch.save(hosted.join(F.broadcast(least) if few else least, ["host", "h"]).dropDuplicates(["host"]).select("host", F.col("html").alias("reference")), "references")
    small = few and (references.agg(F.sum(F.length("reference"))).first()[0] or 0) <= BROADCAST_CHARS
    held = hosted.select("host", "html").join(F.broadcast(references) if small else references, "host")

    added = held.mapInArrow(_vote_rows, "host string, path string, n long").groupBy("host", "path").agg(F.sum("n").alias("n"))
    # the paths of a host: no more than its template has different places
    paths = added.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("path", "n"))).alias("varying"))
    slots = scratch.save(paths.mapInArrow(_chosen, "host string, slot string"), "slots")

    slotted = held.join(F.broadcast(slots) if few else slots, "host", "left").select("host", "html", "reference", "slot")
    repeated = scratch.save(slotted.mapInArrow(_repeated_rows, "host string, path string, code long, text long").distinct().groupBy("host", "path", "code").agg(F.count("*").alias("n")), "repeated")
    size = repeated.filter("path = ''").select("host", F.col("n").alias("texts"))
    sure = repeated.filter("path <> ''").join(size, "host").filter((F.col("texts") >= TEMPLATE_PAGES - 1) & (F.col("n") >= TEMPLATE_SHARE * F.col("texts")))
    sure = sure.groupBy("host").agg(F.sort_array(F.collect_list(F.concat_ws("\t", "path", "code"))).alias("template"))  # nodes of the reference: no more than one page has
    return scratch.save(slots.join(sure, "host", "full"), "wrappers")


def extract_text(df: DataFrame, markup: str = "html", url: str = "url", key: str = "page_id", broadcast_rows: int = 200_000) -> DataFrame:
    """One row per row of df: page_id, url, text (empty if none), n_chars (code points).

    Null and empty pages have empty text; pages with null and malformed URLs have no host, so no slot and no template.
    Whole pages are read and nothing of the article is cut. Hosts' wrappers are broadcast up to broadcast_rows hosts, else joined by a shuffle.
    """
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "html-wrapper")
    pages = df.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(markup).cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    wrappers = induce(pages, scratch, broadcast_rows)
    few = wrappers.limit(broadcast_rows + 1).count() <= broadcast_rows
    joined = pages.join(F.broadcast(wrappers) if few else wrappers, "host", "left").select("page_id", "url", "html", "slot", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, frozenset] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part, out = batch.slice(i, 128), []
                for page, slot, template in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                    nodes = tuple(template or ())
                    if nodes not in known:
                        if len(known) > 1000:
                            known.clear()
                        known[nodes] = frozenset((p, int(c)) for p, _, c in (x.rpartition("\t") for x in nodes))
                    out.append(text_of(parse(page or ""), slot or "", known[nodes]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array(np.array([len(x) for x in out], np.int64))], names=["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
