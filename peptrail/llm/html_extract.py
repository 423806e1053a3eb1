"""Main text of web pages: flat text blocks, judged by a decision tree over each block and its neighbours.

A page is cut into blocks at block-level tags, in one pass whose time is in proportion to the page. A
block's features are its words and link density, the same of the block before and after, whether it
stands in an article or in an element that frames one (menus, headers, footers, asides, forms), and, as a
weak sign, how much of the page lies outside a container that its names call a frame part. A small tree,
fitted on the labelled blocks below, decides which blocks are main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peptrail.llm.shared import text_groups

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTES = re.compile(r"[^>=]*+(?:>|=\s*+)")
_HINT = re.compile(r"""(?:^|[\s"'/])(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile("[A-Z]?[a-z]+")

#: fixed values: HTML element groups
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead title tr ul".split()
)
#: elements whose content is no text; of the second group the content is no markup either
_HIDDEN = frozenset("head select object canvas button svg math audio video".split())
_RAW = frozenset("script style noscript noembed noframes template iframe title textarea".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FRAME = frozenset("nav header footer aside form menu dialog search fieldset".split())
_ARTICLE = frozenset(("article", "main"))
_CLOSED_BY_NEXT = frozenset("p li dd dt td th tr option h1 h2 h3 h4 h5 h6".split())
#: elements that hold one block each, so that their names say little of more than it
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th tr caption figcaption pre blockquote summary legend".split())
#: fixed values: words that names give to parts that are not the article, and to the article where no element marks it
_FRAME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent cookie cookies "
    "contentinfo copyright disclaimer disqus discussion feedback footer gdpr login masthead menu modal nav navbar navigation newsletter notice "
    "notices pager pagination popup promo promotion reactions related remarks replies reply respond response responses search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe subscription thread toolbar widget".split()
)
_ARTICLE_WORDS = frozenset("article content entry main post story".split())

FEATURES = (
    "words", "link_density", "words_before", "links_before", "words_after", "links_after",
    "in_article", "page_has_article", "in_frame", "outside_named", "own_name",
)

#: Labelled blocks of invented pages, a page a line. A block is its place (a: in an article, f: in an element
#: that frames one, n: in a container whose names say so, o: with such a name of its own, -: none of them),
#: its words, its words in links, and a plus if it is main text.
LABELLED = """
f1/1 f1/1 f2/2 n9/0 a6/0+ a48/0+ a75/3+ a120/0+ f12/2
f3/3 f2/2 a9/0+ a2/0+ a40/0+ an18/0 a64/2+ a1/0+ a33/0+ an7/1 an30/0 an55/0 f20/0
a5/5+ a31/0+ a4/4+ a90/0+ -3/3 -12/1 -22/0 f8/0
f2/2 f2/2 n14/2 ao3/0+ a80/0+ ao12/0+ a25/0+ af6/0 af18/3 a52/0+ f9/9
f2/2 a5/2+ a90/0+ a12/6+ an4/4 an12/9 a120/0+ a4/4+ a200/3+ af4/3 af6/6 a30/9+ a3/1+ an5/4 a150/0+ f9/9
a3/3+ a60/0+ a4/4+ a5/5+ a80/0+ a2/2+ a1/1+ a40/4+ a9/7+ a10/9+ a70/0+ a3/2+ a4/3+ a4/3+ f2/2
a8/0+ an3/3 an5/5 a60/0+ an1/1 an9/7 a30/0+ af2/2 af8/8 a45/0+ an30/25 an4/3 a2/0+ af6/5 a50/0+ f6/6
-2/2 -1/1 a3/3+ a6/5+ a1/1+ a35/0+ a4/4+ a7/6+ -4/4 -6/6 f3/3
a300/4+ n60/0 n45/0 n80/0 n20/2 f7/0
f1/1 f1/1 a11/0+ a3/0+ a6/0+ a2/0+ -40/0 -35/0 -60/2 f10/0
n3/0+ n60/0+ n80/4+ n7/0+ n45/0+ f2/1
-2/2 -2/2 -3/3 -60/0+ -80/2+ -5/0+ -70/0+ -45/0+ -4/4 -9/8
-1/1 -1/1 -1/1 -8/0+ -150/0+ -3/3 -3/3 -2/2
f2/2 f3/3 -9/0+ -35/2+ -70/0+ -20/0+ f3/0
-4/4 -5/5 -20/16 -7/0+ -55/0+ -28/5+ -90/0+ -6/0+ -40/0+ -12/12 -40/30 -9/9
-6/0+ -40/0+ -23/0+ n12/0 n30/0 -23/0+ -13/0+ -3/3
-3/0 -2/2 -2/2 -2/2 -18/0+ -60/0+ -16/0+ -2/2 -6/0 -3/3
f4/0 -12/0+ -30/0+ n8/0 n70/0 n90/0 n66/0 f5/0
-25/0+
-1/0 -1/1 -2/2 -5/0 -3/3
-2/0+ f3/1
f6/6 f30/0 f50/2 -7/0+ -90/0+ f40/0
-2/2 -3/3 -14/0+ -12/0+ -18/0+ -4/4 -6/0 -5/5
o4/0+ -30/0+ o20/0+ -3/3 -6/5
"""


class DecisionTree:
    """Binary tree by Gini impurity; of equal splits the first feature and the least cut are taken."""

    def __init__(self, rows: np.ndarray, depth: int = 8, least: int = 2):
        self.nodes: list[tuple[int, float, int, int]] = []  # feature (-1: leaf), cut, left, right or label
        self._grow(rows[:, :-1], rows[:, -1].astype(int), depth, least)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, 0.0, int(y.mean() >= 0.5), 0))
        best = (len(y) * 2 * y.mean() * (1 - y.mean()) - 1e-9, -1, 0.0)
        if depth and len(y) >= 2 * least and 0 < y.mean() < 1:
            for f in range(x.shape[1]):
                values = np.unique(x[:, f])
                for cut in (values[1:] + values[:-1]) / 2:
                    low = x[:, f] <= cut
                    if least <= low.sum() <= len(y) - least:
                        p, q = y[low].mean(), y[~low].mean()
                        cost = low.sum() * 2 * p * (1 - p) + (~low).sum() * 2 * q * (1 - q)
                        if cost < best[0] - 1e-9:
                            best = (cost, f, float(cut))
        if best[1] >= 0:
            low = x[:, best[1]] <= best[2]
            self.nodes[at] = (best[1], best[2], self._grow(x[low], y[low], depth - 1, least), self._grow(x[~low], y[~low], depth - 1, least))
        return at

    def predict(self, row: tuple[float, ...]) -> int:
        f, cut, a, b = self.nodes[0]
        while f >= 0:
            f, cut, a, b = self.nodes[a if row[f] <= cut else b]
        return a


def _with_neighbours(blocks: list[tuple[int, int, bool, bool, float, bool]]) -> list[tuple[float, ...]]:
    """Features of blocks: words, words in links, in an article, in a frame, share of the page outside the named container, own name."""
    flat = [(0, 0.0), *((n, linked / n) for n, linked, *_ in blocks), (0, 0.0)]
    some = any(b[2] for b in blocks)
    return [(*flat[k + 1], *flat[k], *flat[k + 2], float(b[2]), float(some), float(b[3]), b[4], float(b[5])) for k, b in enumerate(blocks)]


def labelled_rows() -> np.ndarray:
    """Features and label of each labelled block."""
    out = []
    for line in LABELLED.split("\n"):
        found = [(m[1], int(m[2]), int(m[3]), m[4] == "+") for m in re.finditer(r"([afno-]+)(\d+)/(\d+)([+]?)", line)]
        total, k, blocks = sum(b[1] for b in found), 0, []
        while k < len(found):  # neighbours in named containers share one
            j = k
            while j < len(found) and ("n" in found[j][0]) == ("n" in found[k][0]):
                j += 1
            outside = 1 - sum(b[1] for b in found[k:j]) / total if "n" in found[k][0] else 0.0
            blocks += [(n, linked, "a" in place, "f" in place, outside, "o" in place) for place, n, linked, _ in found[k:j]]
            k = j
        out += [(*row, main) for row, (*_, main) in zip(_with_neighbours(blocks), found, strict=True)]
    return np.array(out, float)


@lru_cache(maxsize=1)
def default_tree() -> DecisionTree:
    return DecisionTree(labelled_rows())


@lru_cache(maxsize=4096)
def _named(attributes: str) -> tuple[bool, bool]:
    """Whether an element's names say that it is a frame part, and that it is an article."""
    words: set[str] = set()
    for found in _HINT.finditer(attributes):
        words |= {w.lower() for w in _WORD.findall(next(g for g in found.groups() if g is not None))}
    return bool(words & _FRAME_WORDS), bool(words & _ARTICLE_WORDS)


class _Page:
    """Blocks of one page: text, words, words in links, and the element that holds them."""

    def __init__(self, source: str):
        self.source = source
        self.blocks: list[tuple[str, int, int, int]] = []
        self.parts: list[str] = []
        self.linked = self.in_link = self.hidden = 0
        # elements: the one around it, whether it frames, is an article, has a frame part's name and an article's
        self.elements: list[tuple[int, bool, bool, bool, bool]] = [(-1, False, False, False, False)]
        self.leaf_names: dict[int, bool] = {}
        self.stack: list[tuple[str, int, bool]] = []  # open elements: name, number, whether hidden
        self.open: dict[str, int] = {}
        self._walk()

    def _walk(self) -> None:
        source, at, end = self.source, 0, len(self.source)
        last = {c: source.rfind(c) for c in "><\"'"}
        strict = True  # quotes are heeded until they once hid the end of a tag
        while at < end:
            mark = source.find("<", at)
            if mark < 0 or mark > last[">"]:  # no tag ends any more
                self._text(source[at:])
                break
            if mark > at:
                self._text(source[at:mark])
            if source.startswith("<!--", mark):
                at = mark + 5 if source.startswith("<!-->", mark) else mark + 6 if source.startswith("<!--->", mark) else self._after("-->", mark + 4)
                continue
            closing = source.startswith("/", mark + 1)
            name = _NAME.match(source, mark + 1 + closing)
            if name is None:
                if closing or source[mark + 1 : mark + 2] in ("!", "?"):
                    at = self._after(">", mark)
                else:
                    self._text("<")
                    at = mark + 1
                continue
            stop = self._tag_end(name.end(), last) if strict else -1
            if stop < 0:
                strict, stop = False, source.find(">", name.end())
            attributes, at = source[name.end() : stop], stop + 1
            self._tag(name[0].lower(), attributes, closing)
            if not closing and name[0].lower() in _RAW:
                close = re.compile(f"</{re.escape(name[0])}(?=[\\s/>])", re.I).search(source, at)
                at = self._after(">", close.start()) if close else end
        self._flush()

    def _after(self, what: str, at: int) -> int:
        found = self.source.find(what, at)
        return found + len(what) if found >= 0 else len(self.source)

    def _tag_end(self, at: int, last: dict[str, int]) -> int:
        """Where the ``>`` of a tag is, quoted values left aside; -1 if there is none."""
        source = self.source
        while found := _ATTRIBUTES.match(source, at):
            at = found.end()
            if source[at - 1] == ">":
                return at - 1
            quote = source[at : at + 1]
            if quote in ('"', "'") and quote and at < last[quote]:
                at = source.find(quote, at + 1) + 1
        return -1

    def _text(self, text: str) -> None:
        if self.hidden:
            return
        if "&" in text:
            text = html.unescape(text)
        if self.in_link:
            self.linked += len(text.split())
        self.parts.append(text)

    def _flush(self) -> None:
        if self.parts:
            words = "".join(self.parts).split()
            if words:
                self.blocks.append((" ".join(words), len(words), min(self.linked, len(words)), self.stack[-1][1] if self.stack else 0))
            self.parts = []
        self.linked = 0

    def _tag(self, name: str, attributes: str, closing: bool) -> None:
        if name == "a":
            self.in_link = 0 if closing else 1
        elif name == "br":
            self.parts.append(" ")
        if name not in _BLOCK and name not in _HIDDEN:
            return
        if name not in _HIDDEN or name in ("head", "select"):
            self._flush()
        if closing:
            self._close(name)
        elif name not in _VOID:
            self._open(name, attributes)

    def _open(self, name: str, attributes: str) -> None:
        if name == "body":  # whatever was open before belongs to the head
            while self.stack:
                self._pop()
        while name in _CLOSED_BY_NEXT and self.stack and (self.stack[-1][0] == "p" or self.stack[-1][0] == name):
            self._pop()
        frame_name, article_name = _named(attributes) if "=" in attributes and name not in ("body", "html") else (False, False)
        around = self.stack[-1][1] if self.stack else 0
        frame, article = name in _FRAME, name in _ARTICLE
        if name in _LEAF:
            number = around
            if frame_name:
                number = len(self.elements)
                self.elements.append((around, False, False, False, False))
                self.leaf_names[number] = True
        elif frame or article or frame_name or article_name:
            number = len(self.elements)
            self.elements.append((around, frame, article, frame_name and not article, article_name))
        else:
            number = around
        hidden = name in _HIDDEN
        self.stack.append((name, number, hidden))
        self.open[name] = self.open.get(name, 0) + 1
        self.hidden += hidden

    def _pop(self) -> None:
        name, _, hidden = self.stack.pop()
        self.open[name] -= 1
        self.hidden -= hidden

    def _close(self, name: str) -> None:
        if self.open.get(name):
            while self.stack[-1][0] != name:
                self._pop()
            self._pop()

    def features(self) -> list[tuple[float, ...]]:
        """Features of the blocks, by what is known of the whole page."""
        words = [0] * len(self.elements)
        for _, n, _, number in self.blocks:
            words[number] += n
        total = max(1, sum(words))
        for number in range(len(self.elements) - 1, 0, -1):
            words[self.elements[number][0]] += words[number]
        marked = any(e[2] for e in self.elements)  # article elements go before names
        state: list[tuple[bool, bool, float]] = []  # in a frame, in an article, share of the page outside a named container
        for number, (around, frame, article, frame_name, article_name) in enumerate(self.elements):
            in_frame, in_article, outside = state[around] if number else (False, False, 0.0)
            if frame_name:
                outside = max(outside, 1 - words[number] / total)
            # an article within a part that is named as a frame is one of its entries
            in_article |= (article or (article_name and not frame_name and not marked)) and outside < 0.15
            state.append((in_frame or frame, in_article, outside))
        return _with_neighbours([
            (n, linked, state[number][1], state[number][0], state[number][2], number in self.leaf_names) for _, n, linked, number in self.blocks
        ])


def main_text(source: str | None, tree: DecisionTree | None = None) -> str:
    """Main blocks joined by line feeds; empty for a null or empty page."""
    if not source:
        return ""
    tree, page = tree or default_tree(), _Page(source)
    return "\n".join(block[0] for block, row in zip(page.blocks, page.features(), strict=True) if tree.predict(row))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of ``pages(page_id, url, html)``: one row a page, no shuffle.

    A null page or one without main text has an empty text; equal pages give equal rows, and repeated
    ids keep their rows; null ids and urls stay null; other columns are not read; an empty table gives no
    rows; nothing in a page is cut at a length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_groups(batch, 2):
                texts = [main_text(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
