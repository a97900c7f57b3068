"""HTML extraction by minimum-cut labelling: block costs are terminal capacities, proximity is smoothness."""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import escape as html_escape
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A quote that nothing ends, or that ends amid letters, is a character like any other, so that it swallows no text.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"(?=[\s/>]|\Z)|'[^']*'(?=[\s/>]|\Z)|["'])*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
CLASS = re.compile(r"""\bclass\s*=\s*["']?\s*([^\s"'>]+)""", re.I)
XMP = re.compile(r"</xmp\b[^>]*>?", re.I)
#: Elements without text of their own for a reader; what they hold is left out.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "object", "svg", "noframes", "noembed"}
#: Those that run to the page's end without an end tag; of the others only the tag is skipped then.
UNENDING = {"script", "style", "textarea", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
    "math", "mi", "mo", "mn", "ms", "mtext", "mrow", "mfrac", "msup", "msub", "msubsup", "msqrt", "mroot", "mover", "munder", "munderover", "mspace", "mstyle", "mpadded", "semantics", "annotation",
}
#: Elements that a start tag of the same kind ends.
ALIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "p": set()}

#: Log-odds of content that being inside such an element adds.
INSIDE = {
    "article": 4.0, "main": 2.5, "nav": -7.0, "aside": -6.0, "footer": -7.0, "form": -6.0, "button": -5.0, "select": -6.0, "dialog": -6.0, "menu": -6.0, "fieldset": -5.0, "address": -2.0,
}
#: A page's header, and one inside an article, which often holds its title.
HEADER, ARTICLE_HEADER = -6.0, 0.0
#: The same by words of class, id and role: adverts, consent, readers' comments and what is not shown,
HIDES = set(
    "ad ads adbox advert advertisement advertising adverts sponsor sponsored promo promoted cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup paywall "
    "sidebar sidebars aside rail nav navbar navigation breadcrumb breadcrumbs pagination pager widget widgets footer foot masthead topbar toolbar searchbox complementary contentinfo "
    "comment comments commentlist reply replies disqus respond skip hidden".split()
)
#: and names of other parts of the page that a section or a paragraph of an article may have too.
MAY_HIDE = set(
    "banner promotion notice alert menu menus share sharing social related recommended recommendations trending discussion login signin search copyright legal disclaimer".split()
)
#: Elements that these words don't hide, and words in a name that tell of other parts of the page (has-sidebar, comments-open).
HOLDS = {"html", "body", "main", "article"}
ABOUT, STATES = {"has", "no", "with", "without", "not", "layout"}, {"open", "closed", "enabled", "disabled", "layout"}
SHOWS = {"article", "content", "main", "post", "entry", "story"}
HIDDEN, SHOWN = -6.5, 1.5
#: What such a name adds to prose inside an article or main: so much that other signs can outvote it.
OUTVOTED = -2.5
#: Prose has at most this share of its letters in links, and at least that share in blocks that end a sentence; so many children of one kind are a list of things.
LINKS, PROSE, ALL_ALIKE = 0.25, 0.6, 3
#: Letters of prose that such a part has at least.
SOME = 60
#: What a block's own text says: per unit of link density, per 100 letters up to LONG, and a sentence's end.
START, LINKED, LETTERS, LONG, SENTENCE = -0.3, -3.5, 0.8, 2.0, 0.5
#: Signs that end a sentence.
ENDS = ".!?:;…。\"'”"
#: Smoothness between neighbours in the page, less by their distance in the tree, and between blocks next to each other under one parent.
NEAR, SIBLINGS = 0.9, 0.5
#: Capacities are counted in whole thousandths, so that flows are exact.
UNIT = 1000


@dataclass
class Block:
    #: The text's parts; a block that an inline element inside makes stands among them.
    parts: list[str | Block]
    text: str
    letters: int
    linked: int
    #: The innermost element around it.
    element: int
    #: Log-odds by the elements around it.
    around: float = 0.0
    #: Whether it is a part of another block.
    inner: bool = False


class Tree:
    """The elements of a page in page order: parent, depth, and the log-odds that each adds."""

    def __init__(self):
        self.parent, self.depth, self.adds = [0], [0], [0.0]
        #: Elements that hide by their names, and the main parts of the page.
        self.named: set[int] = set()
        self.main: set[int] = set()
        #: Of those that hide by their names the ones whose names an article's sections may have, and the kinds (name and class) of elements with a class.
        self.unsure: set[int] = set()
        self.kinds: dict[int, str] = {}

    def add(self, parent: int, odds: float) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.adds.append(odds)
        return len(self.parent) - 1

    def apart(self, a: int, b: int) -> int:
        """Steps from a to b. Between blocks next to each other these are the elements that end or begin there."""
        steps = 0
        while a != b:
            if self.depth[a] < self.depth[b]:
                a, b = b, a
            a = self.parent[a]
            steps += 1
        return steps

    def settle(self, found: list[Block]) -> None:
        """Gives the blocks what the elements around them add.

        An element that hides by its name what is the page itself doesn't hide: one around every article and
        main with over half of the letters, or with over nine tenths in a page without any. One inside an
        article whose name may be that of a section doesn't hide prose either, unless it holds a list of like
        things (as comments are); there the name is one sign among others.
        """
        n = len(self.parent)
        letters, mains, linked, prose = [0] * n, [0] * n, [0] * n, [0] * n
        for b in found:
            letters[b.element] += b.letters
            linked[b.element] += b.linked
            if b.text[-1] in ENDS and b.linked * 4 <= b.letters:
                prose[b.element] += b.letters
        for e in self.main:
            mains[e] += 1
        alike: Counter[tuple[int, str]] = Counter()
        for e, kind in self.kinds.items():
            alike[self.parent[e], kind] += 1
            alike[self.parent[self.parent[e]], kind] += 1
        lists = {e for (e, _), k in alike.items() if k >= ALL_ALIKE}
        inside = [False] * n
        for e in range(1, n):
            inside[e] = inside[self.parent[e]] or self.parent[e] in self.main
        for e in range(n - 1, 0, -1):
            for told in (letters, linked, prose, mains):
                told[self.parent[e]] += told[e]
        for e in self.named:
            if mains[e] == mains[0] and letters[e] * 10 > letters[0] * (5 if mains[0] else 9):
                self.adds[e] -= HIDDEN
            elif e in self.unsure and inside[e] and e not in lists and linked[e] <= LINKS * letters[e] and prose[e] >= max(SOME, PROSE * letters[e]):
                self.adds[e] += OUTVOTED - HIDDEN
        around = [0.0] * n
        for e in range(1, n):
            around[e] = around[self.parent[e]] + self.adds[e]
        for b in found:
            b.around = around[b.element]


#: What words of class, id and role say.
SURE, UNSURE, NOT_SAID = "sure", "unsure", ""


@lru_cache(4096)
def _said(attributes: str) -> tuple[float, str]:
    """What class, id and role say about an element, or that it's hidden; how surely words say so."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    names = [[w.lower() for w in WORD.findall(n)] for key in ("class", "id", "role", "aria-label") for n in found.get(key, "").split()]
    words = {w for n in names if n and not ABOUT & set(n[:-1]) and n[-1] not in STATES for w in n}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return HIDDEN, NOT_SAID
    return (HIDDEN, SURE) if words & HIDES else (HIDDEN, UNSURE) if words & MAY_HIDE else (SHOWN, SURE) if words & SHOWS else (0.0, NOT_SAID)


class _Reader:
    """Reads a page tag by tag; time grows with the page's length, however deep its elements lie."""

    def __init__(self):
        self.tree, self.found = Tree(), []
        # Open elements: name and number. Inline ones stand here only if they link or hide.
        self.stack: list[tuple[str, int]] = [("", 0)]
        self.open: Counter[str] = Counter()
        self.parts: list[str | Block] = []
        self.linked = 0
        #: Of inline elements that are blocks inside a block: the outer one's parts and linked letters.
        self.outer: list[tuple[int, list[str | Block], int]] = []

    def text(self, text: str) -> None:
        self.parts.append(text)
        if self.open["a"]:
            self.linked += len(text)

    def _block(self, element: int) -> Block | None:
        raw = "".join(x for x in self.parts if isinstance(x, str))
        text = " ".join(unescape(raw).split())
        made = None
        if text:
            made = Block(self.parts, text, len(text), min(self.linked, len(text)), element)
            self.found.append(made)
        else:  # nothing of its own around inner blocks
            for x in self.parts:
                if isinstance(x, Block):
                    x.inner = False
        self.parts, self.linked = [], 0
        return made

    def flush(self) -> None:
        while self.outer:
            self._end_inner()
        if self.parts:
            self._block(self.stack[-1][1])

    def _end_inner(self) -> None:
        element, parts, linked = self.outer.pop()
        made = self._block(element)
        self.parts, self.linked = parts, linked
        if made:
            made.inner = True
            self.parts += [" ", made, " "]

    def push(self, name: str, odds: float) -> int:
        number = self.tree.add(self.stack[-1][1], odds)
        self.stack.append((name, number))
        self.open[name] += 1
        return number

    def pop_to(self, k: int) -> None:
        self.flush()
        for name, _ in self.stack[k:]:
            self.open[name] -= 1
        del self.stack[k:]

    def start_inline(self, name: str, attributes: str) -> None:
        said = _said(attributes)[0] if attributes else 0.0
        if said < 0:  # an inline advert or the like is a block of its own inside this one
            self.outer.append((self.push(name, said), self.parts, self.linked))
            self.parts, self.linked = [], 0
        elif name == "a":
            self.push(name, 0.0)

    def end_inline(self, name: str) -> None:
        if not self.open[name]:
            return
        k = len(self.stack) - 1
        while self.stack[k][0] != name:
            k -= 1
        number = self.stack[k][1]
        if any(x[0] == number for x in self.outer):
            while self.outer[-1][0] != number:
                self._end_inner()
            self._end_inner()
        for x, _ in self.stack[k + 1 :]:
            if x not in INLINE:  # blocks that were begun inside stay open
                break
        else:
            for x, _ in self.stack[k + 1 :]:
                self.open[x] -= 1
            del self.stack[k + 1 :]
        self.open[name] -= 1
        del self.stack[k]

    def end(self, name: str) -> None:
        self.flush()
        if self.open[name]:
            k = len(self.stack) - 1
            while self.stack[k][0] != name:
                k -= 1
            self.pop_to(k)

    def start(self, name: str, attributes: str) -> None:
        self.flush()
        ends = ALIKE.get(name, set()) | {"p"}
        scope = SCOPES.get(name, set())
        for k in range(len(self.stack) - 1, 0, -1):
            there = self.stack[k][0]
            if there in ends:
                self.pop_to(k)
                if name not in ALIKE or self.stack[-1][0] not in ends:
                    break
            elif there in scope or (there not in INLINE and there != "p" and not scope):
                break
            elif not any(self.open[x] for x in ends):
                break
        if name == "header":
            odds = ARTICLE_HEADER if self.open["article"] or self.open["main"] else HEADER
        else:
            odds = INSIDE.get(name, 0.0)
        said, by_words = _said(attributes) if attributes else (0.0, NOT_SAID)
        hides = said < 0 and by_words and name not in HOLDS
        if said < 0 and by_words and name in HOLDS:
            said = 0.0
        named = hides and odds >= 0
        if odds < 0 and said < 0:
            odds, said = min(odds, said), 0.0
        number = self.push(name, odds + said)
        if named:
            self.tree.named.add(number)
            if by_words == UNSURE:
                self.tree.unsure.add(number)
        if attributes and (kind := CLASS.search(attributes)):
            self.tree.kinds[number] = f"{name} {kind[1]}"
        if name in ("article", "main"):
            self.tree.main.add(number)


def blocks(html: str) -> tuple[list[Block], Tree]:
    """The page's runs of text between block-level tags, in page order, and its elements."""
    page, at, end = _Reader(), 0, len(html)
    search = TAG.search
    unended: set[str] = set()  # raw elements of which no end tag follows any more
    while at < end:
        m = search(html, at)
        if not m:
            page.text(html[at:])
            break
        if m.start() > at:
            page.text(html[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            page.end_inline(name) if name in INLINE else page.end(name)
        elif name == "svg" and m[3].endswith("/"):
            continue
        elif name == "xmp":  # its text is no markup
            page.flush()
            close = XMP.search(html, at)
            page.text(html[at : close.start() if close else end].replace("&", "&amp;"))
            page.flush()
            at = close.end() if close else end
        elif name in RAW:
            close = None if name in unended else re.compile(rf"</{name}\b", re.I).search(html, at)
            if not close:
                unended.add(name)
            if close:
                at = html.find(">", close.end()) + 1 or end
                if name != "svg":
                    page.parts.append(" ")
            elif name in UNENDING:
                break
        elif name == "br":
            page.parts.append(" ")
        elif name in VOID:
            if name == "hr":
                page.flush()
        elif name in INLINE:
            page.start_inline(name, m[3])
        else:
            page.start(name, m[3])
    page.flush()
    page.tree.settle(page.found)
    return page.found, page.tree


def odds_of_content(block: Block) -> float:
    """The block classifier's log-odds."""
    own = START + LINKED * block.linked / block.letters + LETTERS * min(block.letters / 100, LONG)
    return own + (SENTENCE if block.text[-1] in ENDS else 0.0) + block.around


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's side of a minimum cut, by Dinic's maximum flow.

    A node's positive odds are what it costs to call it boilerplate, negative ones what it costs to call it
    content; an edge costs its weight if it is cut.
    """
    n = len(odds)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[int] = []
    arcs: list[list[int]] = [[] for _ in range(n + 2)]

    def arc(a: int, b: int, there: int, back: int) -> None:
        arcs[a].append(len(to))
        arcs[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for i, x in enumerate(odds):
        w = round(abs(x) * UNIT)
        if w:
            arc(*((source, i) if x > 0 else (i, sink)), w, 0)
    for a, b, w in edges:
        arc(a, b, round(w * UNIT), round(w * UNIT))
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            x = queue.popleft()
            for e in arcs[x]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        tried = [0] * (n + 2)
        path: list[int] = []
        x = source
        while True:
            if x == sink:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                k = next(k for k, e in enumerate(path) if not room[e])
                x = to[path[k] ^ 1]
                del path[k:]
                continue
            while tried[x] < len(arcs[x]):
                e = arcs[x][tried[x]]
                if room[e] and level[to[e]] == level[x] + 1:
                    break
                tried[x] += 1
            if tried[x] < len(arcs[x]):
                path.append(e)
                x = to[e]
            elif path:
                e = path.pop()
                x = to[e ^ 1]
                tried[x] += 1
            else:
                break


def content(found: list[Block], tree: Tree) -> list[bool]:
    """Which blocks are content."""
    odds = [odds_of_content(b) for b in found]
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, NEAR / max(1, tree.apart(found[i - 1].element, b.element) - 1)))
        parent = tree.parent[b.element]
        if parent in last and last[parent] != i - 1:
            edges.append((last[parent], i, SIBLINGS))
        last[parent] = i
    if all(x > 0 for x in odds) or all(x <= 0 for x in odds):  # nothing to weigh up
        return [x > 0 for x in odds]
    return min_cut(odds, edges)


def main_text(html: str | None) -> str:
    """The page's main text: its content blocks, in page order, joined by line feeds."""
    found, tree = blocks(html or "")
    kept = {id(b) for b, keep in zip(found, content(found, tree), strict=True) if keep}

    def said(b: Block) -> str:
        whole = "".join(x if isinstance(x, str) else html_escape(said(x)) if id(x) in kept else "" for x in b.parts)
        return " ".join(unescape(whole).split())

    # A block inside another one stands in its text, unless only the inner one stays.
    within = {id(x) for b in found if id(b) in kept for x in b.parts if isinstance(x, Block)}
    return "\n".join(said(b) for b in found if id(b) in kept and id(b) not in within)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pa.array([main_text(x.as_py()) for x in batch.column("html")], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page: the article's text without the page around it.

    pages: page_id, url, html. Null, empty and text-free pages give an empty text; broken and cut-off
    markup is read as far as it goes; very long pages are read whole, in time linear in their tags; repeated
    rows are read alike; ids and urls may be null; further columns, whatever their names, are ignored; an
    empty table gives an empty result. No shuffle; a task holds one page's blocks at a time besides its batch.
    """
    told = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return told.mapInArrow(_extract, "page_id long, url string, text string")


def op3_html_extract(spark, sf_dir: str) -> DataFrame:
    """The main text of every page and its code points."""
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
