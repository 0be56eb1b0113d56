"""Main text of web pages by a minimum cut between content and boilerplate."""

from __future__ import annotations

import re
from collections import Counter, deque
from html.parser import HTMLParser
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed sets of element names.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HIDDEN = {"script", "style", "head", "noscript", "template", "svg", "iframe", "object", "canvas", "button", "select", "textarea", "option", "audio", "video", "map", "datalist"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: A start tag closes the open elements of the second set, up to one of the third.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
AWAY = {"nav", "aside", "form", "footer", "menu", "dialog", "search", "fieldset"}
AWAY_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form"}
AWAY_NAMES = re.compile(r"(?:^|[-_\s])(?:ads?|adverts?|advertisement|advertising|adsense|sponsor(?:ed)?|promo|promotion|banner|sidebar|side|widget|nav|navbar|navigation|menu|breadcrumbs?|footer|masthead|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|comments?|commentlist|disqus|replies|respond|share|sharing|social|related|recommended|pagination|pager|toolbar|copyright)(?:$|[-_\s\d])", re.I)
#: Of these names those that also stand in names of other things, and so tell little inside the main part.
SOFT_NAMES = re.compile(r"(?:^|[-_\s])(?:side|social|share|sharing|related|recommended|widget|banner|notice|alert|promotion|overlay|toolbar|menu)(?:$|[-_\s\d])", re.I)
#: Headings of reader comments: those that say so by themselves, and words that do if they stand at the head of a part of their own.
COMMENT_HEAD = re.compile(r"(?:\d+|one|no)\s+(?:reader\s+)?(?:comments?|thoughts?|responses?|repl(?:y|ies)|commentaires?|réponses?|kommentare?|antworten|comentarios?|respuestas?)\b|leave a (?:reply|comment)\b|(?:join|start) the (?:discussion|conversation)\b|(?:reader|user) comments\b|what (?:readers|others) (?:say|said)\b|laisser un commentaire\b|schreibe einen kommentar\b|deja un comentario\b", re.I)
COMMENT_WORD = re.compile(r"(?:comments?|responses|replies|discussion|commentaires?|réponses|kommentare?|antworten|comentarios?|respuestas?)\s*(?:\(\d+\))?:?", re.I)
MAIN_NAMES = re.compile(r"(?:^|[-_\s])(?:article|content|main|post|entry|story|body)(?:$|[-_\s])", re.I)
# Fixed phrases of notices and calls to readers, which tell against short blocks.
NOTICE = re.compile(r"\bcookies?\b|\bsubscribe\b|\bnewsletter\b|\bsign (?:in|up)\b|\blog ?in\b|\badvertisement\b|\bsponsored\b|\bshare (?:this|on)\b|\brelated (?:posts|articles|stories)\b|©|\(c\) ?\d{4}|\ball rights reserved\b", re.I)
TEXT_TAGS = {"p", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption", "dd", "dt", "td", "th"}


class Element:
    """An element, below another one; own numbers the elements of a page, depth those around one."""

    __slots__ = ("tag", "own", "names", "role", "hidden", "parent", "depth")

    def __init__(self, tag: str, own: int, attrs: dict[str, str | None], parent: Element | None):
        self.tag, self.own, self.parent, self.depth = tag, own, parent, parent.depth + 1 if parent else 0
        self.names, self.role = f"{attrs.get('class') or ''} {attrs.get('id') or ''}", (attrs.get("role") or "").lower()
        self.hidden = tag in HIDDEN or "hidden" in attrs or attrs.get("aria-hidden") == "true"


class Block:
    """Text of a page between block boundaries, with the element that it stands in, the innermost block around it, and its links."""

    __slots__ = ("text", "element", "tag", "linked")

    def __init__(self, text: str, element: Element | None, tag: str, linked: int):
        self.text, self.element, self.tag, self.linked = text, element, tag, linked


class PageBlocks(HTMLParser):
    """Cuts a page into blocks; elements left open are closed as browsers do, in the main. How many elements of a name are open is known, so that none is looked for in vain."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.elements, self.open, self.within, self.parts, self.links, self.hidden = [], [], [], [], [], 0, 0
        self.names: Counter[str] = Counter()

    def flush(self) -> None:
        if self.parts and (text := " ".join("".join(self.parts).split())):
            self.blocks.append(Block(text, self.open[-1] if self.open else None, self.within[-1].tag if self.within else "", self.links))
        self.parts, self.links = [], 0

    def close_to(self, k: int) -> None:
        if any(e.tag in BLOCKS for e in self.open[k:]):
            self.flush()
        for e in self.open[k:]:
            self.left(e)
        del self.open[k:]

    def left(self, e: Element) -> None:
        self.names[e.tag] -= 1
        self.hidden -= e.hidden
        if self.within and self.within[-1] is e:
            self.within.pop()

    def ended(self, ends: set[str], stops: set[str]) -> None:
        """Closes the innermost open element of ends, unless one of stops is further inside."""
        if any(self.names[t] for t in ends):
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k].tag in ends:
                    self.close_to(k)
                    return
                if self.open[k].tag in stops:
                    return

    def handle_starttag(self, tag, attrs):
        if tag == "br" or tag == "wbr":
            self.parts.append(" " * (tag == "br"))
            return
        if tag in BLOCKS:
            self.flush()
            self.ended({"p"}, BLOCKS)
        if tag in CLOSES:
            self.ended(*CLOSES[tag])
        if tag == "body" and self.names["head"]:  # a head left open ends here
            for e in self.open:
                if e.tag == "head":
                    self.left(e)
            self.open = [e for e in self.open if e.tag != "head"]
        if tag not in VOID:
            e = Element(tag, len(self.elements), dict(attrs), self.open[-1] if self.open else None)
            self.elements.append(e)
            self.open.append(e)
            self.names[tag] += 1
            self.hidden += e.hidden
            if tag in BLOCKS:
                self.within.append(e)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1].tag == tag and tag in ("svg", "script", "iframe", "path"):
            self.left(self.open.pop())

    def handle_endtag(self, tag):
        if not self.names[tag]:
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag == tag:
                self.close_to(k)
                return
            if self.open[k].tag in ("article", "main", "body") and tag not in BLOCKS:
                return

    def handle_data(self, data):
        if self.hidden:
            return
        self.parts.append(data)
        if self.names["a"]:
            self.links += len(data.strip())


class Page(NamedTuple):
    """A page's blocks in order, and its elements, those outside before those inside."""

    blocks: list[Block]
    elements: list[Element]


def page_of(html: str) -> Page:
    parser = PageBlocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return Page(parser.blocks, parser.elements)


def page_blocks(html: str) -> list[Block]:
    return page_of(html).blocks


def _kind_away(e: Element, inside: bool) -> bool:
    return e.tag in AWAY or e.role in AWAY_ROLES or (e.tag == "header" and not inside)


def _is_main(e: Element) -> bool:
    return e.tag in ("article", "main") or e.role in ("main", "article")


def text_sizes(page: Page) -> list[int]:
    """The characters of text in each element."""
    sizes = [0] * len(page.elements)
    for b in page.blocks:
        if b.element:
            sizes[b.element.own] += len(b.text)
    for e in reversed(page.elements):
        if e.parent:
            sizes[e.parent.own] += sizes[e.own]
    return sizes


def around(e: Element | None) -> list[Element]:
    """The elements around one, itself left out."""
    found = []
    while e and e.parent:
        e = e.parent
        found.append(e)
    return found


def wrappers(page: Page, sizes: list[int]) -> set[int]:
    """Elements that hold the page's main part, whose names therefore say nothing: around the largest main and the largest article
    (in that main, if there is one), or, on a page without both, those with more than half of its text."""
    away, named = [False] * len(page.elements), {"main": [], "article": []}
    for e in page.elements:
        away[e.own] = (e.parent is not None and away[e.parent.own]) or e.tag in AWAY or e.role in AWAY_ROLES
        kind = e.tag if e.tag in named else e.role
        if kind in named and not away[e.own] and not AWAY_NAMES.search(e.names) and sizes[e.own]:
            named[kind].append(e)
    if not named["main"] and not named["article"]:
        total = sum(len(b.text) for b in page.blocks)
        return {e.own for e in page.elements if 2 * sizes[e.own] > total}
    found: set[int] = set()
    largest = None
    for kind in ("main", "article"):
        inside = [False] * len(page.elements)
        if largest is not None:
            for e in page.elements:
                inside[e.own] = e.parent is not None and (inside[e.parent.own] or e.parent is largest)
        if some := [e for e in named[kind] if largest is None or inside[e.own]]:
            best = max(some, key=lambda e: sizes[e.own])
            found.update(e.own for e in around(best))
            largest = best if kind == "main" else largest
    return found


class State(NamedTuple):
    """What the elements around a place say of it: away (its kind, or that of one around it, is boilerplate), inside (the main part), cost of a name of boilerplate, and how many names
    of a main part there are."""

    away: bool = False
    inside: bool = False
    cost: float = 0.0
    mains: float = 0.0


def _next(state: State, e: Element, wraps: set[int], comments: set[int]) -> State:
    inside = state.inside or (not state.cost and _is_main(e))
    if state.away or _kind_away(e, inside):
        return State(True, inside, state.cost, state.mains)
    if e.own in comments:
        return State(False, False, 7.0, 0.0)
    if e.tag not in ("html", "body", "article", "main") and e.own not in wraps and AWAY_NAMES.search(e.names):
        if inside and not AWAY_NAMES.search(SOFT_NAMES.sub(" ", e.names)):
            alone = any(SOFT_NAMES.fullmatch(n) for n in e.names.split())
            return State(False, True, max(state.cost, 8.5 if alone else 4.0), state.mains)
        return State(False, False, 7.0, 0.0)
    return State(False, inside, state.cost, state.mains + (e.tag not in ("html", "body") and bool(MAIN_NAMES.search(e.names))))


def comment_parts(page: Page, sizes: list[int], wraps: set[int]) -> tuple[set[int], set[int]]:
    """(elements, blocks) of reader comments that their heading shows: what is around a heading of comments, unless that is the main part or half of the page, or else
    all that follows a heading that says by itself that comments follow."""
    total = sum(len(b.text) for b in page.blocks)
    elements: set[int] = set()
    after: set[int] = set()
    for k, b in enumerate(page.blocks):
        says = len(b.text) < 100 and COMMENT_HEAD.match(b.text)
        if not says and not (len(b.text) < 40 and COMMENT_WORD.fullmatch(b.text)):
            continue
        if not (b.tag in HEADS or says and b.tag in ("p", "div", "span", "li", "legend", "summary", "section")):
            continue
        e = b.element
        while e and (e.tag not in BLOCKS or e.tag == b.tag and e.tag in HEADS | {"p", "li", "legend", "summary"}):
            e = e.parent
        own = e and e.tag not in ("html", "body") and not _is_main(e) and e.own not in wraps and 2 * sizes[e.own] < total
        if own:
            elements.add(e.own)
        elif says and b.tag in HEADS:
            held = e.own if e else None
            for j in range(k, len(page.blocks)):
                at = page.blocks[j].element
                while at and at.own != held and (e is None or at.depth > e.depth):
                    at = at.parent
                if (at.own if at else None) != held:
                    break
                after.add(j)
    return elements, after


HEADS = {"h1", "h2", "h3", "h4", "h5", "h6"}


def leanings(page: Page) -> tuple[list[float], list[bool]]:
    """(how far each block by itself looks like content, above 0, or boilerplate; whether what is around it says that it is boilerplate): a linear classifier with set weights.

    Without a sign of boilerplate a block is content: only links, notices, and the elements around it tell against it. An element whose kind is boilerplate decides;
    a name of boilerplate is a cost, and what is around it doesn't speak for the block any more. Inside the main part, names that other things have too are a smaller
    cost, which long text without links outweighs. The names of wrappers don't count.
    """
    sizes = text_sizes(page)
    wraps = wrappers(page, sizes)
    comments, after = comment_parts(page, sizes, wraps)
    states: list[State] = []
    for e in page.elements:
        states.append(_next(states[e.parent.own] if e.parent else State(), e, wraps, comments))
    out, said = [], []
    for k, b in enumerate(page.blocks):
        s = states[b.element.own] if b.element else State()
        if k in after:
            s = State(s.away, False, 7.0, 0.0)
        z = min(s.mains, 2.0) + 6.0 * s.inside - s.cost
        z += 1.0 if b.tag in TEXT_TAGS else 0.0
        z += 0.5 + min(len(b.text), 400) / 200
        z -= 5.0 * b.linked / len(b.text)
        z -= 3.0 if len(b.text) < 200 and not s.inside and NOTICE.search(b.text) else 0.0
        out.append(-20.0 if s.away else z)
        said.append(s.away or (s.cost > 0 and not s.inside and z < 0))
    return out, said


def proximity(a: Block, b: Block) -> float:
    """How near two blocks are in the document tree, from 1 (same parent) down to 0, which is what they are from some twenty steps on."""
    x, y, steps = a.element, b.element, 0
    while x is not y and steps < 24:
        if y is None or (x and x.depth >= y.depth):
            x = x.parent
        else:
            y = y.parent
        steps += 1
    return 2.0 ** -max(0, steps - 2) if steps < 24 else 0.0


class FlowNetwork:
    """Maximum flow by shortest augmenting levels, whole capacities."""

    def __init__(self, size: int):
        self.out: list[list[int]] = [[] for _ in range(size)]
        self.to: list[int] = []
        self.left: list[int] = []

    def edge(self, a: int, b: int, forth: int, back: int = 0) -> None:
        for x, y, c in ((a, b, forth), (b, a, back)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.left.append(c)

    def levels(self, source: int) -> list[int]:
        level = [-1] * len(self.out)
        level[source] = 0
        todo = deque([source])
        while todo:
            x = todo.popleft()
            for e in self.out[x]:
                if self.left[e] > 0 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[x] + 1
                    todo.append(self.to[e])
        return level

    def side(self, source: int, sink: int) -> list[bool]:
        """Saturates the network and tells which nodes are on the source's side of the minimum cut."""
        while (level := self.levels(source))[sink] >= 0:
            tried = [0] * len(self.out)
            path: list[int] = []
            x = source
            while True:
                if x == sink:
                    flow = min(self.left[e] for e in path)
                    for e in path:
                        self.left[e] -= flow
                        self.left[e ^ 1] += flow
                    x, path = source, []
                while tried[x] < len(self.out[x]):
                    e = self.out[x][tried[x]]
                    if self.left[e] > 0 and level[self.to[e]] == level[x] + 1:
                        break
                    tried[x] += 1
                if tried[x] < len(self.out[x]):
                    path.append(self.out[x][tried[x]])
                    x = self.to[path[-1]]
                elif path:
                    level[x] = -1
                    x = self.to[path.pop() ^ 1]
                else:
                    break
        return [x >= 0 for x in level]


def content(page: Page, smooth: float = 1.0) -> list[bool]:
    """Which blocks are content: the minimum cut of classifier costs and smoothness between neighbours.

    Each block is joined to the next one, and to the one before it under the same parent, with smooth times their proximity. Blocks that are said to be boilerplate are joined
    to none, and those on both sides of them to each other, so that what stands between paragraphs doesn't pull them along.
    """
    lean, said = leanings(page)
    n = len(page.blocks)
    if not n:
        return []
    net = FlowNetwork(n + 2)
    for k, value in enumerate(lean):
        z = round(100 * value)
        net.edge(n, k, max(z, 0))
        net.edge(k, n + 1, max(-z, 0))
    seen: dict[int, int] = {}
    last = None
    for k, block in enumerate(page.blocks):
        if said[k]:
            continue
        near = set() if last is None else {last}
        parent = block.element.parent.own if block.element and block.element.parent else -1
        near |= {seen[parent]} if parent in seen else set()
        seen[parent] = last = k
        for j in near:
            if weight := round(100 * smooth * proximity(page.blocks[j], block)):
                net.edge(j, k, weight, weight)
    return net.side(n, n + 1)[:n]


def main_text(html: str) -> str:
    """The content blocks of a page, in page order, joined by line ends. If the cut leaves none, all blocks that aren't boilerplate by the kind of an element, and not by a name that
    says so outside the main part."""
    page = page_of(html)
    kept = [b for b, yes in zip(page.blocks, content(page), strict=True) if yes]
    if not kept:
        sizes = text_sizes(page)
        wraps = wrappers(page, sizes)
        states: list[State] = []
        for e in page.elements:
            states.append(_next(states[e.parent.own] if e.parent else State(), e, wraps, set()))
        found = [(b, states[b.element.own] if b.element else State()) for b in page.blocks]
        kept = [b for b, s in found if not s.away and (not s.cost or s.inside)]
    return "\n".join(b.text for b in kept)


def extract(html: Column) -> Column:
    """The main text of pages; a null or empty page, or one of boilerplate alone, gives an empty text. Very long pages are read whole."""

    @F.pandas_udf("string")
    def texts(pages: pd.Series) -> pd.Series:
        return pages.fillna("").map(main_text)

    return texts(html.cast("string"))


def op9_html_text(pages: DataFrame) -> DataFrame:
    """The thin query over extract; repeated rows are answered each, other columns are ignored."""
    return pages.select("page_id", "url", extract(F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
