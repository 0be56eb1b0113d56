"""Small helpers for tasks: a lenient HTML tree, allow-lists, and the blocks of one page."""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

from foliant.functions.code_lines import runs
from foliant.functions.nested import flat, joined, safe_address

# Fixed sets of element names and attributes.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
UNSEEN = {"script", "style", "head", "template", "noscript"}
WRAPPERS = {"html", "body", "div", "section", "article", "main"}
BLOCK_TAGS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
INLINE = {"a": ("href", "rel", "target", "title"), "br": (), "code": (), "em": (), "i": (), "img": ("alt", "src"), "strong": (), "sub": (), "sup": (), "u": ()}
LIST = INLINE | {"li": (), "ol": (), "ul": ()}
QUOTE = INLINE | {"cite": (), "p": ()}
TABLE = INLINE | {"tbody": (), "td": ("colspan", "rowspan"), "tfoot": (), "th": ("colspan", "rowspan"), "thead": (), "tr": ()}
INLINE_TAGS = {"a", "abbr", "b", "br", "cite", "code", "del", "em", "i", "img", "ins", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "u"}
CALLOUT_NAMES = re.compile(r"\b(callout|note|tip|warning|important|caution)\b")
CALLOUT_TEXT = re.compile(r"(note|tip|warning|important|caution):\s+")
#: Attributes whose value is an address.
ADDRESSES = {"action", "archive", "background", "cite", "classid", "codebase", "data", "formaction", "href", "icon", "longdesc", "manifest", "poster", "profile", "src", "srcdoc", "usemap", "xlink:href", "xmlns"}
PRESETS = ("plain_blocks", "clean_article", "documentation")
LEVELS = {f"h{k}": k for k in range(1, 7)}


def escape(text: str, quote: bool = True) -> str:
    """Text as HTML; quotes as in attributes and code."""
    out = text.replace("&", "&amp;") if "&" in text else text
    if "<" in out or ">" in out:
        out = out.replace("<", "&lt;").replace(">", "&gt;")
    return out.replace('"', "&quot;").replace("'", "&#039;") if quote else out


_COUNTED = {"img", "table", "a"}


class Node:
    """An element, or a text where tag is empty. images, tables and links count what is in it, itself included, once the tree is read; plain says that only texts are, as the reader has seen."""

    __slots__ = ("tag", "attrs", "children", "text", "images", "tables", "links", "plain")

    def __init__(self, tag: str, attrs: dict | None = None, text: str = ""):
        self.tag, self.attrs, self.children, self.text = tag, attrs or {}, [], text
        self.images = self.tables = self.links = 0
        self.plain = False
        if tag in _COUNTED:
            self.images, self.tables, self.links = int(tag == "img"), int(tag == "table"), int(tag == "a")

    def nodes(self) -> Iterator[Node]:
        """The node and all in it, in order."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(reversed(node.children))

    def content(self) -> str:
        if self.plain and self.tag:
            if len(self.children) == 1:
                return self.children[0].text
            return "\n" if self.tag == "br" else "".join([c.text for c in self.children])
        return "".join(n.text if not n.tag else "\n" if n.tag == "br" else "" for n in self.nodes())

    def find(self, tag: str) -> list[Node]:
        return [n for n in self.nodes() if n.tag == tag]


class Tree(HTMLParser):
    """Builds a tree; p, li, rows and cells left open end where browsers end them. How many elements of a name are open is known, so that none is looked for in vain."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.names, self.made, self.unseen = [Node("body")], defaultdict(int), [], 0

    def close_to(self, k: int) -> None:
        for node in self.open[k:]:
            self.names[node.tag] -= 1
            self.unseen -= node.tag in UNSEEN
        del self.open[k:]

    def end(self, tags: set[str], stops: set[str]) -> None:
        if not any(self.names[t] for t in tags):
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                self.close_to(k)
                return
            if self.open[k].tag in stops:
                return

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK_TAGS and self.names["p"]:
            self.end({"p"}, _NOT_P)
        if tag == "li":
            self.end({"li"}, {"ul", "ol"})
        elif tag in ("td", "th"):
            self.end({"td", "th"}, {"tr", "table"})
        elif tag == "tr":
            self.end({"tr"}, {"table"})
        node, above = Node(tag, {k: v or "" for k, v in attrs}), self.open[-1]
        node.plain = True
        self.made.append((above, node))
        above.children.append(node)
        above.plain = False
        if tag not in VOID:
            self.open.append(node)
            self.names[tag] += 1
            self.unseen += tag in UNSEEN

    def handle_endtag(self, tag):
        if not self.names[tag]:
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                self.close_to(k)
                return

    def leaf(self, tag, text):
        """An element without attributes that holds a text or nothing, begun and ended at once."""
        if self.names["p"] and tag in BLOCK_TAGS:
            self.end({"p"}, _NOT_P)
        if tag == "li" and self.names["li"]:
            self.end({"li"}, {"ul", "ol"})
        node, above = Node(tag), self.open[-1]
        node.plain = True
        above.children.append(node)
        above.plain = False
        if text and not self.unseen:
            node.children.append(Node("", None, text))

    def handle_data(self, data):
        if not self.unseen:
            self.open[-1].children.append(Node("", text=data))


_NOT_P = BLOCK_TAGS - {"p"}
_SPACE = r"[ \t\n\r\f]"
_NAMED = rf"""{_SPACE}+([a-zA-Z][a-zA-Z0-9_:-]*)(?:=(?:"([^"&]*)"|'([^'&]*)'|([a-zA-Z0-9_.%:?#/-]+(?<!/)(?=[ \t\n\r\f>]|\Z))))?(?=[ \t\n\r\f/>]|\Z)"""
_OWN = _NAMED.replace("([", "(?:[")
#: Plain pieces of a page: a leaf (name, text), a text, an end tag, a start tag (name, attributes, slash), a script or style (name), a title (name, text), a sign that begins no tag, a comment or the like; and what isn't plain.
_PIECES = re.compile(
    rf"<(p|h[1-6]|li|b|strong|em|i|u|code|span|dt|dd|figcaption)>([^<]*)</\1>|([^<]+)|</([a-zA-Z][a-zA-Z0-9]*){_SPACE}*>|<(?:(script|style)>(?:[^<]|<(?!!--|/(?:script|style)))*+</\5|(title)>([^<]*)</title)>|<([a-zA-Z][a-zA-Z0-9]*)((?:{_OWN})*){_SPACE}*(/?)>|(<)(?=[^a-zA-Z/!?])|<!--[a-zA-Z0-9 :./_]*-->|<!(?:DOCTYPE|doctype) html>|(<)"
)
_ATTRIBUTES = re.compile(_NAMED)
#: Elements whose content a parser reads by rules of its own.
_RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp", "plaintext", "noscript", "svg", "math"}


def _pieces(html: str) -> list[tuple] | None:
    """The plain pieces of a page, as HTMLParser would tell them; None where something isn't plain, so that it is for HTMLParser to say."""
    pieces = _PIECES.findall(html)
    for piece in pieces:
        if piece[11] or piece[7] and piece[7].lower() in _RAW:
            return None
    return pieces


def parse(html: str) -> Node:
    tree = Tree()
    pieces = _pieces(html)
    if pieces is None:
        tree.feed(html)
        tree.close()
    else:
        start, end, data = tree.handle_starttag, tree.handle_endtag, tree.handle_data
        for leaf, held, text, closed, raw, title, inside, opened, attrs, slash, sign, _ in pieces:
            if leaf:
                tree.leaf(leaf, unescape(held) if "&" in held else held)
            elif text:
                data(unescape(text) if "&" in text else text)
            elif closed:
                end(closed.lower())
            elif opened:
                start(opened.lower(), [(k.lower(), a or b or c) for k, a, b, c in _ATTRIBUTES.findall(attrs)] if attrs else ())
                if slash:
                    end(opened.lower())
            elif raw or title:
                start(raw or title, ())
                if inside:
                    data(unescape(inside))
                end(raw or title)
            elif sign:
                data(sign)
    for above, node in reversed(tree.made):
        if node.images:
            above.images += node.images
        if node.tables:
            above.tables += node.tables
        if node.links:
            above.links += node.links
    return tree.open[0]


def _shown(attrs: dict[str, str]) -> str:
    """Attributes as HTML; addresses that could run something go."""
    if not attrs:
        return ""
    return "".join(f' {k}="{escape(v)}"' for k, v in attrs.items() if k not in ADDRESSES or safe_address(v))


def _inner(node: Node, allowed: dict[str, tuple[str, ...]]) -> Iterator:
    for c in node.children:
        if not c.tag:
            yield escape(c.text, quote=False)
        elif c.tag in allowed:
            yield f"<{c.tag}{_shown({k: v for k, v in c.attrs.items() if k in allowed[c.tag]})}>"
            if c.tag not in VOID:
                yield _inner(c, allowed)
                yield f"</{c.tag}>"
        elif c.tag not in UNSEEN:
            yield _inner(c, allowed)


def cleaned(node: Node, allowed: dict[str, tuple[str, ...]]) -> str:
    """The inner HTML of a node with allowed elements and attributes; others leave their contents."""
    if node.plain:
        return escape(node.content(), quote=False) if node.tag != "br" else ""
    return joined(_inner(node, allowed))


def _whole(node: Node) -> Iterator:
    if not node.tag:
        yield escape(node.text, quote=False)
        return
    yield f"<{node.tag}{_shown({k: v for k, v in node.attrs.items() if not k.startswith('on')})}>"
    if node.tag not in VOID:
        yield from (_whole(c) for c in node.children if c.tag not in UNSEEN)
        yield f"</{node.tag}>"


def outer(node: Node) -> str:
    """A node as HTML, with its attributes and all that is in it; scripts and the like go."""
    return joined(_whole(node))


def standalone_image(node: Node) -> dict | None:
    """The image of an img, or of an a, figure, p or span with one img and no text besides a caption."""
    if node.tag == "img":
        return {"url": node.attrs.get("src", ""), "alt": node.attrs.get("alt", ""), "caption": "", "href": ""}
    if node.tag not in ("a", "figure", "p", "span") or node.images != 1:
        return None
    images = node.find("img")
    captions = node.find("figcaption") if node.tag == "figure" else []
    caption = " ".join(" ".join(c.content() for c in captions).split())
    if " ".join(node.content().split()) != caption:
        return None
    links = [a for a in node.find("a") if a.images] if node.links else []
    return {"url": images[0].attrs.get("src", ""), "alt": images[0].attrs.get("alt", ""), "caption": caption, "href": links[0].attrs.get("href", "") if links else ""}


_ROLES = dict.fromkeys(LEVELS, "heading") | {"ul": "list", "ol": "list", "table": "table", "pre": "code", "code": "code"}


def role(node: Node) -> str:
    """What a part of a page is, by the first rule that fits."""
    if node.tag in _ROLES:
        return _ROLES[node.tag]
    if node.images and standalone_image(node):
        return "image"
    names = " ".join(node.attrs.get(k, "") for k in ("class", "id", "data-type")).lower() if node.attrs else ""
    if node.tag in ("blockquote", "aside") or names and CALLOUT_NAMES.search(names) or node.tag == "p" and ":" in (said := node.content()) and CALLOUT_TEXT.match(" ".join(said.lower().split()) + " "):
        return "callout"
    return "container" if node.tag in WRAPPERS else "default"


def _items(node: Node) -> Iterator:
    """A list's HTML; lists in its items are blocks of their own."""
    yield f'<{node.tag} class="wp-block-list">'
    for li in (c for c in node.children if c.tag == "li"):
        plain, nested = Node("li"), []
        for c in li.children:
            (nested if c.tag in ("ul", "ol") else plain.children).append(c)
        yield f"<!-- wp:list-item --><li>{cleaned(plain, INLINE).strip()}"
        for n in nested:
            opening, closing = _marks("list", _list_attrs(n))
            yield opening
            yield _items(n)
            yield closing
        yield "</li><!-- /wp:list-item -->"
    yield f"</{node.tag}>"


def _list_attrs(node: Node) -> dict:
    return {"ordered": True} if node.tag == "ol" else {}


def _marks(name: str, attrs: dict) -> tuple[str, str]:
    shown = f" {json.dumps(attrs, separators=(',', ':'), ensure_ascii=False)}" if attrs else ""
    return f"<!-- wp:{name}{shown} -->", f"<!-- /wp:{name} -->"


_NAMES = {"ul": "list", "ol": "list", "table": "table", "blockquote": "quote", "hr": "separator"}


def name_of(node: Node, kind: str, preset: str = "plain_blocks") -> str:
    """The name of an element's block, as block_of has it; kind is the element's role."""
    tag = node.tag
    if tag in LEVELS:
        return "heading"
    if kind == "image" or node.images and standalone_image(node):
        return "image"
    if preset == "documentation" and kind == "callout":
        return "quote"
    if tag == "p" or tag in INLINE_TAGS:
        return "paragraph"
    if tag == "pre":
        return "code" if preset == "documentation" else "preformatted"
    return _NAMES.get(tag, "html")


def block_of(node: Node, preset: str = "plain_blocks") -> tuple[str, dict, str]:
    """(name, attributes, inner HTML) of an element."""
    tag = node.tag
    if tag in LEVELS:
        level = 2 if tag == "h1" and preset == "clean_article" else LEVELS[tag]
        return "heading", {"level": level}, f"<h{level}>{cleaned(node, INLINE)}</h{level}>"
    if node.images and (image := standalone_image(node)):
        attrs = {k: image[k] for k in ("url", "alt", "caption", "href") if image[k]}
        if image["href"]:
            attrs["linkDestination"] = "custom"
        alt = f' alt="{escape(image["alt"])}"' if image["alt"] else ""
        img = f'<img src="{escape(image["url"])}"{alt} />'
        img = f'<a href="{escape(image["href"])}">{img}</a>' if image["href"] else img
        caption = f'<figcaption class="wp-element-caption">{escape(image["caption"])}</figcaption>' if image["caption"] else ""
        return "image", attrs, f'<figure class="wp-block-image">{img}{caption}</figure>'
    if preset == "documentation" and role(node) == "callout":
        inner = cleaned(node, QUOTE)
        inner = f"<p>{inner}</p>" if tag == "p" else inner
        return "quote", {"className": "doc-callout"}, f'<blockquote class="wp-block-quote doc-callout">{inner}</blockquote>'
    if tag == "p":
        return "paragraph", {}, f"<p>{cleaned(node, INLINE)}</p>"
    if tag in INLINE_TAGS:
        frame = Node("p")
        frame.children = [node]
        return "paragraph", {}, f"<p>{cleaned(frame, INLINE)}</p>"
    if tag in ("ul", "ol"):
        return "list", _list_attrs(node), joined(_items(node))
    if tag == "table":
        return "table", {}, f'<figure class="wp-block-table"><table>{cleaned(node, TABLE)}</table></figure>'
    if tag == "blockquote":
        return "quote", {}, f"<blockquote>{cleaned(node, QUOTE)}</blockquote>"
    if tag in ("pre", "code"):
        return code_block(node.content()) if preset == "documentation" else ("preformatted", {}, f"<pre>{escape(node.content(), quote=False)}</pre>")
    if tag == "hr":
        return "separator", {}, '<hr class="wp-block-separator has-alpha-channel-opacity"/>'
    return "html", {}, outer(node)


def code_block(code: str) -> tuple[str, dict, str]:
    code = code.replace("\r\n", "\n").replace("\r", "\n").rstrip()
    return "code", {}, f'<pre class="wp-block-code"><code>{escape(code)}</code></pre>'


def code_paragraphs(children: list[Node], roles: list[str], contents: list[str]) -> dict[int, tuple[int, str]]:
    """Of the children of a container, with their roles and contents: first child to (last child, code) of each run of code in paragraphs. Only plain paragraphs without images and tables are lines."""
    texts = [_lines(said) if c.tag == "p" and kind == "default" and not c.images and not c.tables else None for c, kind, said in zip(children, roles, contents, strict=True)]
    return {first: (last, code) for first, last, _, code in runs(texts)}


def _lines(said: str) -> str:
    """A paragraph's text as lines of code, their ends trimmed."""
    if "\n" in said or "\r" in said:
        return "\n".join(x.replace("\u00a0", " ").rstrip() for x in re.split(r"\r\n|\r|\n", said))
    return said.replace("\u00a0", " ").rstrip()


BLOCK = ("name", "role", "tag", "level", "depth", "attrs", "text", "inner")


def page_blocks(html: str, preset: str = "plain_blocks", whole: bool = True) -> list[dict]:
    """The rows of block_rows, by the names of BLOCK."""
    return [dict(zip(BLOCK, row, strict=True)) for row in block_rows(html, preset, whole)]


def block_rows(html: str, preset: str = "plain_blocks", whole: bool = True) -> list[tuple]:
    """The blocks of a page in order: name, role, tag, level, depth, attrs (JSON), text, inner. Wrappers are transparent; empty
    parts are left out, but for images and rules, and in plain_blocks all elements stay. In documentation, runs of paragraphs that are code become one block.
    Where they aren't wanted whole, attrs and inner are empty."""
    out: list[tuple] = []

    def add(name: str, kind: str, tag: str, depth: int, attrs: dict, text: str, inner: str) -> None:
        shown = json.dumps(attrs, ensure_ascii=False) if attrs else "{}"
        out.append((name, kind, tag, LEVELS.get(tag, 0), depth, shown if whole else "", text, inner))

    def visit(node: Node, depth: int) -> Iterator:
        children = [c for c in node.children if c.tag and c.tag not in UNSEEN or c.text.strip()]
        roles = [role(c) if c.tag else "default" for c in children]
        contents = [None if c.tag in WRAPPERS and kind == "container" else c.content() if c.tag else c.text for c, kind in zip(children, roles, strict=True)]
        code, after = code_paragraphs(children, roles, contents) if preset == "documentation" else {}, 0
        for k, (c, kind, content) in enumerate(zip(children, roles, contents, strict=True)):
            if k in code:
                after, found = code[k][0] + 1, code[k][1]
                add("code", "code", "p", depth, {}, found, code_block(found)[2] if whole else "")
                continue
            if k < after:
                continue
            if content is None:
                yield visit(c, depth + 1)
                continue
            text = " ".join(content.split())
            if not c.tag:
                add("paragraph", "default", "", depth, {}, text, f"<p>{escape(text, quote=False)}</p>" if whole else "")
            elif text or c.tag == "hr" or c.images or preset == "plain_blocks" and c.tag != "br":
                name, attrs, inner = block_of(c, preset) if whole else (name_of(c, kind, preset), {}, "")
                add(name, kind, c.tag, depth, attrs, content if c.tag in ("p", "pre") else text, inner)

    for _ in flat(visit(parse(html), 0)):
        pass
    return out


def serialized(blocks: list[dict]) -> str:
    return "".join(b["inner"].join(_marks(b["name"], json.loads(b["attrs"]) if b["attrs"] != "{}" else {})) for b in blocks)


_ATTRIBUTE = re.compile(r"""[\s/"']([^\s/>="']+)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""")


class _Images(HTMLParser):
    """The img elements of a page as they are written."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found = []

    def handle_starttag(self, tag, attrs):
        if tag == "img":
            self.found.append(self.get_starttag_text())


def _images(html: str) -> list[tuple[int, str]]:
    """The images of a page as they are written, and where."""
    if _pieces(html) is not None:
        return [(m.start(), m[0]) for m in _PIECES.finditer(html) if m[8] and m[8].lower() == "img"]
    images, out, at = _Images(), [], 0
    images.feed(html)
    images.close()
    for image in images.found:
        at = html.index(image, at)
        out.append((at, image))
        at += len(image)
    return out


def image_cuts(html: str) -> list[str]:
    """A page cut at the sources of its images: text, source as it is written (in its quotes), text, and so on; the last is text. Images without a source aren't cut."""
    out, done = [], 0
    for at, image in _images(html):
        source = next((m for m in _ATTRIBUTE.finditer(image) if m[1].lower() == "src"), None)
        if source:
            out += [html[done : at + source.start(2)], source[2]]
            done = at + source.end(2)
    return [*out, html[done:]]
