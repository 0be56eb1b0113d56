"""Small helpers for tasks: document trees (JSON) as HTML, an element at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from foliant.functions.markup import escape
from foliant.functions.nested import joined, objects, parsed, safe_address, within, words

# Glyphs of numbered lists, and what an address may hold.
NUMBERED = {"DECIMAL", "ZERO_DECIMAL", "UPPER_ALPHA", "ALPHA", "LOWER_ALPHA", "UPPER_ROMAN", "ROMAN", "LOWER_ROMAN"}
_NOT_IN_ADDRESSES = re.compile(r"[^A-Za-z0-9~+_.?#=!&;,/:%@$|*'()\[\]\x80-\U0010ffff-]")


_TAGS = re.compile("<[^>]*>")


class Piece(NamedTuple):
    """An element of a document's parts: its number from 1, how many there are, its HTML, and the end tag of the list that is open after it."""

    pos: int
    total: int
    html: str
    closes: str


class Part(NamedTuple):
    """A document, or one of its tabs, with the lists and inline objects that its elements name."""

    tab: str
    depth: int
    content: list[dict]
    lists: dict
    inline: dict


def parts(tree: dict) -> Iterator[Part]:
    """The tabs of a document in order, children after their parent, or the document itself where it has none. A tab's own lists and objects count before the document's."""
    named = lambda part, name: part[name] if isinstance(part.get(name), dict) else tree[name] if isinstance(tree.get(name), dict) else {}
    of = lambda part, tab, depth: Part(tab, depth, objects(within(part, "body", "content")), named(part, "lists"), named(part, "inlineObjects"))
    if not isinstance(tree.get("tabs"), list):
        yield of(tree, "", 0)
        return
    todo = [(0, t) for t in reversed(objects(tree["tabs"]))]
    while todo:
        depth, tab = todo.pop()
        if isinstance(tab.get("documentTab"), dict):
            yield of(tab["documentTab"], words(within(tab, "tabProperties", "tabId")), depth)
        todo.extend((depth + 1, t) for t in reversed(objects(tab.get("childTabs"))))


def link_address(address: str) -> str:
    """An address for an attribute; empty where its scheme isn't allowed."""
    shown = _NOT_IN_ADDRESSES.sub("", address.strip().replace(" ", "%20"))
    return shown.replace("&", "&#038;").replace("'", "&#039;") if safe_address(address) else ""


def _linked(address: str, html: str) -> str:
    return f'<a href="{link_address(address)}">{html}</a>'


def _run(run: dict) -> str:
    """A text run: escaped, line ends as breaks but for the last, then bold, italic, underline and link around it from the inside."""
    content = words(run.get("content"))
    content = content.removesuffix("\n").removesuffix("\n")
    if not content:
        return ""
    html = escape(content)
    if "\n" in html:
        html = html.replace("\n", "<br>\n")
    if "textStyle" not in run:
        return html
    for style, tag in (("bold", "strong"), ("italic", "em"), ("underline", "u")):
        html = f"<{tag}>{html}</{tag}>" if within(run, "textStyle", style) else html
    address = within(run, "textStyle", "link", "url")
    return _linked(words(address), html) if isinstance(address, (str, int, float)) else html


def _picture(element: dict, part: Part) -> str:
    """An inline object as an image, or the words that describe it where it has no address."""
    embedded = within(part.inline, words(element.get("inlineObjectId")), "inlineObjectProperties", "embeddedObject")
    described = next((t for t in (" ".join(re.sub("<[^>]*>", "", words(within(embedded, k))).split()) for k in ("description", "title")) if t), "")
    address = words(within(embedded, "imageProperties", "contentUri"))
    return f'<img src="{link_address(address)}" alt="{escape(described)}" />' if address else escape(described)


def _inline(element: dict, part: Part) -> str:
    if isinstance(run := element.get("textRun"), dict):
        return _run(run)
    if element.get("horizontalRule") is not None:
        return "<hr />"
    if isinstance(element.get("inlineObjectElement"), dict):
        return _picture(element["inlineObjectElement"], part)
    if isinstance(element.get("richLink"), dict):
        title, address = (words(within(element, "richLink", "richLinkProperties", k)) for k in ("title", "uri"))
        return _linked(address, escape(title)) if title and address else escape(title)
    return escape(words(within(element, "person", "personProperties", "name")))


def list_of(paragraph: dict, part: Part) -> tuple[str, str, int, str] | None:
    """The list that a paragraph is an item of: its tag, id, level and glyph."""
    if "bullet" not in paragraph:
        return None
    name, level = words(within(paragraph, "bullet", "listId")), within(paragraph, "bullet", "nestingLevel")
    if not name:
        return None
    level = abs(int(level)) if isinstance(level, (int, float)) and abs(level) < 1e9 else 0
    levels = within(part.lists, name, "listProperties", "nestingLevels")
    glyph = words(within(levels[level], "glyphType")) if isinstance(levels, list) and level < len(levels) else ""
    return ("ol" if glyph in NUMBERED else "ul"), name, level, glyph


def _end(opened: tuple | None) -> str:
    return f"</{opened[0]}>" if opened else ""


def _paragraph(paragraph: dict, part: Part, opened: tuple | None) -> tuple[str, tuple | None]:
    """(HTML, the list that is open after it) of a paragraph. An empty one leaves an open list as it is."""
    inline = "".join([_inline(e, part) for e in objects(paragraph.get("elements"))])
    if not (_TAGS.sub("", inline) if "<" in inline else inline).strip(" \t\n\r\0\x0b") and not re.search(r"<(?:img|hr)\b", inline):
        return "", opened
    if own := list_of(paragraph, part):
        begins = "" if opened == own else f"{_end(opened)}<{own[0]}>"
        return f"{begins}<li>{inline}</li>", own
    if inline.strip() == "<hr />":
        return f"{_end(opened)}<hr />", None
    found = re.fullmatch("HEADING_([1-6])", words(within(paragraph, "paragraphStyle", "namedStyleType"))) if "paragraphStyle" in paragraph else None
    tag = f"h{found[1]}" if found else "p"
    return f"{_end(opened)}<{tag}>{inline}</{tag}>", None


def _elements(content: list[dict], part: Part, opened: list[tuple | None]) -> Iterator:
    """The HTML of elements one after the other; opened holds the list that is open."""
    for element in content:
        if isinstance(element.get("paragraph"), dict):
            html, opened[0] = _paragraph(element["paragraph"], part, opened[0])
            yield html
        elif isinstance(element.get("table"), dict):
            yield _end(opened[0])
            opened[0] = None
            yield _table(element["table"], part)


def _table(table: dict, part: Part) -> Iterator:
    yield "<table><tbody>"
    for row in objects(table.get("tableRows")):
        yield "<tr>"
        for cell in objects(row.get("tableCells")):
            opened: list[tuple | None] = [None]
            yield "<td>"
            yield _elements(objects(cell.get("content")), part, opened)
            yield f"{_end(opened[0])}</td>"
        yield "</tr>"
    yield "</tbody></table>"


def pieces(document: str | None) -> Iterator[Piece] | None:
    """The elements of a document tree in order; None where it can't be read. What isn't of the kind that is expected in a place counts as nothing."""
    tree = parsed(document)
    if tree is None:
        return None
    found = list(parts(tree))
    total = max(1, sum(len(p.content) for p in found))

    def walk() -> Iterator[Piece]:
        pos = 0
        for part in found:
            opened: list[tuple | None] = [None]
            for k, element in enumerate(part.content):
                pos += 1
                if isinstance(paragraph := element.get("paragraph"), dict):
                    html, opened[0] = _paragraph(paragraph, part, opened[0])
                else:
                    html = joined(_elements([element], part, opened))
                if k == len(part.content) - 1:
                    html, opened = html + _end(opened[0]), [None]
                yield Piece(pos, total, html, _end(opened[0]))

    return walk()


def paragraphs(document: str | None) -> list[dict]:
    """The paragraphs of a document tree in order: tab, depth, style, list_key, text, objects (inline images as HTML)."""
    out = []
    for part in parts(parsed(document) or {}):
        for element in part.content:
            if not isinstance(paragraph := element.get("paragraph"), dict):
                continue
            inside = objects(paragraph.get("elements"))
            own = list_of(paragraph, part)
            images = "".join(_picture(e["inlineObjectElement"], part).replace(" />", ">") for e in inside if isinstance(e.get("inlineObjectElement"), dict))
            text = "".join(words(within(e, "textRun", "content")) for e in inside).removesuffix("\n")
            out.append({"tab": part.tab, "depth": part.depth, "style": words(within(paragraph, "paragraphStyle", "namedStyleType")), "list_key": f"{own[1]}:{own[2]}:{own[3]}" if own else None, "text": text, "objects": images})
    return out


def element_count(document: str | None) -> int:
    """How many elements the parts of a document have, one at least."""
    return max(1, sum(len(p.content) for p in parts(parsed(document) or {})))
