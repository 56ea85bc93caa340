"""A captured page as an indexed tree.

Elements are numbered in document order and each knows the number after its last
descendant, so "the first heading inside this element" is a bisection in the sorted
places of all headings, and an element's text is a slice of the page's text
pieces. Parsing is tolerant (unclosed and stray tags) and decodes entities. Plain tags, which are
nearly all, are read by one pattern each; every other piece of a page is left to ``HTMLParser``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

VOID = {"br", "img", "meta", "link", "input", "hr", "source", "wbr", "area", "base", "col", "embed", "param", "track"}
#: Lower-case names, attributes in double quotes and without entities; not the tags that change how their content is read.
_PLAIN_START = re.compile(r'<(?!(?:script|style|textarea|title|xmp|iframe|noembed|noframes|noscript|plaintext)[\s>])([a-z][a-z0-9]*)((?:\s+[a-z][a-z0-9-]*="[^"&]*")*)>')
_PLAIN_ATTRIBUTE = re.compile(r'([a-z][a-z0-9-]*)="([^"]*)"')
_PLAIN_END = re.compile(r"</([a-z][a-z0-9]*)>")


class Element:
    __slots__ = ("tag", "attrs", "parent", "number", "end", "first_text", "last_text", "children")

    def __init__(self, tag: str, attrs: dict, parent: "Element | None", number: int, text_at: int):
        self.tag, self.attrs, self.parent, self.number = tag, attrs, parent, number
        self.end, self.first_text, self.last_text = number + 1, text_at, text_at
        self.children = 0  # their number; the first is the next element in document order

    @property
    def classes(self) -> str:
        return self.attrs.get("class") or ""

    def ancestors(self, most: int) -> Iterator["Element"]:
        node = self.parent
        while node is not None and most > 0:
            yield node
            node, most = node.parent, most - 1


class Page(HTMLParser):
    """Elements and stripped text pieces of a page, in document order."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.root = Element("root", {}, None, -1, 0)
        self.elements: list[Element] = []
        self._open = self.root
        self._places: dict[str, list[int]] = {}
        self.feed(html or "")
        self.close()
        while self._open is not None:
            self._leave(self._open)
            self._open = self._open.parent

    def _leave(self, node: Element) -> None:
        node.end, node.last_text = len(self.elements), len(self.pieces)

    def updatepos(self, i, j):
        return j  # line numbers are not used

    def parse_starttag(self, i):
        plain = _PLAIN_START.match(self.rawdata, i)
        if plain is None:
            return super().parse_starttag(i)
        self.handle_starttag(plain[1], _PLAIN_ATTRIBUTE.findall(plain[2]) if plain[2] else ())
        return plain.end()

    def parse_endtag(self, i):
        plain = _PLAIN_END.match(self.rawdata, i) if self.cdata_elem is None else None
        if plain is None:
            return super().parse_endtag(i)
        self.handle_endtag(plain[1])
        return plain.end()

    def handle_starttag(self, tag, attrs):
        node = Element(tag, {k: v if v is not None else "" for k, v in attrs} if attrs else {}, self._open, len(self.elements), len(self.pieces))
        self._open.children += 1
        self.elements.append(node)
        if tag in VOID:
            self._leave(node)
        else:
            self._open = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self._open
        while node is not None and node.tag != tag:
            node = node.parent
        if node is None or node is self.root:
            return
        while True:
            closed = self._open
            self._leave(closed)
            self._open = closed.parent
            if closed is node:
                return

    def handle_data(self, data):
        piece = data.strip()
        if piece:
            self.pieces.append(piece)

    def text(self, node: Element, joiner: str = " ") -> str:
        return joiner.join(self.pieces[node.first_text:node.last_text])

    def only_text(self, node: Element) -> str | None:
        """The text of an element that holds one piece, directly or in a chain of single elements."""
        if node.last_text - node.first_text != 1:
            return None
        while node.children:
            child = self.elements[node.number + 1]
            if node.children > 1 or child.last_text == child.first_text:
                return None
            node = child
        return self.pieces[node.first_text]

    def places(self, kind: str, test: Callable[[Element], bool]) -> list[int]:
        """Numbers of the elements that pass ``test``; computed once per ``kind``."""
        if kind not in self._places:
            self._places[kind] = [e.number for e in self.elements if test(e)]
        return self._places[kind]

    def first_inside(self, node: Element, kind: str, test: Callable[[Element], bool]) -> Element | None:
        found = self.places(kind, test)
        k = bisect_left(found, node.number + 1)
        return self.elements[found[k]] if k < len(found) and found[k] < node.end else None

    def all_inside(self, node: Element, kind: str, test: Callable[[Element], bool]) -> list[Element]:
        found = self.places(kind, test)
        return [self.elements[k] for k in found[bisect_left(found, node.number + 1):bisect_left(found, node.end)]]
