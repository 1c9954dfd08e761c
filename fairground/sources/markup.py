"""A small tree of a page's elements, to pick parts by tag and class."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from ..shipping import by_value

by_value(__name__)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
LINES = {"p", "div", "li", "tr", "section", "article", "br", "h1", "h2", "h3", "h4", "h5", "h6"}


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None) -> None:
        self.tag, self.attrs, self.up, self.kids = tag, attrs, up, []

    def walk(self) -> Iterator[Node]:
        """This element and all below it, in the order of the page."""
        stack: list[Node] = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(k for k in reversed(node.kids) if isinstance(k, Node))

    def all(self, tag: str | None = None, cls: str | None = None, **attrs: str | None) -> list[Node]:
        """Elements below with a tag, a word of the class, and attributes (None: any value)."""
        fits = lambda n: (tag is None or n.tag == tag) and (cls is None or cls in n.attrs.get("class", "").split()) and all(k in n.attrs and (v is None or n.attrs[k] == v) for k, v in attrs.items())
        return [n for n in self.walk() if n is not self and fits(n)]

    def one(self, *args, **attrs) -> Node | None:
        return next(iter(self.all(*args, **attrs)), None)

    def raw(self) -> str:
        """All text below, scripts included."""
        return "".join(k if isinstance(k, str) else k.raw() for k in self.kids)

    def lines(self) -> str:
        """Text with blocks on lines of their own; runs of blank lines shrink to one."""
        out: list[str] = []

        def add(node: Node) -> None:
            for k in node.kids:
                if isinstance(k, str):
                    out.append(k.replace("\n", " "))
                elif k.tag not in ("script", "style"):
                    add(k)
                    out.append("\n" if k.tag in LINES else " ")

        add(self)
        rows = [" ".join(r.split()) for r in "".join(out).split("\n")]
        return "\n".join(r for i, r in enumerate(rows) if r or (i and rows[i - 1])).strip()

    def text(self) -> str:
        return " ".join(self.lines().split())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.top = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.kids.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.top and node.tag != tag:
            node = node.up
        if node is not self.top:
            self.at = node.up

    def handle_data(self, data):
        self.at.kids.append(data)


def tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.top


def plain(html: str | None) -> str:
    """Lines of text of a fragment."""
    return tree(html).lines() if html else ""


def shorten(text: str, most: int = 1000) -> str:
    """Cut behind a sentence, or before a line or word, of the second half."""
    if len(text) <= most:
        return text
    head = text[:most]
    at = max(head.rfind(m) for m in (". ", "\n", " "))
    return head[: at + head.startswith(". ", at) if at > most / 2 else most].strip() + "…"
