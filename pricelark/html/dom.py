"""A lenient HTML tree on the standard library's tokenizer.

Names are in lower case, text keeps its entities as written, script and style
hold one text node. Void elements have no children; an open p, li, dt, dd,
option, tr, td or th ends where HTML says that it does. An end tag without a
start is left out; one that skips open elements closes them.
"""

from __future__ import annotations

import html
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of this name ends when one of these starts.
ENDS = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]), "tr": frozenset(["tr", "tbody"]), "td": frozenset(["td", "th", "tr", "tbody"]), "th": frozenset(["td", "th", "tr", "tbody"])}
#: Where the search for such an element stops.
SCOPES = frozenset("table ul ol dl select div body main section article".split())

TEXT, COMMENT, DOCUMENT = "#text", "#comment", "#document"


class Node:
    __slots__ = ("attrs", "children", "name", "parent", "text")

    def __init__(self, name: str, attrs: dict[str, str] | None = None, text: str = ""):
        self.name, self.attrs, self.text = name, attrs or {}, text
        self.children: list[Node] = []
        self.parent: Node | None = None

    def add(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def get(self, name: str, default: str = "") -> str:
        return self.attrs.get(name, default)

    @property
    def is_element(self) -> bool:
        return self.name[0] != "#"

    def walk(self) -> Iterator[Node]:
        """All nodes below, in document order, without recursion."""
        stack = list(reversed(self.children))
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def elements(self) -> Iterator[Node]:
        return (n for n in self.walk() if n.is_element)

    def up(self) -> Iterator[Node]:
        """The node and its ancestors, the document left out."""
        node = self
        while node is not None and node.name != DOCUMENT:
            yield node
            node = node.parent

    def inner_text(self) -> str:
        if self.name == TEXT:
            return self.text
        return "".join(n.text for n in self.walk() if n.name == TEXT)

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def copy(self) -> Node:
        out = Node(self.name, dict(self.attrs), self.text)
        todo = [(self, out)]
        while todo:
            source, target = todo.pop()
            for c in source.children:
                todo.append((c, target.add(Node(c.name, dict(c.attrs), c.text))))
        return out

    def write(self) -> str:
        if self.name == TEXT:
            return self.text
        inner = "".join(c.write() for c in self.children)
        if self.name == DOCUMENT:
            return inner
        attrs = "".join(f' {k}="{v}"' for k, v in self.attrs.items())
        return f"<{self.name}{attrs}>" + ("" if self.name in VOID else f"{inner}</{self.name}>")


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.root = Node(DOCUMENT)
        self.open = [self.root]

    def _text(self, data: str) -> None:
        here = self.open[-1]
        if here.children and here.children[-1].name == TEXT:
            here.children[-1].text += data
        else:
            here.add(Node(TEXT, text=data))

    handle_data = _text

    def handle_entityref(self, name: str) -> None:
        self._text(f"&{name};")

    def handle_charref(self, name: str) -> None:
        self._text(f"&#{name};")

    def handle_comment(self, data: str) -> None:
        self.open[-1].add(Node(COMMENT, text=data))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            name = self.open[k].name
            if tag in ENDS.get(name, ()):
                del self.open[k:]
                break
            if name in SCOPES:
                break
        node = self.open[-1].add(Node(tag, {k: v or "" for k, v in reversed(attrs)}))
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.open[-1].add(Node(tag, {k: v or "" for k, v in reversed(attrs)}))

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name == tag:
                del self.open[k:]
                return


def parse(page: str | None) -> Node:
    builder = _Builder()
    builder.feed(page or "")
    builder.close()
    return builder.root


def unescape(text: str) -> str:
    return html.unescape(text)
