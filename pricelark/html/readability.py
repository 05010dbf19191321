"""The readable part of a page (HTM-16 to HTM-18)."""

from __future__ import annotations

import re

from pricelark.html.dom import COMMENT, DOCUMENT, Node, parse, unescape

# Tags and parts of classes and ids.
DROP = frozenset("script style noscript iframe head link meta header footer nav aside form svg canvas object embed".split())
HIDDEN = ("display:none", "display: none", "visibility:hidden", "visibility: hidden", "opacity:0", "opacity: 0")
UNLIKELY = re.compile("ad-break|ad-container|ad-wrapper|adsense|advertisement|announcement|author|bio|bookmark|bottom|breadcrumbs|combobox|comment|contact|credits|disqus|extra|foot|footer|footnote|header|header-menu|headline-link|login|masthead|media-credit|menu|meta|nav|navigation|outbrain|pager|pagination|popup|related|reply|robots|rss|shiba|sidebar|site-index|social|sponsor|subscription|tab|teaser|toolbar|trackback|widget|zone", re.IGNORECASE)
MAYBE = re.compile("and|article|body|column|content|entry|main|page|pagination|post|text|story", re.IGNORECASE)
POSITIVE = re.compile("article|body|content|entry|main|page|post|text", re.IGNORECASE)
NEGATIVE = re.compile("comment|combobox|contact|foot|footer|header|menu|nav|sidebar|sponsor|social|widget|ad", re.IGNORECASE)
CANDIDATES = frozenset("p div td span section article".split())
MARKS = frozenset(",;.?!-")


def _names(n: Node) -> str:
    return f"{n.get('class')} {n.get('id')}"


def pre_clean(root: Node) -> Node:
    """HTM-16, in place: comments, tags that hold no text, hidden and unlikely elements."""

    def gone(n: Node) -> bool:
        if n.name == COMMENT or n.name in DROP:
            return True
        style = n.get("style").lower()
        if any(h in style for h in HIDDEN):
            return True
        return n.is_element and n.name not in ("body", "html") and bool(UNLIKELY.search(_names(n))) and not MAYBE.search(_names(n))

    stack = [root]
    while stack:
        node = stack.pop()
        node.children = [c for c in node.children if not gone(c)]
        stack.extend(node.children)
    return root


def link_density(n: Node) -> float:
    size = len(n.inner_text())
    return sum(len(a.inner_text()) for a in n.elements() if a.name == "a") / size if size else 0.0


def scores(root: Node) -> list[tuple[Node, float]]:
    """HTM-17: an element's score goes to itself, its parent and by half to its grandparent; links take it away."""
    total: dict[int, list] = {}

    def add(n: Node | None, x: float) -> bool:
        if n is None or n.name in (DOCUMENT, "html"):
            return False
        total.setdefault(id(n), [n, 0.0])[1] += x
        return True

    for n in root.elements():
        if n.name not in CANDIDATES:
            continue
        text = n.inner_text()
        if len(text.strip()) < 25:
            continue
        x = 1 + 25 * bool(POSITIVE.search(_names(n))) - 25 * bool(NEGATIVE.search(_names(n))) + len(text) / 100 + sum(c in MARKS for c in text)
        x *= 1 - link_density(n)
        add(n, x)
        if add(n.parent, x):
            add(n.parent.parent, x / 2)
    return [(n, x * (1 - link_density(n))) for n, x in total.values()]


def main_node(page: str | None) -> Node | None:
    found = scores(pre_clean(parse(page)))
    return max(found, key=lambda x: x[1])[0] if found else None


def main_text(page: str | None) -> str:
    """HTM-18."""
    node = main_node(page)
    return unescape(node.inner_text()).strip() if node is not None else ""


def main_html(page: str | None) -> str:
    node = main_node(page)
    return node.write() if node is not None else ""
