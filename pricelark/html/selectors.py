"""Selectors: is it XPath, is it well formed, does it still find the price (FN-24 to FN-27, HTM-11 to HTM-13)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Decimal

from pricelark.html import xpath
from pricelark.html.dom import Node
from pricelark.html.values import parse_price

# What only XPath has.
PREFIXES = ("/", "./", "../", "(", "id(", "text(")
MARKERS = ("[@", "text()", "contains(", "following-sibling::", "preceding-sibling::", "parent::", "ancestor::")
COMBINATORS = "+~>,\\"
OUTSIDE = frozenset("@!$%^&=")


def _bare(text: str) -> Iterator[tuple[str, str]]:
    """Characters outside quotes and not escaped, each with the next one; then how the text ends."""
    quote, k = "", 0
    while k < len(text):
        c = text[k]
        if c == "\\":
            if k + 1 == len(text):
                yield "open", ""
            k += 2
            continue
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        else:
            yield c, text[k + 1 : k + 2]
        k += 1
    if quote:
        yield "open", ""


def is_xpath(selector: str | None) -> bool:
    """FN-24."""
    s = (selector or "").strip()
    if not s:
        return False
    return s.startswith(PREFIXES) or any(m in s for m in MARKERS) or any(c == "/" or c == "[" and n.isdigit() for c, n in _bare(s))


def is_valid_css(selector: str | None) -> bool:
    """FN-26."""
    s = (selector or "").strip()
    if not s or s[-1] in COMBINATORS:
        return False
    depth = {"[": 0, "(": 0}
    for c, _ in _bare(s):
        if c == "open":
            return False
        if c in depth:
            depth[c] += 1
        elif c in "])":
            opener = "[" if c == "]" else "("
            depth[opener] -= 1
            if depth[opener] < 0:
                return False
        if not any(depth.values()) and c in OUTSIDE:
            return False
    return not any(depth.values())


def is_valid_selector(selector: str | None) -> bool:
    """FN-27."""
    return xpath.is_valid(selector) if is_xpath(selector) else is_valid_css(selector)


def first_invalid(price: str | None, name: str | None, stock: str | None, container: str | None) -> tuple[str, str] | None:
    """FN-27: the first malformed selector of a site; blank ones are fine."""
    for label, s in (("Precio", price), ("Nombre", name), ("Stock", stock), ("Contenedor", container)):
        if s and s.strip() and not is_valid_selector(s):
            return label, s
    return None


def is_dynamic_id(value: str) -> bool:
    """HTM-11: ids that change from page to page."""
    return not value.strip() or any(x in value for x in ("ng-", "mat-", "ember", "compare-", "quantity_")) or bool(re.fullmatch(r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|\d{5,}", value))


def smart_xpath(node: Node) -> str:
    """HTM-11: from the nearest stable id, else from the root, by places among equal names."""
    path = ""
    for at in node.up():
        own = at.get("id")
        if own and not is_dynamic_id(own):
            return f"//*[@id='{own}']{path}"
        before = 1
        for s in at.parent.children if at.parent is not None else ():
            if s is at:
                break
            before += s.name == at.name
        path = f"/{at.name}[{before}]{path}"
    return path


def learned_selector_holds(root: Node, selector: str, price: Decimal) -> bool:
    """HTM-13: one node, and the price that was expected."""
    try:
        found = xpath.select(root, selector)
    except xpath.XPathError:
        return False
    if len(found) != 1 or not isinstance(found[0], Node):
        return False
    got = parse_price(found[0].inner_text())
    return got is not None and got.price == price


