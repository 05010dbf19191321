"""Names, prices and images of nodes (FN-6, FN-8, FN-23)."""

from __future__ import annotations

import re
from decimal import Decimal

from pricelark.html.dom import TEXT, Node
from pricelark.html.values import best_srcset, normalize_name, parse_price

# Parts of classes.
PROMO = ("promo", "discount", "badge", "tag", "offer", "sale", "shipping", "envio", "ahorro", "flag")
STRUCK = ("old", "original", "list-price")
WHOLE = ("fraction", "whole", "integer", "price-whole", "main-price", "amount", "price-amount")
CENTS = ("cents", "decimal", "fraction-cents", "price-cents", "centavos")
LAZY = ("data-src", "data-lazy-src", "data-original", "data-lazy", "src")


def has_class(node: Node, parts: tuple[str, ...]) -> bool:
    own = node.get("class")
    return any(p in own for p in parts)


def first_text(node: Node) -> str:
    """What XPath 1.0 makes of text(): the first text child."""
    return next((c.text for c in node.children if c.name == TEXT), "")


def _without(node: Node, gone) -> Node:
    out = node.copy()
    for n in list(out.elements()):
        if gone(n):
            n.remove()
    return out


def _is_promo(n: Node) -> bool:
    return has_class(n, PROMO) or "%" in first_text(n) or "OFF" in first_text(n)


def name_of(node: Node | None) -> str:
    """FN-6."""
    return normalize_name(_without(node, _is_promo).inner_text()) if node is not None else ""


def price_of(node: Node | None) -> Decimal | None:
    """FN-8: the current price, put together if its cents stand apart."""
    if node is None:
        return None
    struck = lambda n: "line-through" in n.get("style") or n.name in ("del", "s") or has_class(n, STRUCK)
    clean = _without(_without(node, struck), _is_promo)
    whole = next((n for n in clean.elements() if has_class(n, WHOLE)), None)
    cents = next((n for n in clean.elements() if has_class(n, CENTS)), None)
    if whole is None or cents is None:
        leaves = [n for n in clean.walk() if not n.children and re.search(r"\d", n.inner_text())][:2]
        digits = [re.sub(r"\D", "", n.inner_text()) for n in leaves]
        if len(leaves) == 2 and all(digits) and len(digits[1]) <= 2:
            whole, cents = leaves
    if cents is whole:
        cents = None
    found = None
    if whole is not None:
        tail = (re.sub(r"\D", "", cents.inner_text()) if cents is not None else "")[:2].ljust(2, "0")
        found = parse_price(re.sub(r"[^\d.,]", "", whole.inner_text()) + "." + tail)
    else:
        found = parse_price(clean.inner_text())
    return found.price if found else None


def image_of(node: Node | None) -> str | None:
    """FN-23: picture sources, srcset, lazy attributes, then a CSS background."""
    if node is None:
        return None
    picture = next((a for a in node.up() if a.name == "picture"), None)
    for s in picture.elements() if picture is not None else ():
        if s.name == "source" and s.get("srcset"):
            best = best_srcset(s.get("srcset"))
            if best:
                return best
    for a in ("srcset", "data-srcset"):
        best = best_srcset(node.get(a)) if node.get(a) else None
        if best:
            return best
    for a in LAZY:
        own = node.get(a).strip()
        if own and not own.startswith("data:") and not re.search(r"placeholder|blank\.|spacer|loading", own, re.IGNORECASE):
            return own
    for n in (node, *node.elements()):
        m = re.search(r"background(?:-image)?\s*:[^;]*url\(\s*['\"]?([^'\")]+)", n.get("style").replace("&quot;", '"'))
        if m:
            return m.group(1)
    return None
