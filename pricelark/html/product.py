"""Product extraction from a page: structured data, meta tags, then the DOM (HTM-1 to HTM-10, HTM-12 to HTM-15)."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, fields
from decimal import Decimal
from functools import lru_cache

from pricelark.functions.text import NO_BRAND
from pricelark.html import values as V
from pricelark.html import xpath
from pricelark.html.dom import TEXT, Node, parse
from pricelark.html.nodes import first_text
from pricelark.html.selectors import smart_xpath

# Labels, and parts of ids, classes and texts.
BY_JSON, BY_META, BY_DOM, CORRECTED = "JSON-LD (Datos Estructurados)", "Meta Etiquetas (Open Graph)", "Analisis Semantico DOM (Fallback)", " (Con Corrección de Descuento DOM)"
SIDE = ("warranty", "protection", "seguro", "insurance", "carousel", "recommend", "similar", "related", "sponsored", "upsell", "fbt", "bought", "viewed", "purchased", "personalization", "alternative", "recs", "ad-", "widget", "oos", "cardinstance", "celwidget")
CURRENT = ("current", "final", "sale", "discount", "special")
OLD = ("old", "original", "list-price", "was")
MONTHLY = ("monthly", "mensual", "msi", "installment")
GONE = ("no disponible", "no está disponible", "out of stock", "agotado", "sin stock", "unavailable")
THERE = ("en stock", "disponible", "in stock", "sólo queda", "solo queda")
PAGE_GONE = ("este producto no está disponible", "producto no disponible", "publicación pausada", "currently unavailable")
PRICE_CLASSES = ("price", "amount", "special", "promo", "precio")
STOCK_CLASSES = ("availability", "stock", "no_stock")


@dataclass
class Product:
    name: str | None = None
    price: Decimal | None = None
    in_stock: bool = True
    xpath: str | None = None
    image_url: str | None = None
    sku: str | None = None
    brand: str | None = None
    method: str = "Ninguno"
    source: str | None = None
    raw_price: str | None = None
    currency: str | None = None
    price_xpath: str | None = None
    confidence: int = 0

    def set_price(self, raw: str | None, source: str, confidence: int, node: Node | None = None) -> bool:
        found = V.parse_price(raw)
        if found is None:
            return False
        self.price, self.raw_price, self.currency = found.price, found.raw, found.currency or self.currency
        self.source, self.confidence = source, confidence
        if node is not None:
            self.price_xpath = smart_xpath(node)
        return True


SCHEMA = "name string, price decimal(18,2), in_stock boolean, xpath string, image_url string, sku string, brand string, method string, source string, raw_price string, currency string, price_xpath string, confidence int"


def _has(text: str, parts: tuple[str, ...]) -> bool:
    return any(p in text for p in parts)


# --- structured data ---------------------------------------------------------


def json_objects(x) -> Iterator[dict]:
    """HTM-2: objects of arrays, `@graph` and `hasVariant`, outermost first."""
    if isinstance(x, list):
        for y in x:
            yield from json_objects(y)
    elif isinstance(x, dict):
        yield x
        yield from json_objects(x.get("@graph"))
        yield from json_objects(x.get("hasVariant"))


def _scalar(x) -> str | None:
    return x if isinstance(x, str) else str(x) if isinstance(x, (int, float, Decimal)) and not isinstance(x, bool) else None


def _offers(x) -> Iterator[dict]:
    if isinstance(x, list):
        for y in x:
            yield from _offers(y)
    elif isinstance(x, dict):
        yield from _offers(x.get("offers"))
        if "price" in x or "lowPrice" in x:
            yield x


def best_offer(x) -> dict | None:
    """HTM-3: direct before lowest price, in stock, with a currency; the first of equals."""
    best, most = None, -1
    for o in _offers(x):
        direct = "price" in o
        found = V.parse_price(_scalar(o["price"] if direct else o["lowPrice"]))
        if found is None:
            continue
        there = not _has(str(o.get("availability") or "").lower(), ("outofstock", "soldout", "discontinued"))
        currency = (_scalar(o["priceCurrency"]) or "").upper() or None if "priceCurrency" in o else found.currency
        rank = (100 if direct else 80) + 20 * there + 5 * bool(currency)
        if rank > most:
            best, most = {"price": found.price, "raw_price": found.raw, "currency": currency, "in_stock": there, "source": "JSON-LD" if direct else "JSON-LD (Precio mínimo)", "confidence": 100 if direct else 90}, rank
    return best


def _from_json(root: Node, out: Product) -> bool:
    for script in root.elements():
        if script.name != "script" or script.get("type") != "application/ld+json":
            continue
        try:
            data = json.loads(script.inner_text(), parse_float=Decimal)
        except ValueError:
            continue
        for o in json_objects(data):
            kinds = o.get("@type")
            kinds = [kinds] if isinstance(kinds, str) else kinds if isinstance(kinds, list) else []
            if not any(isinstance(k, str) and k.lower() == "product" for k in kinds):
                continue
            offer = best_offer(o.get("offers"))
            if offer is None:
                continue
            name, image, brand = o.get("name"), o.get("image"), o.get("brand")
            image = image[0] if isinstance(image, list) and image else image
            out.name = name if isinstance(name, str) else None
            out.image_url = image if isinstance(image, str) else None
            for key in ("sku", "gtin", "mpn"):
                if key in o:
                    out.sku = V.normalize_sku(_scalar(o[key]))
                    break
            brand = _scalar(brand.get("name")) if isinstance(brand, dict) and "name" in brand else brand
            out.brand = V.normalize_brand(brand) if isinstance(brand, str) else None
            for k, v in offer.items():
                setattr(out, k, v)
            return True
    return False


# --- meta tags ---------------------------------------------------------------


def _meta(root: Node, *keys: tuple[str, str]) -> Node | None:
    found: dict[tuple[str, str], Node] = {}
    for n in root.elements():
        if n.name == "meta":
            for a in ("property", "name", "itemprop"):
                if a in n.attrs:
                    found.setdefault((a, n.attrs[a]), n)
    return next((found[k] for k in keys if k in found), None)


def _from_meta(root: Node, out: Product) -> bool:
    """HTM-4. What it sets stays even if it isn't enough."""
    title = _meta(root, ("property", "og:title"), ("name", "twitter:title"), ("name", "title"))
    if title is not None and not out.name:
        out.name = title.get("content").strip()
    image = _meta(root, ("property", "og:image"), ("name", "twitter:image"), ("name", "image"))
    if image is not None and not out.image_url:
        out.image_url = image.attrs.get("content")
    site = _meta(root, ("name", "twitter:site"))
    head = xpath.first(root, "//title")
    amazon = site is not None and "amazon" in site.get("content").lower() or head is not None and "amazon" in head.inner_text().lower()
    price = _meta(root, ("property", "product:price:amount"), ("property", "og:price:amount"), *(() if amazon else (("name", "twitter:data1"),)))
    if price is not None and not out.price:
        out.set_price(price.get("content").strip(), "Meta etiqueta", 90)
    stock = _meta(root, ("property", "product:availability"), ("property", "og:availability"))
    if stock is not None:
        said = stock.get("content").lower()
        out.in_stock = True if "instock" in said else False if _has(said, ("out", "oos", "agotado")) else out.in_stock
    return bool(out.name) and (not out.in_stock or bool(out.price))


# --- DOM -----------------------------------------------------------------------


def product_scope(root: Node) -> Node:
    """HTM-6."""
    h1 = xpath.first(root, "//h1")
    for n in h1.up() if h1 is not None else ():
        said = f"{n.get('id')} {n.get('class')} {n.get('itemtype')}".lower()
        if n.name == "main" or _has(said, ("product", "pdp")):
            return n
    return xpath.first(root, "//main") or root


def is_side(node: Node) -> bool:
    """HTM-7: in a warranty, carousel or the like."""
    for depth, n in enumerate(node.up()):
        if depth == 100:
            return False
        if _has(n.get("id").lower(), (*SIDE, "coaseguro")) or _has(n.get("class").lower(), SIDE):
            return True
    return False


def price_score(node: Node) -> int:
    """HTM-9."""
    said = f"{node.get('id')} {node.get('class')} {node.get('data-testid')}".lower()
    return 10 + 60 * (node.get("itemprop").lower() == "price") + 40 * _has(said, CURRENT) + 20 * _has(said, ("price", "amount")) - 100 * _has(said, OLD) - 100 * _has(said, MONTHLY)


def dom_price(scope: Node) -> tuple[Decimal, Node] | None:
    """HTM-8: the best marked element, else the first short text with a currency."""
    best, most = None, None
    for n in scope.elements():
        if n.get("itemprop") == "price" or _has(n.get("class"), PRICE_CLASSES) or _has(n.get("id"), ("price", "precio")):
            text = n.inner_text()
            found = V.parse_price(text) if len(text) <= 100 and not is_side(n) else None
            if found and (most is None or price_score(n) > most):
                best, most = (found.price, n), price_score(n)
    if best:
        return best
    for n in scope.walk():
        text = n.text.strip()
        if n.name == TEXT and len(text) < 30 and ("$" in text or re.search(r"\b(?:MXN|USD|EUR|GBP)\b", text, re.IGNORECASE)) and not is_side(n.parent):
            found = V.parse_price(text)
            if found:
                return found.price, n.parent
    return None


def _from_dom(root: Node, scope: Node, out: Product) -> None:
    """HTM-5."""
    h1 = xpath.first(scope, ".//h1") or xpath.first(root, "//h1")
    if not out.name:
        if h1 is not None:
            out.name = h1.inner_text().strip()
        else:
            title = xpath.first(root, "//title")
            if title is not None:
                text = title.inner_text()
                cut = min((k for k in map(text.find, "|-•") if k > 0), default=len(text))
                out.name = text[:cut].strip()
    stock = next((n for n in scope.elements() if n.get("id") == "availability"), None) or next((n for n in scope.elements() if _has(n.get("id"), STOCK_CLASSES) or _has(n.get("class"), STOCK_CLASSES)), None)
    if stock is not None:
        said = stock.inner_text().lower()
        out.in_stock = False if _has(said, GONE) else True if _has(said, THERE) else out.in_stock
    if _has(scope.inner_text().lower(), PAGE_GONE):
        out.in_stock = False
    image = next((n for n in scope.elements() if n.name == "img" and any("product" in n.get(a) for a in ("class", "id", "src"))), None) or next((n for n in scope.elements() if n.name == "img" and (n.get("id") in ("landingImage", "main-image") or n.get("class") == "front-image")), None)
    if image is not None and not out.image_url:
        out.image_url = image.attrs.get("src") or image.attrs.get("data-src")
    if out.price is None and (found := dom_price(scope)):
        out.price = found[0]
        out.xpath = out.price_xpath = smart_xpath(found[1])
        out.set_price(found[1].inner_text(), "DOM semántico", 50, found[1])


def node_with_price(scope: Node, price: Decimal) -> Node | None:
    """HTM-10: the node with fewest elements whose first text has the price, with or without grouping."""
    forms = (f"{price:.2f}", f"{price:,.2f}")
    found = [n for n in scope.elements() if n.name not in ("script", "style", "head", "html", "body") and _has(first_text(n), forms)]
    return min(found, key=lambda n: sum(1 for _ in n.elements()), default=None)


@lru_cache(maxsize=256)
def _extract(page: str) -> Product:
    out, root = Product(), parse(page)
    scope = product_scope(root)
    if _from_json(root, out):
        out.method = BY_JSON
    elif _from_meta(root, out):
        out.method = BY_META
    else:
        _from_dom(root, scope, out)
        out.method = BY_DOM
    if out.price is not None:
        now = dom_price(scope)
        if now and _has(f"{now[1].get('id')} {now[1].get('class')}".lower(), CURRENT) and now[0] != out.price and out.set_price(now[1].inner_text(), "Precio actual DOM", 80, now[1]):
            out.xpath = smart_xpath(now[1])
            out.method += CORRECTED
        if not out.xpath and (node := node_with_price(scope, out.price)) is not None:
            out.xpath = out.price_xpath = smart_xpath(node)
    if not out.sku:
        own = _meta(root, ("property", "product:retailer_item_id"), ("itemprop", "sku"), ("name", "sku")) or next((n for n in root.elements() if _has(n.get("class"), ("sku", "codigo")) or _has(n.get("id"), ("sku", "codigo"))), None)
        if own is not None:
            out.sku = V.normalize_sku(own.attrs.get("content", own.inner_text()))
    if not out.brand or out.brand == NO_BRAND:
        own = _meta(root, ("property", "product:brand"), ("itemprop", "brand"), ("name", "brand")) or next((n for n in root.elements() if n.name == "a" and (_has(n.get("href"), ("vendors", "brand")) or _has(n.get("class"), ("brand", "vendor")))), None)
        if own is not None:
            out.brand = V.normalize_brand(own.attrs.get("content", own.inner_text()))
    if out.image_url:
        out.image_url = V.image_url(V.absolute_url(out.image_url, None))
    return out


def extract(page: str | None) -> Product:
    """HTM-1. The last 256 pages of a worker are kept; the caller gets a copy."""
    if not (page or "").strip():
        return Product()
    found = _extract(page)
    return Product(**{f.name: getattr(found, f.name) for f in fields(Product)})


def by_selectors(root: Node, price: str | None, stock: str | None, image: str | None) -> Product | None:
    """HTM-12: with a site's own selectors; a current discount near the price wins. None if there is no price."""
    out = Product(method="Selector configurado", confidence=90)
    try:
        node = xpath.first(root, price) if (price or "").strip() else None
        if node is None or not out.set_price(node.inner_text(), "Selector configurado", 90, node):
            return None
        for c in ("current-price", "sale-price", "discount-price", "special-price"):
            special = next((n for n in root.elements() if c in n.get("class") and not is_side(n)), None)
            got = V.parse_price(special.inner_text()) if special is not None else None
            if got and got.price < out.price:
                out.set_price(special.inner_text(), "Precio con descuento", 90, special)
                break
        if (stock or "").strip() and (s := xpath.first(root, stock)) is not None:
            out.in_stock = not _has(s.inner_text().lower(), ("agotado", "sin stock", "out of stock"))
        if (image or "").strip() and (i := xpath.first(root, image)) is not None:
            out.image_url = next((i.get(a) for a in ("content", "src", "data-src", "href") if i.get(a)), None)
    except xpath.XPathError:
        return None
    return out


def diagnose(page: str | None) -> dict[str, str | None]:
    """HTM-15: selectors that a reviewer may take for a failed page."""
    root = parse(page)
    scope = product_scope(root)
    price = dom_price(scope)
    pick = lambda n: smart_xpath(n) if n is not None else None
    return {
        "price": pick(price[1]) if price else None,
        "name": pick(xpath.first(scope, ".//h1") or xpath.first(root, "//h1")),
        "image": pick(next((n for n in scope.elements() if n.name == "img"), None)),
        "stock": pick(next((n for n in scope.elements() if _has(n.get("id"), STOCK_CLASSES) or _has(n.get("class"), STOCK_CLASSES)), None)),
    }
