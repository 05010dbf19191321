"""What a browser client can read from a page by itself (FN-17, FN-19, FN-20, HTM-28).

Rules for stores are tables of places to look, tried in order. Layout isn't
known here, so the text of an element is all the text below it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from decimal import Decimal, InvalidOperation

from pricelark.functions.pages import NO_STOCK
from pricelark.functions.text import KNOWN_BRANDS, NO_BRAND
from pricelark.html.dom import Node, parse
from pricelark.html.product import Product
from pricelark.html.selectors import smart_xpath

METHOD, SOURCE = "Heurística JavaScript local", "JavaScript local"
MESSAGE = re.compile("no está disponible|agotado|pausada|sin stock", re.IGNORECASE)

Test = Callable[[Node], bool]


def cls(*names: str) -> Test:
    """Has all of these classes."""
    return lambda n: set(names) <= set(n.get("class").split())


def part(attr: str, text: str, tag: str | None = None) -> Test:
    return lambda n: text in n.get(attr) and (tag is None or n.name == tag)


def tag(kind: str, /, **attrs: str) -> Test:
    return lambda n: n.name == kind and all(n.get(k) == v for k, v in attrs.items())


def own_id(value: str) -> Test:
    return lambda n: n.get("id") == value


def inside(outer: Test, inner: Test) -> Test:
    return lambda n: inner(n) and any(outer(a) for a in n.up() if a is not n)


# Where stores keep what.
STORES: dict[str, dict[str, list[Test]]] = {
    "costco.com.mx": {
        "name": [tag("h1"), cls("product-name")],
        "price": [cls("price-after-discount"), cls("product-price-amount"), cls("price")],
        "image": [inside(cls("product-image"), tag("img")), own_id("product-image"), lambda n: n.name == "img" and cls("main-image")(n)],
        "sku": [cls("product-details-code"), lambda n: n.get("itemprop") == "sku"],
    },
    "mercadolibre.com.mx": {
        "name": [cls("ui-pdp-title"), tag("h1"), cls("ui-pdp-header__title")],
        "price": [inside(cls("ui-pdp-price__part"), cls("andes-money-amount__fraction")), cls("andes-money-amount__fraction")],
        "cents": [inside(cls("ui-pdp-price__part"), cls("andes-money-amount__cents")), cls("andes-money-amount__cents")],
        "image": [cls("ui-pdp-gallery__figure__image"), cls("ui-pdp-image"), part("src", "mlstatic", "img")],
        "brand": [inside(cls("ui-pdp-features"), cls("ui-pdp-attribute-value")), lambda n: n.get("itemprop") == "brand"],
    },
    "amazon.com.mx": {
        "name": [own_id("productTitle")],
        "price": [cls("a-price-whole")],
        "cents": [cls("a-price-fraction")],
        "image": [own_id("landingImage"), own_id("imgBlkFront")],
        "brand": [own_id("bylineInfo"), cls("brand-link")],
    },
}
URL_SKUS = {
    "costco.com.mx": [r"/p/(\d+)"],
    "mercadolibre.com.mx": [r"(?i)/up/(MLM[A-Z0-9]+)", r"(?i)/p/(MLM[A-Z0-9]+)", r"(?i)(MLM[A-Z0-9]{8,15})", r"(?i)(MLM-?\d+)"],
    "amazon.com.mx": [r"(?i)/dp/([A-Z0-9]{10})"],
}
ANY_URL = [r"(?i)/up/(MLM[A-Z0-9]+)", r"(?i)/p/(MLM[A-Z0-9]+)", r"(?i)(MLM[A-Z0-9]{8,15})", r"/p/(\d+)", r"(?i)/dp/([A-Z0-9]{10})", r"(?i)(MLM-?\d+)", r"/(\d{5,12})(?:/|\.|$)"]
PAGE_SKUS = [r'(?i)"(?:user_product_id|catalog_product_id)"\s*:\s*"(MLM[A-Z0-9]+)"', r"(?i)/up/(MLM[A-Z0-9]+)", r"(?i)/p/(MLM[A-Z0-9]+)"]
SKU_PLACES: list[Test] = [tag("meta", property="product:retailer_item_id"), tag("meta", itemprop="sku"), tag("meta", name="sku"), tag("meta", property="og:sku"), cls("product-meta__sku-number"), part("class", "sku-number"), part("class", "sku"), part("id", "sku"), lambda n: "data-sku" in n.attrs]
META = {
    "name": [tag("meta", property="og:title"), tag("meta", name="twitter:title")],
    "price": [tag("meta", property="product:price:amount"), tag("meta", property="og:price:amount"), tag("meta", name="twitter:data1")],
    "image": [tag("meta", property="og:image"), tag("meta", name="twitter:image")],
}
GENERIC = {
    "name": [tag("h1")],
    "price": [cls("price"), part("class", "price"), part("id", "price")],
    "image": [inside(tag("main"), tag("img")), inside(tag("article"), tag("img")), part("src", "product", "img")],
}
MESSAGES: list[Test] = [cls("ui-pdp-message"), part("class", "no-stock"), inside(cls("ui-pdp-buybox"), cls("ui-message"))]


def find(root: Node, tests: Iterable[Test]) -> Node | None:
    """The first element in the document of the first test that any passes."""
    return next((n for t in tests for n in root.elements() if t(n)), None)


def _said(n: Node | None) -> str:
    return "" if n is None else n.get("content") if n.name == "meta" else n.inner_text().strip()


def number(text: str | None) -> Decimal:
    """FN-18."""
    m = re.match(r"\d*\.?\d*", re.sub(r"[^\d.]", "", text or ""))
    try:
        return Decimal(m.group())
    except InvalidOperation:
        return Decimal(0)


def stable_hash(text: str) -> str:
    """FN-16."""
    h = 0
    data = text.encode("utf-16-le")
    for k in range(0, len(data), 2):
        h = (h * 31 + int.from_bytes(data[k : k + 2], "little")) & 0xFFFFFFFF
    h = abs(h - (1 << 32) if h >> 31 else h)
    out = ""
    while h:
        h, r = divmod(h, 36)
        out = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[r] + out
    return "GEN-" + (out or "0")


def brand_from_name(name: str) -> str:
    """FN-19."""
    low = name.lower()
    known = next((b for w, b in KNOWN_BRANDS.items() if w in low), None)
    first = name.strip().split(" ")[0]
    return known or (first if len(first) > 2 else NO_BRAND)


def any_product(x) -> dict | None:
    """The first object of type Product at any depth."""
    if isinstance(x, dict) and x.get("@type") == "Product":
        return x
    for y in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
        found = any_product(y)
        if found:
            return found
    return None


def _structured(root: Node) -> dict | None:
    for n in root.elements():
        if n.name == "script" and n.get("type") == "application/ld+json":
            try:
                found = any_product(json.loads(n.inner_text()))
            except ValueError:
                continue
            if found:
                return found
    return None


def _first_match(patterns: list[str], text: str) -> str:
    return next((m.group(1) for p in patterns if (m := re.search(p, text))), "")


def extract_sku(root: Node, page: str, url: str, data: dict | None = None) -> str:
    """FN-17: structured data, marked elements, the page's scripts, the URL, else a hash of the URL."""
    data = data or _structured(root) or {}
    sku = str(data.get("sku") or data.get("mpn") or data.get("productID") or "")
    if not sku:
        n = find(root, SKU_PLACES)
        sku = (_said(n) or n.get("data-sku") or n.get("value")) if n is not None else ""
    sku = re.sub(r"(?i)sku\s*:\s*", "", sku, count=1).strip()
    return sku or _first_match(PAGE_SKUS, page) or _first_match(ANY_URL, url).replace("-", "") or stable_hash(url)


def is_out_of_stock(root: Node, page: str) -> bool:
    """FN-20."""
    low = page.lower()
    message = find(root, MESSAGES)
    return any(p in low for p in NO_STOCK) or message is not None and bool(MESSAGE.search(message.inner_text()))


def _image(n: Node | None) -> str | None:
    return n.get("src") or None if n is not None else None


def _from_store(root: Node, page: str, url: str, store: str, out: Product) -> None:
    places = STORES[store]
    name, price, cents = (find(root, places.get(k, ())) for k in ("name", "price", "cents"))
    out.name = _said(name)
    if store == "mercadolibre.com.mx" and not out.name:
        out.name = re.sub(r"(?i)\s*\|\s*MercadoLibre.*", "", _said(find(root, META["name"]))).strip()
    if price is not None:
        whole = re.sub(r"\D", "", price.inner_text()) if "cents" in places else price.inner_text()
        out.price = number(whole + ("." + re.sub(r"\D", "", cents.inner_text()) if cents is not None else ""))
        out.price_xpath = smart_xpath(price)
    elif store == "mercadolibre.com.mx":
        out.price = number(_said(find(root, META["price"][:2])))
    out.sku = _first_match(URL_SKUS[store], url).replace("-", "")
    if not out.sku and store == "costco.com.mx":
        out.sku = re.sub(r"\D", "", _said(find(root, places["sku"])))
    if not out.sku and store == "mercadolibre.com.mx":
        out.sku = extract_sku(root, page, url)
    out.image_url = _image(find(root, places["image"]))
    brand = re.sub("(?i)Visita la tienda de|Marca:", "", _said(find(root, places.get("brand", ())))).strip()
    out.brand = brand or (NO_BRAND if store == "amazon.com.mx" else brand_from_name(out.name or ""))


def _generic(root: Node, page: str, url: str, out: Product) -> None:
    data = _structured(root) or {}
    name, image, brand, offers = data.get("name"), data.get("image"), data.get("brand"), data.get("offers")
    offers = offers[0] if isinstance(offers, list) and offers else offers
    offers = offers if isinstance(offers, dict) else {}
    image = image[0] if isinstance(image, list) and image else image
    image = image.get("url") if isinstance(image, dict) else image
    brand = brand.get("name") if isinstance(brand, dict) else brand
    title = find(root, [tag("title")])
    out.name = str(name or "") or _said(find(root, META["name"])).strip() or re.split(r"[-|]", _said(title))[0].strip() or _said(find(root, GENERIC["name"]))
    out.price = number(str(offers.get("price") or "")) or number(str(offers.get("lowPrice") or "")) or number(_said(find(root, META["price"])))
    if not out.price and (n := find(root, GENERIC["price"])) is not None:
        out.price, out.price_xpath = number(n.inner_text()), smart_xpath(n)
    out.image_url = str(image or "") or _said(find(root, META["image"])) or _image(find(root, GENERIC["image"]))
    out.sku = str(data.get("sku") or data.get("mpn") or data.get("productID") or "") or extract_sku(root, page, url, data)
    out.brand = str(brand) if brand else brand_from_name(out.name) if out.name else NO_BRAND


def extract_client(page: str | None, url: str | None, domain: str | None = None) -> Product | None:
    """HTM-28, HTM-29: a store's places or the general way; None unless there is a SKU, a name, and a price or no stock."""
    page, url = page or "", url or ""
    out, root = Product(method=METHOD, source=SOURCE, confidence=0), parse(page)
    store = next((s for s in STORES if s in (domain or url)), None)
    if store:
        _from_store(root, page, url, store, out)
    else:
        _generic(root, page, url, out)
    out.in_stock = not is_out_of_stock(root, page)
    out.price = out.price.quantize(Decimal("0.01")) if out.price and out.price < 10**16 else Decimal(0)
    return out if out.sku and out.name and (out.price > 0 or not out.in_stock) else None
