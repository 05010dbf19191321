"""Category pages: find the grid of cards, read the cards, find the next page (FLT-16, AGG-16, AGG-17, HTM-19 to HTM-27, SET-4).

What a strategy asks of a node is a question about the nodes below it, so one
pass from the leaves up (`Page`) answers all of them for all strategies.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

from pricelark.html import values as V
from pricelark.html import xpath
from pricelark.html.dom import TEXT, Node, parse
from pricelark.html.nodes import image_of, name_of, price_of

# Tags, classes, words, messages and the selectors that a detection returns.
NO_CARD_TAGS = frozenset("script style noscript br hr iframe head link meta".split())
NOISE_AREAS = frozenset("head script style noscript svg iframe header footer nav aside".split())
NOISE_WORDS = ("header", "footer", "nav", "menu")
PRICE_TEXT = re.compile(r"\$\s*\d+(?:[.,]\d+)?")
LONG_NUMBER = re.compile(r"\d{4,}")
DYNAMIC_WORDS = ("ng-", "mat-", "ember")
UUID_START = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-", re.IGNORECASE)
LAYOUT_PREFIXES = tuple("col- row- flex- grid- w- h- order- justify- align- self- items- content- text- bg- border- rounded- shadow- opacity- z- transition- duration- delay- ease- overflow- cursor- pointer-events- select- resize- divide- ring- outline-".split())
LAYOUT_NAMES = frozenset("row flex grid container ng-star-inserted".split())
LAYOUT_SPACING = re.compile(r"[pmgtbxy]-[0-9]+")
LAYOUT_STATES = frozenset("sm md lg xl 2xl focus hover active disabled visited dark motion-reduce motion-safe first last odd even".split())
FRAMEWORK_PREFIXES = ("ng-", "mat-", "mdc-")
HEADINGS = frozenset("h1 h2 h3 h4 h5".split())
NAME_CLASSES = ("name", "title", "titulo")
PRICE_WORDS = ("$", "MXN", "USD")
PRICE_CLASSES = ("price", "precio", "amount", "money", "fraction", "cost", "costo")
CARD_PRICE_CLASSES = ("price", "precio", "amount")
CARD_WORDS = ("product", "producto", "item", "card", "tarjeta", "lister", "tile", "entry", "article", "result")
LINKS = ("href", "data-href", "data-url", "data-permalink", "data-path", "pathname")
NEXT_WORDS = frozenset(["siguiente", "next", "sig", "chevron", ">", "»", "sig >"])
NEXT_CLASSES = ("next", "siguiente", "chevron-right", "arrow-right")
NO_NEXT = ("producto", "artículo", "detalle")
PROMO_PRICES = ("discount", "promo", "sale", "special", "efectivo", "cash", "current")
BLOCKED_PAGES = ("px-captcha", "cloudflare", "Verify Your Identity", "Verifica tu identidad")

CARD = "[(self::a or .//a) and .//img]"
NAME = ".//h3[1] | .//h2[1] | .//h4[1] | .//h5[1] | .//*[contains(@class, 'name') or contains(@class, 'title') or contains(@class, 'titulo')][not(self::a) or normalize-space(.)][1] | .//a[normalize-space(.) and @href][1] | .//a[normalize-space(.)][1]"
PRICE = ".//*[contains(@class, 'discount') or contains(@class, 'promo') or contains(@class, 'sale') or contains(@class, 'special') or contains(@class, 'current') or contains(@class, 'price') or contains(@class, 'precio') or contains(@class, 'amount') or contains(@class, 'money')][contains(text(), '$') or .//*[contains(text(), '$')]][1] | .//*[contains(text(), '$')][1] | .//*[contains(@class, 'price') or contains(@class, 'precio')][1]"
LINK = ".//a[contains(@class, 'product') or contains(@class, 'item') or contains(@class, 'name') or contains(@class, 'title') or contains(@class, 'link')][normalize-space(.)][1] | .//a[@href and normalize-space(.)][1] | .//a[@href][1]"
IMAGE = ".//img[contains(@class, 'product') or contains(@class, 'item') or contains(@class, 'main') or contains(@class, 'primary') or contains(@class, 'image') or contains(@class, 'img')][1] | .//img[1] | .//*[contains(@style, 'background-image')][1]"
PAGER = "//a[@rel='next'][1] | //a[contains(@class, 'next') or contains(@class, 'siguiente') or contains(@aria-label, 'siguiente') or contains(@title, 'siguiente') or contains(text(), 'Siguiente') or contains(text(), 'Next')][1]"
SINGLE_CONTAINER = "//*[contains(@class, 'ui-pdp') or contains(@class, 'pdp') or contains(@id, 'product') or contains(@class, 'product')] | //main | //body"
SINGLE_NAME = ".//h1 | .//meta[@property='og:title']"
SINGLE_PRICE = ".//*[contains(@class, 'andes-money-amount__fraction') or contains(@class, 'price') or contains(@class, 'a-price-whole') or contains(@property, 'price')]"
SINGLE_IMAGE = ".//meta[@property='og:image'] | .//img"
STRATEGIES = ("repetitive", "structural", "density", "semantic", "single")
MINIMUM, THRESHOLD = 3, 10.0
LEVELS = 5


@dataclass
class Selectors:
    container: str
    name: str = NAME
    price: str = PRICE
    link: str = LINK
    image: str = IMAGE
    pager: str = PAGER
    strategy: str = ""


SELECTORS_SCHEMA = "container string, name string, price string, link string, image string, pager string, strategy string"


def _layout(c: str) -> bool:
    """HTM-27: a class for looks that both rules know."""
    return c.startswith(LAYOUT_PREFIXES) or c in LAYOUT_NAMES or LAYOUT_SPACING.fullmatch(c) is not None or c.partition(":")[0] in LAYOUT_STATES and ":" in c


def _dynamic(value: str) -> bool:
    """A generated class or id."""
    low = value.lower()
    return any(w in low for w in DYNAMIC_WORDS) or LONG_NUMBER.search(value) is not None or UUID_START.match(value) is not None


def telling_classes(n: Node) -> list[str]:
    """HTM-19: classes that say what an element is, whatever their case, in order of name."""
    return sorted(c for c in n.get("class").split() if not (_dynamic(c) or _layout(c.lower()) or c.lower() == "bootstrap"))


def utility_class(c: str) -> bool:
    """HTM-22: a class of a framework or for looks. Case counts."""
    return c.startswith(FRAMEWORK_PREFIXES) or "bootstrap" in c or _layout(c)


def _fixed_id(n: Node, *more: str) -> str:
    """The node's id if it looks written by hand, else ''."""
    own = n.get("id").strip()
    return "" if LONG_NUMBER.search(own) or any(w in own for w in ("ember", "ng-", *more)) else own


# Marks of a node and of what is below it.
HREF, LINKED, FAR_LINKED, PICTURE, IMG, SOURCE, BACKGROUND, COST, PRICED, HEADING, LOW_HEADING, NAMED, WORDS, PLAIN_LINK = (1 << k for k in range(14))


def _marks(n: Node, below: int) -> int:
    if n.name == TEXT:
        return (WORDS if n.text.strip() else 0) | (COST if PRICE_TEXT.search(n.text) else 0) | (PRICED if any(w in n.text for w in PRICE_WORDS) else 0)
    if not n.is_element:
        return 0
    at, cls = n.attrs, n.get("class")
    out = {"img": IMG, "picture": PICTURE, "source": SOURCE, "h5": LOW_HEADING}.get(n.name, HEADING if n.name in HEADINGS else 0)
    if n.name == "a":
        out |= (HREF if "href" in at else 0) | (PLAIN_LINK if below & WORDS and not below & IMG else 0)
    if any(a in at for a in LINKS[:3]):
        out |= LINKED
    if any(a in at for a in LINKS[3:5]):
        out |= FAR_LINKED
    if "background-image" in n.get("style"):
        out |= BACKGROUND
    if cls:
        out |= (NAMED if any(w in cls for w in NAME_CLASSES) else 0) | (PRICED if any(w in cls for w in PRICE_CLASSES) else 0)
    return out


class Page:
    """A tree with, for each node, its marks, those below it, and whether it stands in a noise area (HTM-27)."""

    def __init__(self, root: Node):
        nodes = list(root.walk())
        self.root, self.elements = root, [n for n in nodes if n.is_element]
        self.own: dict[int, int] = {}
        self.below: dict[int, int] = defaultdict(int)
        for n in reversed(nodes):
            own = self.own[id(n)] = _marks(n, self.below[id(n)])
            self.below[id(n.parent)] |= own | self.below[id(n)]
        self.noisy: set[int] = set()
        for n in nodes:
            p = n.parent
            if p is not root and (id(p) in self.noisy or p.name in NOISE_AREAS or any(w in v for v in (p.get("class").lower(), p.get("id").lower()) for w in NOISE_WORDS)):
                self.noisy.add(id(n))

    def clear(self, nodes: list[Node]) -> list[Node]:
        return [n for n in nodes if n.is_element and id(n) not in self.noisy]

    def is_tile(self, n: Node) -> bool:
        """Has a link and an image, as density and class clustering ask."""
        below = self.below[id(n)]
        return bool((n.name == "a" or below & LINKED) and (n.name == "img" or below & (IMG | PICTURE | SOURCE) or self.own[id(n)] & BACKGROUND))

    def is_card(self, n: Node) -> bool:
        """Has a link, an image, a price and a name, as structural grouping asks."""
        own, below = self.own[id(n)], self.below[id(n)]
        linked = n.name == "a" or own & LINKED or below & (LINKED | FAR_LINKED)
        pictured = n.name == "img" or below & (IMG | PICTURE | SOURCE) or (own | below) & BACKGROUND
        return bool(linked and pictured and below & PRICED and below & (HEADING | LOW_HEADING | NAMED | PLAIN_LINK))

    def titled(self, n: Node) -> bool:
        return bool(self.below[id(n)] & (HEADING | LOW_HEADING | NAMED))


def _named_path(n: Node) -> str:
    """By its written id, else the tags from below html."""
    own, names = _fixed_id(n), [a.name for a in n.up() if a.name != "html"]
    return f"//*[@id='{own}']" if own else "/" + "".join(f"/{x}" for x in reversed(names))


def _indexed_path(n: Node) -> str:
    """From the nearest written id, else from below html, with places among siblings."""
    out: list[str] = []
    for a in n.up():
        if a.name == "html":
            break
        own = a.get("id").strip()
        if own and not _dynamic(own):
            return "//" + "/".join([f"*[@id='{own}']", *out])
        k = 1
        for s in a.parent.children if a.parent is not None else ():
            if s is a:
                break
            k += s.name == a.name
        out.insert(0, f"{a.name}[{k}]")
    return "//" + "/".join(out)


def _repetitive(page: Page) -> str | None:
    """HTM-19: children of one parent with one tag and one set of classes, worth what their cards hold."""
    best, most = None, THRESHOLD
    for parent in page.elements:
        groups: dict[tuple[str, str], list[Node]] = defaultdict(list)
        children = [c for c in parent.children if c.is_element and c.name not in NO_CARD_TAGS]
        for c in children if len(children) >= MINIMUM else ():
            groups[c.name, ".".join(telling_classes(c))].append(c)
        for (tag, classes), nodes in groups.items():
            if len(nodes) < MINIMUM:
                continue
            total = 0
            for n in nodes:
                below = page.below[id(n)]
                total += 10 * (n.name == "a" or bool(below & HREF)) + 5 * (n.name == "img" or bool(below & (IMG | PICTURE))) + 10 * bool(below & COST) + 5 * bool(below & (HEADING | NAMED))
            score = total / len(nodes) * math.log(len(nodes) + 1)
            if score >= THRESHOLD and (best is None or score > most):
                first = classes.split(".")[0]
                best, most = f"{_indexed_path(parent)}/{tag}" + (f"[contains(@class, '{first}')]" if first else ""), score
    return best + CARD if best else None


def _anchor(n: Node) -> tuple[Node, str]:
    """The nearest written id, body, or fifth ancestor, and the tags from below it."""
    steps: list[str] = []
    while n.parent is not None and n.name not in ("html", "body", "#document") and len(steps) < LEVELS and not _fixed_id(n, "layout"):
        steps.insert(0, n.name)
        n = n.parent
    return n, "/".join(steps)


def _structural(page: Page) -> str | None:
    """HTM-20: whole cards, grouped by their anchor and the tags from it.

    Of cards inside cards the inner one counts, unless only the outer one has a title.
    """
    cards: dict[int, Node] = {}
    chosen: dict[int, Node] = {}
    for n in page.clear(page.elements):
        if not page.is_card(n):
            continue
        outer = [a for a in n.up() if a is not n and id(a) in cards]
        cards[id(n)] = n
        if not outer or page.titled(n) or not any(map(page.titled, outer)):
            for a in outer:
                chosen.pop(id(a), None)
            chosen[id(n)] = n
    groups: dict[tuple[int, str], list] = defaultdict(list)
    for n in chosen.values():
        anchor, steps = _anchor(n)
        groups[id(anchor), steps].append(anchor)
    found = max((g for g in groups.items() if len(g[1]) >= MINIMUM), key=lambda g: len(g[1]), default=None)
    if found is None:
        return None
    steps = found[0][1]
    return _named_path(found[1][0]) + (f"/{steps}" if steps else "") + CARD


def _density(page: Page) -> str | None:
    """HTM-21: a parent whose children of one tag nearly all have a link and an image; a written id counts 15."""
    best, most = None, 0
    for parent in page.clear(page.elements):
        children = page.clear(parent.children)
        by_tag: dict[str, list[Node]] = defaultdict(list)
        for c in children if len(children) >= MINIMUM else ():
            by_tag[c.name].append(c)
        for tag, nodes in by_tag.items():
            score = len(nodes) + 15 * bool(_fixed_id(parent))
            if len(nodes) >= MINIMUM and score > most and sum(map(page.is_tile, nodes)) / len(nodes) >= 0.8:
                best, most = f"{_named_path(parent)}/{tag}", score
    return best + CARD if best else None


def _semantic(page: Page) -> str | None:
    """HTM-22: a class that at least three tiles have; a word for cards in it counts 20. Of equals the first in the page wins."""
    by_class: dict[str, int] = {}
    for n in page.clear(page.elements):
        tile = page.is_tile(n)
        for c in dict.fromkeys(n.get("class").split()):
            if len(c) >= 3 and not utility_class(c):
                by_class[c] = by_class.get(c, 0) + tile
    best = max(((n + 20 * any(w in c.lower() for w in CARD_WORDS), c) for c, n in by_class.items() if n >= MINIMUM), key=lambda x: x[0], default=None)
    return f"//*[contains(@class, '{best[1]}')]{CARD}" if best else None


def _single(root: Node) -> Selectors | None:
    """HTM-23: a page of one product."""
    if xpath.first(root, "//h1", "//meta[@property='og:title']") is None:
        return None
    return Selectors(SINGLE_CONTAINER, SINGLE_NAME, SINGLE_PRICE, ".//a", SINGLE_IMAGE, "", "single")


def _parts(card: Node, selector: str) -> Iterator[Node | None]:
    for part in selector.split("|"):
        yield xpath.first(card, part.strip())


def _name(card: Node, selector: str) -> str:
    return next((t for n in _parts(card, selector) if (t := name_of(n))), "")


def _price(node: Node | None) -> Decimal | None:
    if node is None:
        return None
    own = price_of(node)
    if own is not None:
        return own
    got = V.parse_price(node.inner_text())
    return got.price if got else None


def _holds(root: Node, s: Selectors) -> bool:
    """HTM-24: of the first five cards at least one has a name, and a price if it shows one."""
    for card in xpath.select(root, s.container)[:5]:
        if _name(card, s.name) and ("$" not in card.inner_text() or any(_price(n) for n in _parts(card, s.price))):
            return True
    return False


def detect(root: Node, strategy: str = "auto") -> Selectors | None:
    """HTM-24: the first strategy whose selectors hold, or what the named one says."""
    ways = {"repetitive": _repetitive, "structural": _structural, "density": _density, "semantic": _semantic}
    page = Page(root)
    for name in STRATEGIES if strategy == "auto" else (strategy,):
        container = ways[name](page) if name in ways else None
        found = Selectors(container, strategy=name) if container else _single(root) if name == "single" else None
        if found is not None and (strategy != "auto" or _holds(root, found)):
            return found
    return None


def next_page(root: Node, pager: str | None = None) -> str | None:
    """HTM-26."""
    if (pager or "").strip():
        n = xpath.first(root, pager)
        if n is not None and n.get("href"):
            return n.get("href")
    for a in root.elements():
        if a.name != "a" or not a.get("href"):
            continue
        rel, text = a.get("rel").lower(), a.inner_text().lower().strip()
        if rel == "next" or "siguiente" in rel:
            return a.get("href")
        said = f"{text} {a.get('aria-label')} {a.get('title')}".lower()
        own = a.get("class").lower()
        marked = any(m in own for m in NEXT_CLASSES[:2]) or "next" in a.get("id").lower() or any(m in d.get("class") for d in a.elements() for m in NEXT_CLASSES)
        if (text in NEXT_WORDS or "siguiente" in said or "next" in said or marked) and not any(x in text for x in NO_NEXT):
            return a.get("href")
    return None


@dataclass
class Category:
    """Products (name, price, url, image_url, sku) and what was left out or looks odd."""

    products: list[dict] = field(default_factory=list)
    diagnostics: list[str] = field(default_factory=list)
    next_url: str | None = None
    selectors: Selectors | None = None
    strategy: str | None = None


CATEGORY_SCHEMA = "products array<struct<name:string,price:decimal(18,2),url:string,image_url:string,sku:string>>, diagnostics array<string>, next_url string, container string"


def _valid(n: Node | None, names: tuple[str, ...] = LINKS) -> str | None:
    return next((n.get(a).strip() for a in names if V.valid_link(n.get(a))), None) if n is not None else None


def _link(card: Node, selector: str) -> str | None:
    """What the selector's first node says, else the card itself if it is a link, else its first link that is one."""
    found = _valid(card if selector in ("self", ".") else xpath.first(card, selector) if selector else None)
    if found is None and card.name == "a":
        found = _valid(card, LINKS[:3])
    return found or next((x for d in card.elements() if d.name == "a" and (x := _valid(d))), None)


def _card_price(card: Node, selector: str) -> Decimal:
    """AGG-17: what the selector says, else the first promotional price, else the lowest found."""
    got = next((p for n in _parts(card, selector) if (p := _price(n))), None) if selector else None
    if got:
        return got
    found = []
    for n in card.elements():
        if ("$" in next((c.text for c in n.children if c.name == TEXT), "") or any(c in n.get("class") for c in CARD_PRICE_CLASSES)) and sum(c.name != TEXT for c in n.children) <= 3:
            p = _price(n)
            if p:
                found.append(p)
    if not found:
        return Decimal(0)
    promo = next((p for n in card.elements() if any(c in n.get("class") for c in PROMO_PRICES) and (p := _price(n))), None)
    return promo or min(found)


def read_category(page: str | None, base: str | None, selectors: Selectors | None = None) -> Category:
    """HTM-25, FLT-16: the cards of one page. A page that blocks its reader has none, and asks for the strongest strategy."""
    out = Category()
    if any(w in (page or "") for w in BLOCKED_PAGES):
        out.strategy = "Cloudflare"
        out.diagnostics.append("Se detectó una firma de bloqueo o captcha en el portal.")
        return out
    root = parse(page)
    s = out.selectors = selectors or detect(root)
    if s is None:
        out.diagnostics.append("No se detectó una cuadrícula de productos.")
        return out
    for k, card in enumerate(xpath.select(root, s.container), 1):
        link = _link(card, s.link)
        if not link:
            out.diagnostics.append(f"Tarjeta #{k}: sin enlace de producto.")
            continue
        costco = "costco" in (base or "").lower() or "costco" in link.lower()
        if "/c/" in link.lower() or costco and "/p/" not in link.lower():
            out.diagnostics.append(f"Tarjeta #{k}: enlace de categoría {link}.")
            continue
        url = V.absolute_url(link, base)
        name = _name(card, s.name) or name_of(xpath.first(card, ".//h3", ".//h2", ".//a"))
        if not name:
            out.diagnostics.append(f"Tarjeta #{k}: sin título, {url}.")
            continue
        price = _card_price(card, s.price)
        if not price:
            out.diagnostics.append(f"Tarjeta #{k}: precio en 0, {name}.")
        image = next((i for n in (xpath.first(card, s.image) if s.image else None, xpath.first(card, ".//img")) if (i := image_of(n))), None)
        if image is None:
            out.diagnostics.append(f"Tarjeta #{k}: sin imagen, {name}.")
        out.products.append({"name": name, "price": price, "url": url, "image_url": V.absolute_url(image, base) if image else None, "sku": V.deduce_sku(url)})
    following = next_page(root, s.pager)
    out.next_url = V.absolute_url(following, base) if following else None
    return out
