"""Text rules over whole pages and answers, as Catalyst expressions: FN-20 (phrases), FN-32 to FN-35."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelark.functions.text import any_in

# Signatures and phrases, in lower case, and hosts of trackers.
BLOCKS = ["px-captcha", "challenge-platform", "cf-challenge", "mantén presionado", "manten presionado", "verifica tu identidad", "human challenge", "securitas", "perimeterx"]
NO_STOCK = ['"pdp_type":"no_stock"', '"has_stock":false', "este producto no está disponible", "publicación pausada", "producto no disponible", "sin stock", "agotado", "out of stock", "sold out"]
TRACKERS = ["googletagmanager.com", "google-analytics.com", "connect.facebook.net", "facebook.com/tr", "hotjar.com", "crazyegg.com", "doubleclick.net", "tiktok.com/embed", "pixel.wp.com"]
#: What stands for a tracker's source, a tag manager's name, a pixel's first call, and a way out of the frame.
BLOCKED_SOURCE, BLOCKED_MANAGER, BLOCKED_PIXEL, OWN_FRAME = "#blocked-tracker", "blocked_gtm", "console.log('fbq blocked'); //", "window.self.location"
MANAGERS, FRAMES = ["google_tag_manager", "gtm.js"], ["top", "parent"]
#: Sections of an answer: the sign and title of its heading.
SECTIONS = {"best": ("🏆", "La Mejor Oferta"), "numbers": ("📊", "Los Números"), "insights": ("💡", "Insights de Compra"), "mention": ("🥈", "Mención Honorífica")}
#: What ends a section: the first also a mark inside its line, the last its line, others the next line that begins with a mark.
SECTION_ENDS = {"best": r"[\n\r*]", "mention": r"[\n\r]"}
NEXT_MARK = r"\n\s*\*"


def is_captcha_or_block(page: Column) -> Column:
    """FN-32."""
    return F.coalesce(any_in(F.lower(page), BLOCKS), F.lit(False))


def says_no_stock(page: Column) -> Column:
    """FN-20: the phrases; html.client has the test of message elements."""
    return F.coalesce(any_in(F.lower(page), NO_STOCK), F.lit(False))


def neutralize_trackers(page: Column) -> Column:
    """FN-33: sources of tracking scripts, their inline calls, and scripts that leave the frame.

    One pattern serves all names of a kind, as each place has one.
    """
    any_of = lambda names: "(?:" + "|".join(map(re.escape, names)) + ")"
    out = F.regexp_replace(page, rf"""(?i)(<script\b[^>]*?\bsrc=)(["'])[^"']*{any_of(TRACKERS)}[^"']*\2""", f"$1$2{BLOCKED_SOURCE}$2")
    out = F.regexp_replace(out, f"(?i){any_of(MANAGERS)}", BLOCKED_MANAGER)
    out = F.regexp_replace(out, r"""(?i)fbq\(\s*["']init["']""", BLOCKED_PIXEL)
    return F.regexp_replace(out, rf"(?i)\b(?:window\.)?{any_of(FRAMES)}\.location\b", OWN_FRAME)


def answer_sections(answer: Column) -> Column:
    """FN-34: struct of the sections of an analysis; '' for one that isn't there.

    A section is what follows its heading, cut at its end; one of several lines
    that holds a mark inside a line isn't told apart and counts as missing.
    """
    found = []
    for name, (sign, title) in SECTIONS.items():
        heading = rf"(?iu)\*\*\s*{sign}\s*{title}:\s*\*\*\s*"
        body = F.get(F.split(F.get(F.split(answer, heading, 2), F.lit(1)), SECTION_ENDS.get(name, NEXT_MARK), 2), F.lit(0))
        whole = F.lit(True) if name in SECTION_ENDS else ~F.contains(body, F.lit("*"))
        found.append(F.coalesce(F.when(whole, F.trim(body)), F.lit("")).alias(name))
    return F.struct(*found)


def markdown_html(text: Column) -> Column:
    """FN-35: bold, emphasis, bullets and line ends."""
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(F.regexp_replace(out, r"\*\*(.+?)\*\*", "<strong>$1</strong>"), r"\*(.+?)\*", "<em>$1</em>")
    return F.coalesce(F.replace(F.regexp_replace(out, r"\n[*-] ", "<br/>• "), F.lit("\n"), F.lit("<br/>")), F.lit(""))
