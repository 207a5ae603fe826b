"""Main text of web pages: flat text blocks classified by a trained decision tree.

A page is cut at block-level tags into flat blocks of text.  Each block has its
word count and link density (share of words inside links), those of the block
before and after it, and what encloses it: a content element (article, main),
boilerplate elements (nav, header outside of content, footer, aside, form,
menu ...) and elements with boilerplate names (class, id, role), each as the
share of the page's words that stand outside of it (a form or a named box around
the whole page says nothing of a block), whether it is a heading, and how many
of its words only notices have.  A decision tree grown by Gini gain on the small
labelled table ``EXAMPLES`` keeps or drops the block.  Scripts, styles, other
non-text elements, comments of the markup and the head are never text.

Text: character references decoded, white space runs inside a block become one
space, blocks are trimmed and joined in page order by one space; nothing else
is dropped or capped.

Defined results: null and empty pages, and pages without text, give an empty
string; unclosed elements end with their parent or the page; a tag or comment
cut off by the end of the page is markup; repeated rows are extracted each.
Columns other than the id, url and html are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(>|\Z)|</[^>]*(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?(?:false|until))|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_BLANK = re.compile(r"\s+")
#: Elements whose content is not text.
SILENT = frozenset(("script", "style", "noscript", "template", "head", "title", "svg", "iframe", "object", "canvas", "select", "option", "textarea", "button", "audio", "video", "map", "math", "datalist", "noembed", "noframes"))
_RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "template", "svg"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
INLINE = frozenset(("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"))
BOILER = frozenset(("nav", "footer", "aside", "form", "menu", "dialog", "fieldset"))
CONTENT = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Parts of class, id and role names that speak of boilerplate ...
_BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner sponsor sponsored promo promos promotion promotions cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar widget widgets footer header masthead topbar toolbar share sharing social related recommended comment comments commentlist disqus replies reply respond discussion "
    "pagination pager search tags copyright legal disclaimer skip contentinfo complementary".split()
)
#: ... and those that only say where or what kind of box it is.
_BOX_WORDS = frozenset("site main page global primary secondary top bottom left right center sticky fixed mobile desktop area bar block blocks body box button buttons col column container content form frame group holder inner item items link links list module outer panel row section slot space title unit wrap wrapper zone side foot the and".split())
_PART = re.compile(r"[^0-9a-z]+")


@lru_cache(4096)
def _boiler_name(names: str) -> bool:
    """Whether one of the names is boilerplate's: it has a word of it, and all its other words only name a box.  So ``site-footer`` and ``ad-slot-2`` are, ``comments-open``, ``side-effects`` and ``legal-history`` are not."""
    for name in names.lower().split():
        words = [w for w in _PART.split(name) if w and not w.isdigit()]
        if any(w in _BOILER_WORDS for w in words) and all(w in _BOILER_WORDS or w in _BOX_WORDS for w in words):
            return True
    return False


_CONTENT_NAME = re.compile(r"(?:^|[\s_-])(?:article|articlebody|body|content|entry|main|post|story|text)(?:$|[\s_-])", re.I)


@dataclass
class Enclosing:
    """An element that may be boilerplate, and what it holds."""

    words: int = 0
    blocks: int = 0

    def outside(self, total: int) -> float:
        """Share of the page's words outside of it; an element of one block is no wrapper, whatever its share."""
        return 1.0 - self.words / total if self.blocks > 1 else 1.0


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    words: int = 0
    linked: int = 0
    boiler: list[Enclosing] = field(default_factory=list)
    boiler_name: list[Enclosing] = field(default_factory=list)
    content: bool = False
    heading: bool = False
    listed: bool = False

    def text(self) -> str:
        return _BLANK.sub(" ", html.unescape("".join(self.parts))).strip()


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in order, without empty ones."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool, bool]] = []  # name, boiler, boiler name, content, silent
    boiler: list[Enclosing] = []
    named: list[Enclosing] = []
    content = silent = links = 0
    heading = listed = 0
    current: Block | None = None
    at, size = 0, len(page)

    def flush() -> None:
        nonlocal current
        if current is not None and current.words:
            out.append(current)
            for e in (*current.boiler, *current.boiler_name):
                e.words += current.words
                e.blocks += 1
        current = None

    def push(name: str, attributes: str) -> None:
        nonlocal content, silent, links, heading, listed
        names = " ".join(m[1].strip("\"'") for m in _NAMES.finditer(attributes)) if attributes else ""
        is_content = (name in CONTENT and not _boiler_name(names)) or bool(names and _CONTENT_NAME.search(names) and not _boiler_name(names))
        is_boiler = name in BOILER or (name == "header" and not content)
        is_named = bool(names and name not in ("html", "body", "main") and _boiler_name(names))
        is_silent = name in SILENT or bool(attributes and _HIDDEN.search(attributes))
        stack.append((name, is_boiler, is_named, is_content, is_silent))
        boiler.extend([Enclosing()] * is_boiler)
        named.extend([Enclosing()] * is_named)
        content, silent = content + is_content, silent + is_silent
        links, heading, listed = links + (name == "a"), heading + (name in HEADINGS), listed + (name == "li")

    def pop() -> None:
        nonlocal content, silent, links, heading, listed
        name, is_boiler, is_named, is_content, is_silent = stack.pop()
        del boiler[len(boiler) - is_boiler :], named[len(named) - is_named :]
        content, silent = content - is_content, silent - is_silent
        links, heading, listed = links - (name == "a"), heading - (name in HEADINGS), listed - (name == "li")

    def text(piece: str) -> None:
        nonlocal current
        if silent or not piece:
            return
        n = len(piece.split())
        if current is None:
            if not n:
                return
            current = Block(boiler=list(boiler), boiler_name=list(named), content=content > 0, heading=heading > 0, listed=listed > 0)
        current.parts.append(piece)
        current.words += n
        current.linked += n if links else 0

    while at < size:
        m = _MARKUP.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[6] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[1] or m[5]), m[3] or m[7] or ""
        if name not in INLINE or name == "br":
            flush()
        if name in VOID:
            continue
        if not closing:
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack:
                # an open one of its kind ends here
                ends = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}.get(name, (name,))
                k = len(stack) - 1
                while k >= 0 and stack[k][0] in INLINE:
                    k -= 1
                if k >= 0 and stack[k][0] in ends:
                    while len(stack) > k:
                        pop()
            if attributes.rstrip().endswith("/") and name not in BOILER | CONTENT:
                continue
            push(name, attributes)
            if name in _RAW and name not in ("svg", "template"):
                end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else size
                pop()
        else:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), -1)
            if depth >= 0:
                while len(stack) > depth:
                    pop()
    flush()
    return out


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "boiler", "boiler_name", "content", "heading", "listed", "notice")
#: Words that notices are made of.
_NOTICE = re.compile(r"\b(?:cookies?|copyright|all rights reserved|privacy policy|terms of (?:use|service)|accept|consent|subscribe|newsletter|sign up|log ?in)\b|\u00a9", re.I)


def features(found: list[Block]) -> list[tuple[float, ...]]:
    total = sum(b.words for b in found)
    own = [(float(b.words), b.linked / b.words) for b in found]
    edge = (0.0, 0.0)
    most = lambda elements: max((e.outside(total) for e in elements), default=0.0)
    return [
        (*own[i], *(own[i - 1] if i else edge), *(own[i + 1] if i + 1 < len(own) else edge), most(b.boiler), most(b.boiler_name), float(b.content), float(b.heading), float(b.listed), float(len(_NOTICE.findall(b.text())) if b.words < 60 else 0))
        for i, b in enumerate(found)
    ]


#: Labelled blocks, in the order of FEATURES and then 1 for main text.
EXAMPLES = (
    # inside a content element
    (40, 0.0, 8, 0.0, 55, 0.0, 0, 0, 1, 0, 0, 0, 1),
    (120, 0.0, 40, 0.0, 80, 0.0, 0, 0, 1, 0, 0, 0, 1),
    (9, 0.0, 14, 0.0, 60, 0.0, 0, 0, 1, 1, 0, 0, 1),
    (2, 0.0, 70, 0.0, 33, 0.0, 0, 0, 1, 1, 0, 0, 1),
    (1, 0.0, 90, 0.0, 45, 0.0, 0, 0, 1, 0, 0, 0, 1),
    (5, 0.0, 30, 0.0, 12, 0.0, 0, 0, 1, 0, 1, 0, 1),
    (14, 0.1, 22, 0.0, 18, 0.0, 0, 0, 1, 0, 1, 0, 1),
    (60, 0.2, 25, 0.0, 6, 1.0, 0, 0, 1, 0, 0, 0, 1),
    (25, 0.0, 4, 1.0, 4, 1.0, 0, 0, 1, 0, 0, 0, 1),
    (3, 0.0, 1, 1.0, 5, 1.0, 0, 0, 1, 0, 0, 0, 1),
    (6, 1.0, 40, 0.0, 35, 0.0, 0, 0, 1, 0, 0, 0, 1),
    (4, 1.0, 50, 0.0, 70, 0.0, 0, 0, 1, 1, 0, 0, 1),
    (4, 0.0, 20, 0.0, 6, 1.0, 0, 0, 1, 0, 0, 0, 1),
    (7, 0.0, 30, 0.0, 3, 1.0, 0, 0, 1, 0, 0, 0, 1),
    (2, 0.0, 5, 0.0, 9, 1.0, 0, 0, 1, 0, 0, 0, 1),
    (5, 0.0, 60, 0.2, 12, 0.9, 0, 0, 1, 1, 0, 0, 1),
    (1, 0.0, 1, 0.0, 2, 0.0, 0, 0, 1, 0, 0, 0, 1),
    (2, 0.0, 3, 0.0, 1, 0.0, 0, 0, 1, 0, 0, 0, 1),
    (3, 0.0, 25, 0.0, 10, 0.0, 0, 0, 1, 0, 0, 0, 1),
    (4, 0.0, 90, 0.0, 9, 0.1, 0, 0, 1, 0, 0, 0, 1),
    (2, 0.0, 60, 0.0, 0, 0.0, 0, 0, 1, 0, 0, 0, 1),
    (1, 0.0, 33, 0.0, 22, 0.0, 0, 0, 1, 0, 1, 0, 1),
    (3, 1.0, 4, 1.0, 5, 1.0, 0, 0, 1, 0, 1, 0, 1),
    (2, 1.0, 12, 0.0, 16, 0.0, 0, 0, 1, 0, 1, 0, 1),
    (10, 0.0, 1, 1.0, 80, 0.0, 0, 0, 1, 1, 0, 0, 1),
    (200, 0.0, 10, 0.0, 8, 0.2, 0, 0, 1, 0, 0, 0, 1),
    (3, 0.0, 7, 0.0, 8, 0.1, 0, 0, 1, 0, 0, 0, 1),
    (1, 0.0, 7, 0.0, 11, 0.1, 0, 0, 1, 1, 0, 0, 1),
    # the only block, or the last one, after a menu
    (12, 0.0, 1, 1.0, 0, 0.0, 0, 0, 1, 0, 0, 0, 1),
    (30, 0.0, 2, 1.0, 0, 0.0, 0, 0, 1, 0, 0, 0, 1),
    (2, 0.0, 1, 1.0, 0, 0.0, 0, 0, 1, 0, 0, 0, 1),
    (5, 0.0, 1, 1.0, 3, 0.0, 0, 0, 1, 1, 0, 0, 1),
    (3, 0.0, 3, 1.0, 2, 0.0, 0, 0, 1, 0, 0, 0, 1),
    # a content element's own boilerplate
    (2, 1.0, 1, 1.0, 2, 1.0, 0, 0.95, 1, 0, 1, 0, 0),
    (12, 0.0, 40, 0.0, 60, 0.0, 0, 0.8, 1, 0, 0, 0, 0),
    (45, 0.0, 80, 0.0, 30, 0.0, 0, 0.9, 1, 0, 0, 0, 0),
    (6, 0.0, 90, 0.0, 20, 0.0, 0.6, 0, 1, 0, 0, 0, 0),
    (25, 0.0, 60, 0.0, 22, 0.0, 0.97, 0, 1, 0, 0, 0, 0),
    (3, 0.0, 60, 0.0, 24, 0.0, 0, 0.7, 1, 1, 0, 0, 0),
    (30, 0.0, 3, 0.0, 28, 0.0, 0.85, 0.5, 1, 0, 0, 0, 0),
    # menus, headers, footers, sidebars, notices, adverts, forms
    (1, 1.0, 0, 0.0, 1, 1.0, 0.4, 0, 0, 0, 1, 0, 0),
    (5, 0.0, 0, 0.0, 70, 0.0, 0.95, 0, 0, 1, 0, 0, 0),
    (3, 0.0, 0, 0.0, 40, 0.0, 0.8, 0, 0, 1, 0, 0, 0),
    (30, 0.0, 45, 0.0, 60, 0.0, 0.9, 0, 0, 0, 0, 0, 0),
    (80, 0.0, 20, 0.0, 90, 0.0, 0.6, 0, 0, 0, 0, 0, 0),
    (15, 0.0, 12, 0.0, 30, 0.0, 0.97, 0, 0, 0, 0, 0, 0),
    (2, 0.0, 30, 0.0, 3, 0.0, 0.7, 0, 0, 0, 0, 0, 0),
    (4, 0.0, 3, 0.0, 2, 0.0, 0.85, 0, 0, 0, 1, 0, 0),
    (100, 0.0, 60, 0.0, 80, 0.0, 0, 0.5, 0, 0, 0, 0, 0),
    (2, 0.0, 3, 0.0, 3, 0.0, 0, 0.4, 0, 0, 0, 0, 0),
    (2, 1.0, 1, 1.0, 3, 1.0, 0.95, 0, 0, 0, 1, 0, 0),
    (3, 1.0, 2, 1.0, 10, 0.0, 0.8, 0.9, 0, 0, 1, 0, 0),
    (8, 0.0, 60, 0.0, 0, 0.0, 0.6, 0, 0, 0, 0, 0, 0),
    (10, 0.1, 120, 0.0, 0, 0.0, 0.97, 0.7, 0, 0, 0, 0, 0),
    (40, 0.0, 80, 0.0, 12, 0.0, 0.85, 0, 0, 0, 0, 0, 0),
    (7, 0.0, 1, 1.0, 9, 0.0, 0, 0.5, 0, 0, 0, 0, 0),
    (22, 0.0, 1, 1.0, 55, 0.0, 0, 0.4, 0, 0, 0, 0, 0),
    (60, 0.0, 40, 0.0, 35, 0.0, 0, 0.95, 0, 0, 0, 0, 0),
    (35, 0.0, 2, 0.0, 41, 0.0, 0, 0.8, 0, 0, 0, 0, 0),
    (4, 0.0, 0, 0.0, 1, 1.0, 0.9, 0, 0, 1, 0, 0, 0),
    (3, 0.0, 50, 0.0, 20, 0.0, 0, 0.6, 0, 1, 0, 0, 0),
    # pages without a content element
    (45, 0.0, 2, 1.0, 0, 0.0, 0, 0, 0, 0, 0, 0, 1),
    (14, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0, 0, 0, 0, 1),
    (11, 0.0, 3, 1.0, 0, 0.0, 0, 0, 0, 0, 0, 0, 1),
    (2, 0.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0, 0, 0, 0),
    (4, 0.0, 3, 1.0, 0, 0.0, 0, 0, 0, 0, 0, 0, 0),
    (45, 0.0, 38, 0.0, 52, 0.0, 0, 0, 0, 0, 0, 0, 1),
    (80, 0.1, 9, 0.0, 66, 0.0, 0, 0, 0, 0, 0, 0, 1),
    (30, 0.0, 6, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 0, 1),
    (18, 0.0, 2, 1.0, 40, 0.0, 0, 0, 0, 0, 0, 0, 1),
    (15, 0.0, 55, 0.0, 70, 0.0, 0, 0, 0, 0, 0, 0, 1),
    (12, 0.0, 30, 0.0, 3, 1.0, 0, 0, 0, 0, 0, 0, 1),
    (7, 0.0, 1, 1.0, 45, 0.0, 0, 0, 0, 1, 0, 0, 1),
    (4, 0.0, 60, 0.0, 50, 0.0, 0, 0, 0, 1, 0, 0, 1),
    (11, 0.0, 20, 0.0, 13, 0.0, 0, 0, 0, 0, 1, 0, 1),
    (5, 0.0, 40, 0.0, 30, 0.0, 0, 0, 0, 0, 0, 0, 1),
    (1, 0.0, 0, 0.0, 6, 0.0, 0, 0, 0, 1, 0, 0, 1),
    (2, 0.0, 0, 0.0, 50, 0.0, 0, 0, 0, 1, 0, 0, 1),
    (3, 0.0, 30, 0.0, 25, 0.0, 0, 0, 0, 0, 0, 0, 1),
    (1, 0.0, 4, 0.0, 8, 0.0, 0, 0, 0, 0, 0, 0, 1),
    (6, 0.0, 2, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 0, 1),
    (9, 0.0, 1, 0.0, 5, 0.0, 0, 0, 0, 0, 0, 0, 1),
    (25, 0.1, 3, 1.0, 4, 1.0, 0, 0, 0, 0, 0, 0, 1),
    (2, 1.0, 1, 1.0, 2, 1.0, 0, 0, 0, 0, 1, 0, 0),
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0, 0, 0, 0),
    (4, 1.0, 3, 1.0, 20, 0.0, 0, 0, 0, 0, 0, 0, 0),
    (6, 0.9, 30, 0.0, 5, 1.0, 0, 0, 0, 0, 1, 0, 0),
    (9, 1.0, 8, 1.0, 9, 0.8, 0, 0, 0, 0, 1, 0, 0),
    (12, 0.8, 4, 1.0, 10, 1.0, 0, 0, 0, 0, 0, 0, 0),
    (20, 0.9, 15, 1.0, 18, 0.9, 0, 0, 0, 0, 0, 0, 0),
    (3, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0, 0, 0, 0),
    # a form, or a box with a telling name, around the whole page or nearly so
    (60, 0.0, 5, 0.0, 80, 0.0, 0.0, 0, 0, 0, 0, 0, 1),
    (9, 0.0, 0, 0.0, 70, 0.0, 0.05, 0, 0, 1, 0, 0, 1),
    (45, 0.1, 12, 0.0, 33, 0.0, 0.1, 0, 0, 0, 0, 0, 1),
    (30, 0.0, 40, 0.0, 0, 0.0, 0.15, 0, 1, 0, 0, 0, 1),
    (90, 0.0, 2, 1.0, 25, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
    (14, 0.0, 60, 0.0, 35, 0.0, 0, 0.05, 1, 0, 0, 0, 1),
    (50, 0.0, 0, 0.0, 40, 0.0, 0, 0.15, 1, 0, 0, 0, 1),
    (22, 0.0, 31, 0.0, 18, 0.0, 0.0, 0.1, 0, 0, 0, 0, 1),
    (5, 1.0, 4, 1.0, 6, 1.0, 0.05, 0, 0, 0, 1, 0, 0),
    (3, 1.0, 2, 1.0, 40, 0.0, 0, 0.1, 0, 0, 0, 0, 0),
    # boilerplate that holds many of a short page's words
    (40, 0.0, 12, 0.0, 9, 0.0, 0.3, 0, 0, 0, 0, 0, 0),
    (25, 0.0, 30, 0.0, 20, 0.0, 0, 0.35, 0, 0, 0, 0, 0),
    # notices without telling names, and text that only mentions their words
    (16, 0.0, 3, 1.0, 50, 0.0, 0, 0, 0, 0, 0, 2, 0),
    (25, 0.1, 0, 0.0, 7, 0.0, 0, 0, 0, 0, 0, 3, 0),
    (12, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 3, 0),
    (5, 0.0, 45, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 2, 0),
    (30, 0.0, 70, 0.0, 4, 0.0, 0, 0, 0, 0, 0, 2, 0),
    (45, 0.0, 60, 0.0, 55, 0.0, 0, 0, 0, 0, 0, 1, 1),
    (30, 0.0, 40, 0.0, 50, 0.0, 0, 0, 1, 0, 0, 1, 1),
    (35, 0.0, 50, 0.0, 45, 0.0, 0, 0, 1, 0, 0, 2, 1),
    (8, 0.0, 40, 0.0, 60, 0.0, 0, 0, 0, 1, 0, 1, 1),
)


def grow(rows: list[tuple[float, ...]], depth: int = 6):
    """A decision tree by Gini gain: a label, or (feature, threshold, left for <=, right)."""
    ones = sum(r[-1] for r in rows)
    if depth == 0 or ones in (0, len(rows)):
        return int(ones * 2 > len(rows))
    gini = lambda part: 2 * (p := sum(r[-1] for r in part) / len(part)) * (1 - p) * len(part)
    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:]):
            cut = (a + b) / 2
            left, right = [r for r in rows if r[f] <= cut], [r for r in rows if r[f] > cut]
            cost = gini(left) + gini(right)
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, cut, left, right)
    if best is None or best[0] >= gini(rows) - 1e-12:
        return int(ones * 2 > len(rows))
    left, right = grow(best[3], depth - 1), grow(best[4], depth - 1)
    return left if left == right and isinstance(left, int) else (best[1], best[2], left, right)


def decide(tree, row: tuple[float, ...]) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


TREE = grow([tuple(map(float, r[:-1])) + (r[-1],) for r in EXAMPLES])


def main_text(page: str | None, tree=TREE) -> str:
    """Main text of one page."""
    if not page:
        return ""
    found = blocks(page)
    kept = (b.text() for b, row in zip(found, features(found), strict=True) if decide(tree, row))
    return " ".join(t for t in kept if t)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), tree=TREE) -> DataFrame:
    """The ``keep`` columns, the main text and its length in code points."""
    ship(pages.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [main_text(p, tree) for p in frame.pop("_html")]
            frame["text"], frame["n_chars"] = pd.Series(texts, index=frame.index, dtype=object), pd.Series([len(t) for t in texts], index=frame.index, dtype="int64")
            yield frame

    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(*keep, F.col(html_col).cast("string").alias("_html")).mapInPandas(run, schema)
