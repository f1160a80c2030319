"""Leaf blocks of an HTML page: runs of text between block-level tags, with their ancestors."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# Element classes of HTML.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol option p pre "
    "section select summary table tbody td template textarea tfoot th thead title tr ul video".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))
CLOSES_P = BLOCK - {"html", "head", "body", "button", "option", "select", "textarea", "iframe", "video", "noscript", "template"}
OWN_KIND = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LIST_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"(class|id|role|data-main)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    tags: tuple[str, ...]  # from the root to the parent
    names: frozenset[str]  # words of class, id and role of all ancestors
    link_chars: int
    main: bool  # inside an element that is marked as main text


class _Element:
    __slots__ = ("tag", "names", "main")

    def __init__(self, tag: str, attributes: str) -> None:
        self.tag, names, self.main = tag, [], False
        if "=" in attributes:
            for m in _NAMED.finditer(attributes):
                value = (m[2] or m[3] or m[4] or "").lower()
                if m[1].lower() == "data-main":
                    self.main = True
                else:
                    names += _PART.findall(value)
        self.names = names


def leaf_blocks(page: str) -> list[Block]:
    """Blocks in page order; blocks without visible text are left out."""
    blocks: list[Block] = []
    stack: list[_Element] = []
    parts: list[str] = []
    links = 0
    open_links = 0

    def text_ended() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                names = frozenset(n for e in stack for n in e.names)
                blocks.append(Block(text, tuple(e.tag for e in stack), names, links, any(e.main for e in stack)))
            parts.clear()
        links = 0

    def pop_to(depth: int) -> None:
        nonlocal open_links
        open_links -= sum(e.tag == "a" for e in stack[depth:])
        del stack[depth:]

    def close(kinds: tuple[str, ...], scope: tuple[str, ...]) -> None:
        """Close the nearest open element of ``kinds`` that is not hidden behind ``scope``."""
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth].tag in kinds:
                pop_to(depth)
                return
            if stack[depth].tag in scope:
                return

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            text = html.unescape(page[at:end])
            parts.append(text)
            if open_links:
                links += len(text.strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in RAW:
            if not closing:
                stop = re.compile(rf"</{tag}\s*(?:>|\Z)", re.I).search(page, at)
                at = stop.end() if stop else len(page)
            continue
        if tag in BLOCK:
            text_ended()
        elif tag == "br":
            parts.append(" ")
        if closing:
            close((tag,), ())
            continue
        if tag in CLOSES_P:
            close(("p",), ("div", "article", "section", "li", "td", "th", "blockquote", "form", "body", "main", "aside", "nav", "header", "footer", "button"))
        if tag in OWN_KIND:
            close(OWN_KIND[tag], LIST_SCOPE[tag])
        if tag not in VOID and not attributes.endswith("/"):
            stack.append(_Element(tag, attributes))
            open_links += tag == "a"
    text_ended()
    return blocks
