"""From HTML to a sequence of leaf blocks: the texts between block-level tags, with their tag paths."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S | re.I)
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[^A-Za-z0-9]+")
_SPACE = re.compile(r"\s+")
#: Tags that don't end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Tags without content, and those that a new tag of the same kind closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": ("li",), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int  # characters inside links


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page's body in page order. Scripts, styles, comments, the head and form controls hold none;
    character references are decoded, white space is one space, blocks without other text are left out. Tags that are
    not closed end with those around them; what isn't a tag is text."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    links = linked = 0
    in_head = False

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text and not in_head:
                out.append(Block(tuple(x for _, marks in stack for x in marks), text, linked))
            parts, linked = [], 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if links:
                linked += m.start() - at
        at = m.end()
        tag = m.group(3)
        if tag is None:
            if m.group(1) and m.group(1).lower() not in ("script", "style", "noscript", "template"):
                parts.append(" ")
            continue
        tag, ending = tag.lower(), bool(m.group(2))
        if tag == "a":
            links = max(0, links + (-1 if ending else 1))
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            continue
        close()
        links = 0
        if tag == "head":
            in_head = not ending
        elif tag == "body" and not ending:
            in_head = False
        if ending:
            names = [t for t, _ in stack]
            if tag in names:
                while stack and stack.pop()[0] != tag:
                    pass
            continue
        if stack and stack[-1][0] == "p":
            stack.pop()
        for other in CLOSES.get(tag, ()):
            if stack and stack[-1][0] == other:
                stack.pop()
        if tag not in VOID:
            names = [x.lower() for a in _ATTR.findall(m.group(4)) for x in _NAME.split("".join(a)) if x] if m.group(4) else []
            stack.append((tag, (tag, *("." + x for x in names))))
    if at < len(page):
        parts.append(page[at:])
    close()
    return out
