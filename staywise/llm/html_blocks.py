"""Leaf text blocks of an HTML page, with the tag path above each."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Comments, declarations, elements whose text is no text, and tags. A construct that the page's end cuts off reaches to the end.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|title)\b(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attr>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*)(?P<attr2>[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
#: An opening tag ends an open element of its own kind or of these.
_CLOSES = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
_SCOPE = frozenset("ul ol dl table div article aside section nav header footer main form body html td th".split())


@dataclass
class Block:
    path: tuple[str, ...]  # tags from the root, each followed by its class, id and role words
    text: str
    linked: int  # characters within links


def _open_names(tag: str, attributes: str) -> tuple[str, ...]:
    names = [f"<{tag}"]
    for kind, *values in _NAMES.findall(attributes):
        for word in re.findall(r"[a-z0-9]+", "".join(values).lower()):
            names.append(f"{kind[0].lower()}={word}")
    return tuple(names)


def blocks(page: str) -> list[Block]:
    """The page's non-empty blocks in order: text decoded, white space as single spaces."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    linked = 0

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            out.append(Block(tuple(n for _, names in stack for n in names), text, min(linked, len(text))))
        pieces.clear()
        linked = 0

    def said(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw)
            pieces.append(text)
            if any(tag == "a" for tag, _ in stack):
                linked += len(text.strip())

    def drop(kinds: tuple[str, ...]) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in kinds:
                del stack[k:]
                return
            if stack[k][0] in _SCOPE:
                return

    at = 0
    for m in _MARKUP.finditer(page):
        said(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            if m["raw"] and m["raw"].lower() not in ("script", "style", "template", "svg"):
                close()
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag not in _INLINE:
            close()
        if m["end"] or m["end2"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if tag in _INLINE and stack[k][0] not in _INLINE:
                    break
        elif tag not in _VOID:
            if tag in _CLOSES:
                drop(_CLOSES[tag])
            elif tag in _ENDS_P:
                drop(("p",))
            stack.append((tag, _open_names(tag, m["attr"] or m["attr2"] or "")))
    said(page[at:])
    close()
    return out
