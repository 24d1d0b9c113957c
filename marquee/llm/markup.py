"""Reading one HTML page: block tags with their paths, and the blocks of text between them."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

from .common import Memo

#: Elements that stay inside a block of text, and elements without an end tag (fixed values).
INLINE = set(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
    "strike strong sub sup time tt u var wbr br img object".split()
)
#: Elements of formulas: they stay inside a block, and part the words of it.
MATH = set(
    "math semantics annotation annotation-xml mrow mi mo mn ms mtext mspace msup msub msubsup mover "
    "munder munderover mfrac msqrt mroot mstyle mpadded mphantom merror maction menclose mfenced "
    "mmultiscripts mprescripts mtable mtr mtd mlabeledtr".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup: they run to their end tag or the end of the page.
RAW = "script|style|textarea|title"
#: Elements whose content is never text of the page. Without an end tag they hold nothing.
DROPPED = set("noscript template iframe svg select button".split())
#: Elements an opening block tag ends, and those that end their like.
_ENDED_BY_BLOCK = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
_ENDS_ALIKE = {
    "li": ("ul", "ol", "menu"),
    "dt": ("dl",),
    "dd": ("dl",),
    "tr": ("table",),
    "td": ("tr", "table"),
    "th": ("tr", "table"),
    "option": ("select",),
}
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)"
    rf"|<({RAW})(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+>(?:(?<=/>)|.*?(?:</\1\s*>|\Z))"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)"
    r"|[^<]++|<",
    re.S | re.I,
)
_DROPPED_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in DROPPED}
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_DIGITS = re.compile(r"\d+")


class Block(NamedTuple):
    """A block tag or the text of a block; ``path`` names the open elements from the root."""

    kind: str  # "open", "close" or "text"
    path: tuple[str, ...]
    text: str


def _named(key: tuple[str, str]) -> str:
    """Tag with its class, id and role; numbers in them do not tell elements apart."""
    tag, attributes = key
    names = " ".join("".join(m) for m in _NAMED.findall(attributes)).lower().split()
    return ".".join([tag, *(_DIGITS.sub("0", n) for n in names)])


_NAME = Memo(_named, 4096)


def _tokens(page: str) -> Iterator[re.Match]:
    """Tags and texts of a page in order, without the elements in DROPPED."""
    at: int | None = 0
    endless = set()  # elements without a further end tag: a page is searched once for each
    while at is not None:
        start, at = at, None
        for m in _TOKEN.finditer(page, start):
            tag = m[3] and m[3].lower()
            if tag not in DROPPED:
                yield m
            elif not m[2] and not m[4].endswith("/") and tag not in endless:
                if end := _DROPPED_END[tag].search(page, m.end()):
                    at = end.end()
                    break
                endless.add(tag)


def blocks(page: str) -> Iterator[Block]:
    """Block tags and texts of a page in order.

    Character references are decoded, white space in a text is one space, texts are trimmed and
    never empty. End tags without a start are skipped, elements left open end with their parent.
    """
    stack: list[str] = []
    tags: list[str] = []
    pieces: list[str] = []

    def text() -> Iterator[Block]:
        joined = " ".join(html.unescape("".join(pieces)).split())
        pieces.clear()
        if joined:
            yield Block("text", tuple(stack), joined)

    def close(size: int) -> Iterator[Block]:
        while len(stack) > size:
            yield Block("close", tuple(stack), "")
            stack.pop()
            tags.pop()

    for m in _tokens(page):
        tag = m[3]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                pieces.append(m[0])
            continue
        tag = tag.lower()
        if tag in INLINE or tag in MATH:
            if tag in ("br", "img", "wbr") or tag in MATH:
                pieces.append(" ")
            continue
        yield from text()
        if m[2]:
            if tag in tags:
                yield from close(len(tags) - 1 - tags[::-1].index(tag))
            continue
        if tags and tags[-1] in _ENDED_BY_BLOCK:
            yield from close(len(tags) - 1)
        if tag in _ENDS_ALIKE:
            for i in range(len(tags) - 1, -1, -1):
                if tags[i] == tag:
                    yield from close(i)
                if tags[i : i + 1] and tags[min(i, len(tags) - 1)] in _ENDS_ALIKE[tag]:
                    break
        if tag in VOID:
            continue
        stack.append(_NAME[tag, m[4]])
        tags.append(tag)
        yield Block("open", tuple(stack), "")
    yield from text()
    yield from close(0)
