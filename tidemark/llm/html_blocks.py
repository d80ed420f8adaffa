"""Leaf blocks of an HTML page: their text and the elements they stand in.

A forgiving scan: tags that open or close a block end the running leaf; missing end tags are
supplied as browsers do for paragraphs, list items and table parts; scripts, styles and other
raw elements have no text, nor have drawings, objects, templates and what stands in for scripts.
Those end with their parent if they lack an end tag; drawings also where a block starts, or at />.
Nothing is dropped for its length. Paths hold the outermost 512 open elements, and tags look back at so many.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from typing import NamedTuple

# Element names of the HTML standard.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style iframe textarea title".split())
HIDDEN = frozenset("svg math object template noscript".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
_QUOTED = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_MARK = re.compile("[>\"']")
_SELF = re.compile(r"(?:^|[\s\"'])/$")
DEPTH = 512
"""Open elements that a block's path holds at most, and that a tag looks back at."""
TRIES = 8
"""Unclosed quotes of a page that are looked for one by one; then all ends of tags are found in one pass."""
_NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z]+")


class Tags:
    """The tags of a page, in time linear in its length whatever quotes and brackets are missing."""

    def __init__(self, page: str):
        self.page, self.last, self.failed = page, page.rfind(">"), 0
        self.ends: dict[int, int] | None = None

    def after(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, "/" if it closes, name, attributes) of the first tag or comment from a place on; a comment has no name.

        A quote that never closes is an ordinary character. What follows the last > is text.
        """
        page = self.page
        while 0 <= (at := page.find("<", at)) < self.last:
            if page.startswith("!--", at + 1):
                end = page.find("-->", at + 4)
                return at, len(page) if end < 0 else end + 3, "", "", ""
            if page[at + 1] in "!?":
                return at, page.index(">", at + 1) + 1, "", "", ""
            m = _NAME.match(page, at + 1)
            if m:
                end = self._end(m.end())
                if end < 0:
                    end = page.index(">", m.end())
                return at, end + 1, m[1], m[2].lower(), page[m.end() : end]
            at += 1
        if at >= 0 and (at := page.find("<!--", at)) >= 0:  # it may lack its end
            return at, len(page), "", "", ""
        return None

    def _end(self, at: int) -> int:
        """The first > outside quotes, or -1."""
        if self.failed < TRIES:
            m = _QUOTED.match(self.page, at)
            self.failed += not m
            return m.end() - 1 if m else -1
        if self.ends is None:
            # from the right: of each mark, where a tag that meets it outside quotes ends
            self.ends, later, following = {}, {">": -1, '"': -1, "'": -1}, {-1: -1}
            marks = [(m.start(), m[0]) for m in _MARK.finditer(self.page)]
            right = -1
            for place, mark in reversed(marks):
                if mark == ">":
                    self.ends[place] = place
                else:
                    close = later[mark]
                    after_close = following.get(close, -1) if close >= 0 else -1
                    self.ends[place] = self.ends.get(after_close, -1)
                following[place] = right
                later[mark] = right = place
        m = _MARK.search(self.page, at)
        return self.ends.get(m.start(), -1) if m else -1


class Block(NamedTuple):
    text: str
    path: tuple[str, ...]
    """Open elements, outermost first: the tag, then its class, id and role words as .word."""
    linked: int
    """Characters inside links."""


def _element(tag: str, attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return (tag,)
    words = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)).lower()
    return (tag, *("." + w for w in _SPLIT.split(words) if w))


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    open_: list[tuple[str, ...]] = []
    path: tuple[str, ...] | None = None
    text: list[str] = []
    linked: list[str] = []
    links = hidden = at = 0

    def flush() -> None:
        nonlocal path
        if text:
            whole = " ".join(_html.unescape("".join(text)).split())
            if whole:
                if path is None:
                    path = tuple(x for e in open_[:DEPTH] for x in e)
                out.append(Block(whole, path, len("".join(linked))))
            text.clear()
            linked.clear()
        path = None

    def pop_to(k: int) -> None:
        nonlocal links, hidden
        for e in open_[k:]:
            links -= e[0] == "a"
            hidden -= e[0] in HIDDEN
            named[e[0]] -= 1
        del open_[k:]

    def downwards() -> range:
        return range(len(open_) - 1, max(-1, len(open_) - 1 - DEPTH), -1)

    tags, named = Tags(page), Counter()
    while found := tags.after(at):
        start, end, closing, tag, attributes = found
        if start > at and not hidden:
            part = page[at:start]
            text.append(part)
            if links:
                linked.append(part)
        at = end
        if not tag:
            continue
        if tag == "br":
            text.append(" ")
        if closing:
            for k in downwards() if named[tag] else ():
                if open_[k][0] == tag:
                    if tag in BLOCK and hidden == sum(e[0] in HIDDEN for e in open_[k:]):
                        flush()
                    pop_to(k)
                    break
                if tag == "p" and open_[k][0] in HIDDEN:
                    break
            else:
                if tag in BLOCK and not hidden:
                    flush()
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at, tags.last + 1)
            at = close.end() if close else len(page)
            continue
        if tag in VOID or tag not in BLOCK and _SELF.search(attributes):
            continue
        if tag in BLOCK:
            for k in downwards():
                name = open_[k][0]
                if name in ("svg", "math"):
                    pop_to(k)
                    break
                if name in HIDDEN or name in BLOCK:
                    break
            if not hidden:
                flush()
            for k in downwards():
                name = open_[k][0]
                if name in HIDDEN:
                    break
                if name == "p" or name in CLOSES.get(tag, ()):
                    pop_to(k)
                    if name == "p":
                        continue
                elif name in FENCE.get(tag, ()) or name in BLOCK and tag not in CLOSES:
                    break
        open_.append(_element(tag, attributes))
        links += tag == "a"
        hidden += tag in HIDDEN
        named[tag] += 1
    text.append(page[at:] if at < len(page) and not hidden else "")
    flush()
    return out
