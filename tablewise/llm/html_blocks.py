"""Leaf blocks of web pages: whitespace-collapsed text with the path of open elements above it."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Fixed values of HTML: elements inside a line of text, elements without an end, elements whose content is no markup.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark nobr q rp rt ruby s samp"
    " small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
#: An element that starts closes an open one of these, up to an element that holds it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>", re.S
)
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    path: list[str]  # names and class words of all open elements
    own: list[str]  # those of the innermost element that is no part of a line
    linked: int  # characters inside links


def _words(name: str, attributes: str) -> list[str]:
    out = [name]
    for kind, value in NAMES.findall(attributes):
        out += ["." + t.lower() for t in TOKEN.findall(value)] if kind.lower() != "role" else ["role " + value.strip("\"'").lower()]
    return out


class _Reader:
    def __init__(self):
        self.open: list[tuple[str, list[str]]] = []
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = self.links = 0

    def flush(self):
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                path = [w for _, words in self.open for w in words]
                own = next((words for name, words in reversed(self.open) if name not in INLINE), [])
                self.blocks.append(Block(text, path, own, min(self.linked, len(text))))
        self.parts, self.linked = [], 0

    def text(self, raw: str):
        if raw:
            self.parts.append(raw)
            if self.links:
                self.linked += len(raw)

    def close(self, names: set[str], until: set[str]):
        """Close the nearest open element of ``names`` with all inside it, unless one of ``until`` comes first."""
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] in names:
                self.links -= sum(n == "a" for n, _ in self.open[at:])
                del self.open[at:]
                return
            if self.open[at][0] in until:
                return

    def start(self, name: str, attributes: str):
        if name not in INLINE:
            self.flush()
            # a block ends a paragraph
            self.close({"p"}, {"table", "button", "td", "th", "body", "html"})
            if name in CLOSES:
                self.close(*CLOSES[name])
        elif name == "br":
            self.parts.append(" ")
        if name not in VOID and not attributes.rstrip().endswith("/"):
            self.open.append((name, _words(name, attributes)))
            self.links += name == "a"

    def end(self, name: str):
        if name not in INLINE:
            self.flush()
        self.close({name}, set() if name not in INLINE else {n for n, _ in self.open} - INLINE - {name})


def leaf_blocks(page: str) -> list[Block]:
    """Blocks of a page in order. Comments, scripts and styles are no blocks; what stands around a block's
    own children counts as blocks too. Elements that lack an end are closed by what cannot lie inside them."""
    reader, at = _Reader(), 0
    while True:
        tag = TAG.search(page, at)
        reader.text(page[at : tag.start() if tag else len(page)])
        if tag is None:
            break
        at, name = tag.end(), (tag[2] or "").lower()
        if not name:
            continue
        if tag[1]:
            reader.end(name)
            continue
        if name in RAW:
            reader.flush()
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
            at = close.end()
            continue
        reader.start(name, tag[3])
    reader.flush()
    return reader.blocks
