"""Web pages as trees of blocks: a tolerant parser for the extraction model.

Nodes are block elements and leaves of text.  A leaf is what stands between two
block tags: character references decoded, inline tags removed, white space
turned into single spaces and trimmed; empty leaves are left out.  Scripts,
styles and other elements that never show text are skipped whole.  Missing end
tags are implied where HTML implies them; a tag cut off by the end of the page
is dropped.  A quote opens a string only where an attribute's value begins and
if it is closed.  Without its end tag a script, style, title or text area goes
on to the end of the page; of other skipped elements only the start tag is.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# HTML element names by kind.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike "
             "strong sub sup time tt u var wbr".split())
HIDDEN = set("script style title template iframe noscript textarea svg noembed noframes xmp object".split())
TO_THE_END = set("script style title textarea".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
             "hr main menu nav ol p pre section table ul".split())
# An opening tag ends the open elements named first, up to an element named second.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "option": ({"option"}, {"select"}), "thead": ({"tr", "td", "th"}, {"table"}),
        "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "tr", "td", "th"}, {"table"}),
        "body": ({"head"}, {"html"})}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
    r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)"
    r"(?P<rest>(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+)*+)(?:>|\Z)", re.S)
_HINT = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    hints: tuple[str, ...] = ()
    text: str = ""
    words: int = 0
    linked: float = 0.0
    leaves: int = 0
    children: list[int] = field(default_factory=list)


def hints(attributes: str) -> tuple[str, ...]:
    """Lower-case words of an element's class, id, role, label and property."""
    if "=" not in attributes:
        return ()
    values = (a or b or c for a, b, c in _HINT.findall(attributes))
    return tuple(dict.fromkeys(p.lower() for v in values for p in _PART.findall(v)))


class _Builder:
    def __init__(self):
        self.nodes = [Node("#root", -1, 0)]
        self.open, self.run, self.links, self.linked = [0], [], 0, 0

    def flush(self) -> None:
        if not self.run:
            return
        text = " ".join(html.unescape("".join(self.run)).split())
        if text:
            self.add(Node("#text", 0, 0, text=text, words=text.count(" ") + 1, linked=min(1.0, self.linked / len(text))))
        self.run, self.linked = [], 0

    def add(self, node: Node) -> int:
        node.parent = self.open[-1]
        node.depth = self.nodes[node.parent].depth + 1
        self.nodes.append(node)
        return len(self.nodes) - 1

    def text(self, raw: str) -> None:
        if raw:
            self.run.append(raw)
            if self.links:
                self.linked += len(raw)

    def end_of(self, names: set[str], limits: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.nodes[self.open[i]].tag
            if tag in limits:
                return
            if tag in names:
                self.flush()
                del self.open[i:]
                if not self.open or tag != "p":
                    self.end_of(names, limits)
                return

    def start(self, name: str, rest: str) -> None:
        if name in INLINE:
            if name == "br":
                self.run.append(" ")
            elif name == "a":
                self.links = 1
            return
        self.flush()
        self.links = 0
        if name in ENDS_P:
            self.end_of({"p"}, {"table", "td", "th", "button"})
        if name in ENDS:
            self.end_of(*ENDS[name])
        at = self.add(Node(name, 0, 0, hints=hints(rest)))
        if name not in VOID:
            self.open.append(at)

    def end(self, name: str) -> None:
        if name in INLINE:
            if name == "a":
                self.links = 0
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.nodes[self.open[i]].tag == name:
                self.flush()
                del self.open[i:]
                return


def parse(page: str) -> list[Node]:
    """Nodes in page order, parents first; only leaves and elements with a leaf below them."""
    build, at, n = _Builder(), 0, len(page)
    unclosed = set()                                        # names without an end tag from here on
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            build.text(page[at:])
            break
        build.text(page[at:m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                build.text(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        if m["end"]:
            build.end(name)
        elif name in HIDDEN:
            if name not in unclosed and (not m["rest"].rstrip().endswith("/") or name in TO_THE_END):
                close = re.compile(rf"</{re.escape(name)}(?![^\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                if close:
                    at = close.end()
                elif name in TO_THE_END:
                    at = n
                else:
                    unclosed.add(name)
        else:
            build.start(name, m["rest"])
    build.flush()
    return _pruned(build.nodes)


def _pruned(nodes: list[Node]) -> list[Node]:
    for node in reversed(nodes):
        if node.tag == "#text":
            node.leaves = 1
        if node.parent >= 0:
            nodes[node.parent].leaves += node.leaves
    new, kept = {}, []
    for i, node in enumerate(nodes):
        if node.leaves or i == 0:
            new[i] = len(kept)
            node.parent = new.get(node.parent, -1)
            if node.parent >= 0:
                kept[node.parent].children.append(new[i])
            kept.append(node)
    return kept
