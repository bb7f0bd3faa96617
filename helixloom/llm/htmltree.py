"""A forgiving HTML parser: the element tree of a page, and its text in blocks.

Whole pages only. Implied ends follow the HTML rules that matter for text: a new paragraph, item, row or cell ends an
open one; raw-text elements end at their own end tag alone; a stray end tag is ignored; a cut-off page ends all.
"""

from __future__ import annotations

import re
from html import unescape

# Element names of HTML by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noframes template".split())
#: Elements that begin a block; all others, unknown ones too, run on in the text around them.
BLOCK = frozenset("address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav noframes ol optgroup option p plaintext pre search section select summary table tbody td tfoot th thead tr ul xmp".split())
#: Elements without text of the page, which may stand within a block of it.
SILENT = RAW | frozenset("button datalist embed input link meta param progress meter".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element of the first kind is ended by a start tag of the second.
ENDED_BY = {
    "p": frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "thead", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "thead", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "thead", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
    "head": frozenset(["body"]),
}
#: Elements whose inside an implied end never leaves.
SCOPE = frozenset("html body table td th caption article section div main aside nav header footer form ul ol dl button figure blockquote".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
SPACES = re.compile(r"[\s\xa0]+")


class Node:
    """An element. ``items`` holds, in order, texts (str), line breaks (None) and elements."""

    __slots__ = ("tag", "names", "parent", "items", "data")

    def __init__(self, tag: str, names: str = "", parent: Node | None = None):
        self.tag, self.names, self.parent, self.items, self.data = tag, names, parent, [], None


def _names(attributes: str) -> str:
    if not attributes or not attributes.strip():
        return ""
    out = []
    for m in ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            out.append(unescape(m[2] or m[3] or m[4] or ""))
        elif name in ("hidden",):
            out.append("hidden")
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", m[2] or m[3] or m[4] or "", re.I):
            out.append("hidden")
    return " ".join(out).lower()


def parse(html: str) -> Node:
    root = Node("#root")
    now, at = root, 0
    while True:
        m = TOKEN.search(html, at)
        if m is None:
            break
        if m.start() > at:
            now.items.append(unescape(html[at : m.start()]))
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            open_ = now
            while open_ is not root and open_.tag != tag:
                # an inline end tag doesn't end a block around it
                if tag not in BLOCK and open_.tag in BLOCK:
                    open_ = root
                    break
                open_ = open_.parent
            if open_ is not root:
                now = open_.parent
            continue
        place = now
        while place is not root:  # implied ends
            ended = ENDED_BY.get(place.tag)
            if ended is not None and tag in ended:
                now = place.parent
                place = now
                continue
            if place.tag in SCOPE and place.tag not in ENDED_BY:
                break
            if place.tag not in BLOCK or place.tag in ENDED_BY or place.tag in HEADINGS:
                place = place.parent
                continue
            break
        if tag == "br":
            now.items.append(None)
            continue
        node = Node(tag, _names(m[3]), now)
        now.items.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            found = RAW_END[tag].search(html, at)  # in the page itself: its lower case may be longer
            if found is None:
                at = len(html)
            else:
                end = found.start()
                node.items.append(html[at:end])
                close = html.find(">", end)
                at = len(html) if close < 0 else close + 1
            continue
        now = node
    if at < len(html):
        rest = html[at:]
        cut = rest.rfind("<")  # a tag that is cut off isn't text
        if cut >= 0 and re.match(r"</?[a-zA-Z!]", rest[cut:]) and ">" not in rest[cut:]:
            rest = rest[:cut]
        if rest:
            now.items.append(unescape(rest))
    return root


def tidy(text: str) -> str:
    return SPACES.sub(" ", text).strip()
