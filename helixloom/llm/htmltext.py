"""Main text of pages by a tree-structured graphical model.

Each block element of a page is a node that is content or not. Its own evidence (element, names, length, share of link
text, final stops, its share of the page's text) gives a node potential; each parent and child share a pair potential, so that what stands in an
article is likely content and what stands in a menu isn't. Messages pass once from the leaves up and once back down
(sum-product); they give every node's exact marginal, and text of nodes above one half is the main text.

Potentials are fitted to labelled pages (``TRAINING_PAGES``, written here) by conditional likelihood; that takes a
second or two and is done by each worker that needs them, with the same result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .htmltree import BLOCK, SILENT, Node, parse, tidy

#: Names, in class, id, role or label, that are evidence of their own.
NAME_KINDS = {
    "content": ("article", "content", "main", "post", "entry", "story", "body", "text"),
    "menu": ("nav", "menu", "breadcrumb", "pagination", "pager", "toc", "skip", "tabs"),
    "edge": ("header", "footer", "masthead", "banner", "copyright", "colophon", "topbar", "bottom"),
    "side": ("sidebar", "aside", "related", "widget", "recommend", "trending", "popular", "more", "rail"),
    "notice": ("cookie", "consent", "notice", "gdpr", "popup", "modal", "alert", "newsletter", "subscribe", "signup", "paywall"),
    "advert": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner-ad"),
    "talk": ("comment", "comments", "reply", "discussion", "respond", "disqus"),
    "social": ("share", "social", "follow", "tags", "byline", "meta"),
    "hidden": ("hidden", "sr-only", "visually-hidden", "print-only"),
}
_KIND_OF = {word: kind for kind, words in NAME_KINDS.items() for word in words}
_WORD = re.compile(r"[a-z]+(?:-ad)?")
#: Boxes that seldom have text of their own.
BOXES = frozenset("#root html body center div td section main article".split())
SECTIONS = frozenset("article main aside nav footer header section form".split())
#: Elements that are never main text by what is asked for: menus, sidebars, footers, controls, the page's head.
NEVER = SILENT | frozenset("head select nav aside footer".split())
#: Names that are used for anything, and say less than a name of content beside them.
WEAK = frozenset("more bottom popular rail notice alert meta tags follow skip tabs header banner reply popup".split())


def _kinds(node: Node) -> list[str]:
    """Kinds of name; a weak name beside one of content doesn't count, and alone is a kind of its own."""
    if not node.names:
        return []
    words = {w for w in _WORD.findall(node.names) if w in _KIND_OF}
    strong = {_KIND_OF[w] for w in words - WEAK}
    weak = {f"maybe-{_KIND_OF[w]}" for w in words & WEAK}
    return sorted(strong if "content" in strong else strong | {w for w in weak if w[6:] not in strong})


def _features(node: Node) -> list[str]:
    own, links, length, under, share, linked, bare = node.data
    out = [f"tag={node.tag}", f"under={under}"]
    out += [f"name={k}" for k in _kinds(node)]
    out.append(f"length={min(6, int(math.log2(1 + length) / 2))}")
    if length:
        out.append(f"links={min(3, int(4 * links / length))}")
        out.append(f"stop={own.rstrip()[-1:] in '.!?…»”' if own.strip() else 'none'}")
    # a box named for something else may hold much text all the same
    named = under in NAME_KINDS and under != "content"
    out.append(f"below={linked}")
    out.append(f"share={share} below={linked} named={named}")
    if length and node.tag in BOXES:
        out.append(f"bare={bare} named={named}")
    return out


def _nodes(root: Node) -> list[Node]:
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(_children(node))
    return order


def block_nodes(root: Node) -> list[Node]:
    """Block elements in page order, parents before children. Each one's data: its own text (with that of inline
    elements in it), the characters of that in links, its length, the section or kind of name it stands under; of all
    text in and below it the share of the page's and that of links, and of its own text the share of the page's, in
    quarters."""
    order = _nodes(root)
    for node in order:
        own, links = _own(node)
        text = tidy("".join(own))
        up, kinds = parent_block(node), _kinds(node)
        under = node.tag if node.tag in SECTIONS else up.data[3] if up is not None else "page"
        telling = [k for k in kinds if not k.startswith("maybe-")]
        if telling and telling != ["content"]:
            under = next(k for k in telling if k != "content")
        elif telling and under in ("page", *SECTIONS):
            under = "content"
        node.data = (text, links, len(text), under)
    mass = {id(n): [0, 0] if n.tag in NEVER else [n.data[2], n.data[1]] for n in order}
    for node in reversed(order[1:]):
        if node.tag not in NEVER:
            up = mass[id(parent_block(node))]
            up[0], up[1] = up[0] + mass[id(node)][0], up[1] + mass[id(node)][1]
    total = max(1, mass[id(root)][0])
    for node in order:
        size, links = mass[id(node)]
        node.data += ("none" if not size else min(3, 4 * size // total), "none" if not size else min(3, 4 * links // size), min(3, 4 * node.data[2] // total))
    return order


def _children(node: Node) -> list[Node]:
    """Block elements below, through inline ones, the last first."""
    found, stack = [], list(node.items)
    while stack:
        x = stack.pop()
        if isinstance(x, Node):
            if _joins(x):
                stack.extend(x.items)
            elif x.tag not in SILENT:
                found.append(x)
    return found


def _joins(node: Node) -> bool:
    return node.tag not in BLOCK and node.tag not in SILENT and node.tag != "#root"


def _own(node: Node) -> tuple[list[str], int]:
    out, links = [], 0
    stack = [(x, False) for x in reversed(node.items)]
    while stack:
        x, linked = stack.pop()
        if x is None:
            out.append(" ")
        elif isinstance(x, str):
            out.append(x)
            if linked:
                links += len(x.strip())
        elif _joins(x):
            inside = linked or x.tag == "a"
            stack.extend((y, inside) for y in reversed(x.items))
        elif x.tag not in SILENT:
            out.append(" ")
    return out, links


def parent_block(node: Node) -> Node | None:
    up = node.parent
    while up is not None and _joins(up):
        up = up.parent
    return up


EPOCHS = 40
RATE = 0.3
PULL = 0.02


class Model:
    """Log-potentials: of a node's features for content against not, and of a child's state given its parent's.

    Fitted by gradient ascent on the conditional likelihood of labelled pages: counts seen less counts expected, which
    the messages give."""

    def __init__(self, pages: list[str]):
        """Labels: label-yes and label-no in a class; a page that begins with ``ROOT_YES`` is content itself, as plain
        text is."""
        self.weight: dict[str, float] = {}
        self.pair = [[0.0, -1.0], [-1.0, 0.0]]
        labelled = []
        for html in pages:
            root = parse(html.removeprefix(ROOT_YES))
            order, state = _nodes(root), {}
            for node in order:
                up = parent_block(node)
                mark = re.search(r"\blabel-(yes|no)\b", node.names)
                state[id(node)] = int(mark[1] == "yes") if mark else (state[id(up)] if up is not None else int(html.startswith(ROOT_YES)))
                node.names = re.sub(r"\blabel-(yes|no)\b", "", node.names)
            order = block_nodes(root)
            labelled.append((order, [state[id(n)] for n in order], [_features(n) for n in order]))
        size: Counter = Counter()
        pair_size = 1e-6
        for _ in range(EPOCHS):
            slope: Counter = Counter()
            moves = [[0.0, 0.0], [0.0, 0.0]]
            for order, states, features in labelled:
                place = {id(n): k for k, n in enumerate(order)}
                expected, edges = self.beliefs(order, features)
                for y, p, f in zip(states, expected, features, strict=True):
                    if abs(y - p) > 1e-4:
                        for x in f:
                            slope[x] += y - p
                for k in range(1, len(order)):
                    up = place[id(parent_block(order[k]))]
                    moves[states[up]][states[k]] += 1
                    for i in (0, 1):
                        for j in (0, 1):
                            moves[i][j] -= edges[k][2 * i + j]
            for x, g in slope.items():
                g -= PULL * self.weight.get(x, 0.0)
                size[x] += g * g
                self.weight[x] = self.weight.get(x, 0.0) + RATE * g / math.sqrt(size[x] + 1e-6)
            pair_size += max(abs(v) for row in moves for v in row) ** 2
            for i in (0, 1):
                for j in (0, 1):
                    self.pair[i][j] += RATE * moves[i][j] / math.sqrt(pair_size)

    def marginals(self, order: list[Node]) -> list[float]:
        """P(content) of each node; ``order`` has parents first."""
        return self.beliefs(order, [_features(n) for n in order])[0]

    def beliefs(self, order: list[Node], features: list[list[str]]) -> tuple[list[float], list[tuple]]:
        """Marginals of nodes, and of each node's parent and itself, by messages up, then down."""
        place = {id(n): k for k, n in enumerate(order)}
        up = [place[id(p)] if (p := parent_block(n)) is not None else -1 for n in order]
        weight, (stay0, go1), (go0, stay1) = self.weight, self.pair[0], self.pair[1]
        own0, own1 = [0.0] * len(order), [sum(weight.get(x, 0.0) for x in f) for f in features]
        sent = [(0.0, 0.0)] * len(order)
        for k in range(len(order) - 1, 0, -1):  # children come after their parents
            a = _log_add(own0[k] + stay0, own1[k] + go1)
            b = _log_add(own0[k] + go0, own1[k] + stay1)
            sent[k] = (a, b)
            own0[up[k]] += a
            own1[up[k]] += b
        out, edges = [0.0] * len(order), [()] * len(order)
        belief = [(0.0, 0.0)] * len(order)
        for k in range(len(order)):
            b0, b1 = own0[k], own1[k]
            if k:
                r0, r1 = belief[up[k]]
                r0, r1 = r0 - sent[k][0], r1 - sent[k][1]  # the parent's belief without this child's message
                joint = (r0 + stay0 + b0, r0 + go1 + b1, r1 + go0 + b0, r1 + stay1 + b1)
                top = max(joint)
                joint = [math.exp(x - top) for x in joint]
                all_ = sum(joint)
                edges[k] = tuple(x / all_ for x in joint)
                b0 += _log_add(r0 + stay0, r1 + go0)
                b1 += _log_add(r0 + go1, r1 + stay1)
            top = max(b0, b1)
            b0, b1 = b0 - top, b1 - top
            belief[k] = (b0, b1)
            out[k] = math.exp(b1) / (math.exp(b0) + math.exp(b1))
        return out, edges


def _log_add(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


_P = "<p>Some sentence of an article stands here, long enough to look like prose. Then comes another sentence, and a third one ends it.</p>"
_S = "<p>A short line.</p>"
_LINKS = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Home", "World", "Sport", "About us", "Contact"))
_T = "Some sentence of a page stands here, long enough to look like prose. Then comes another sentence, and a third one ends it."
ROOT_YES = "label-yes:"
_HEAD = "<!DOCTYPE html><html><head><meta charset=utf-8><title>A title</title><style>p{}</style><script>var a='</p>';</script></head>"

#: Labelled pages: label-yes and label-no in a class mark an element and all below it until another mark.
TRAINING_PAGES = [
    f'{_HEAD}<body><nav><ul>{_LINKS}</ul></nav><div class="ad">Buy this now. Only today.</div><article class="label-yes"><h1>A headline of some words</h1>{_P}{_S}{_P * 3}</article><footer>&copy; site.example &middot; All rights reserved.</footer></body></html>',
    f'{_HEAD}<body><header><h1>The Site</h1><p>News since 1990</p></header><nav class="menu"><ul>{_LINKS}</ul></nav><main class="label-yes"><article><h1>Headline</h1><p><b>Lead sentence stands here.</b></p>{_P * 4}<h2>Between</h2>{_P}<ul><li>First point of a list.</li><li>Second point of a list.</li></ul></article></main><aside class="label-no sidebar"><h3>Related</h3><ul>{_LINKS}</ul></aside><footer><p>Copyright notice.</p></footer></body></html>',
    f'{_HEAD}<body><div id="header"><div class="logo">Site</div><div class="topbar"><a href="/">Home</a> <a href="/b">Blog</a></div></div><div id="content" class="label-yes"><div class="post"><h1>Post title</h1><div class="label-no byline">By A. Writer, 3 May</div>{_P * 3}<blockquote>{_P}</blockquote><pre>code line</pre>{_P}<div class="label-no share"><a href="#">Share</a> <a href="#">Tweet</a></div></div><div id="comments" class="label-no"><h3>2 comments</h3><div class="comment"><p>I think this is wrong, and here is a long reason why I think so.</p></div><div class="comment">{_P}</div><form><input><button>Reply</button></form></div></div><div id="sidebar"><div class="widget"><h4>Popular</h4><ul>{_LINKS}</ul></div></div><div id="footer">All rights reserved.</div></body></html>',
    f'{_HEAD}<body><div class="cookie-notice"><p>We use cookies to improve your visit. By staying you accept our policy.</p><button>Accept</button></div><div class="wrapper"><section class="label-yes entry-content"><h1>Title</h1>{_P * 5}{_S}<table><tr><th>Year</th><th>Sum</th></tr><tr><td>1999</td><td>12</td></tr></table><div class="label-no advertisement"><p>Advertisement: a product you need. Order it today and save.</p></div>{_P}</section><section class="related"><h2>More stories</h2><ul>{_LINKS}</ul></section></div><div class="newsletter"><p>Sign up for our newsletter and never miss a story.</p><form><input></form></div><footer><nav><ul>{_LINKS}</ul></nav><p>Imprint</p></footer></body></html>',
    f'{_HEAD}<body><nav><ul>{_LINKS}</ul></nav><!-- ad 1 --><div class="ads"><p>Sponsored words.</p></div><article class="label-yes"><h1>Short</h1>{_S}</article><footer>&copy; a.example</footer></body></html>',
    f'{_HEAD}<body><table><tr><td class="menu"><ul>{_LINKS}</ul></td><td class="label-yes main"><h1>Old page</h1>{_P * 3}{_S}</td></tr></table><p class="label-no">Last updated 1999</p></body></html>',
    f'{_HEAD}<body><div role="navigation"><ul>{_LINKS}</ul></div><div role="main" class="label-yes"><h1>Words</h1>{_P}<figure><img><figcaption>What the picture shows.</figcaption></figure>{_P}<h2>Next part</h2>{_P}<ol><li>{_S}</li><li>{_S}</li></ol></div><div role="complementary"><h2>Trending</h2>{_S}</div><div role="contentinfo">Terms. Privacy.</div></body></html>',
    f'{_HEAD}<body><p class="label-yes">A page of bare paragraphs, with no article around them, that are all there is to read.</p><p class="label-yes">Another one follows and goes on for a while, as text does.</p><div class="label-no footer">Copyright</div></body></html>',
    f'{_HEAD}<body><article class="label-yes"><header><h1>Headline in a header</h1></header>{_P * 2}<aside class="label-no"><p>An aside with a remark that is not of the article.</p></aside><div class="label-no promo"><p>Try our app, it is free.</p></div>{_P}<section class="label-no comments"><h2>Comments</h2><article><p>A reader says something here.</p></article></section></article></body></html>',
]

#: Prose by a name that tells it isn't the article's: a page for each name, as text of its own and in paragraphs, before,
#: inside and after the article.
for _kind, _words in NAME_KINDS.items():
    if _kind != "content":
        for _name in _words:
            _bare = f'<div class="label-no {_name}">A sentence that stands here, long enough to look like prose. Then another one ends it.</div>'
            _full = f'<div class="label-no {_name}">{_P}{_S}</div>'
            _art = f'<article class="label-yes"><h1>Headline</h1>{_P * 3}{_S}{_full}{_P}</article>'
            _main = f'<div class="label-yes content"><h2>Headline</h2>{_P * 3}{_bare}{_S}</div>'
            TRAINING_PAGES += [f"{_HEAD}<body>{_bare}{_art}{_full}</body></html>", f"{_HEAD}<body>{_full}{_main}{_bare}</body></html>"]


#: Weak names on the box that holds nearly all text, and text without any names: boxes in boxes, bare text, fragments.
for _name in sorted(WEAK):
    TRAINING_PAGES += [
        f'{_HEAD}<body><div><ul>{_LINKS}</ul></div><div class="label-yes {_name}"><h1>Title</h1>{_P * 3}{_S}</div><div>&copy; Site</div></body></html>',
        f'{_HEAD}<body><div class="label-yes {_name}"><div>{_P * 2}<blockquote>{_P}</blockquote></div></div></body></html>',
    ]
for _k in (1, 2, 4):
    TRAINING_PAGES += [
        f"{_HEAD}<body><div><a href=/>Site</a> <a href=/b>Blog</a></div><div><ul>{_LINKS}</ul></div><div class=label-yes><h1>Title of the page</h1>{_P * _k}{_S}<ul><li>A point of some words.</li><li>Another point.</li></ul></div><div><p>&copy; 2020 Site. All rights reserved.</p></div></body></html>",
        f"{_HEAD}<body><div><div><div class=label-yes>{_P * _k}</div></div></div></body></html>",
        f"<div class=label-yes>{_P * _k}</div>",
        f"{_HEAD}<body><div><a href=/>Home</a> | <a href=/b>World</a> | <a href=/c>Sport</a></div><div><div class=label-yes>{_P * _k}</div></div><div>Copyright 2020 Site</div></body></html>",
        f"{_HEAD}<body><div><div><h1>The site</h1></div><div><div class=label-yes>{_P * _k}</div></div><div class='label-no side'><ul>{_LINKS}</ul><p>About the site. It has pages.</p></div></div></body></html>",
        f"{_HEAD}<body><div class='label-no cookie'>{_P * _k}</div><article class=label-yes><h1>Title</h1>{_P}<div class='label-no ad'>{_P}</div><ul><li>One point.</li><li>Two points.</li></ul></article><section class='label-no comments'>{_P * _k}</section></body></html>",
        f"{_HEAD}<body><div><ul>{_LINKS}</ul></div><table><tr><td><ul>{_LINKS}</ul></td><td class=label-yes>{_T}<br><br>{_T * _k}</td></tr></table></body></html>",
        f"{_HEAD}<body class=label-yes>{_T * _k}<br><br>{_T}</body></html>",
        f"{_HEAD}<body class=label-yes><h1>Title</h1>{_P * _k}<pre>some code</pre>{_S}</body></html>",
        ROOT_YES + _T * _k,
        f"{ROOT_YES}<h1>Title</h1>{_P * _k}",
        f"{ROOT_YES}{_T}<p>{_T * _k}</p>",
        f"{_HEAD}<body><form><div><ul>{_LINKS}</ul></div><div class=label-yes><h1>Title</h1>{_P * _k}{_S}</div><input></form></body></html>",
        f"{_HEAD}<body><article class=label-yes><h1>Title</h1>{_P * (_k + 1)}<form class=label-no><p>Leave your name and tell us what you think of it.</p><p>Your name</p><input></form>{_P}</article><form><p>Search the whole site for what you need.</p><input></form></body></html>",
    ]
for _k in (1, 2, 3):
    _list = f"<div><ul>{_LINKS}</ul></div>"
    TRAINING_PAGES += [
        f"{_HEAD}<body>{_list * _k}</body></html>",
        f"<body>{_list * _k}<div>{_LINKS}</div></body>",
        f"{_HEAD}<body><div class='label-no comments'>{_P * _k}</div><section class=label-yes><h2>Part</h2>{_P * (_k + 1)}</section><section class=label-yes>{_P}</section></body></html>",
        f"{_HEAD}<body><section class=label-yes>{_P * _k}</section><section class='label-no comments'>{_P}</section></body></html>",
        f"{_HEAD}<body><div class=label-yes>{_P}</div><div class='label-no newsletter'>{_P}</div><div class=label-yes>{_P * _k}</div><div class='label-no advert'>{_S}</div><div class=label-yes>{_P}</div></body></html>",
        f"{_HEAD}<body><center class=label-yes><font>{_T * _k}</font></center></body></html>",
        f"<body class=label-yes>{_T * _k}</body>",
        f"<body class=label-yes>{_T}<p>{_T * _k}</p></body>",
        ROOT_YES + _T[:60] * _k,
        ROOT_YES + "A few words" * _k,
    ]
TRAINING_PAGES += [f"{_HEAD}<body><ul>{_LINKS}</ul></body></html>", f"{_HEAD}<body><div><a href=/a>One</a> <a href=/b>Two</a></div><div><ul>{_LINKS}</ul></div></body></html>", f"<ul>{_LINKS}</ul>"]


@lru_cache(maxsize=1)
def model() -> Model:
    return Model(TRAINING_PAGES)


def extract(html: str | None) -> str:
    """The main text: blocks joined by one newline."""
    if not html:
        return ""
    order = block_nodes(parse(html))
    chosen: dict[int, bool] = {}
    for node, p in zip(order, model().marginals(order), strict=True):
        up = parent_block(node)
        barred = node.tag in NEVER or (up is not None and chosen[id(up)] is None) or (node.tag == "header" and not _within(node))
        chosen[id(node)] = None if barred else p > 0.5  # below a barred node nothing is main text
    out: list[str] = []
    _emit(order[0], chosen, out)
    return "\n".join(out)


def _within(node: Node) -> bool:
    """Whether a header is that of an article, not of the page."""
    while (node := node.parent) is not None:
        if node.tag in ("article", "main"):
            return True
    return False


def _emit(root: Node, chosen: dict[int, bool | None], out: list[str]) -> None:
    """Blocks in page order. Text between block children of a chosen node is a block of its own."""
    words: list[str] = []

    def close() -> None:
        text = tidy("".join(words))
        words.clear()
        if text:
            out.append(text)

    stack: list[tuple] = [("open", root, False)]
    while stack:
        kind, x, keep = stack.pop()
        if kind == "close":
            close()
        elif x is None:
            words.append(" ")
        elif isinstance(x, str):
            if keep:
                words.append(x)
        elif _joins(x):
            stack.extend(("open", y, keep) for y in reversed(x.items))
        elif x.tag not in SILENT:
            close()
            mine = chosen.get(id(x))
            if mine is None:
                continue
            stack.append(("close", x, mine))
            stack.extend(("open", y, mine) for y in reversed(x.items))
    close()


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page. A null or empty page, or one without main text, has
    the empty text. Repeated rows give repeated rows; an empty table gives none."""
    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(h) for h in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    source = pages.select("page_id", "url", shared.text_or_empty("html").alias("html"))
    return shared.arrow_map(source, make, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
