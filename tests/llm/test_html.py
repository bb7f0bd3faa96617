import html as entities
import re

import pytest

from helixloom.llm import htmltext
from helixloom.llm.htmltree import parse


def test_brute_marginals():
    """Sum-product against the sum over all assignments."""
    import itertools
    import math

    m = htmltext.model()
    order = htmltext.block_nodes(parse("<body><div class=ad><p>One sentence.</p></div><article><p>Two, long enough to look like prose.</p><ul><li>x</li></ul></article></body>"))
    place = {id(n): k for k, n in enumerate(order)}
    own = [sum(m.weight.get(f, 0) for f in htmltext._features(n)) for n in order]
    total, inside = 0.0, [0.0] * len(order)
    for states in itertools.product((0, 1), repeat=len(order)):
        x = sum(w for w, s in zip(own, states) if s)
        for k, n in enumerate(order[1:], 1):
            x += m.pair[states[place[id(htmltext.parent_block(n))]]][states[k]]
        p = math.exp(x)
        total += p
        inside = [a + p * s for a, s in zip(inside, states)]
    assert m.marginals(order) == pytest.approx([a / total for a in inside])


def brute(page):
    """Pages of the test tables: what stands in the article, a block for each paragraph or heading."""
    a = page[page.find("<article>") + 9 :]
    a = a[: a.find("</article>")] if "</article>" in a else re.sub(r"<[^>]*$", "", a)
    blocks = re.split(r"<[^>]*>", re.sub(r"</?b>", "", a.replace("<br>", " ")))
    return "\n".join(x for x in (re.sub(r"\s+", " ", entities.unescape(b)).strip() for b in blocks) if x)


def test_sample(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in htmltext.extract_pages(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        want = brute(r.html)
        assert got[r.page_id] == (want, len(want))


P = "<p>A sentence of the article, long enough to look like prose. Another one follows it.</p>"
T = "A sentence of the article, long enough to look like prose. Another one follows it."


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<html><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><main><h1>Title</h1>{P}<h2>Part</h2>{P}</main><aside>{P}</aside><footer>{P}</footer></body></html>", f"Title\n{T}\nPart\n{T}"),
        (f'<body><div class="cookie-notice">{P}</div><article><h1>Title &amp; more</h1>{P}<div class="ad">{P}</div><ul><li>One point here.</li><li>Two&nbsp;points  here.</li></ul></article><section class="comments">{P}</section>', f"Title & more\n{T}\nOne point here.\nTwo points here."),
        (f"<article>{P}<script>if (a < b) document.write('<p>no</p>')</script><style>p {{}}</style><form><p>Your name</p><input></form><!-- <p>no</p> -->{P}</article>", f"{T}\n{T}"),
        (f"<article><p>One<p>Two is <b>bold</b> and <a href=x>linked</a>.<br>Next line.{P}</article>", f"One\nTwo is bold and linked. Next line.\n{T}"),
        (f"<article><h1>T</h1>{P}{P}<p>cut off he", f"T\n{T}\n{T}\ncut off he"),
        (f'<article><h1>T</h1>{P}<p>cut tag <a href="x', f"T\n{T}\ncut tag"),
    ],
)
def test_pages(page, text):
    assert htmltext.extract(page) == text


def test_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<nav>only a menu</nav>"), (4, "u", "<" * 2000), (5, "u", "<div>" * 3000 + "deep text"), (6, "u", "<p>" + "word " * 50_000), (6, "u", "</p></div>&#0;&nosuch;<a"), (None, None, "plain")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = htmltext.extract_pages(pages).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == by[3] == ""
    assert htmltext.extract_pages(pages.filter("false")).count() == 0
