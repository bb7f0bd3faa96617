"""Pages of other makes than the shipped tables: no names, misleading names, fragments, fallback content. None is a
training page."""

import pytest

from helixloom.llm import htmltext

P = "<p>A sentence of the article, long enough to look like prose. Another one follows it.</p>"
T = "A sentence of the article, long enough to look like prose. Another one follows it."
L = "<ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul>"
PAGES = [
    (f"<html><body><div>{P}{P}</div></body></html>", f"{T}\n{T}"),
    (f'<html><body><div class="post-body text-bottom">{P}{P}</div></body></html>', f"{T}\n{T}"),
    (f'<article>{P}<div class="more-text">{P}</div>{P}</article>', f"{T}\n{T}\n{T}"),
    (T, T),
    (f"<article>{P}<p>We know <math><mi>E</mi></math> holds.</p></article>", f"{T}\nWe know E holds."),
    (f"<article>{P}<object>{P}</object>{P}</article>", f"{T}\n{T}\n{T}"),
    (f"<article>{P}<noscript>{P}</noscript>{P}</article>", f"{T}\n{T}\n{T}"),
    (f"<article>{P}<dialog open>{P}</dialog>{P}</article>", f"{T}\n{T}\n{T}"),
    (f"<article>{P}<p>See <svg><text>label</text></svg> here.</p></article>", f"{T}\nSee label here."),
    (f"<article><p>One <script>x<y</script>two <button>Go</button>three.</p>{P}</article>", f"One two three.\n{T}"),
    (f"<body><div>{L}</div><div><div>{P}</div><div>{P}</div></div><div>&copy; 2021</div></body>", f"{T}\n{T}"),
    (f"<body><form><div>{L}</div><div>{P}{P}</div></form></body>", f"{T}\n{T}"),
    (f"<p>{T}</p><p>{T}</p>", f"{T}\n{T}"),
    (f"<body>{T}<br><br>{T}</body>", f"{T} {T}"),
    (f"<body><div id=wrapper><div id=top>{L}</div><div id=mid>{P}<h2>Part</h2>{P}</div><div id=low>{L}</div></div></body>", f"{T}\nPart\n{T}"),
    (f'<body><div class="header-image bottom">{P}{P}{P}</div></body>', f"{T}\n{T}\n{T}"),
    (f'<body><div class="sidebar">{P}</div><div>{P}{P}{P}</div></body>', f"{T}\n{T}\n{T}"),
    (f'<body><div class="comments">{P}{P}</div><section>{P}{P}{P}</section></body>', f"{T}\n{T}\n{T}"),
    (f"<body><main><x-card><p>{T}</p></x-card>{P}</main></body>", f"{T}\n{T}"),
    (f"<body><table><tr><td>{L}</td><td>{P}{P}</td></tr></table></body>", f"{T}\n{T}"),
    (f"<body><center><font size=2>{T}</font></center></body>", T),
    (f"<body>{L}</body>", ""),
    (f"<body><div>{L}</div><div>{L}</div></body>", ""),
    (f'<body><div class="c1"><div class="c2"><h1>Head</h1><div class="c3">{T}</div><div class="c3">{T}</div></div></div></body>', f"Head\n{T}\n{T}"),
    (f"<body><section><h1>Head</h1>{P}<ol><li>First step of it.</li><li>Second step.</li></ol>{P}</section></body>", f"Head\n{T}\nFirst step of it.\nSecond step.\n{T}"),
    (f"<body><article><h1>Head</h1><details><summary>More of it</summary>{P}</details>{P}</article></body>", f"Head\nMore of it\n{T}\n{T}"),
    (f"<body><div role=main>{P}<dl><dt>Term</dt><dd>What it means.</dd></dl></div></body>", f"{T}\nTerm\nWhat it means."),
    (f"<body><article>{P}<audio src=x>{T}</audio></article></body>", f"{T}\n{T}"),
    (f"<body><article>{P}<p>x<sup>2</sup> + <i>y</i><em>z</em></p></article></body>", f"{T}\nx2 + yz"),
    (f"<body><div>{P}</div><div class=newsletter>{P}</div><div>{P}</div><div>{P}</div></body>", f"{T}\n{T}\n{T}"),
    (f"<body><div><p>{T}</p><p>{T}</p><div>{L}</div></div></body>", f"{T}\n{T}"),
    (f"<body><pre>{T}</pre></body>", T),
    (f"<body><blockquote>{P}</blockquote>{P}</body>", f"{T}\n{T}"),
    (f"<body><div class=popular>{L}</div><div class=more>{L}</div><div>{P}{P}</div></body>", f"{T}\n{T}"),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_page(page, text):
    assert page not in htmltext.TRAINING_PAGES
    assert htmltext.extract(page) == text
