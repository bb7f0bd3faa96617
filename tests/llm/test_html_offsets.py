from helixloom.llm import htmltext


def test_raw_elements_end_where_they_end():
    """Letters whose lower case is longer (U+0130) before a raw element don't move its end."""
    p = "<p>A sentence of the article, long enough to look like prose. Another one follows it.</p>"
    t = "A sentence of the article, long enough to look like prose. Another one follows it."
    dotted = "\u0130" * 40
    assert htmltext.extract(f"<article><p>{dotted} {t}</p><script>a < b</SCRIPT>{p}{p}</article>") == f"{dotted} {t}\n{t}\n{t}"
