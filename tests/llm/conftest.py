import pytest

EDGE_TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog. It barked, twice!\nIt barked, twice!\n"),
    (2, None),
    (3, ""),
    (4, " \t\n  "),
    (5, "one two"),
    (6, "naïve café 日本語 😀 it's  \n 12 3,4 <|endoftext|> end."),
    (7, "word " * 3000),
    (8, "a" * 5000 + " b"),
    (9, "The quick brown fox jumps over the lazy dog. It barked, twice!\nIt barked, twice!\n"),
    (9, "The quick brown fox jumps over the lazy dog. It barked, twice!\nIt barked, twice!\n"),
    (None, "no id here"),
    (11, "x\x1cy z w # $ % | & <b>\n\n# $\n# $"),
]


@pytest.fixture
def edge_docs(spark):
    """Nulls, empty and long texts, repeated rows, extra columns whose names clash with results."""
    rows = [(i, t, "en" if k % 3 else None, "src", len(t or ""), "x", 5) for k, (i, t) in enumerate(EDGE_TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words int")


@pytest.fixture
def no_docs(edge_docs):
    return edge_docs.filter("false")


@pytest.fixture(scope="session")
def sample_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
