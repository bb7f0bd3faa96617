"""The pipeline against a plain version of its stages, on a table with every odd kind of row."""

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_copies import brute_components
from test_pii import brute as personal
from test_rules import brute_counts, distance

import __spark_entry__ as entry
import corpus_pipeline
from helixloom.llm import decontam, pii, quality

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(corpus_pipeline.BYTE_BPE), "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ITEM = "the committee met on tuesday to discuss the long awaited report about rivers"


def made_rows():
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdefghijklmnoprstu") for _ in range(rnd.randint(2, 9))) for _ in range(500)]

    def prose(n):
        return " ".join(rnd.choice(words) for _ in range(n))

    rows = [(k, prose(rnd.randint(60, 120))) for k in range(40)]
    near = rows[3][1].split()
    near[5] = "edited"
    rows += [(100, rows[3][1]), (101, " ".join(near)), (2, rows[2][1]), (102, prose(30) + " " + ITEM + " " + prose(40)), (103, prose(30) + " " + ITEM.replace("tuesday", "tuesdy") + " " + prose(40))]
    rows += [(104, prose(60) + " mail jane@site.org or call +1 555 123 4567 now"), (105, None), (106, ""), (107, "too short"), (108, "again and again " * 40), (None, prose(70)), (109, prose(4000))]
    return rows


def plain(rows, kept):
    """Of (doc_id, text) rows, what the stages leave, and its digests. ``kept`` says whether the quality rules keep a text."""
    rows = [(i, t) for i, t in rows if not brute_counts(t)[-1] and kept[t]]
    classes = dict((i, c) for i, _, c in brute_components(rows))
    once = {}
    for i, t in rows:
        if i is None or classes[i] == i:
            once.setdefault((i, t) if i is None else i, (i, t))
    rows = [(i, t) for i, t in once.values() if distance(ITEM, decontam.normal(t)) > decontam.budget(len(ITEM), decontam.ERROR_RATE)]
    out = []
    for i, t in rows:
        spans, at, text = [], 0, ""
        for a, k, b in personal(t)[2]:
            if spans and a < spans[-1][2]:
                spans[-1][2] = max(spans[-1][2], b)
            else:
                spans.append([a, k, b])
        for a, k, b in spans:
            text, at = text + t[at:a] + f"[{pii.KINDS[k].upper()}]", b
        text += t[at:]
        ids = LIBRARY.encode_ordinary(text)
        out.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture
def folder(spark, tmp_path):
    rows = made_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.when(F.col("doc_id") % 7 != 0, "en"), "source": F.lit("web"), "n_chars": F.length("text"), "n_words": F.lit("clash"), "kept": F.lit(3), "row": F.lit(1), "h": F.lit("x")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_pipeline_equals_plain_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r.text: r.kept for r in quality.verdicts(docs).join(docs.select("doc_id", "text"), "doc_id").collect()}
    kept |= {r.text: True for r in quality.keep_good(docs).filter("doc_id is null").collect()}
    want = plain([tuple(r) for r in docs.select("doc_id", "text").collect()], kept | {t: False for _, t in made_rows() if t not in kept})
    got = sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=repr)
    assert got == want and len(want) > 25
    left = {r[0] for r in want}
    assert not left & {100, 101, 102, 103, 105, 106, 107, 108} and {3, 2, 104, 109} <= left


def test_stages_keep_columns_and_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() == 0
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == 0


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and sum(n.startswith("op") and n[2].isdigit() for n in names) == 10
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "PII", "byte-level BPE encoding and decoding"]
