import hashlib
import random

import pytest

from helixloom.llm import substrings


def brute(rows, window):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        if i is not None:
            for k in range(len(w) - window + 1):
                g = tuple(w[k : k + window])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in split:
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < i:
                    gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("bits", [4, 36])
def test_equals_brute_force(spark, seed, bits):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(3 if seed == 2 else 60)]
    passages = [[rnd.choice(words) for _ in range(rnd.randint(8, 60))] for _ in range(8)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rnd.randint(0, 4)):
            p = list(rnd.choice(passages))
            if rnd.random() < 0.4:
                p[rnd.randrange(len(p))] = "edited"
            if rnd.random() < 0.4:
                p = p[rnd.randint(0, 10) : rnd.randint(20, 60)]
            w += p + [rnd.choice(words) for _ in range(rnd.randint(0, 20))]
        rows.append((rnd.randrange(50), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(substrings.digests(docs, window=12, gram=5, bits=bits)) == brute(rows, 12)


def test_sketch_never_counts_too_little():
    """Merged partition sketches of cells estimate two or more wherever two partitions, or one twice, have the cell."""
    import numpy as np
    import pandas as pd

    rnd = np.random.default_rng(2)
    parts = [rnd.integers(0, 500, 300) for _ in range(5)]
    blobs = [substrings._packed([p]).astype("<u4").tobytes() for p in parts]
    got = substrings._merged(pd.DataFrame({"row": [1] * 5, "slice": [3] * 5, "cells": blobs}))
    cell, n = np.unique(np.concatenate(parts), return_counts=True)
    assert sorted(got["cell"] - (3 << substrings.SLICE_BITS)) == sorted(cell[n > 1])


def test_sketch_width_follows_the_input(spark, no_docs):
    docs = spark.range(1000).selectExpr("id doc_id", "repeat('word ', 780) text")
    assert substrings.row_bits(docs) == 18 and substrings.row_bits(no_docs) == 10


def test_edges(spark, edge_docs, no_docs):
    rows = [tuple(r) for r in edge_docs.select("doc_id", "text").collect()]
    rows += [(20, "word " * 60), (21, "other " + "word " * 49), (22, "word " * 49)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(substrings.digests(docs)) == brute(rows, 50)
    kept = {r.doc_id: r.kept for r in substrings.dedup(docs).collect()}
    assert kept[20] == "" and kept[21].startswith("other word")
    assert got(substrings.digests(edge_docs)) == brute(rows[:-3], 50)
    assert substrings.digests(no_docs).count() == 0


def test_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got(substrings.digests(docs)) == brute(rows, 50)
