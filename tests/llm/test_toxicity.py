import zlib

import numpy as np
import pyarrow as pa

from helixloom.llm import toxicity


def test_held_out_rows_are_scored_well(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    weights = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, weights).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    toxic, clean = [r for r in held if r.toxic == 1], [r for r in held if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)
    worst = toxicity.offending(docs, weights).collect()
    assert worst and all(r.probability >= 0.5 for r in worst)


def test_labels_of_held_out_rows_are_not_learnt(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    assert (toxicity.fit(docs, labels) == toxicity.fit(docs, turned)).all()


def test_sentences_and_noisy_or():
    weights = np.zeros((1 << toxicity.BITS) + 1, np.float32)
    weights[-1] = -4
    text = "A calm line. Such SCUM, here!\nÉté again. scum"
    for block in __import__("helixloom.llm.blocks", fromlist=["x"]).blocks(pa.array(["scum"]), lower=True):
        weights[toxicity._features(block)[0][0][0]] = 7
    found = toxicity.sentences(text, weights)
    raw = text.encode()
    assert [raw[a:b].decode() for a, b, _ in found] == ["Such SCUM, here!", "scum", "A calm line.", "Été again."]
    p = [x[2] for x in found]
    assert abs(toxicity.score_column(pa.array([text, "", None]), weights)[0] - (1 - np.prod(1 - np.array(p)))) < 1e-9
    assert toxicity.score_column(pa.array(["", None]), weights).tolist() == [0, 0]


def test_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (5, 0, None), (None, 1, 1), (7, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.filter("false")):
        rows = toxicity.score(edge_docs, toxicity.fit(edge_docs, some)).collect()
        assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(no_docs, toxicity.fit(no_docs, labels)).count() == 0


def test_whole_texts_count():
    weights = np.zeros((1 << toxicity.BITS) + 1, np.float32)
    weights[-1] = -9
    for block in __import__("helixloom.llm.blocks", fromlist=["x"]).blocks(pa.array(["scum"]), lower=True):
        weights[toxicity._features(block)[0][0][0]] = 14
    assert toxicity.score_column(pa.array(["fine. " * 100 + "scum"]), weights)[0] > 0.9
