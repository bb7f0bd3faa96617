import numpy as np
import pyarrow as pa

from helixloom.llm import blocks, toxicity


def weights(bias=-7.0):
    w = np.zeros((1 << toxicity.BITS) + 1, np.float32)
    w[-1] = bias
    for block in blocks.blocks(pa.array(["scum"]), lower=True):
        w[toxicity._features(block)[0][0][0]] = 14
    return w


def test_length_alone_is_not_toxic():
    plain = "A calm line.\n" * 20_000
    assert toxicity.score_column(pa.array([plain, plain + "scum"]), weights())[0] == 0
    assert toxicity.score_column(pa.array([plain + "scum"]), weights())[0] > 0.9


def test_long_labelled_texts_are_learnt_from(spark):
    """All toxic texts are long; without them nothing is learnt."""
    rows = [(k, ("A calm line of words. " * 1200) + "You are scum." if k % 2 else f"A calm line of words {k}.") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert got == {k: k % 2 for k in range(300)}
