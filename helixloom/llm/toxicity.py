"""Toxicity by multiple-instance learning.

A document is a bag of sentences; only its label is known. A sentence's probability is a logistic of the weights of its
distinct words and word beginnings, hashed; a sentence with no learnt feature has none. The document's is the noisy-or of
those of its sentences, so a toxic document needs one toxic sentence, not many plain ones, and the sentences that make
it so can be named. Weights are learnt from at most
``TRAIN_PER_CLASS`` labelled documents of each class, chosen by a hash of the id, in one task of bounded memory; then
every document is scored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, shared

#: Labelled documents of each class that are learnt from, at most.
TRAIN_PER_CLASS = 3000
BITS = 20
#: Bytes of word beginnings that are features beside the whole word.
BEGINNINGS = (4, 5)
#: A feature is learnt if the likelihood-ratio statistic of its documents' labels is this or more, whatever their number:
#: copies of a few toxic documents share all their rare words, and these tell nothing of others.
LEAST_EVIDENCE = 25.0
EPOCHS = 300
RATE = 0.1
#: Of the squared weights in the loss, whose documents weigh 1 in all.
DECAY = 1e-5
#: The bias begins here and is drawn back by BIAS_PULL. Plain sentences don't count, so it needn't be so low that a
#: toxic word that stands alone in its sentence can't make up for it.
BIAS = -4.0
BIAS_PULL = 0.05
THRESHOLD = 0.7

_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?\n")] = True


def _features(block: blocks.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word: its features (a column each), its sentence in the block, and of each sentence the document.

    A sentence ends with a word whose last byte ends one, at a newline and with the document.
    """
    n = len(block.starts)
    if not n:
        return np.zeros((0, 1 + len(BEGINNINGS)), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = blocks.word_lengths(block)
    # punctuation at a word's edges isn't part of it
    plain = block.raw.copy()
    letters = (plain >= 128) | ((plain >= 97) & (plain <= 122)) | ((plain >= 48) & (plain <= 57)) | blocks.SPACE[plain]
    plain[~letters] = 39
    stem = np.add.reduceat((letters & ~blocks.SPACE[block.raw])[block.starts[0] :].astype(np.int64), block.starts - block.starts[0])
    code = blocks.BYTE_CODE[block.raw[block.starts[0] :]]
    code[~letters[block.starts[0] :] | blocks.SPACE[block.raw[block.starts[0] :]]] = 0
    gaps = np.diff(np.append(block.starts, len(block.raw)))
    kept = (code != 0).astype(np.int64)
    running = np.cumsum(kept) - kept
    offset = block.starts - block.starts[0]
    place = running - np.repeat(running[offset], gaps)  # among the letters of the word
    code *= blocks.IN_WORD.upto(int(place.max()) + 1)[place]
    columns = [np.add.reduceat(code, offset)]
    for k in BEGINNINGS:
        first = np.where(place < k, code, np.uint64(0))
        columns.append(np.where(stem > k, np.add.reduceat(first, offset) + np.uint64(k), np.uint64(0)))
    features = np.stack([np.where(c == 0, np.uint64(0), blocks.mix(c) >> np.uint64(64 - BITS)) for c in columns], 1).astype(np.int64)
    last = block.raw[block.starts + size - 1]
    newline = np.add.reduceat((block.raw[block.starts[0] :] == 10).astype(np.int64), offset) > 0
    ends = _ENDS[last] | newline
    begins = np.ones(n, bool)
    begins[1:] = ends[:-1] | (block.doc[1:] != block.doc[:-1])
    return features, np.cumsum(begins) - 1, block.doc[np.flatnonzero(begins)]


def _noisy_or(logits: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """log of the probability that no sentence is toxic, by document."""
    return np.bincount(doc, -np.logaddexp(0, logits), n_docs)


def _logits(pairs: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Of n sentences, from their distinct (sentence, feature) codes; minus infinity where no feature is learnt."""
    at, w = pairs >> BITS, weights[pairs & (1 << BITS) - 1]
    known = np.bincount(at, w != 0, n) > 0
    return np.where(known, np.bincount(at, w, n) + weights[-1], -np.inf)


def _telling(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    """Whether each feature is commoner in toxic documents than chance explains, by a likelihood-ratio test."""
    n = toxic + clean
    share = n_toxic / max(1.0, n_toxic + n_clean)

    def term(k, p):
        return k * np.log(np.maximum(k, 1e-12) / np.maximum(n * p, 1e-12))

    return (2 * (term(toxic, share) + term(clean, 1 - share)) >= LEAST_EVIDENCE) & (toxic > n * share)


def train(texts: list[str], labels: np.ndarray) -> np.ndarray:
    """Weights by gradient descent with momentum and a step size a weight; the last entry is the bias."""
    f, s, d, at_s, at_d = [], [], [], 0, 0
    for block in blocks.blocks(pa.array(texts, pa.large_string()), lower=True):
        features, sentence, doc = _features(block)
        pairs = np.unique(np.stack([np.repeat(sentence, features.shape[1]), features.ravel()], 1), axis=0)
        pairs = pairs[pairs[:, 1] > 0]  # 0 is no feature
        s.append(pairs[:, 0] + at_s)
        f.append(pairs[:, 1])
        d.append(doc + at_d)
        at_s, at_d = at_s + len(doc), at_d + block.n_docs
    weights = np.zeros((1 << BITS) + 1, np.float32)
    weights[-1] = BIAS
    if not at_s:
        return weights
    f, s, d = np.concatenate(f), np.concatenate(s), np.concatenate(d)
    y = labels[:at_d].astype(float)
    held = np.unique(np.stack([f, d[s]], 1), axis=0)  # each feature once a document that has it
    used, which = np.unique(held[:, 0], return_inverse=True)
    toxic = np.bincount(which, y[held[:, 1]], len(used))
    clean = np.bincount(which, 1 - y[held[:, 1]], len(used))
    used = used[_telling(toxic, clean, y.sum(), (1 - y).sum())]
    at = np.searchsorted(used, f)
    known = at < len(used)
    known[known] = used[at[known]] == f[known]
    f, s = at[known], s[known]
    # sentences without a learnt feature are of probability 0, and out of the sums
    with_one, s = np.unique(s, return_inverse=True)
    d = d[with_one]
    w, bias = np.zeros(len(used)), BIAS
    step, step_bias = [np.zeros(len(used)), np.zeros(len(used))], [0.0, 0.0]
    balance = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    for epoch in range(1, EPOCHS + 1):
        logits = np.bincount(s, w[f], len(d)) + bias
        none = np.minimum(_noisy_or(logits, d, len(y)), -1e-12)
        # the loss is minus the log-likelihood; by a sentence's logit it slopes as the sentence's probability times
        # 1 for a clean document, and times minus the odds that no sentence is toxic for a toxic one
        pull = balance * np.where(y == 1, np.exp(none) / np.expm1(none), 1.0)
        slope = pull[d] / (1 + np.exp(-logits))
        g = np.bincount(f, slope[s], len(used)) + DECAY * w
        g_bias = slope.sum() + BIAS_PULL * (bias - BIAS)
        for moments, x in ((step, g), (step_bias, g_bias)):
            moments[0] = 0.9 * moments[0] + 0.1 * x
            moments[1] = 0.99 * moments[1] + 0.01 * x * x
        scale = RATE * np.sqrt(1 - 0.99**epoch) / (1 - 0.9**epoch)
        w -= scale * step[0] / (np.sqrt(step[1]) + 1e-9)
        bias -= scale * step_bias[0] / (np.sqrt(step_bias[1]) + 1e-9)
    weights[used] = w
    weights[-1] = bias
    weights[0] = 0
    return weights


def score_column(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    """The probability of each text of a column; an empty text has no sentence and scores 0."""
    out = [np.zeros(0)]
    for block in blocks.blocks(column, lower=True):
        features, sentence, doc = _features(block)
        # few features are learnt: only these are made distinct within their sentences
        word, column = np.nonzero((features > 0) & (weights[features] != 0))
        pairs = np.unique(sentence[word] * (1 << BITS) + features[word, column])
        logits = _logits(pairs, weights, len(doc))
        out.append(-np.expm1(_noisy_or(logits, doc, block.n_docs)))
    return np.clip(np.concatenate(out), 0.0, 1.0)


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights from labelled rows that aren't held out. Of repeated labels of an id the greatest counts; rows without
    label or id are left out; without any rows the bias alone is left."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(~F.coalesce(held_out(), F.lit(True))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for value in (0, 1):
        part = known.filter(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_PER_CLASS)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select("doc_id", shared.text_or_empty().alias("text")).filter(F.length("text") > 0)
    sample = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")  # 2 * TRAIN_PER_CLASS ids at most

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("doc_id").sort_values("doc_id")
        weights = train(rows["text"].tolist(), rows["toxic"].to_numpy())
        used = np.flatnonzero(weights)
        return pd.DataFrame({"at": [used.astype("<i4").tobytes()], "weight": [weights[used].astype("<f4").tobytes()]})

    weights = np.zeros((1 << BITS) + 1, np.float32)
    weights[-1] = BIAS
    for at, values in sample.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(learn, "at binary, weight binary").collect():
        weights[np.frombuffer(at, "<i4")] = np.frombuffer(values, "<f4")
    return weights


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, held_out, score and predicted of every row. A null text counts as empty; the score of a text doesn't
    depend on its row, so repeated rows score alike. A null id counts as not held out. An empty table gives no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_column(batch.column(1), sent.value), pa.float64())], ["doc_id", "score"])

    scored = shared.arrow_map(docs.select("doc_id", shared.text_or_empty().alias("text")), make, f"doc_id {kind}, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def sentences(text: str | None, weights: np.ndarray) -> list[tuple[int, int, float]]:
    """Start and end (bytes of the UTF-8 text) and probability of each sentence, the worst first."""
    out = []
    for block in blocks.blocks(pa.array([text or ""]), lower=True):
        features, sentence, doc = _features(block)
        pairs = np.unique((sentence[:, None] * (1 << BITS) + features)[features > 0])
        logits = _logits(pairs, weights, len(doc))
        ends = block.starts + blocks.word_lengths(block)
        for k, z in enumerate(logits):
            words = np.flatnonzero(sentence == k)
            out.append((int(block.starts[words[0]]), int(ends[words[-1]]), float(1 / (1 + np.exp(-z)))))
    return sorted(out, key=lambda x: (-x[2], x[0]))


def offending(docs: DataFrame, weights: np.ndarray, least: float = 0.5) -> DataFrame:
    """doc_id, sentence and probability of every sentence of at least that probability."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for k, text in enumerate(batch.column(1).to_pylist()):
            raw = text.encode()
            rows += [(k, raw[a:b].decode(), p) for a, b, p in sentences(text, sent.value) if p >= least]
        take = pa.array([r[0] for r in rows], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())], ["doc_id", "sentence", "probability"])

    return shared.arrow_map(docs.select("doc_id", shared.text_or_empty().alias("text")), make, f"doc_id {kind}, sentence string, probability double")
