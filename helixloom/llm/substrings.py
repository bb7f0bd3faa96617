"""Substring dedup: windows of 50 consecutive words that also start in a document with a smaller doc_id go.

Windows are found by anchors: of the 26 runs of 25 words in a window, the leftmost of least hash. Equal windows have
equal anchors, so an anchor's count is never less than a window's; a document has one anchor for about 13 windows.

1. Count-min prefilter. A sketch has ``DEPTH`` rows of cells, ``CELLS`` or more to each anchor that the input's bytes let
   expect, so that it fills alike at every size. Each partition sketches its anchors, a count of documents a cell, where
   two stands for two or more; the partition sketches travel in slices of 2^``SLICE_BITS`` cells and merge slice by slice,
   so no task holds more than a slice. A window's count is estimated as the least of its anchor's cells; no estimate is
   too small.
2. Second pass. Anchors estimated in two documents or more stay, with the stretch of words that their windows cover.
   Stretches of one hash are equal, windows and all: but for the least document, they go entirely. Of anchors with
   several different stretches, the least document's of each meet window by window. Both groupings are exact: keys are
   pairs of 64-bit hashes of words.
3. The stretches to remove are joined to the texts, and the words that no stretch covers are kept.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, shared

WINDOW = 50
GRAM = 25
DEPTH = 2
#: Cells of a row for each expected anchor; text has about one in ANCHOR_BYTES.
CELLS, ANCHOR_BYTES = 4, 78
SLICE_BITS = 20
#: Cells that a partition holds before it sends them on.
HELD = 1 << 22
#: Bits for the place of a word in a block: a row of Arrow text has less than 2^31 bytes, so fewer words than 2^30.
PLACE_BITS = 30
_U = np.uint64
_SALTS = (_U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB))


def _anchors(block: blocks.Block, window: int, gram: int):
    """For each stretch: document, anchor place, first and last window start, anchor hash, stretch hash."""
    hashes = blocks.word_hashes(block)
    n = len(hashes) - window + 1
    if n <= 0:
        return None
    runs = blocks.Runs(hashes)
    grams = runs.of(np.arange(len(hashes) - gram + 1), gram)
    # the low bits hold the place, so the least is the leftmost of equals; how many must not depend on the block, or
    # copies of a window in blocks of different size could have different anchors
    low = _U((1 << PLACE_BITS) - 1)
    key = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    reach, have = window - gram + 1, 1
    least = key
    while have < reach:
        step = min(have, reach - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    anchor = (least[:n] & low).astype(np.int64)
    doc = block.doc
    starts = np.flatnonzero(doc[:n] == doc[window - 1 : window - 1 + n])
    if not len(starts):
        return None
    anchor = anchor[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    heads = np.flatnonzero(new)
    first, last = starts[heads], starts[np.append(heads[1:], len(starts)) - 1]
    at = anchor[heads]
    stretch = blocks.mix(runs.of(first, last - first + window) + (at - first).astype(np.uint64) * _SALTS[0])
    return doc[first], at, first, last, grams[at], stretch


def cells(anchor_hash: np.ndarray, depth: int, bits: int) -> list[np.ndarray]:
    return [(blocks.mix(anchor_hash ^ (_SALTS[k % 2] + _U(k))) >> _U(64 - bits)).view(np.int64) for k in range(depth)]


def row_bits(docs: DataFrame) -> int:
    """log2 of the cells of a row, by the bytes of the texts."""
    n = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(10, math.ceil(math.log2(CELLS * n / ANCHOR_BYTES + 1)))


def _packed(parts: list[np.ndarray]) -> np.ndarray:
    """The cells of several sketches as one: sorted, those of two or more documents twice."""
    cell, n = np.unique(np.concatenate(parts), return_counts=True)
    return np.repeat(cell, np.minimum(n, 2))


def _merged(parts: pd.DataFrame) -> pd.DataFrame:
    """Of one slice the cells of two documents or more."""
    cell = _packed([np.frombuffer(x, "<u4") for x in parts["cells"]])
    often = cell[1:][cell[1:] == cell[:-1]].astype(np.int64) + (int(parts["slice"].iloc[0]) << SLICE_BITS)
    return pd.DataFrame({"row": np.full(len(often), parts["row"].iloc[0], np.int8), "cell": often})


def sketch(docs: DataFrame, window: int, gram: int, depth: int, bits: int) -> DataFrame:
    """row, cell of the merged sketch with a count of two documents or more."""
    low = (1 << SLICE_BITS) - 1

    def send(held: list[list[np.ndarray]]):
        for row, parts in enumerate(held):
            if not parts:
                continue
            cell = _packed(parts)
            edges = np.flatnonzero(np.append(True, (cell[1:] >> SLICE_BITS) != (cell[:-1] >> SLICE_BITS)))
            blobs = [x.astype("<u4").tobytes() for x in np.split(cell & low, edges[1:])]
            slices = cell[edges] >> SLICE_BITS
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(edges), row, np.int8)), pa.array(slices), pa.array(blobs, pa.binary())], ["row", "slice", "cells"])

    def run(batches):
        held, n = [[] for _ in range(depth)], 0
        for batch in batches:
            for block in blocks.blocks(batch.column(2)):
                found = _anchors(block, window, gram)
                if found is None:
                    continue
                doc, hashes = found[0], found[4]
                order = np.lexsort((hashes, doc))
                doc, hashes = doc[order], hashes[order]
                once = np.ones(len(doc), bool)
                once[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
                for row, cell in enumerate(cells(hashes[once], depth, bits)):
                    held[row].append(_packed([cell]))
                    n += len(held[row][-1])
                if n > HELD:
                    yield from send(held)
                    held, n = [[] for _ in range(depth)], 0
        yield from send(held)

    return docs.mapInArrow(run, "row byte, slice long, cells binary").groupBy("row", "slice").applyInPandas(_merged, "row byte, cell long")


def stretches(docs: DataFrame, window: int, gram: int, depth: int, bits: int) -> DataFrame:
    """Of every stretch its document, hashes, anchor place in it, word places, and the cells of its anchor."""

    def make(batch: pa.RecordBatch):
        ids, tags = batch.column(0), batch.column(1)
        for block in blocks.blocks(batch.column(2)):
            found = _anchors(block, window, gram)
            if found is None:
                continue
            doc, at, first, last, hashes, stretch = found
            base = block.word_edges[doc]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(doc + block.first)),
                    tags.take(pa.array(doc + block.first)),
                    pa.array(hashes.view(np.int64)),
                    pa.array(stretch.view(np.int64)),
                    pa.array((at - first).astype(np.int32)),
                    pa.array((first - base).astype(np.int32)),
                    pa.array((last - base).astype(np.int32)),
                    *(pa.array(c) for c in cells(hashes, depth, bits)),
                ],
                ["doc_id", "tag", "anchor", "stretch", "offset", "first", "last", *(f"c{k}" for k in range(depth))],
            )

    names = ", ".join(f"c{k} long" for k in range(depth))
    return shared.arrow_map(docs, make, f"doc_id long, tag int, anchor long, stretch long, offset int, first int, last int, {names}")


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """doc_id, anchor, place of the anchor in the window, hash and start of each window of the given stretches.
    ``texts`` has doc_id, tag, text and spans, an array of (anchor, offset, first, last)."""

    def make(batch: pa.RecordBatch):
        ids, tags, spans = batch.column(0), batch.column(1), batch.column(3).to_pylist()
        for block in blocks.blocks(batch.column(2)):
            hashes = blocks.word_hashes(block)
            runs = blocks.Runs(hashes)
            of, anchor, place, start = [], [], [], []
            for k in range(block.n_docs):
                for s in spans[block.first + k]:
                    n = s["last"] - s["first"] + 1
                    starts = np.arange(s["first"], s["last"] + 1)
                    of.append(np.full(n, block.first + k))
                    anchor.append(np.full(n, s["anchor"], np.int64))
                    place.append((s["first"] + s["offset"] - starts).astype(np.int32))
                    start.append(starts)
            if not of:
                continue
            of, start = np.concatenate(of), np.concatenate(start)
            h = runs.of(start + block.word_edges[of - block.first], window)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(of)), tags.take(pa.array(of)), pa.array(np.concatenate(anchor)), pa.array(np.concatenate(place)), pa.array(h.view(np.int64)), pa.array(start.astype(np.int32))],
                ["doc_id", "tag", "anchor", "place", "h", "start"],
            )

    return shared.arrow_map(texts, make, "doc_id long, tag int, anchor long, place int, h long, start int")


def removed_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, depth: int = DEPTH, bits: int | None = None) -> DataFrame:
    """doc_id, tag, low, high: word places [low, high) to remove; they may overlap. ``docs`` has doc_id, tag (a hash of
    the text, which tells texts of one doc_id apart) and text."""
    known = docs.filter("doc_id is not null")
    tables, bits = shared.Tables(docs.sparkSession), bits or row_bits(known)
    often = tables.write("window-sketch", sketch(known, window, gram, depth, bits))
    found = stretches(known, window, gram, depth, bits)
    for k in range(depth):
        found = found.join(often.filter(F.col("row") == k).select(F.col("cell").alias(f"c{k}")), f"c{k}", "left_semi")
    found = tables.write("window-stretches", found.drop(*[f"c{k}" for k in range(depth)]))
    tables.drop("window-sketch")

    # groups are written before their rows are joined to them: both sides then stand behind a shuffle of their own, and
    # Spark splits the share of a stretch or window that many documents hold
    least = found.groupBy("anchor", "stretch").agg(F.min("doc_id").alias("least"))
    least = tables.write("window-least", least)
    whole = found.join(least, ["anchor", "stretch"]).filter("doc_id > least")
    whole = whole.select("doc_id", "tag", F.col("first").alias("low"), (F.col("last") + window).alias("high"))

    several = least.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    # the least document of a stretch may hold it more than once; each place counts
    kinds = least.join(several, "anchor").select("anchor", "stretch", F.col("least").alias("doc_id"))
    ours = found.join(kinds, ["anchor", "stretch", "doc_id"])
    spans = ours.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("anchor", "offset", "first", "last")).alias("spans"))
    windows = tables.write("windows", _windows(docs.join(spans, ["doc_id", "tag"]).select("doc_id", "tag", "text", "spans"), window))
    lowest = windows.groupBy("anchor", "place", "h").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("top")).filter("least < top")
    lowest = tables.write("window-lowest", lowest.drop("top"))
    single = windows.join(lowest, ["anchor", "place", "h"]).filter("doc_id > least").select("doc_id", "tag", F.col("start").alias("low"), (F.col("start") + window).alias("high"))
    spans = shared.written(whole.union(single), "window-spans")
    tables.drop(*tables.paths)
    return spans


def _kept(spans, n: int) -> np.ndarray:
    depth = np.zeros(n + 1, np.int64)
    for s in spans or ():
        depth[s["low"]] += 1
        depth[min(s["high"], n)] -= 1
    return np.cumsum(depth[:-1]) == 0


def _with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Adds ``spans``: those of a document that touch are made one, so that its list has a row a passage."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id", "tag").orderBy("low", "high")
    reach = spans.withColumn("before", F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    run = reach.withColumn("run", F.sum(F.when(F.col("low") <= F.col("before"), 0).otherwise(1)).over(order))
    merged = run.groupBy("doc_id", "tag", "run").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return docs.join(merged.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("low", "high")).alias("spans")), ["doc_id", "tag"], "left")


def dedup(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed and ``kept``, the kept words joined by one space.

    A null text has no words; a null doc_id is compared with nothing; rows of one doc_id remove nothing from each other.
    An empty table gives no rows.
    """
    return _result(docs, False, options)


def digests(docs: DataFrame, **options) -> DataFrame:
    """As ``dedup``, with kept_sha256 in place of the words, made where the words are."""
    return _result(docs, True, options)


def _result(docs: DataFrame, digest: bool, options: dict) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash(shared.text_or_empty()).alias("tag"), shared.text_or_empty().alias("text"))
    spans = removed_spans(docs, **options)
    last = "kept_sha256" if digest else "kept"

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        total, removed, out = [], [], []
        for text, found in zip(batch.column(1), batch.column(2), strict=True):
            words = text.as_py().encode().split()
            if found.is_valid:
                keep = _kept(found.as_py(), len(words))
                left = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
            else:
                left = words
            total.append(len(words))
            removed.append(len(words) - len(left))
            data = b" ".join(left)
            out.append(hashlib.sha256(data).hexdigest() if digest else data.decode())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())], ["doc_id", "n_words", "n_removed", last])

    return shared.arrow_map(_with_spans(docs, spans).select("doc_id", "text", "spans"), make, f"doc_id long, n_words long, n_removed long, {last} string")
