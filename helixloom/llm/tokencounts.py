"""Token counts by offset-mapped attribution.

A whole document is encoded once. Token spans, in code points, meet the spans of its sections (or fields) in an
interval join; a token that crosses a boundary goes, by rule ``share``, to the section that holds most of its
characters (the earlier of equals), or, by rule ``start``, to the one that holds its first character. So the counts
of sections add up to the document's.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

RULES = ("share", "start")


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        size[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size


def token_spans(text: str, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of tokens in code points. A character split between tokens is in the span of each."""
    encoding, size = _encoding(path, pattern)
    ids = np.array(encoding.encode_ordinary(text), np.int64)
    ends = np.cumsum(size[ids])
    starts = ends - size[ids]
    raw = np.frombuffer(text.encode(), np.uint8)
    if len(raw) == len(text):
        return starts, ends
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    return char[starts], char[ends - 1] + 1


def line_edges(text: str) -> np.ndarray:
    """Edges of the sections that lines make; a newline belongs to the line that it ends."""
    edges, at = [0], text.find("\n")
    while at >= 0:
        edges.append(at + 1)
        at = text.find("\n", at + 1)
    if edges[-1] < len(text):
        edges.append(len(text))
    return np.array(edges, np.int64)


def attribute(starts: np.ndarray, ends: np.ndarray, edges: np.ndarray, rule: str = "share") -> tuple[np.ndarray, int]:
    """Tokens of each section between ``edges``, and how many tokens cross a boundary."""
    n = len(edges) - 1
    if n < 1 or not len(starts):
        return np.zeros(max(n, 0), np.int64), 0
    first = np.searchsorted(edges, starts, "right") - 1
    last = np.searchsorted(edges, ends, "left") - 1
    to = first.copy()
    crossing = np.flatnonzero(last > first)
    if rule == "share":
        for k in crossing.tolist():
            sections = np.arange(first[k], last[k] + 1)
            shares = np.minimum(ends[k], edges[sections + 1]) - np.maximum(starts[k], edges[sections])
            to[k] = sections[np.argmax(shares)]
    return np.bincount(to, minlength=n), len(crossing)


def count_sections(docs: DataFrame, path: str, pattern: str, rule: str = "share") -> DataFrame:
    """Per document: doc_id, n_tokens, n_sections, n_crossing and section_tokens, an array with a count a line.

    A null or empty text has no sections and no tokens. Repeated rows give repeated rows; an empty table gives none.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens, crossing, sections = [], [], []
        for text in batch.column(1).to_pylist():
            starts, ends = token_spans(text, path, pattern)
            counts, n = attribute(starts, ends, line_edges(text), rule)
            tokens.append(len(starts))
            crossing.append(n)
            sections.append(counts)
        lists = pa.array([c.tolist() for c in sections], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(tokens, pa.int64()), pa.array([len(c) for c in sections], pa.int64()), pa.array(crossing, pa.int64()), lists],
            ["doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens"],
        )

    source = docs.select("doc_id", shared.text_or_empty().alias("text"))
    return shared.arrow_map(source, make, f"doc_id {kind}, n_tokens long, n_sections long, n_crossing long, section_tokens array<long>")


def count_fields(rows: DataFrame, id_column: str, fields: list[str], path: str, pattern: str, joint: str = "\n", rule: str = "share") -> DataFrame:
    """Per row its id, n_tokens of the fields joined by ``joint``, and ``tokens`` of each field (a joint belongs to the
    field before it). A null field counts as empty. Repeated rows give repeated rows; an empty table gives none."""
    kind = rows.schema[id_column].dataType.simpleString()
    source = rows.select(F.col(id_column).alias("id"), *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"f{i}") for i, f in enumerate(fields)])

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        totals, lists = [], []
        for parts in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            text = joint.join(parts)
            edges = np.cumsum([0, *(len(p) + len(joint) for p in parts)])
            edges[-1] = len(text)
            starts, ends = token_spans(text, path, pattern)
            # searchsorted finds a token in an empty field's place only if edges differ; equal edges get no tokens
            distinct, where = np.unique(edges, return_index=True)
            counts, _ = attribute(starts, ends, distinct, rule)
            out = np.zeros(len(parts), np.int64)
            out[np.append(where[1:], len(edges))[: len(counts)] - 1] = counts
            totals.append(len(starts))
            lists.append(out.tolist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["id", "n_tokens", "tokens"])

    return shared.arrow_map(source, make, f"id {kind}, n_tokens long, tokens array<long>").withColumnRenamed("id", id_column)
