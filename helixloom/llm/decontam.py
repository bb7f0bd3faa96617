"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared in lower case with each run of white space as one space. An item of n characters may differ by
e = floor(n * ERROR_RATE) edits. Cut into e + 1 pieces, at least one piece of any such occurrence is unchanged; an
automaton of all pieces finds these in one pass over a document, and Myers' bit-parallel distance verifies the item
around each place once. Items meet documents in blocks of at most ``BLOCK_CHARS`` characters; of several blocks one at a
time is broadcast, and what it finds is written before the next. An item of fewer than 13 characters has no error budget:
it occurs wherever a text holds it, within words too.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import shared

ERROR_RATE = 0.08
#: Of normalised item text in one broadcast.
BLOCK_CHARS = 4_000_000


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def budget(n: int, rate: float) -> int:
    return int(n * rate)


def cuts(n: int, pieces: int) -> list[int]:
    return [n * i // pieces for i in range(pieces + 1)]


class Pattern:
    """An item for Myers' algorithm: bit masks of its characters."""

    def __init__(self, text: str):
        self.n, self.full, self.high = len(text), (1 << len(text)) - 1, 1 << len(text) - 1
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def search(self, text: str) -> tuple[int, int]:
        """The least edit distance to any substring, and where the first such substring ends."""
        up, down, score, best, end = self.full, 0, self.n, self.n, 0
        masks, full, high = self.masks, self.full, self.high
        for at, c in enumerate(text):
            equal = masks.get(c, 0)
            vertical = equal | down
            horizontal = (((equal & up) + up) ^ up) | equal
            plus, minus = down | ~(horizontal | up) & full, up & horizontal
            if plus & high:
                score += 1
            elif minus & high:
                score -= 1
            plus, minus = plus << 1 & full, minus << 1 & full
            up, down = minus | ~(vertical | plus) & full, plus & vertical
            if score < best:
                best, end = score, at + 1
        return best, end


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.rate, self.patterns = rate, {}
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(items):
            edges = cuts(len(text), budget(len(text), rate) + 1)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                places.setdefault(text[a:b], []).append((k, b))
        for piece, where in places.items():
            self.automaton.add_word(piece, where)
        self.automaton.make_automaton()
        self.items = items

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item, distance, end) of each item that occurs within its budget; the best occurrence, the first of equals."""
        regions: dict[int, list[int]] = {}
        for last, where in self.automaton.iter(text):
            for k, b in where:
                regions.setdefault(k, []).append(last + 1 - b)
        out = []
        for k, begins in regions.items():
            item, pattern_text = self.items[k]
            n = len(pattern_text)
            e = budget(n, self.rate)
            if k not in self.patterns:
                self.patterns[k] = Pattern(pattern_text)
            best = (e + 1, 0)
            begins.sort()
            at = 0
            while at < len(begins):  # overlapping places are verified as one
                low = begins[at] - e
                high = begins[at] + n + e
                at += 1
                while at < len(begins) and begins[at] - e <= high:
                    high = begins[at] + n + e
                    at += 1
                distance, end = self.patterns[k].search(text[max(0, low) : high])
                best = min(best, (distance, max(0, low) + end))
            if best[0] <= e:
                out.append((item, *best))
        return out


@lru_cache(maxsize=2)
def _matcher(items: tuple[tuple[int, str], ...], rate: float) -> Matcher:
    return Matcher(list(items), rate)


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS):
    """Items, normalised, block by block; null and empty items match nothing and are left out. Streams from the
    executors a partition at a time, so the driver holds a block and a partition."""
    block, chars = [], 0
    for item_id, text in benchmark.select("item_id", "text").filter("text is not null").toLocalIterator():
        text = normal(text)
        if not text:
            continue
        if block and chars + len(text) > block_chars:
            yield block
            block, chars = [], 0
        block.append((item_id, text))
        chars += len(text)
    if block:
        yield block


def _one_by_one(docs: DataFrame, benchmark: DataFrame, block_chars: int, find) -> DataFrame | None:
    """What ``find(docs, sent)`` returns for each broadcast block of items, together; None without items. The result of a
    lone block is lazy; of several, each is written and its block forgotten before the next is read."""
    spark, every = docs.sparkSession, item_blocks(benchmark, block_chars)
    block, found = next(every, None), None
    while block is not None:
        sent, after = spark.sparkContext.broadcast(tuple(block)), next(every, None)
        part = find(docs, sent)
        if found is not None or after is not None:
            part = shared.written(part, "benchmark-hits")
            sent.unpersist()
        found, block = part if found is None else found.unionByName(part), after
    return found


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance and end (code points of the normalised text) for each item found in each document. Ids
    are of any type, and may be null.

    Null or empty texts have no match. Repeated documents or items each give rows of their own.
    """
    item_kind = benchmark.schema["item_id"].dataType
    arrow_kind = to_arrow_type(item_kind)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {item_kind.simpleString()}, distance long, end long"

    def find(source: DataFrame, sent) -> DataFrame:
        def make(batch: pa.RecordBatch) -> pa.RecordBatch:
            matcher = _matcher(sent.value, rate)
            rows = [(i, *hit) for i, text in enumerate(batch.column(1).to_pylist()) for hit in matcher.find(normal(text))]
            at, item, distance, end = (pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), arrow_kind, pa.int64(), pa.int64())))
            return pa.RecordBatch.from_arrays([batch.column(0).take(at), item, distance, end], ["doc_id", "item_id", "distance", "end"])

        return shared.arrow_map(source, make, schema)

    found = _one_by_one(docs.select("doc_id", shared.text_or_empty().alias("text")), benchmark, block_chars, find)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)


def drop_matching(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents in which no item occurs, with all their columns. Documents with a null or empty text stay, and each
    of repeated rows is judged alone; without items all stay. A benchmark of one block takes a single pass; with several,
    documents are written once under row numbers, and those of the matching ones are joined out."""
    place, blocks = docs.columns.index("text"), item_blocks(benchmark, block_chars)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return docs
    if second is None:
        sent = docs.sparkSession.sparkContext.broadcast(tuple(first))

        def make(batch: pa.RecordBatch) -> pa.RecordBatch:
            matcher = _matcher(sent.value, rate)
            return batch.filter(pa.array([not matcher.find(normal(text)) for text in batch.column(place).to_pylist()], pa.bool_()))

        return shared.arrow_map(docs, make, docs.schema)
    inner = [f"in_{k}" for k in range(len(docs.columns))]
    numbered = shared.written(docs.toDF(*inner).withColumn("row", F.monotonically_increasing_id()), "benchmark-docs")
    hits = matches(numbered.select(F.col("row").alias("doc_id"), F.col(inner[place]).alias("text")), benchmark, rate, block_chars)
    return numbered.join(hits.select(F.col("doc_id").alias("row")).distinct(), "row", "left_anti").select(*inner).toDF(*docs.columns)
