"""Words and their hashes over whole Arrow batches of text, by numpy.

A word is ``[^\\x20\\x09-\\x0D]+``. UTF-8 bytes of other characters are never in that set, so words are found in
the bytes. Hashes are 64 bits, the same on every machine and in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes worked on at once; a longer document is worked on alone.
CHUNK_BYTES = 2_000_000

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_BASE = _U(0xD1342543DE82EF95)
_BASE_INVERSE = _U(pow(0xD1342543DE82EF95, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finalizer)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)


class Powers:
    """Powers of an odd number modulo 2^64, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.table = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.table) < n:
            size = 1 << max(10, (n - 1).bit_length())
            steps = np.full(size, self.base, np.uint64)
            steps[0] = 1
            self.table = np.cumprod(steps, dtype=np.uint64)
        return self.table[:n]


IN_WORD, UP, DOWN = Powers(_STEP | _U(1)), Powers(_BASE), Powers(_BASE_INVERSE)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Block:
    """Some consecutive documents of a batch. Positions count from the block's start."""

    first: int  # the number in the batch of the first document
    raw: np.ndarray  # bytes
    edges: np.ndarray  # byte offsets of documents, one more than documents
    starts: np.ndarray  # of words, in bytes
    doc: np.ndarray  # the document of each word, counted in the block
    word_edges: np.ndarray  # word offsets of documents

    @property
    def n_docs(self) -> int:
        return len(self.edges) - 1


def blocks(column: pa.Array, lower: bool = False, chunk: int = CHUNK_BYTES) -> Iterator[Block]:
    data, offsets = utf8(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + chunk, "right")) - 1)
        raw = data[offsets[at] : offsets[end]]
        if lower:
            raw = LOWER[raw]
        edges = offsets[at : end + 1] - offsets[at]
        inside = ~SPACE[raw]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        heads = edges[:-1][edges[:-1] < len(raw)]
        begins[heads] = inside[heads]
        starts = np.flatnonzero(begins)
        word_edges = np.searchsorted(starts, edges)
        doc = np.repeat(np.arange(end - at), np.diff(word_edges))
        yield Block(at, raw, edges, starts, doc, word_edges)
        at = end


def word_hashes(block: Block, salt: int = 0) -> np.ndarray:
    """One 64-bit hash a word."""
    if not len(block.starts):
        return np.zeros(0, np.uint64)
    raw, starts = block.raw, block.starts
    length = np.diff(np.append(starts, len(raw)))
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, length)
    code = BYTE_CODE[raw[starts[0] :]]
    code[SPACE[raw[starts[0] :]]] = 0
    code *= IN_WORD.upto(int(length.max()))[place]
    return mix(np.add.reduceat(code, starts - starts[0]) + _U(salt & (1 << 64) - 1))


def word_lengths(block: Block) -> np.ndarray:
    """Bytes of each word."""
    if not len(block.starts):
        return np.zeros(0, np.int64)
    inside = (~SPACE[block.raw[block.starts[0] :]]).astype(np.int64)
    return np.add.reduceat(inside, block.starts - block.starts[0])


class Runs:
    """Hashes of any runs of consecutive words of a block, from running sums."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * UP.upto(n), out=self.sums[1:], dtype=np.uint64)
        self.down = DOWN.upto(n + 1)

    def of(self, start: np.ndarray, size) -> np.ndarray:
        """Equal word sequences have equal hashes, wherever they stand; lengths are part of the hash."""
        raw = (self.sums[start + size] - self.sums[start]) * self.down[start]
        return mix(raw + np.asarray(size).astype(np.uint64) * _STEP)


def shingles(block: Block, hashes: np.ndarray, width: int) -> list[np.ndarray]:
    """Of each document the sorted distinct hashes of its ``width``-word runs; shorter documents have one run."""
    runs, edges, out = Runs(hashes), block.word_edges, []
    n = len(hashes)
    every = runs.of(np.arange(max(0, n - width + 1)), width) if n >= width else np.zeros(0, np.uint64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(every[a : b - width + 1]))
        elif b > a:
            out.append(runs.of(np.array([a]), b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
