"""Byte-level BPE with a segment tree.

The pattern splits a text into pieces. A piece that is a token is done; otherwise its bytes are the leaves of a
segment tree. A leaf holds the rank of the pair that begins there, with its position in the low bits, so the root is
the leftmost of the least ranks. A merge gives its left leaf the merged token, takes the right one out, and updates
the leaves of the merged token and its live left neighbour: a logarithmic number of nodes each.

Short pieces of a batch go through their trees side by side, as rows of one array; longer ones through a tree of
their own. Each worker keeps the pieces met last, ``CACHE_PIECES`` at most: memory is bounded, results are the same.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

CACHE_PIECES = 300_000
#: Pieces longer than this have a tree of their own.
ROW_BYTES = 32
ROWS_AT_ONCE = 8192
NONE = np.int64(1) << np.int64(40)
#: Fixed value: the pattern of the public byte-level vocabularies, for which texts may be cut before spaces.
SPACE_LED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Vocabulary:
    """Ranks of byte strings, and what each pair of tokens merges to."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.size = max(ranks.values()) + 1
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left * self.size + right] = rank
        # an open-addressing table of the pairs, for looking up many at once
        self.bits = max(4, (4 * len(self.pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int64)
        self.probes = 1
        for key, rank in self.pairs.items():
            slot, tries = self._slot(key), 1
            while self.keys[slot] >= 0:
                slot, tries = (slot + 1) & (1 << self.bits) - 1, tries + 1
            self.keys[slot], self.values[slot], self.probes = key, rank, max(self.probes, tries)

    def _slot(self, key: int) -> int:
        return ((key * 0x9E3779B97F4A7C15) & (1 << 64) - 1) >> (64 - self.bits)

    def rank_of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair merges to, NONE where it doesn't; a negative token is none."""
        key = left * self.size + right
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(key), NONE, np.int64)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            at, want = slot[open_], key[open_]
            found = self.keys[at]
            hit = found == want
            out[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (found >= 0)]
            slot[open_] = (slot[open_] + 1) & (1 << self.bits) - 1
        return out


@lru_cache(maxsize=4)
def load_vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


def merge_piece(piece: bytes, v: Vocabulary) -> list[int]:
    """One piece through a segment tree of its own."""
    n = len(piece)
    if n == 1:
        return [int(v.single[piece[0]])]
    size = 1 << (n - 1).bit_length()
    shift = size.bit_length()
    top = int(NONE) << shift
    token = v.single[np.frombuffer(piece, np.uint8)]
    ranks = v.rank_of_pairs(token[:-1], token[1:])
    level = np.full(size, top, np.int64) if top < 1 << 62 else np.full(size, 1 << 62, np.int64)
    top = int(level[0])
    known = ranks < NONE
    level[: n - 1][known] = (ranks[known] << shift) | np.flatnonzero(known)
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
    tree = np.concatenate([[top], *levels[::-1]]).tolist()
    token, pairs, step, mask = token.tolist(), v.pairs, v.size, (1 << shift) - 1
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(leaf: int, value: int) -> None:
        at = size + leaf
        tree[at] = value
        at >>= 1
        while at:
            a, b = tree[2 * at], tree[2 * at + 1]
            tree[at] = a if a < b else b
            at >>= 1

    while tree[1] < top:
        left = tree[1] & mask
        right = after[left]
        token[left] = tree[1] >> shift
        token[right] = -1
        beyond = after[left] = after[right]
        put(right, top)
        if beyond < n:
            before[beyond] = left
            r = pairs.get(token[left] * step + token[beyond])
            put(left, top if r is None else r << shift | left)
        else:
            put(left, top)
        if (ahead := before[left]) >= 0:
            r = pairs.get(token[ahead] * step + token[left])
            put(ahead, top if r is None else r << shift | ahead)
    return [t for t in token if t >= 0]


def merge_rows(pieces: list[bytes], v: Vocabulary) -> list[bytes]:
    """Pieces of at most ``ROW_BYTES`` bytes, a row of trees for each length class; ids as unsigned 32-bit numbers."""
    out = [b""] * len(pieces)
    length = np.array([len(p) for p in pieces])
    width = 2
    while width <= ROW_BYTES:
        mine = np.flatnonzero((length <= width) & (length > (width >> 1 if width > 2 else 0)))
        for at in range(0, len(mine), ROWS_AT_ONCE):
            rows = mine[at : at + ROWS_AT_ONCE]
            for k, ids in zip(rows.tolist(), _rows([pieces[i] for i in rows.tolist()], width, v), strict=True):
                out[k] = ids
        width *= 2
    return out


def _rows(pieces: list[bytes], width: int, v: Vocabulary) -> list[bytes]:
    n, shift = len(pieces), 6
    top = NONE << shift
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
    length = np.array([len(p) for p in pieces])
    place = np.arange(width)
    token = np.where(place < length[:, None], v.single[raw], -1)
    after = np.broadcast_to(place + 1, (n, width)).copy()
    before = np.broadcast_to(place - 1, (n, width)).copy()
    tree = np.full((n, 2 * width), top, np.int64)
    ranks = v.rank_of_pairs(token[:, :-1].ravel(), token[:, 1:].ravel()).reshape(n, width - 1)
    tree[:, width : 2 * width - 1] = np.where(ranks < NONE, ranks << shift | place[:-1], top)
    for at in range(width - 1, 0, -1):
        tree[:, at] = np.minimum(tree[:, 2 * at], tree[:, 2 * at + 1])

    def put(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        at = leaf + width
        tree[rows, at] = value
        at = at >> 1
        for _ in range(width.bit_length() - 1):
            tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])
            at = at >> 1

    live = np.flatnonzero(tree[:, 1] < top)
    while len(live):
        root = tree[live, 1]
        left = root & 63
        right = after[live, left]
        merged = root >> shift
        token[live, left] = merged
        token[live, right] = -1
        beyond = after[live, right]
        after[live, left] = beyond
        put(live, right, np.full(len(live), top))
        inside = beyond < length[live]
        before[live[inside], beyond[inside]] = left[inside]
        following = np.where(inside, token[live, np.minimum(beyond, width - 1)], -1)
        rank = v.rank_of_pairs(merged, following)
        put(live, left, np.where(rank < NONE, rank << shift | left, top))
        ahead = before[live, left]
        has = ahead >= 0
        rows, where = live[has], ahead[has]
        rank = v.rank_of_pairs(token[rows, where], merged[has])
        put(rows, where, np.where(rank < NONE, rank << shift | where, top))
        live = live[tree[live, 1] < top]
    kept = token >= 0
    flat, ends = token[kept].astype(np.uint32).tobytes(), np.cumsum(4 * kept.sum(1)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, np.uint32).tobytes()


#: Where white space adjoins a space, what stands between spaces isn't split apart from its neighbours.
TOUCHING = re.compile(r"\s | \s")


class Encoder:
    """Encodes texts; keeps what it has learnt of pieces, and of the stretches between single spaces.

    In the pattern a space before a non-space begins a piece. So, where no other white space adjoins a space, a text
    can be cut before each space, and what follows is split and encoded alike wherever it stands.
    """

    def __init__(self, vocabulary_path: str, pattern: str, cache_pieces: int = CACHE_PIECES):
        import regex

        self.v, self.split, self.limit = load_vocabulary(vocabulary_path), regex.compile(pattern).findall, cache_pieces
        self.cut_at_spaces = pattern == SPACE_LED
        self.pieces: dict[str, bytes] = {}
        self.stretches: dict[str, bytes] = {}

    def _room(self, known: dict, wanted: set[str]) -> list[str]:
        new = [x for x in wanted if x not in known]
        if len(known) + len(new) > self.limit:
            known.clear()
            new = list(wanted)
        return new

    def _learn_pieces(self, wanted: set[str]) -> None:
        short, long = [], []
        for piece in self._room(self.pieces, wanted):
            data = piece.encode()
            if (rank := self.v.ranks.get(data)) is not None:
                self.pieces[piece] = _packed([rank])
            else:
                (short if len(data) <= ROW_BYTES else long).append((piece, data))
        for (piece, _), ids in zip(short, merge_rows([d for _, d in short], self.v), strict=True):
            self.pieces[piece] = ids
        for piece, data in long:
            self.pieces[piece] = _packed(merge_piece(data, self.v))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit numbers."""
        out: list = [None] * len(texts)
        plain = [k for k, t in enumerate(texts) if not self.cut_at_spaces or TOUCHING.search(t)]
        if plain:
            pieces = [self.split(texts[k]) for k in plain]
            self._learn_pieces(set().union(*pieces))
            for k, of in zip(plain, pieces, strict=True):
                out[k] = np.frombuffer(b"".join(map(self.pieces.__getitem__, of)), np.uint32)
        spaced = [k for k in range(len(texts)) if out[k] is None]
        if spaced:
            heads, tails = [], []
            for k in spaced:
                head, *tail = texts[k].split(" ")
                heads.append(self.split(head))
                tails.append(tail)
            new = self._room(self.stretches, set().union(*tails))
            pieces = [self.split(" " + x) for x in new]
            self._learn_pieces(set().union(*heads, *pieces))
            known = self.pieces.__getitem__
            for x, of in zip(new, pieces, strict=True):
                self.stretches[x] = b"".join(map(known, of))
            for k, head, tail in zip(spaced, heads, tails, strict=True):
                out[k] = np.frombuffer(b"".join([*map(known, head), *map(self.stretches.__getitem__, tail)]), np.uint32)
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.v.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(vocabulary_path: str, pattern: str, cache_pieces: int = CACHE_PIECES) -> Encoder:
    return Encoder(vocabulary_path, pattern, cache_pieces)


def groups(texts: list[str], chars: int = 400_000):
    """Consecutive texts, about ``chars`` at a time."""
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end]) <= chars):
            total += len(texts[end])
            end += 1
        yield texts[at:end]
        at = end


def encode(docs: DataFrame, vocabulary_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document its id, ``ids`` (array of int) and ``decoded`` (binary, from the ids).

    A null text counts as empty: no ids, no bytes. Repeated rows give repeated rows; an empty table gives none.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def make(batch: pa.RecordBatch):
        coder, at = encoder(vocabulary_path, pattern), 0
        for texts in groups(batch.column(1).to_pylist()):
            ids = coder.encode(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(ids, pa.list_(pa.int32())), pa.array([coder.decode(x.tolist()) for x in ids], pa.binary())], ["id", "ids", "decoded"])
            at += len(texts)

    source = docs.select(F.col(id_column).alias("id"), shared.text_or_empty(text_column).alias("text"))
    return shared.arrow_map(source, make, f"id {kind}, ids array<int>, decoded binary").withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, vocabulary_path: str, ids_column: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary) to a table of id lists; a null list decodes to no bytes."""

    @F.pandas_udf("binary")
    def from_ids(lists):
        table = load_vocabulary(vocabulary_path).bytes_of
        return lists.map(lambda ids: b"" if ids is None else b"".join(table[int(i)] for i in ids))

    return encoded.withColumn(shared.free_name(encoded, "decoded"), from_ids(ids_column))


def digests(docs: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: made where the ids are, so that no id list leaves its task."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make(batch: pa.RecordBatch):
        coder, at = encoder(vocabulary_path, pattern), 0
        for texts in groups(batch.column(1).to_pylist()):
            ids = [x.tolist() for x in coder.encode(texts)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(at, len(texts)),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in ids]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
            at += len(texts)

    source = docs.select("doc_id", shared.text_or_empty().alias("text"))
    return shared.arrow_map(source, make, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
