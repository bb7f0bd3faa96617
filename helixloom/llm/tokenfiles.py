"""Token ids in files of patched frame-of-reference blocks.

A file holds consecutive documents in ascending id order. ids are cut into blocks of ``BLOCK`` regardless of
documents. A block has its minimum, a width that holds the share ``WIDTH_SHARE`` of its values, the values less the
minimum packed at that width, and a list of exceptions: place and high bits of each wider value. The index has the
start of each block, and of each document its id and length, so a reader can seek to any document.

Layout, little-endian: magic, n_blocks u32, n_docs u32, n_ids u64, block offsets u64[n_blocks + 1] (from the end of
the index), doc ids i64[n_docs], doc lengths u32[n_docs], then blocks: minimum u32, n_values u16, width u8, spare u8,
n_exceptions u16, places u16[], high bits u32[], packed values.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

MAGIC = b"HXPF\x01\x00\x00\x00"
BLOCK = 1024
WIDTH_SHARE = 0.9
#: A file is closed when it holds so many ids.
FILE_IDS = 16_000_000
CACHE_WORDS = 500_000
#: Words of Latin letters that have no other normal form and lower to one letter each.
PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
MARKS = b".,!?;:%#$*&"
#: The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def pack(values: np.ndarray) -> bytes:
    """One block."""
    least = int(values.min())
    rest = (values - least).astype(np.uint32)
    bits = np.frexp(rest.astype(np.float64))[1]  # the bit length of each
    width = int(np.partition(bits, k := min(len(bits) - 1, int(len(bits) * WIDTH_SHARE)))[k])
    places = np.flatnonzero(bits > width)
    low = (rest[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    head = struct.pack("<IHBBH", least, len(values), width, 0, len(places))
    return head + places.astype("<u2").tobytes() + (rest[places] >> np.uint32(width)).astype("<u4").tobytes() + np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes) -> np.ndarray:
    least, n, width, _, extra = struct.unpack_from("<IHBBH", data)
    at = 10
    places = np.frombuffer(data, "<u2", extra, at)
    high = np.frombuffer(data, "<u4", extra, at + 2 * extra)
    bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=at + 6 * extra), count=n * width, bitorder="little").reshape(n, width)
    out = bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32)) if width else np.zeros(n, np.uint32)
    out[places] |= high << np.uint32(width)
    return out + np.uint32(least)


def encode_file(doc_ids: list[int], lengths: list[int], ids: np.ndarray) -> bytes:
    blocks = [pack(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    offsets = np.cumsum([0, *map(len, blocks)])
    index = struct.pack("<IIQ", len(blocks), len(doc_ids), len(ids)) + offsets.astype("<u8").tobytes()
    return b"".join([MAGIC, index, np.array(doc_ids, "<i8").tobytes(), np.array(lengths, "<u4").tobytes(), *blocks])


class TokenFile:
    """Reads a file's bytes."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        self.data = data
        n_blocks, n_docs, self.n_ids = struct.unpack_from("<IIQ", data, 8)
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, 24).astype(np.int64)
        at = 24 + 8 * (n_blocks + 1)
        self.doc_ids = np.frombuffer(data, "<i8", n_docs, at)
        self.lengths = np.frombuffer(data, "<u4", n_docs, at + 8 * n_docs).astype(np.int64)
        self.base = at + 12 * n_docs
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])

    def block(self, k: int) -> np.ndarray:
        return unpack(self.data[self.base + self.offsets[k] : self.base + self.offsets[k + 1]])

    def span(self, start: int, end: int) -> np.ndarray:
        """ids from ``start`` to ``end``, from the blocks that hold them."""
        if start >= end:
            return np.zeros(0, np.uint32)
        first = start // BLOCK
        got = np.concatenate([self.block(k) for k in range(first, (end - 1) // BLOCK + 1)])
        return got[start - first * BLOCK : end - first * BLOCK]

    def document(self, k: int) -> np.ndarray:
        return self.span(int(self.starts[k]), int(self.starts[k + 1]))


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordEncoder:
    """Encodes texts by the tokenizer file, each distinct word once while it is remembered.

    The tokenizer drops white space and never joins characters across it, so a text's ids are those of its words. A
    final run of MARKS after a letter is a piece of its own, so it is remembered apart.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.path, self.limit, self.known = path, cache_words, {}

    def _fill(self, words: list[bytes]) -> None:
        """Learns words: a plain word and the marks that end it are pieces, and normalising only lowers them, so they go
        straight to the library's merges; any other word goes through the library's whole encoding."""
        known, model, rest = self.known, _tokenizer(self.path).model.tokenize, []
        for word in words:
            stem = word.rstrip(MARKS)
            found = known.get(stem)
            if found is None:
                text = stem.decode()
                if not PLAIN.fullmatch(text):
                    rest.append(word)
                    continue
                text = text.lower()
                if not text.isascii():
                    text = text.encode().decode("latin-1").translate(BYTE_CHARS)
                found = array("I", [t.id for t in model(text)]).tobytes()
                known[stem] = found
            elif stem != word and not PLAIN.fullmatch(stem.decode()):
                rest.append(word)
                continue
            if stem != word:
                end = word[len(stem) :]
                marks = known.get(end)
                if marks is None:
                    marks = known[end] = array("I", [t.id for t in model(end.decode())]).tobytes()
                known[word] = found + marks
        if rest:
            for word, e in zip(rest, _tokenizer(self.path).encode_batch_fast([w.decode() for w in rest], add_special_tokens=False), strict=True):
                known[word] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode() for t in texts]
        # normalising lowers letters, but the strings of special tokens are found before that
        split = [(r if b"<|" in r else r.lower()).split() for r in raw]
        wanted = set().union(*split)
        new = [w for w in wanted if w not in self.known]
        if len(self.known) + len(new) > self.limit:
            self.known.clear()
            new = list(wanted)
        if new:
            self._fill(new)
        return [np.frombuffer(b"".join(map(self.known.__getitem__, words)), "<u4") for words in split]


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _texts(column: pa.Array, chars: int = 1_000_000):
    at, texts, total = 0, [], 0
    for text in column.to_pylist():
        if texts and total + len(text) > chars:
            yield at, texts
            at, texts, total = at + len(texts), [], 0
        texts.append(text)
        total += len(text)
    if texts:
        yield at, texts


def _store(folder: str):
    """The file system of a folder, for Python on the executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)


def write(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the token files and returns their list: file, first_id, n_docs, n_ids, in ascending id order.

    A null text counts as empty and has the end id alone; a null id counts as before all others. Documents of one id
    stand together, in no set order. The texts are shuffled once, by ranges of ids.
    """
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), shared.text_or_empty().alias("text"))
    n = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = source.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")

    def run(batches):
        store, path = _store(folder)
        part, number = TaskContext.get().partitionId(), 0
        coder, doc_ids, lengths, parts, total = word_encoder(tokenizer_path), [], [], [], 0

        def close():
            name = f"part-{part:06d}-{number:04d}.hxp"
            store.create_dir(path, recursive=True)
            hidden = f"{path}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(hidden) as f:
                f.write(encode_file(doc_ids, lengths, np.concatenate(parts)))
            store.move(hidden, f"{path}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part * 1_000_000 + number], pa.int64()), pa.array([len(doc_ids)], pa.int64()), pa.array([total], pa.int64())], ["file", "number", "n_docs", "n_ids"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, texts in _texts(batch.column(1)):
                for doc_id, got in zip(ids[at : at + len(texts)], coder.encode(texts), strict=True):
                    doc_ids.append(doc_id)
                    lengths.append(len(got) + 1)
                    parts.append(np.append(got, np.uint32(end_id)))
                    total += len(got) + 1
                    if total >= file_ids:
                        yield close()
                        doc_ids, lengths, parts, total, number = [], [], [], 0, number + 1
        if doc_ids:
            yield close()

    return shared.written(ranged.mapInArrow(run, "file string, number long, n_docs long, n_ids long"), "token-files")


def read(spark, folder: str, listing: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files of ``listing``.

    Where a file starts is a running sum over the list, which has a row a file.
    """
    starts = listing.select("file", (F.sum("n_ids").over(Window.orderBy("number")) - F.col("n_ids")).alias("base"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.hxp").load(folder)
    joined = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").join(starts, "file").select("base", "content")

    def run(batches):
        for batch in batches:
            for base, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                f = TokenFile(data.as_py())
                step = 64 * BLOCK
                at, crcs, left, crc = 0, [], list(f.lengths.tolist()), 0
                k, need = 0, left[0] if left else 0
                while at < f.n_ids:  # all blocks in order, a few at a time
                    ids = f.span(at, min(at + step, f.n_ids)).astype("<u4")
                    here = 0
                    while here < len(ids):
                        take = min(need, len(ids) - here)
                        crc = zlib.crc32(ids[here : here + take].tobytes(), crc)
                        here, need = here + take, need - take
                        if not need:
                            crcs.append(crc)
                            crc, k = 0, k + 1
                            need = left[k] if k < len(left) else 0
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids), pa.array(f.starts[:-1] + base), pa.array(f.lengths), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    out = joined.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")))
