import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from helixloom.llm import bytebpe, shared, tokencounts, tokenfiles

MULTI = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_byte_bpe_equals_library(spark, sample_docs, edge_docs, no_docs):
    for docs in (sample_docs, edge_docs):
        want = []
        for i, t in docs.select("doc_id", "text").collect():
            ids = LIBRARY.encode_ordinary(t or "")
            want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
        assert rows_of(bytebpe.digests(docs, MULTI, P.PATTERN)) == sorted(want, key=repr)
        for i, ids, decoded in bytebpe.encode(docs, MULTI, P.PATTERN).collect():
            assert bytes(decoded) == LIBRARY.decode_bytes(ids)
    assert bytebpe.digests(no_docs, MULTI, P.PATTERN).count() == 0
    again = bytebpe.decode(bytebpe.encode(edge_docs, MULTI, P.PATTERN).drop("decoded"), MULTI)
    assert sorted(bytes(r.decoded) for r in again.collect()) == sorted((r.text or "").encode() for r in edge_docs.collect())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abthe'sé1 \n\t.,日!")), max_size=60))
def test_byte_bpe_any_text(text):
    coder = bytebpe.encoder(MULTI, P.PATTERN)
    assert coder.encode([text])[0].tolist() == LIBRARY.encode_ordinary(text)


@pytest.mark.parametrize("piece", [b"a" * 3000, b"ab" * 500, bytes(range(256)), b" " * 700])
def test_long_pieces_have_their_own_tree(piece):
    v = bytebpe.load_vocabulary(MULTI)
    parts = [bytes([b]) for b in piece]
    while True:  # the plain way: the leftmost least rank, again and again
        ranked = [(RANKS[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in RANKS]
        if not ranked:
            break
        k = min(ranked)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    assert bytebpe.merge_piece(piece, v) == [RANKS[p] for p in parts]


def test_small_cache_changes_nothing():
    texts = ["the cat sat on the mat", "a dog ran", "the dog sat"] * 3
    small = bytebpe.Encoder(MULTI, P.PATTERN, cache_pieces=2)
    for t in texts:
        assert small.encode([t])[0].tolist() == LIBRARY.encode_ordinary(t)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), min_size=1, max_size=1024))
def test_blocks_round_trip(values):
    values = np.array(values, np.uint32)
    assert (tokenfiles.unpack(tokenfiles.pack(values)) == values).all()


def test_files_seek():
    rng = np.random.default_rng(1)
    lengths = [0, 1, 5000, 3, 1024, 0, 2047]
    ids = rng.integers(0, 49408, sum(lengths)).astype(np.uint32)
    f = tokenfiles.TokenFile(tokenfiles.encode_file(list(range(7)), lengths, ids))
    at = 0
    for k, n in enumerate(lengths):
        assert (f.document(k) == ids[at : at + n]).all()
        at += n


@pytest.mark.parametrize("file_ids", [tokenfiles.FILE_IDS, 2000])
def test_token_files(spark, sample_docs, edge_docs, no_docs, file_ids):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for docs in (sample_docs, edge_docs):
        folder = shared.fresh_path(spark, "test-tokens")
        listing = tokenfiles.write(docs, P.path("word_bpe_49k.json"), folder, file_ids=file_ids)
        got = [tuple(r) for r in tokenfiles.read(spark, folder, listing).collect()]
        got.sort(key=lambda r: r[1])
        want, at = [], 0
        for i, t in sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
            ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
            want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        assert got == want
    folder = shared.fresh_path(spark, "test-tokens")
    listing = tokenfiles.write(no_docs, P.path("word_bpe_49k.json"), folder)
    assert listing.count() == 0


def test_section_counts(spark, sample_docs, edge_docs, no_docs):
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for docs in (sample_docs, edge_docs):
        got = {(r.doc_id, r.n_tokens, tuple(r.section_tokens)) for r in tokencounts.count_sections(docs, path, P.PATTERN).collect()}
        want = set()
        for i, t in docs.select("doc_id", "text").collect():
            t = t or ""
            lines = t.splitlines(keepends=True) if not any(c in t for c in "\r\x0b\x0c\x1c\x1d\x1e\x85  ") else [x + "\n" for x in t.split("\n")[:-1]] + [x for x in t.split("\n")[-1:] if x]
            owner = [k for k, line in enumerate(lines) for _ in line.encode()]
            byte_char = [c for c, ch in enumerate(t) for _ in ch.encode()]
            line_of_char = [k for k, line in enumerate(lines) for _ in line]
            counts, at = [0] * len(lines), 0
            for b in library.decode_tokens_bytes(library.encode_ordinary(t)):
                chars = range(byte_char[at], byte_char[at + len(b) - 1] + 1)
                held = [line_of_char[c] for c in chars]
                counts[max(sorted(set(held)), key=held.count)] += 1
                at += len(b)
            assert at == len(owner)
            want.add((i, sum(counts), tuple(counts)))
        assert got == want
    assert tokencounts.count_sections(no_docs, path, P.PATTERN).count() == 0


def test_boundary_rules():
    starts, ends, edges = np.array([0, 2]), np.array([2, 8]), np.array([0, 3, 8])
    assert tokencounts.attribute(starts, ends, edges, "share")[0].tolist() == [1, 1]
    assert tokencounts.attribute(starts, ends, edges, "start")[0].tolist() == [2, 0]


def test_field_counts(spark):
    rows = spark.createDataFrame([(1, "a title", "the body text", ""), (2, None, "only", None), (3, None, None, None)], "id long, title string, body string, tail string")
    path = P.path("byte_bpe_50k.tiktoken")
    for r in tokencounts.count_fields(rows, "id", ["title", "body", "tail"], path, P.PATTERN).collect():
        assert sum(r.tokens) == r.n_tokens and len(r.tokens) == 3
        if r.id == 1:
            assert r.tokens[0] >= 2 and r.tokens[1] >= 3 and r.tokens[2] == 0


def test_fields_of_odd_tables(spark):
    rows = spark.createDataFrame([(1, None, None, 7), (1, None, None, 7), (None, "x", "", 8), (2, "", "y z", 9)], "id long, title string, body string, tokens int")
    path = P.path("byte_bpe_50k.tiktoken")
    got = sorted(((r.id, r.n_tokens, sum(r.tokens)) for r in tokencounts.count_fields(rows, "id", ["title", "body"], path, P.PATTERN).collect()), key=repr)
    assert len(got) == 4 and got.count(got[0]) == 2 and all(n == k for _, n, k in got)
    assert tokencounts.count_fields(rows.filter("false"), "id", ["title"], path, P.PATTERN).count() == 0
