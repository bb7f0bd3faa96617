import itertools
import random
import re

import pytest

from helixloom.llm import components, shingle_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for k, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(k)
    pairs = {p for ks in by.values() if len(ks) > 1 for p in itertools.combinations(ks, 2)}
    for a, b in pairs:
        x, y = sets[a], sets[b]
        if 100 * len(x & y) >= 80 * len(x | y) and rows[a][0] is not None and rows[b][0] is not None:
            p, q = sorted((root(rows[a][0]), root(rows[b][0])))
            parent[q] = p
    return sorted(((i, len(s), None if i is None else root(i)) for (i, _), s in zip(rows, sets)), key=repr)


def got(df):
    return sorted(map(tuple, df.drop("n_links").collect()), key=repr)


def variants(seed, groups=12, copies=12):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    boiler = [rnd.choice(vocabulary) for _ in range(30)]
    rows = []
    for g in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(3, 120))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            if rnd.random() < 0.3:
                w = w[: rnd.randint(1, len(w))]
            if rnd.random() < 0.3:
                w = boiler + w
            rows.append((len(rows) * 7 % 1009, " ".join(w)))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("bits", [6, 16])
def test_join_equals_brute_force(spark, seed, bits):
    rows = variants(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(shingle_join.join_components(docs, sketch_bits=bits)) == brute_components(rows)


def test_edges(spark, edge_docs, no_docs):
    rows = [tuple(r) for r in edge_docs.select("doc_id", "text").collect()]
    assert got(shingle_join.join_components(edge_docs, sketch_bits=16)) == brute_components(rows)
    assert shingle_join.join_components(no_docs, sketch_bits=16).count() == 0
    kept = shingle_join.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    assert got(kept.select("doc_id")) == sorted([(None,), *((i,) for i in (1, 2, 3, 4, 5, 6, 7, 8, 11))], key=repr)


def test_documents_of_several_texts(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (3, b), (9, c), (9, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(shingle_join.join_components(docs, sketch_bits=16)) == [(1, 36, 1), (3, 36, 1), (5, 36, 1), (5, 36, 1), (9, 36, 9), (9, 36, 9)]


def test_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got(shingle_join.join_components(docs)) == brute_components(rows)


def test_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 103), (103, 101), (200, 200)]
    found = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {**{i: 0 for i in range(1, 61)}, 101: 100, 103: 100}


def test_links_join_only_similar_texts_and_are_counted(spark):
    rows = variants(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: shingle_set(t) for i, t in rows}
    _, _, found = shingle_join.links(docs, sketch_bits=16)
    near = [tuple(r) for r in found.collect()]
    assert near and len(set(map(frozenset, near))) == len(near)
    assert all(a != b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a, b in near)
    table = shingle_join.join_components(docs, sketch_bits=16).collect()
    own = {r.doc_id: r.n_links for r in table}
    for i, s in sets.items():
        rep = min(k for k, t in sets.items() if t == s)
        assert own[i] == (sum(rep in p for p in near) if s else 0)


def test_links_are_all_similar_pairs(spark, monkeypatch):
    rnd = random.Random(8)
    base = [f"v{rnd.randrange(500)}" for _ in range(150)]
    rows = variants(6, groups=6) + [(2000 + k, " ".join([*base[: 3 * k], f"new{k}", *base[3 * k + 1 :]])) for k in range(40)]
    rows += [(3000, rows[-1][1]), (3001, rows[-2][1]), (3001, rows[-3][1]), (3001, rows[-3][1])]
    sets = {}
    for i, t in rows:
        s = frozenset(shingle_set(t))
        sets[s] = min(i, sets.get(s, i))
    want = {frozenset((sets[x], sets[y])) for x, y in itertools.combinations(sets, 2) if x and y and 100 * len(x & y) >= 80 * len(x | y)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(want) > 700
    for most in (2048, 7):
        monkeypatch.setattr(shingle_join, "BLOCK_CLASSES", most)
        near = [tuple(r) for r in shingle_join.links(docs, sketch_bits=16)[2].collect()]
        assert len(near) == len(want) and set(map(frozenset, near)) == want
    own = {r.doc_id: r.n_links for r in shingle_join.join_components(docs, sketch_bits=16).collect() if r.doc_id != 3001}
    for i, t in rows:
        if i in own and t:
            assert own[i] == sum(sets[frozenset(shingle_set(t))] in p for p in want)


def test_counted_links_make_no_row_a_pair(spark, monkeypatch):
    import pyarrow as pa

    rnd = random.Random(9)
    base = [f"v{rnd.randrange(5000)}" for _ in range(150)]
    rows = [(k, " ".join([*base[:k], f"new{k}", *base[k + 1 :]])) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wrote, write = {}, shingle_join.shared.Tables.write

    def counting(self, name, df):
        table = write(self, name, df)
        wrote[name] = table.count()
        return table

    monkeypatch.setattr(shingle_join.shared.Tables, "write", counting)
    table = shingle_join.join_components(docs, sketch_bits=16).collect()
    assert [(r.component_id, r.n_links) for r in table] == [(0, 119)] * 120
    assert max(wrote.values()) < 120 * 119 / 2, wrote
    marked = [shingle_join._fingerprint(s) for s in shingle_join._sets(pa.array([t for _, t in rows]), 5)]
    block = pa.table({"doc_id": [i for i, _ in rows], "f1": [f for f, _ in marked], "f2": [f for _, f in marked], "block": [0] * 120, "text": [t for _, t in rows]})
    made = shingle_join._counts_of_blocks(5)((pa.scalar(0), pa.scalar(0), pa.scalar(0)), block)
    assert made.to_pydict() == {"node": list(range(120)), "n": [119] * 120}


def test_a_repeated_row_is_one_link(spark):
    words = [f"w{k}" for k in range(60)]
    one, other = " ".join(words), " ".join([*words[:-1], "end"])
    rows = [(1, one), (2, other), (2, other), (2, other.upper()), (7, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in shingle_join.join_components(docs, sketch_bits=16).collect()} == {(i, 56, 1, 1) for i in (1, 2, 7)}
    assert [tuple(r) for r in shingle_join.links(docs, sketch_bits=16)[2].collect()] == [(2, 1)]


def test_shared_counts_both_ways():
    import numpy as np

    rnd = np.random.default_rng(5)
    for width, n in ((80, 60), (50_000, 12)):  # crowded sets by products, sparse ones pair by pair
        sets = [np.unique(rnd.integers(0, width, 60).astype(np.uint64)) for _ in range(n)]
        left, right = np.arange(0, n, 2), np.arange(1, n, 2)
        xs, ys = (x.ravel() for x in np.meshgrid(left, right))
        got = shingle_join.shared_counts(sets, left, right, xs, ys)
        assert got.tolist() == [len(np.intersect1d(sets[x], sets[y])) for x, y in zip(xs, ys, strict=True)]


def test_signatures_never_lose():
    import numpy as np

    rnd = np.random.default_rng(4)
    for n in (1, 5, 60, 400, 3000):
        x = np.unique(rnd.integers(0, 1 << 62, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: len(x) - n // 9], rnd.integers(0, 1 << 62, n // 9).astype(np.uint64)]))
        a, b = (shingle_join.signature(s).view(np.uint64) for s in (x, y))
        assert sum(int(v).bit_count() for v in a ^ b) <= len(np.setxor1d(x, y))


def test_filters_never_lose(spark):
    rnd = random.Random(3)
    import numpy as np

    for _ in range(300):
        x = np.unique(np.array([rnd.randrange(60) for _ in range(rnd.randint(1, 50))], np.uint64))
        y = np.unique(np.array([rnd.randrange(60) for _ in range(rnd.randint(1, 50))], np.uint64))
        both = len(np.intersect1d(x, y))
        assert shingle_join.suffix_passes(x, y, both)
