import re
from collections import Counter
from decimal import Decimal

from pyspark.sql import functions as F

from helixloom.llm import decontam, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_counts_are_exact(sample_docs, edge_docs):
    for docs in (sample_docs, edge_docs):
        got = sorted(map(tuple, quality.measure(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()), key=repr)
        assert got == sorted(((i, *brute_counts(t)) for i, t in docs.select("doc_id", "text").collect()), key=repr)


def test_verdicts(spark, edge_docs, no_docs):
    assert quality.verdicts(edge_docs).count() == edge_docs.count()
    assert all(not r.kept for r in quality.verdicts(edge_docs).collect() if r.base_failed)
    assert quality.verdicts(no_docs).count() == 0
    assert quality.keep_good(no_docs).count() == 0


def test_outliers_are_rejected_and_good_labels_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = quality.verdicts(docs).join(labels, "doc_id").filter("not base_failed").collect()
    good, bad = [r for r in judged if r.quality == 1], [r for r in judged if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good) and len(good) > 100
    assert sum(r.kept for r in bad) <= 0.2 * len(bad)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in quality.verdicts(docs).filter("kept").collect()}


def test_edge_rows_are_judged_like_verdicts(spark, edge_docs):
    kept = quality.keep_good(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in quality.verdicts(edge_docs).collect() if r.kept)


def test_estimates_are_those_of_steps_over_sorted_distances(spark):
    """The same concentration steps, by numpy over all rows, without bins."""
    import numpy as np

    rnd = np.random.default_rng(5)
    rows, names = [], ("a", "b")
    for lang in ("en", "fr"):
        for source, n in (("a", 900), ("b", 300)):
            x = rnd.normal(0, 0.4, (n, quality.D)) @ (np.eye(quality.D) + 0.3) + (1.0 if source == "b" else 0.2)
            x[: n // 10] += rnd.normal(6, 1, (n // 10, quality.D))
            rows += [(lang, source, *map(float, r)) for r in x]
    kinds = ", ".join(f"{v} double" for v in quality.VECTOR)
    table = spark.createDataFrame(rows, f"lang string, source string, {kinds}").withColumn("base_failed", F.lit(False))
    got = {(r.lang, r.source): (np.array(r.center), np.array(r.whiten).reshape(quality.D, quality.D)) for r in quality.fit(table).collect()}
    for lang in ("en", "fr"):
        data = {s: np.array([r[2:] for r in rows if r[:2] == (lang, s)]) for s in names}
        best = {}
        for start in (0, 1):
            now = {}
            for s, x in data.items():
                q = np.quantile(x, (0.25, 0.5, 0.75), axis=0)
                spread = np.array(quality.FLOORS) if not start else np.maximum((q[2] - q[0]) / 1.349, quality.FLOORS)
                now[s] = (q[1], np.diag(1 / spread))
            for _ in range(quality.STEPS):
                near = {s: x[np.argsort((((x - now[s][0]) @ now[s][1].T) ** 2).sum(1))[: int(quality.SUPPORT * len(x))]] for s, x in data.items()}
                every = np.concatenate(list(near.values()))
                mean, second = every.mean(0), every.T @ every / len(every)
                for s, x in near.items():
                    w = len(x) + quality.PRIOR
                    center = (x.sum(0) + quality.PRIOR * mean) / w
                    cov = quality.CONSISTENCY * ((x.T @ x + quality.PRIOR * second) / w - np.outer(center, center))
                    cov += np.diag(np.maximum(np.square(quality.FLOORS) - np.diag(cov), 1e-9))
                    now[s] = (center, np.linalg.inv(np.linalg.cholesky(cov)), np.linalg.slogdet(cov)[1])
            for s, m in now.items():
                if s not in best or m[2] < best[s][2]:
                    best[s] = m
        for s in names:
            assert np.allclose(got[lang, s][0], best[s][0], atol=0.05)
            assert np.allclose(got[lang, s][1], best[s][1], atol=0.35)


def test_a_document_of_repeated_lines_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    menu = "\n".join([f"alpha{k} beta{k}" for k in range(10)] * 1 + [f"gamma{k % 5}" for k in range(0)] + [f"item{k % 4}" for k in (3, 1, 0, 2, 0, 3, 2, 1) * 16])
    odd = spark.createDataFrame([(-1, menu, "en", docs.filter("lang = 'en'").first().source)], docs.schema)
    row = quality.verdicts(docs.unionByName(odd)).filter("doc_id = -1").first()
    assert not row.kept


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        before, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (a != b))
    return min(row)


ITEM = "the committee met on tuesday to discuss the long awaited report about rivers"


def test_edit_matching(spark, edge_docs, no_docs):
    edited = ITEM.replace("tuesday", "tuesdy").replace("long", "lung").replace("rivers", "riverss")
    far = ITEM.replace("committee", "board").replace("long awaited", "short")
    rows = [(1, f"Intro. {ITEM.upper()} outro"), (2, f"x {edited} y"), (3, f"x {far} y"), (4, None), (5, ""), (6, "other text"), (6, ITEM.replace(" ", "\n "))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, ITEM), (8, None), (9, ""), (10, "zebra crossing on the hill"), (7, ITEM)], "item_id long, text string")
    want = set()
    for i, t in rows:
        d = distance(ITEM, decontam.normal(t))
        if d <= decontam.budget(len(ITEM), decontam.ERROR_RATE):
            want.add((i, 7, d))
    got = decontam.matches(docs, bench).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in got} == want and len(got) == 2 * len(want)
    assert {w[0] for w in want} == {1, 2, 6}
    blocks = decontam.matches(docs, bench, block_chars=10).collect()
    assert sorted(map(tuple, blocks)) == sorted(map(tuple, got))
    assert sorted(r.doc_id for r in decontam.drop_matching(docs, bench).collect()) == [3, 4, 5, 6]
    assert decontam.matches(no_docs, bench).count() == 0
    assert decontam.matches(edge_docs, bench.filter("false")).count() == 0
    assert decontam.drop_matching(edge_docs, bench).columns == edge_docs.columns


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("x", f"a {ITEM} b"), (None, ITEM), ("y", "nothing")], "doc_id string, text string")
    plain = [(3, ITEM), (None, ITEM + " and seas")]
    for kind, cast in (("int", int), ("string", str), ("long", int), ("decimal(9,0)", Decimal)):
        bench = spark.createDataFrame([(None if i is None else cast(i), t) for i, t in plain], f"item_id {kind}, text string")
        for chars in (10, 1_000_000):
            got = decontam.matches(docs, bench, block_chars=chars)
            assert dict(got.dtypes)["item_id"] == kind.replace("long", "bigint")
            assert sorted(((r.doc_id or "", r.item_id) for r in got.collect() if r.distance == 0), key=repr) == sorted((("", cast(3)), ("x", cast(3))), key=repr)
            left = decontam.drop_matching(docs, bench, block_chars=chars)
            assert [r.doc_id for r in left.collect()] == ["y"]


def test_searches_agree_with_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(4)
    items = [(i, decontam.normal(t)) for i, t in bench.collect()]
    planted = docs.selectExpr("doc_id", "text").collect()
    rows = [(d, (t or "")[:400] + " " + items[d % 4][1].replace("the ", "teh ", 2)) for d, t in planted]
    got = {(r.doc_id, r.item_id, r.distance) for r in decontam.matches(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    want = set()
    for d, t in rows:
        for i, item in items:
            n = distance(item, decontam.normal(t))
            if n <= decontam.budget(len(item), decontam.ERROR_RATE):
                want.add((d, i, n))
    assert got == want and want
