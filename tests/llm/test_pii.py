import hashlib
import math
import re

import pytest

from helixloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def brute(text):
    text, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    out.sort()
    joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in out)
    return [sum(k == j for _, k, _ in out) for j in range(4)], hashlib.sha256(joined.encode()).hexdigest(), out


TEXTS = [
    "mail a@b.com, c@d.org_e@f.g or x@y; 日本 é😀 z.z+1@sub.dom-ain.example.co.uk.",
    "1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.2.3 1.2.3 10.0.0.1:80 1.2.3.4",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 5 6 12  4111 1111 1111 1111 99999999999999999999 4111111111111111-",
    "+1 (555) 555-5555 +123 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 +49.30.1234567-8. ++1 555 123 4567+1 555 123 4567",
    "5" * 30_000 + " " + "a" * 30_000 + "@",
    "1 " * 20_000,
    "u@v.ww " * 3000 + "4111 1111 1111 1111",
    "1.1.1.1," * 1500,
    "+" * 2000 + "+1" * 2000,
    "contact john at example dot com or jane(at)site.org, 555-123-4567, (555) 123-4567, 10[.]0[.]0[.]1, 4111.1111.1111.1111",
    "",
    None,
]


def check(docs):
    rows = {}
    for r in pii.detect(docs).collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, rows.values())) == docs.count()
    for i, t in docs.select("doc_id", "text").collect():
        counts, digest, found = brute(t)
        matching = [r for r in rows[i] if [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts and r.base_sha256 == digest]
        assert matching, (i, counts)
        listed = set(matching[0].spans.split(",")) - {""}
        assert {f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in found} <= listed


def test_base_equals_brute_force(spark):
    check(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))


def test_sample_and_edges(spark, edge_docs, no_docs):
    check(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    check(edge_docs)
    assert pii.detect(no_docs).count() == 0
    assert pii.redact(no_docs).count() == 0


def test_trees_add_telling_spans(spark):
    rows = []
    for k in range(600):
        good = f"write to user{k} at example dot com today, call 555-{k % 900 + 100}-{1000 + k}."
        bad = f"look at nothing{k} dot zzz or at rest."
        rows.append((k, good if k % 2 else bad))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.detect(docs).collect()
    for r in found:
        assert (("email" in r.spans) and ("phone" in r.spans)) == bool(r.doc_id % 2), (r.doc_id, r.spans)
    out = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert out[1] == "write to [EMAIL] today, call [PHONE]."
    assert out[2] == rows[2][1]


def test_redaction(spark):
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_chars int, base string")
    models = {k: ([], float("inf")) for k in pii.KINDS}
    got = pii.redacted(docs, models)
    assert got.columns == docs.columns and got.schema == docs.schema
    for r in got.collect():
        want, at = [], 0
        if TEXTS[r.doc_id] is None:
            assert r.text is None
            continue
        merged = []
        for a, k, b in brute(TEXTS[r.doc_id])[2]:
            if merged and a < merged[-1][2]:
                merged[-1][2] = max(merged[-1][2], b)
            else:
                merged.append([a, k, b])
        for a, k, b in merged:
            want += [TEXTS[r.doc_id][at:a], f"[{pii.KINDS[k].upper()}]"]
            at = b
        want.append(TEXTS[r.doc_id][at:])
        assert r.text == "".join(want)


def test_boosting_fits_cells():
    cells = [(b, 100.0, 95.0 if b & 1 and not b & 4 else 2.0) for b in range(8)]
    trees = pii._boost(cells)
    scores = {b: sum(pii._leaf(t, b) for t in trees) for b in range(8)}
    assert min(scores[1], scores[3]) > 1 > max(scores[b] for b in (0, 2, 4, 5, 6, 7))


def test_calibration_is_on_unseen_snippets(spark):
    """Trees score what they weren't fitted to; above the threshold nearly all is good, and most that is good is above."""
    good = chosen = right = 0
    for kind, found in pii.examples(spark).items():
        scored = pii.unseen_scores(found)
        assert len(scored) == len(found)
        slope, offset = pii._calibrate(scored)
        assert slope > 0
        above = [g for s, g in scored if 1 / (1 + math.exp(-(slope * s + offset))) >= pii.LEAST_PROBABILITY]
        good, chosen, right = good + sum(g for _, g in scored), chosen + len(above), right + sum(above)
    assert right >= 0.9 * chosen and right >= 0.85 * good and chosen > 30


def test_calibration_gives_shares():
    points = [(x / 10, k < 100 / (1 + math.exp(-(2 * x / 10 - 1)))) for x in range(-30, 31) for k in range(100)]
    slope, offset = pii._calibrate(points)
    assert abs(slope - 2) < 0.1 and abs(offset + 1) < 0.1
    assert all(abs(v) < 50 for v in pii._calibrate([(1.0, True)] * 5 + [(-1.0, False)] * 5))
    assert all(map(math.isfinite, pii._calibrate([])))
