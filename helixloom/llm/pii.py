"""Personal data, by DataFrame functions alone.

1. Base spans: the leftmost matches of four patterns, kept if their check passes (parts at most 255, Luhn, digits).
2. Generators of high recall propose more spans, which may overlap: email addresses written with "at" and "dot",
   phone numbers without a plus, cards with dots, addresses in brackets, and of digit runs that a base pattern takes
   whole and whose check then fails, the parts of a card's or a phone's length. A proposed span must pass the check of
   its kind without its disguise, and not lie in a base span that passed.
3. Boosted trees score proposed spans by format and context. They are fitted to EXAMPLES, snippets labelled by hand, on
   the driver, and come back as a native expression. No count of the corpus enters: a document's spans are the same in
   a table of any size.
4. Scores are calibrated on snippets that the trees which score them haven't seen: the snippets of a kind are dealt into
   ``FOLDS`` parts, each is scored by trees fitted to the others, and a logistic curve through these scores gives the
   probability that a span is good. Proposed spans of ``LEAST_PROBABILITY`` or more are redacted beside the base spans.
   That is a calibration on the labelled snippets, not on real documents: nothing is labelled there.

Positions count code points; ends are exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

KINDS = ("email", "ip", "card", "phone")

# The base patterns. Runs are possessive and begin where a run begins (or a match ended), which finds the
# same matches in linear time and without recursion.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A substring that every match has, to leave texts without it alone.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

#: Candidate generators: spans that a looser reading takes for the kind. What lies in a base span that passed is dropped.
GENERATORS = {
    "email": r"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]| at ) ?[A-Z0-9-]{1,63}+(?: ?(?:\(dot\)|\[dot\]| dot |\.) ?[A-Z0-9-]{2,63}+){1,4}+",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\+[0-9]{1,3}[ .-]{0,2})?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
    "card": r"(?<![0-9A-Za-z.])[0-9]{4}[. /][0-9]{4}[. /][0-9]{4}[. /][0-9]{1,7}(?![0-9A-Za-z])",
    "ip": r"(?<![0-9.])(?=[0-9.]{1,11}\[)[0-9]{1,3}\[?\.\]?[0-9]{1,3}\[?\.\]?[0-9]{1,3}\[?\.\]?[0-9]{1,3}(?![0-9.])",
}
#: What a text must hold for the generator to run on it.
GENERATOR_NEEDS = {"email": r"(?i)\(at\)|\[at\]| at [a-z0-9-]+(?: ?\(dot\)| ?\[dot\]| dot |\.[a-z0-9])", "phone": r"[0-9]{3}[ .-][0-9]{4}", "card": r"[0-9]{4}[. /][0-9]{4}[. /][0-9]{4}", "ip": r"[0-9]\[\.\]"}

#: Runs in which shorter candidates of a kind may begin: the match is where the next search begins, its group what may be
#: a candidate, up to one digit more than the kind has.
RUNS = {
    "card": r"(?<![0-9])(?=([0-9](?:[ -]?[0-9]){11,19}))[0-9]++",
    "phone": r"(?=(\+[0-9](?:[ ().-]*[0-9]){8,15}))\+[0-9][ ().0-9-]+[0-9]",
}
#: The candidates of so many digits at the head of a run; none ends within a group of digits.
HEADS = {
    "card": [rf"^[0-9](?:[ -]?[0-9]){{{n - 1}}}(?![0-9])" for n in range(12, 20)],
    "phone": [rf"^\+[0-9](?:[ ().-]*[0-9]){{{n - 1}}}(?![0-9])" for n in range(9, 16)],
}

#: Characters before a candidate, and after the one before it, that are its context.
CONTEXT = 40

# Words that speak for and against a candidate.
FOR = "mail|contact|write|reach|phone|call|ring|dial|tel|mobile|cell|fax|sms|card|visa|mastercard|pay|server|host|address|ip"
AGAINST = "no|nr|number|id|order|version|isbn|ref|invoice|part|serial|tracking|v|#"
DOMAINS = "com|org|net|edu|gov|info|io|co|de|fr|es|uk"


def features(value: Column, digits: Column, before: Column) -> list[Column]:
    """Binary features of a candidate's format and context. None of them makes the labels, which are set by hand."""
    n = F.length(digits)
    return [
        n >= 10,
        n >= 13,
        value.rlike(r"(?i)\(at\)|\[at\]|\[\.\]"),
        value.rlike(r"(?i)\(dot\)|\[dot\]| dot "),
        value.rlike(f"(?i)(?:\\.|dot[\\])]?) ?(?:{DOMAINS})$"),
        digits.rlike("^([0-9])\\1*$"),
        before.rlike(f"(?i)(?:^|[^a-z])(?:{FOR})[^a-z0-9]{{0,3}}(?:(?:to|me|us|on|at|is|or|number)[^a-z0-9]{{1,3}}){{0,2}}$"),
        before.rlike(f"(?i)(?:^|[^a-z])(?:{AGAINST})[^a-z0-9]{{0,3}}$"),
        before.rlike("[0-9][ .,/-]?$"),
        value.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}([ ./-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{3})?|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})$"),
        value.rlike(r"^(?:\+[0-9]{1,3}[ .-]*)?\(?[0-9]{3}[ ).-]{1,2}[0-9]{3}[ .-][0-9]{4}$"),
        value.rlike(r"^[+(]"),
    ]


N_FEATURES = 12
ROUNDS = 30
SHRINK = 0.3
PRIOR = 1.0
#: Parts that the snippets of a kind are dealt into for calibration.
FOLDS = 8
#: Least calibrated probability of a span that is redacted.
LEAST_PROBABILITY = 0.7

# The labelled set, by hand. A kind, a snippet, and the values in it that are of the kind; what else the
# generators propose there isn't.
EXAMPLES = [
    ("email", "write to jane.roe at example dot com today", ("jane.roe at example dot com",)),
    ("email", "My address: j_smith (at) uni-lab (dot) edu.", ("j_smith (at) uni-lab (dot) edu",)),
    ("email", "support[at]shop.org answers", ("support[at]shop.org",)),
    ("email", "Questions? info(at)museum.fr", ("info(at)museum.fr",)),
    ("email", "send it to k.brandt [at] verlag [dot] de please", ("k.brandt [at] verlag [dot] de",)),
    ("email", "mail bob at firm.co.uk for a quote", ("bob at firm.co.uk",)),
    ("email", "contact me at sales at depot.net", ("sales at depot.net",)),
    ("email", "reach us: press at paper.com", ("press at paper.com",)),
    ("email", "the author, lee99 at mailbox dot org, says so", ("lee99 at mailbox dot org",)),
    ("email", "ana.diaz at correo dot es", ("ana.diaz at correo dot es",)),
    ("email", "e-mail: tom(at)studio(dot)io", ("tom(at)studio(dot)io",)),
    ("email", "x-ray(at)clinic.info or by post", ("x-ray(at)clinic.info",)),
    ("email", "Read more at example.com", ()),
    ("email", "See the recipes at cooking.org for details", ()),
    ("email", "He works at amazon.com and lives there", ()),
    ("email", "Buy tickets online at theatre.co.uk now", ()),
    ("email", "more news at bbc.co.uk", ()),
    ("email", "She was at home.The door", ()),
    ("email", "They arrived at noon.De Gaulle spoke", ()),
    ("email", "it opens at 9.30 every day", ()),
    ("email", "trading at 3.5 dollars", ()),
    ("email", "look at it.is it red", ()),
    ("email", "aim at the middle dot zzz there", ()),
    ("email", "look at nothing dot zzz or at rest", ()),
    ("email", "the laser points at one dot then stops", ()),
    ("email", "she stared at the dot above", ()),
    ("email", "matrix[at]row.column is read", ()),
    ("email", "f(at)index.value of the array", ()),
    ("ip", "the host 10[.]0[.]0[.]1 beaconed", ("10[.]0[.]0[.]1",)),
    ("ip", "blocked 192.168.1[.]44 today", ("192.168.1[.]44",)),
    ("ip", "traffic to 203[.]0[.]113[.]9 and 198.51[.]100[.]7", ("203[.]0[.]113[.]9", "198.51[.]100[.]7")),
    ("ip", "server 172[.]16[.]0[.]250", ("172[.]16[.]0[.]250",)),
    ("ip", "8[.]8[.]8[.]8", ("8[.]8[.]8[.]8",)),
    ("ip", "ip: 77[.]1[.]2[.]3, port 80", ("77[.]1[.]2[.]3",)),
    ("ip", "version 1.2.3[.]4 of it", ()),
    ("ip", "v 4[.]0[.]0[.]1", ()),
    ("ip", "order 12.1.1[.]3", ()),
    ("card", "card 4111 1111 1111 1111 12/26", ("4111 1111 1111 1111",)),
    ("card", "7536784127813050 4845168114407329", ("7536784127813050", "4845168114407329")),
    ("card", "4111.1111.1111.1111", ("4111.1111.1111.1111",)),
    ("card", "visa 5500/0000/0000/0004", ("5500/0000/0000/0004",)),
    ("card", "paid with 3782 822463 10005 11 days ago", ("3782 822463 10005",)),
    ("card", "12 4012888888881881 was charged", ("4012888888881881",)),
    ("card", "card 6011-1111-1111-1117 123", ("6011-1111-1111-1117",)),
    ("card", "6011000990139424-737 is on file", ("6011000990139424",)),
    ("card", "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 21 22 23 24 25 26 27 28 29 30 31 32 33 34 35 36 37 38 39 40", ()),
    ("card", "0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0", ()),
    ("card", "1914 1918 1939 1945 1949 1961 1968 1989 2001 2008 2020 77", ()),
    ("card", "order 4012888888881881 12345", ()),
    ("card", "tracking 6011111111111117 00042", ()),
    ("card", "0000000000000000 00000 0000", ()),
    ("card", "12 15 18 21 24 27 30 33 36 39 42 45 48 51 54 57 60", ()),
    ("card", "100 200 300 400 500 600 700 800 900 1000 1100 1200", ()),
    ("phone", "call 555-123-4567 today", ("555-123-4567",)),
    ("phone", "Phone: (555) 123-4567.", ("(555) 123-4567",)),
    ("phone", "ring me on 212 555 0187 tonight", ("212 555 0187",)),
    ("phone", "tel. 415.555.0132", ("415.555.0132",)),
    ("phone", "fax 303-555-0199", ("303-555-0199",)),
    ("phone", "the office, (646) 555-0100, is shut", ("(646) 555-0100",)),
    ("phone", "x +1 (826) 555-4081 190.137.223.77 y", ("+1 (826) 555-4081",)),
    ("phone", "+1 509 555 6973 2024 10 12 18", ("+1 509 555 6973",)),
    ("phone", "Her mobile is 702-555-0144", ("702-555-0144",)),
    ("phone", "dial 800 555 0175 or call 888-555-0123", ("800 555 0175", "888-555-0123")),
    ("phone", "write or call (503) 555-0161", ("(503) 555-0161",)),
    ("phone", "order 555-123-4567 was sent", ()),
    ("phone", "ISBN 978 014 0328", ()),
    ("phone", "part no. 100-200-3000", ()),
    ("phone", "ref 120.400.1999", ()),
    ("phone", "rows 100 200 3000 of the table", ()),
    ("phone", "between 120 350 1999 and others", ()),
    ("phone", "tracking 123 456 7890", ()),
    ("phone", "the score was 200-300-4000 in all", ()),
    ("phone", "in 300 400 1500 steps", ()),
    ("phone", "serial 555.123.4567", ()),
    ("phone", "2 100 200 3000 4", ()),
    ("phone", "+1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16", ()),
]


def _luhn(digits: Column) -> Column:
    """Of 12 to 19 digits, without a loop: leading zeros change no Luhn sum."""
    padded, total = F.lpad(digits, 20, "0"), F.lit(0)
    for k in range(20):
        d = F.ascii(F.substring(padded, k + 1, 1)) - 48
        total = total + (F.when(d >= 5, 2 * d - 9).otherwise(2 * d) if k % 2 == 0 else d)
    return (F.length(digits).between(12, 19)) & (total % 10 == 0)


def _parts_fit(value: Column) -> Column:
    """Whether all numbers of an address are at most 255, whatever their leading zeros."""
    return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _passes(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return _parts_fit(value)
    if kind == "card":
        return _luhn(_digits(value))
    return F.length(_digits(value)).between(9, 15)


_BLOCK = 128
_FOUND = "array<struct<start: bigint, end: bigint, value: string, before: string>>"
_NONE = "array<struct<gap: bigint, before: string, value: string, size: int>>"


def _located(rows: DataFrame, pattern: str, needs: Column, out: str, group: int = 0) -> DataFrame:
    """Adds ``out``, an array of (start, end, value, before) of the pattern's matches in ``text``, or of a group that
    begins where the match does.

    The lengths of matches and of what stands between add up to positions. They're summed by blocks, then over blocks,
    so a text of very many matches takes time in proportion to it.
    """
    sized = F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda v: F.struct(v.alias("value"), F.length(v).alias("size")))
    values = sized if not group else F.zip_with(F.regexp_extract_all("text", F.lit(pattern), F.lit(group)), sized, lambda v, s: F.struct(v.alias("value"), s["size"].alias("size")))
    gaps = F.transform(F.split("text", pattern, -1), lambda g: F.struct(F.length(g).cast("long").alias("gap"), F.right(g, F.lit(CONTEXT)).alias("before")))
    pairs = F.zip_with(F.slice(gaps, 1, F.size(values)), values, lambda g, v: F.struct(g["gap"].alias("gap"), g["before"].alias("before"), v["value"].alias("value"), v["size"].alias("size")))
    rows = rows.withColumn("pairs__", F.when(needs, pairs).otherwise(F.array().cast(_NONE)))

    def step(state, m):
        low = state["at"] + m["gap"]
        high = low + F.length(m["value"])
        one = F.struct(low.alias("start"), high.alias("end"), m["value"].alias("value"), m["before"].alias("before"))
        return F.struct((low + m["size"]).alias("at"), F.concat(state["found"], F.array(one)).alias("found"))

    def block(k):
        return F.aggregate(F.slice("pairs__", k * _BLOCK + 1, F.lit(_BLOCK)), F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_FOUND).alias("found")), step)

    some = F.size("pairs__") > 0
    rows = rows.withColumn("blocks__", F.when(some, F.transform(F.sequence(F.lit(0), ((F.size("pairs__") - 1) / _BLOCK).cast("int")), block)))
    bases = F.aggregate(
        "blocks__",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("bases")),
        lambda s, b: F.struct((s["at"] + b["at"]).alias("at"), F.concat(s["bases"], F.array(s["at"])).alias("bases")),
        lambda s: s["bases"],
    )
    moved = F.zip_with(
        "blocks__",
        bases,
        lambda b, base: F.transform(b["found"], lambda x: F.struct((x["start"] + base).alias("start"), (x["end"] + base).alias("end"), x["value"].alias("value"), x["before"].alias("before"))),
    )
    return rows.withColumn(out, F.coalesce(F.flatten(moved), F.array().cast(_FOUND))).drop("pairs__", "blocks__")


def _plain(kind: str, value: Column) -> Column:
    """A proposed value as it'd be written without disguise."""
    if kind == "email":
        undone = F.regexp_replace(value, r"(?i) ?(?:\(at\)|\[at\]| at ) ?", "@")
        return F.regexp_replace(undone, r"(?i) ?(?:\(dot\)|\[dot\]| dot ) ?", ".")
    if kind == "ip":
        return F.regexp_replace(value, r"[\[\]]", "")
    return value


def _proposed(rows: DataFrame) -> DataFrame:
    """Adds to rows with ``text``, for each kind, an array of (start, end, base, bits): the base spans that pass,
    and all spans proposed beside them."""
    passing = [c for c in rows.columns if c != "text"]
    for kind in KINDS:
        needs = F.contains("text", F.lit(NEEDS[kind])) if NEEDS[kind] else F.col("text").rlike("[0-9](?:[ -]?[0-9]){11}")
        rows = _located(rows, PATTERNS[kind], needs, f"base_{kind}")
        rows = _located(rows, GENERATORS[kind], F.col("text").rlike(GENERATOR_NEEDS[kind]), f"more_{kind}")
        if kind in RUNS:
            rows = _located(rows, RUNS[kind], needs, f"runs_{kind}", 1)

    def passed(kind: str):
        return F.filter(f"base_{kind}", lambda b: _passes(kind, b["value"]))

    def heads(kind: str):
        """The shorter candidates at the heads of runs."""

        def of(m):
            found = F.filter(F.array(*[F.regexp_extract(m["value"], p, 0) for p in HEADS[kind]]), lambda v: v != "")
            return F.transform(found, lambda v: F.struct(m["start"].alias("start"), (m["start"] + F.length(v)).alias("end"), v.alias("value"), m["before"].alias("before")))

        return F.flatten(F.transform(f"runs_{kind}", of))

    def alone(kind: str):
        def of(c):
            inside = F.exists(f"passed_{kind}", lambda b: (b["start"] <= c["start"]) & (b["end"] >= c["end"]))
            return _passes(kind, _plain(kind, c["value"])) & ~inside

        return of

    for kind in KINDS:
        rows = rows.withColumn(f"passed_{kind}", passed(kind))
        every = F.concat(f"more_{kind}", heads(kind)) if kind in RUNS else F.col(f"more_{kind}")
        rows = rows.withColumn(f"more_{kind}", F.filter(every, alone(kind)))

    def described(kind: str, base: bool):
        def one(m):
            bits = F.lit(0)
            for k, f in enumerate(features(m["value"], _digits(m["value"]), m["before"])):
                bits = bits + F.when(f, 1 << k).otherwise(0)
            return F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(base).alias("base"), bits.alias("bits"))

        return F.transform(f"{'passed' if base else 'more'}_{kind}", one)

    return rows.select(*passing, "text", *[F.concat(described(k, True), described(k, False)).alias(k) for k in KINDS])


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and the arrays of ``_proposed``. A null text counts as empty."""
    return _proposed(docs.select("doc_id", shared.text_or_empty().alias("text"))).drop("text")


def _boost(cells: list[tuple[int, float, float]]) -> list[tuple]:
    """Trees of two levels for (bits, examples, good ones) cells, by Newton steps on the logistic loss: (feature,
    (feature, leaf off, leaf on) where it's off, the same where it's on)."""
    score = {b: 0.0 for b, _, _ in cells}
    trees = []

    def sums(part):
        g = h = 0.0
        for b, n, good in part:
            p = 1 / (1 + math.exp(-score[b]))
            g += good - n * p
            h += n * p * (1 - p)
        return g, h

    def split(part):
        best = None
        for k in range(N_FEATURES):
            off, on = [c for c in part if not c[0] >> k & 1], [c for c in part if c[0] >> k & 1]
            (g0, h0), (g1, h1) = sums(off), sums(on)
            gain = g0 * g0 / (h0 + PRIOR) + g1 * g1 / (h1 + PRIOR)
            if best is None or gain > best[0] + 1e-12:
                best = (gain, k, SHRINK * g0 / (h0 + PRIOR), SHRINK * g1 / (h1 + PRIOR), off, on)
        return best

    for _ in range(ROUNDS if cells else 0):
        _, k, _, _, off, on = split(cells)
        sides = [split(off)[1:4], split(on)[1:4]]
        trees.append((k, *sides))
        for b in score:
            score[b] += _leaf(trees[-1], b)
    return trees


def _leaf(tree: tuple, bits: int) -> float:
    feature, low, high = tree[1 + (bits >> tree[0] & 1)]
    return high if bits >> feature & 1 else low


def _calibrate(scored: list[tuple[float, bool]]) -> tuple[float, float]:
    """Slope and offset of the logistic curve through (score, good) points, by Newton steps. Targets are drawn towards a
    half as by one more example of each sort, so that a clean split gives no infinite slope."""
    good = sum(g for _, g in scored)
    yes, no = (good + 1) / (good + 2), 1 / (len(scored) - good + 2)
    slope, offset = 1.0, 0.0

    def loss(slope: float, offset: float) -> float:
        return sum(math.log1p(math.exp(-abs(z))) + max(z, 0) - (yes if g else no) * z for z, g in ((slope * s + offset, g) for s, g in scored))

    for _ in range(100):
        g0 = g1 = h00 = h01 = h11 = 1e-9
        for s, g in scored:
            p = 1 / (1 + math.exp(-(slope * s + offset)))
            d, w = p - (yes if g else no), p * (1 - p)
            g0, g1, h00, h01, h11 = g0 + d * s, g1 + d, h00 + w * s * s, h01 + w * s, h11 + w
        det = h00 * h11 - h01 * h01 + 1e-12
        move = ((h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det)
        step, now = 1.0, loss(slope, offset)
        while step > 1e-6 and loss(slope - step * move[0], offset - step * move[1]) > now:
            step /= 2
        slope, offset = slope - step * move[0], offset - step * move[1]
    return slope, offset


def _cells(candidates: list[tuple[int, int, bool]]) -> list[tuple[int, float, float]]:
    """(bits, examples, good ones) of (snippet, bits, good)."""
    cells: dict[int, list[float]] = {}
    for _, bits, good in candidates:
        cell = cells.setdefault(bits, [0.0, 0.0])
        cell[0] += 1
        cell[1] += good
    return sorted((b, n, good) for b, (n, good) in cells.items())


def unseen_scores(candidates: list[tuple[int, int, bool]]) -> list[tuple[float, bool]]:
    """Score and label of each candidate (snippet, bits, good) by trees fitted to the snippets of the other parts."""
    part = {snippet: k % FOLDS for k, snippet in enumerate(sorted({c[0] for c in candidates}, key=lambda x: (x * 7919) % 1009))}
    out = []
    for k in range(FOLDS):
        trees = _boost(_cells([c for c in candidates if part[c[0]] != k]))
        out += [(sum(_leaf(t, bits) for t in trees), good) for snippet, bits, good in candidates if part[snippet] == k]
    return out


_fitted: dict[str, tuple[list[tuple], float]] = {}


def examples(spark: SparkSession) -> dict[str, list[tuple[int, int, bool]]]:
    """Of each kind the candidates that the generators propose in EXAMPLES: snippet, features, label."""
    rows = F.array(*[F.struct(F.lit(k).alias("id"), F.lit(text).alias("text")) for k, (_, text, _) in enumerate(EXAMPLES)])
    found = {r.id: r for r in _proposed(spark.range(1).select(F.inline(rows))).collect()}
    out: dict[str, list[tuple[int, int, bool]]] = {kind: [] for kind in KINDS}
    for k, (kind, text, good) in enumerate(EXAMPLES):
        out[kind] += [(k, c.bits, text[c.start : c.end] in good) for c in found[k][kind] if not c.base]
    return out


def fit(spark: SparkSession) -> dict[str, tuple[list[tuple], float]]:
    """Trees and threshold of each kind, from EXAMPLES alone; fitted once a process."""
    if not _fitted:
        for kind, candidates_ in examples(spark).items():
            slope, offset = _calibrate(unseen_scores(candidates_))
            least = (math.log(LEAST_PROBABILITY / (1 - LEAST_PROBABILITY)) - offset) / slope if slope > 0 else math.inf
            _fitted[kind] = (_boost(_cells(candidates_)), least)
    return _fitted


def _score(bits: Column, trees: list[tuple]) -> Column:
    total = F.lit(0.0)
    for root, low, high in trees:
        side = [F.when(bits.bitwiseAND(F.lit(1 << f)) != 0, on).otherwise(off) for f, off, on in (low, high)]
        total = total + F.when(bits.bitwiseAND(F.lit(1 << root)) != 0, side[1]).otherwise(side[0])
    return total


def spans(found: DataFrame, models: dict[str, tuple[list[tuple], float]]) -> DataFrame:
    """In place of the arrays of ``_proposed``, ``base`` and ``all``: arrays of (start, kind, end), kind as its place in
    KINDS, in order."""

    def of(kind: str, keep):
        return F.transform(F.filter(kind, keep), lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), c["end"].alias("end")))

    def chosen(kind: str):
        trees, least = models[kind]
        if math.isinf(least):
            return lambda c: c["base"]
        return lambda c: c["base"] | (_score(c["bits"], trees) >= F.lit(least - 1e-9))  # sums may differ in their last bits

    base = F.concat(*[of(k, lambda c: c["base"]) for k in KINDS])
    every = F.concat(*[of(k, chosen(k)) for k in KINDS])
    return found.withColumns({"base": F.array_sort(base), "all": F.array_sort(F.array_distinct(every))}).drop(*KINDS)


def written_out(spans_: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, base_sha256 and spans of every row. Repeated rows give repeated rows; an empty table
    gives none."""
    found = shared.written(candidates(docs), "pii-candidates")
    marked = spans(found, fit(docs.sparkSession))

    def of_kind(k: int):
        return lambda s: s["kind"] == k

    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return marked.select("doc_id", *counts, F.sha2(written_out(F.col("base")), 256).alias("base_sha256"), written_out(F.col("all")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with each redacted stretch of text replaced by the kind of its first span in brackets;
    spans that overlap are one stretch. A null text stays null, and n_chars, where there is such a column, follows."""
    return redacted(docs, fit(docs.sparkSession))


def redacted(docs: DataFrame, models: dict[str, tuple[list[tuple], float]]) -> DataFrame:
    """As ``redact``, by given models. The spans are found anew beside each text, so that nothing is shuffled."""
    inner = [f"in_{i}" for i in range(len(docs.columns))]
    text = inner[docs.columns.index("text")]
    rows = spans(_proposed(docs.toDF(*inner).withColumn("text", F.coalesce(F.col(text).cast("string"), F.lit("")))), models)

    def merge(done, s):
        last = F.try_element_at(done, F.lit(-1))
        grown = F.struct(last["start"].alias("start"), last["kind"].alias("kind"), F.greatest(last["end"], s["end"]).alias("end"))
        inside = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] > s["start"])
        return F.when(inside, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(s)))

    rows = rows.withColumn("merged__", F.aggregate("all", F.array().cast("array<struct<start: bigint, kind: int, end: bigint>>"), merge))
    some = F.size("merged__") > 0
    # as characters, so that each stretch is cut out in time of its own length
    rows = rows.withColumn("chars__", F.when(some, F.split("text", "")))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def piece(s, i):
        low = F.when(i > 0, F.try_element_at("merged__", i)["end"]).otherwise(0)
        return F.concat(F.array_join(F.slice("chars__", (low + 1).cast("int"), (s["start"] - low).cast("int")), ""), F.element_at(names, s["kind"] + 1))

    end = F.element_at("merged__", -1)["end"]
    tail = F.array_join(F.slice("chars__", (end + 1).cast("int"), (F.length("text") - end).cast("int")), "")
    rows = rows.withColumn(text, F.when(some, F.concat(F.array_join(F.transform("merged__", piece), ""), tail)).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        rows = rows.withColumn(inner[docs.columns.index("n_chars")], F.when(some, F.length(text).cast(kind)).otherwise(F.col(inner[docs.columns.index("n_chars")])))
    return rows.select(*inner).toDF(*docs.columns)
