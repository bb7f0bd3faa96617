"""N-gram Jaccard join: documents whose sets of word 5-grams have a Jaccard similarity of 0.8 or more.

1. A count sketch of a set number of cells, merged from those of the partitions, gives every shingle a rough frequency;
   rare shingles come first in each document, ties by hash. Any common order gives the same results.
2. One pass over the texts measures each document: the size of its set, a 128-bit fingerprint of it, a signature of 512
   parity bits, and its prefix: of a set of n shingles the first n - ceil(0.8 n) + 1. Two similar documents share a
   prefix shingle. Documents of equal sets form a class; its least doc_id stands for it, and only its prefix is posted.
   Shingles that one class alone has in its prefix are dropped.
3. Documents that share a prefix shingle meet its hub, the one of least id. The length filter, then, with all shared
   prefix shingles of the pair counted, the positional filter prune pairs. The signatures bound what the rest of the
   sets can share, so that texts are fetched for few pairs that aren't similar; then the suffix filter and the exact
   check decide.
4. Pairs of one shingle that are not yet in one component meet in a second round, by the same filters. So a group of
   thousands of near copies costs a link each, not all its pairs, and no link between components is missed.
5. Components are then known, and no similar pair lies across two. Where links are asked for, the classes of a component
   of three or more are dealt into blocks, and each two blocks meet in a task of bounded size that finds all their
   similar pairs. Where only their number is asked for, a task gives a count a class and no pair. The comparisons grow
   as the square of a group of near copies, as its links do. The texts dealt and the counts grow as its power 1.5 until
   blocks have their greatest size, of 2,048 classes or 2^20 shingles; from there as its square over that size.

Results are exact but for collisions of 64-bit shingle hashes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, shared
from .components import components

WIDTH = 5
#: log2 of the cells of the frequency sketch: its size, and that of the broadcast order, don't grow with the data.
SKETCH_BITS = 22
SLICE = 1 << 16
FAN_IN = 64
_U = np.uint64


def similar(shared_: int, a: int, b: int) -> bool:
    return 100 * shared_ >= 80 * (a + b - shared_)


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1 if n else 0


def _sets(column: pa.Array, width: int):
    for block in blocks.blocks(column, lower=True):
        yield from blocks.shingles(block, blocks.word_hashes(block), width)


#: Parity bits of a signature, in 64-bit words.
WORDS = 8
SIGNATURE = [f"s{k}" for k in range(WORDS)]


def signature(s: np.ndarray) -> np.ndarray:
    """Of each of 512 buckets whether an odd number of the set's shingles falls in it. Signatures of two sets differ in
    at most as many bits as there are shingles in one set alone."""
    odd = np.bincount((blocks.mix(s + _U(0x51ED27)) & _U(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    f1 = blocks.mix(s ^ _U(0x1234567)).sum(dtype=np.uint64).view(np.int64)
    f2 = blocks.mix(s + _U(0x7654321)).sum(dtype=np.uint64).view(np.int64)
    return int(f1), int(f2)


def measured(docs: DataFrame, order: np.ndarray, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, the fingerprint and signature of the set, and its prefix shingles, 8 bytes each, in the
    rare-first order."""
    sent = docs.sparkSession.sparkContext.broadcast(order)
    numbers = ["n_shingles", "f1", "f2", *SIGNATURE]

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        rank = sent.value
        mask = _U(len(rank) - 1)
        rows, heads = [], []
        for s in _sets(batch.column(1), width):
            rows.append(np.concatenate([[len(s), *_fingerprint(s)], signature(s)]))
            first = np.argsort(rank[(s & mask).astype(np.int64)], kind="stable")[: prefix_length(len(s))]
            heads.append(s[first].astype("<u8").tobytes())
        table = np.array(rows, np.int64).reshape(-1, len(numbers))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(table[:, k]) for k in range(len(numbers))), pa.array(heads, pa.binary())], ["doc_id", *numbers, "prefix"])

    return shared.arrow_map(docs, make, f"doc_id long, {', '.join(f'{c} long' for c in numbers)}, prefix binary")


def _merge(parts: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(SLICE, np.uint64)
    for data in parts["data"]:
        total += np.frombuffer(zlib.decompress(data), np.uint32)
    return pd.DataFrame({"slice": parts["slice"].iloc[:1], "part": parts["part"].iloc[:1] // FAN_IN, "data": [zlib.compress(np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1)]})


def rarity(docs: DataFrame, width: int = WIDTH, bits: int = SKETCH_BITS) -> np.ndarray:
    """A class of frequency for each cell of the sketch: 0 for what chance collisions explain, then by doublings."""
    cells = 1 << bits
    schema = "slice int, part long, data binary"

    def run(batches):
        total, waiting, n = np.zeros(cells, np.uint32), [], 0
        for batch in batches:
            for s in _sets(batch.column(1), width):
                waiting.append(s & _U(cells - 1))
                n += len(s)
                if n > cells:
                    total += np.bincount(np.concatenate(waiting).astype(np.int64), minlength=cells).astype(np.uint32)
                    waiting, n = [], 0
        if n:
            total += np.bincount(np.concatenate(waiting).astype(np.int64), minlength=cells).astype(np.uint32)
        part = TaskContext.get().partitionId()
        if total.any():
            for k in range(max(1, cells // SLICE)):
                data = np.zeros(SLICE, np.uint32)
                mine = total[k * SLICE : (k + 1) * SLICE]
                data[: len(mine)] = mine
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.int64()), pa.array([zlib.compress(data.tobytes(), 1)], pa.binary())], ["slice", "part", "data"])

    sketch = docs.mapInArrow(run, schema)
    n = docs.rdd.getNumPartitions()
    while True:  # partition sketches merge FAN_IN at a time, so no task gathers all of them
        sketch = sketch.groupBy("slice", F.floor(F.col("part") / FAN_IN).alias("to")).applyInPandas(_merge, schema)
        n = -(-n // FAN_IN)
        if n <= 1:
            break
    counts = np.zeros(max(cells, SLICE), np.int64)
    for k, _, data in sketch.collect():  # cells * 4 bytes in all, whatever the input
        counts[k * SLICE : (k + 1) * SLICE] = np.frombuffer(zlib.decompress(data), np.uint32)
    counts = counts[:cells]
    mean = float(np.median(counts))
    over = (counts - mean) / max(1.0, np.sqrt(mean))
    return np.where(over > 4, np.log2(np.maximum(over, 4)), 0).astype(np.uint8)


def postings(reps: DataFrame) -> DataFrame:
    """h, doc_id, n (size of the set) and pos (place in the rare-first order) of each prefix shingle."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        heads = [x.as_py() for x in batch.column(2)]
        h = np.frombuffer(b"".join(heads), "<i8")
        size = np.array([len(x) // 8 for x in heads], np.int64)
        of = pa.array(np.repeat(np.arange(len(size)), size))
        pos = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
        return pa.RecordBatch.from_arrays([pa.array(h), batch.column(0).take(of), batch.column(1).cast(pa.int32()).take(of), pa.array(pos.astype(np.int32))], ["h", "doc_id", "n", "pos"])

    return shared.arrow_map(reps.select("doc_id", "n_shingles", "prefix"), make, "h long, doc_id long, n int, pos int")


def _shingles_of(reps: DataFrame) -> DataFrame:
    """The prefix shingles alone."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(x.as_py() for x in batch.column(0)), "<i8"))], ["h"])

    return shared.arrow_map(reps.select("prefix"), make, "h long")


#: Least overlap of a similar pair: ceil(4 (n + m) / 9). Bounds compare 9 * overlap with 4 * (n + m).
_LENGTH = "5 * least(n, m) >= 4 * greatest(n, m)"
#: A similar pair that shares o or more shares one among the first n - o + 1 of the one and m - o + 1 of the other.
_PREFIX = "9 * (n - pos) >= 4 * (n + m) and 9 * (m - pos_b) >= 4 * (n + m)"
_POSITION = "9 * (c + least(n - last_a, m - last_b) - 1) >= 4 * (n + m)"


def _pairs(joined: DataFrame) -> DataFrame:
    """a, b of pairs that pass the positional filter; ``joined`` has a row for each shared prefix shingle. What is
    shared is at most the shared prefix shingles and what follows the last of them in both."""
    counted = joined.filter(_LENGTH).filter(_PREFIX).groupBy("a", "b", "n", "m").agg(F.count("*").alias("c"), F.max("pos").alias("last_a"), F.max("pos_b").alias("last_b"))
    return counted.filter(_POSITION).select("a", "b").distinct()


def _promising(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs whose signatures allow similarity: sets of n and m shingles that differ in d or more share at most
    (n + m - d) / 2 of them."""
    known = reps.select("doc_id", "n_shingles", *SIGNATURE)
    one = known.toDF("a", "n__", *[f"x{k}" for k in range(WORDS)])
    other = known.toDF("b", "m__", *[f"y{k}" for k in range(WORDS)])
    differ = sum((F.bit_count(F.col(f"x{k}").bitwiseXOR(F.col(f"y{k}"))) for k in range(WORDS)), F.lit(0))
    met = pairs.join(one, "a").join(other, "b").filter(9 * (F.col("n__") + F.col("m__") - differ) >= 8 * (F.col("n__") + F.col("m__")))
    return met.select("a", "b").distinct()


def suffix_passes(x: np.ndarray, y: np.ndarray, need: int, depth: int = 2) -> bool:
    """False if a split of both sorted sets at a pivot of y, and of their parts, shows fewer than ``need`` in common."""

    def most(x, y, depth):
        if not depth or not len(x) or not len(y):
            return min(len(x), len(y))
        k = len(y) // 2
        i = int(np.searchsorted(x, y[k]))
        hit = i < len(x) and x[i] == y[k]
        return most(x[:i], y[:k], depth - 1) + int(hit) + most(x[i + hit :], y[k + 1 :], depth - 1)

    return most(x, y, depth) >= need


#: log2 of the bits of the filter that keeps documents of no pair out of the shuffle. Its 8 MB are sent to every task;
#: where pairs fill it, it lets all documents through, and the joins alone decide.
FILTER_BITS = 26


def _of_pairs(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The documents whose ids may be in ``pairs``; none that is there is left out."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS))
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).select(bit.alias("bit"))
    parts = ids.groupBy(F.floor(F.col("bit") / 32768).alias("part")).agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("bits"))
    table = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    for part, bits in parts.collect():
        table[part * 4096 : (part + 1) * 4096] = np.frombuffer(bits, np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def marked(bits: pd.Series) -> pd.Series:
        at = bits.to_numpy()
        return pd.Series(sent.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1)

    return docs.filter(marked(bit))


def verify(docs: DataFrame, pairs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The pairs a, b that are similar. Texts are joined to a, then to b, so none meets more than its own pair."""
    texts = _of_pairs(docs.filter("doc_id is not null").select("doc_id", "text"), pairs)
    left = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    hubs = texts.join(pairs.select(F.col("b").alias("doc_id")).distinct(), "doc_id").select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = left.join(hubs, "b").select("a", "b", "text_a", "text_b")

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep, last, of_last = [], None, None
        hub_texts = batch.column(3)
        for k, x in enumerate(_sets(batch.column(2), width)):
            text = hub_texts[k].as_py()
            if text != last:
                last, of_last = text, next(_sets(pa.array([text], pa.string()), width))
            y = of_last
            need = -(-4 * (len(x) + len(y)) // 9)
            good = min(len(x), len(y)) >= need and suffix_passes(x, y, need)
            keep.append(good and similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return shared.arrow_map(both, make, "a long, b long")


#: The most classes and shingles of a block on average; a longer document is a block of its own at worst.
BLOCK_CLASSES, BLOCK_SHINGLES = 2048, 1 << 20
#: Shared shingles that one dense step of ``shared_counts`` counts.
STEP_SHINGLES = 4096


def candidates(sizes: np.ndarray, marks: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs x of ``left`` and y of ``right`` that the length and signature filters let through; where both are the same
    rows, each pair once."""
    same = left is right
    xs, ys = [], []
    for k, x in enumerate(left):
        other = right[k + 1 :] if same else right
        n, m = sizes[x], sizes[other]
        differ = np.bitwise_count(marks[other] ^ marks[x]).sum(axis=1, dtype=np.int64)
        met = other[(5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & (9 * (n + m - differ) >= 8 * (n + m))]
        xs.append(np.full(len(met), x))
        ys.append(met)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(xs or none), np.concatenate(ys or none)


def shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """How many shingles the sets of each pair share: pair by pair, or, where that takes longer, by products of the
    incidence of all shingles that several sets have."""
    sizes = np.array([len(s) for s in sets], np.int64)
    every, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1
    v = int(place[-1]) + 1 if len(place) else 0
    if len(xs) * 20e-6 + float((sizes[xs] + sizes[ys]).sum()) * 40e-9 <= len(left) * len(right) * float(v) / 5e9:
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(xs.tolist(), ys.tolist(), strict=True)], np.int64)
    row = np.repeat(np.arange(len(sets)), sizes)
    several = times[column] > 1
    row, at = row[several], place[column[several]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    count = np.zeros((len(left), len(right)), np.float32)  # whole numbers below 2^24
    for first in range(0, v, STEP_SHINGLES):
        a, b = np.searchsorted(at, [first, first + STEP_SHINGLES])
        dense = np.zeros((len(sets), min(STEP_SHINGLES, v - first)), np.float32)
        dense[row[a:b], at[a:b] - first] = 1
        count += dense[left] @ dense[right].T
    to_left, to_right = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
    to_left[left], to_right[right] = np.arange(len(left)), np.arange(len(right))
    return count[to_left[xs], to_right[ys]].astype(np.int64)


def _pairs_of_blocks(key, table: pa.Table, width: int) -> np.ndarray:
    """All similar pairs, greater id first, between two blocks or within one, each once."""
    low, high = key[1].as_py(), key[2].as_py()
    ids, of_block, f1, f2 = (table.column(c).to_pylist() for c in ("doc_id", "block", "f1", "f2"))
    kept: dict[tuple, tuple] = {}  # a row of another text of its doc_id, and a repeated one, is left out
    for k, s in enumerate(_sets(table.column("text"), width)):
        own = (ids[k], f1[k], f2[k])
        if own not in kept and _fingerprint(s) == own[1:]:
            kept[own] = (of_block[k], s)
    sets = [s for _, s in kept.values()]
    block = np.array([b for b, _ in kept.values()], np.int64)
    doc = np.array([own[0] for own in kept], np.int64)
    left = np.flatnonzero(block == low)
    right = left if low == high else np.flatnonzero(block == high)
    sizes = np.array([len(s) for s in sets], np.int64)
    marks = np.array([signature(s) for s in sets], np.int64).reshape(-1, WORDS).view(np.uint64)
    xs, ys = candidates(sizes, marks, left, right)
    if not len(xs):
        return np.zeros((0, 2), np.int64)
    c = shared_counts(sets, left, right, xs, ys)
    good = similar(c, sizes[xs], sizes[ys]) & (doc[xs] != doc[ys])
    known, place = np.unique(doc, return_inverse=True)
    a, b = place[xs[good]], place[ys[good]]
    once = np.unique(np.maximum(a, b) * len(known) + np.minimum(a, b))
    return np.stack([known[once // len(known)], known[once % len(known)]], axis=1)


def _links_of_blocks(width: int):
    """The pairs themselves: as many rows as links."""

    def make(key, table):
        found = _pairs_of_blocks(key, table, width)
        return pa.table({"a": pa.array(found[:, 0], pa.int64()), "b": pa.array(found[:, 1], pa.int64())})

    return make


def _counts_of_blocks(width: int):
    """How many of the pairs each document is in: a row a document at most."""

    def make(key, table):
        node, n = np.unique(_pairs_of_blocks(key, table, width), return_counts=True)
        return pa.table({"node": pa.array(node, pa.int64()), "n": pa.array(n, pa.int64())})

    return make


def _dealt(docs: DataFrame, classes: DataFrame, found: DataFrame, tables: shared.Tables) -> tuple[DataFrame, DataFrame]:
    """The classes of components of three or more, and their texts, dealt to each two blocks that they meet in. A pair
    of classes meets in one two blocks alone."""
    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    sizes = named.groupBy("component").agg(F.count("*").alias("g"), F.sum("n_shingles").alias("total")).filter("g > 2")
    # of g classes a task meets 2 g / k, and each text is sent k times: both grow more slowly than g
    k = F.ceil(F.greatest(F.sqrt("g") / 4, F.col("g") / BLOCK_CLASSES, F.col("total") / BLOCK_SHINGLES)).cast("int")
    members = named.join(sizes.select("component", k.alias("k")), "component").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))
    members = tables.write("shingle-members", members.select(F.col("rep").alias("doc_id"), "f1", "f2", "component", "k", "block"))
    texts = _of_pairs(docs.filter("doc_id is not null").select("doc_id", "text"), members.selectExpr("doc_id a", "doc_id b"))
    dealt = members.join(texts, "doc_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return members, dealt.select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "doc_id", "f1", "f2", "block", "text")


def _of_two(near: DataFrame, members: DataFrame) -> DataFrame:
    """The one pair of each component of two; verified once for each text of a repeated doc_id."""
    return near.join(members.select(F.col("doc_id").alias("a")).distinct(), "a", "left_anti").select("a", "b").distinct()


def all_links(docs: DataFrame, classes: DataFrame, near: DataFrame, found: DataFrame, width: int = WIDTH) -> DataFrame:
    """All similar pairs a, b of class representatives, given verified ones that connect them and the components of
    these. The one pair of a component of two is known. The table has as many rows as there are links."""
    tables = shared.Tables(docs.sparkSession)
    members, dealt = _dealt(docs, classes, found, tables)
    within = dealt.groupBy("component", "low", "high").applyInArrow(_links_of_blocks(width), "a long, b long")
    pairs = shared.written(_of_two(near, members).union(within), "shingle-all-links")
    tables.drop("shingle-members")
    return pairs


def degrees(docs: DataFrame, classes: DataFrame, near: DataFrame, found: DataFrame, width: int = WIDTH) -> DataFrame:
    """node and n_links: of each representative that has links, how many rows of ``all_links`` it is in. Each two blocks
    count their own, so no pair leaves its task."""
    tables = shared.Tables(docs.sparkSession)
    members, dealt = _dealt(docs, classes, found, tables)
    within = dealt.groupBy("component", "low", "high").applyInArrow(_counts_of_blocks(width), "node long, n long")
    two = _of_two(near, members)
    each = two.selectExpr("a node", "1L n").union(two.selectExpr("b node", "1L n")).union(within)
    counts = shared.written(each.groupBy("node").agg(F.sum("n").alias("n_links")), "shingle-degrees")
    tables.drop("shingle-members")
    return counts


def links(docs: DataFrame, width: int = WIDTH, sketch_bits: int = SKETCH_BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: doc_id, n_shingles, f1 and f2 of every row; the class representative of each set (n_shingles, f1,
    f2, rep); and the links a, b: all similar pairs of representatives, each once. ``docs`` has doc_id and text."""
    slim, classes, near = connected(docs, width, sketch_bits)
    return slim, classes, all_links(docs, classes, near, components(near), width)


def connected(docs: DataFrame, width: int = WIDTH, sketch_bits: int = SKETCH_BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables of ``links``, but for the links: as many verified ones as connect all that similarity connects."""
    tables = shared.Tables(docs.sparkSession)
    sets = tables.write("shingle-sets", measured(docs, rarity(docs, width, sketch_bits), width))
    key = ["n_shingles", "f1", "f2"]
    # what a table is joined with by its own groups is written first: both sides then stand behind a shuffle of their own,
    # and Spark splits the share of a key that a third of the rows have
    classes = shared.written(sets.filter("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep")), "shingle-classes")
    reps = tables.write("shingle-reps", sets.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").filter("n_shingles > 0"))
    slim = shared.written(sets.select("doc_id", *key), "shingle-sizes")
    tables.drop("shingle-sets")

    repeated = tables.write("shingle-repeated", _shingles_of(reps).groupBy("h").count().filter("count > 1").select("h"))
    alive = tables.write("shingle-postings", postings(reps).join(repeated, "h"))
    tables.drop("shingle-repeated")
    reps = tables.write("shingle-signatures", reps.drop("prefix"))
    tables.drop("shingle-reps")

    hubs = alive.groupBy("h").agg(F.min(F.struct("doc_id", "n", "pos")).alias("hub"), F.max("doc_id").alias("top"))
    hubs = tables.write("shingle-hubs", hubs.filter("hub.doc_id < top").select("h", F.col("hub.doc_id").alias("b"), F.col("hub.n").alias("m"), F.col("hub.pos").alias("pos_b")))
    met = alive.join(hubs, "h").filter("doc_id != b").withColumnRenamed("doc_id", "a")
    first = tables.write("shingle-pairs", _promising(tables.write("shingle-met", _pairs(met)), reps))
    tables.drop("shingle-hubs", "shingle-met")
    near = shared.written(verify(docs, first, width), "shingle-links")
    found = components(near)

    named = alive.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    named = tables.write("shingle-named", named)
    tables.drop("shingle-postings")
    mixed = tables.write("shingle-mixed", named.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("h"))
    left = tables.write("shingle-left", named.join(mixed, "h"))
    tables.drop("shingle-mixed", "shingle-named")
    other = left.select("h", F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("pos").alias("pos_b"), F.col("component").alias("component_b"))
    met = left.withColumnRenamed("doc_id", "a").join(other, "h").filter("a > b and component != component_b")
    second = tables.write("shingle-met", _pairs(met).join(first, ["a", "b"], "left_anti"))
    tables.drop("shingle-left")
    more = shared.written(verify(docs, tables.write("shingle-second", _promising(second, reps)), width), "shingle-links")
    tables.drop("shingle-met", "shingle-second", "shingle-pairs", "shingle-signatures")
    return slim, classes, near.union(more)


def join_components(docs: DataFrame, width: int = WIDTH, sketch_bits: int = SKETCH_BITS, counted: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every row of documents.

    ``n_links`` counts the links of the document's class to other classes, all of them; copies within its class aren't
    among them. Without ``counted`` it counts only those that were needed to connect the components.

    A null or empty text has no shingles and is linked with nothing; a null doc_id has no component. Rows of one doc_id
    are one document: its texts' links are its own. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.text_or_empty().alias("text"))
    sets, classes, near = connected(docs, width, sketch_bits)
    groups = components(near)
    if counted:
        degree = degrees(docs, classes, near, groups, width)
    else:
        degree = near.select(F.col("a").alias("node")).union(near.select("b")).groupBy("node").agg(F.count("*").alias("n_links"))
    key = ["n_shingles", "f1", "f2"]

    # documents of several texts link the classes of these
    own = sets.filter("n_shingles > 0 and doc_id is not null").join(classes, key).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a != b")
    several = own.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")).filter("low < high").select("a")
    reps = classes.select(F.col("rep").alias("doc_id")).distinct()
    own = own.join(several, "a").union(reps.join(several.withColumnRenamed("a", "doc_id"), "doc_id").selectExpr("doc_id a", "doc_id b"))
    final = components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(own))

    # what classes know is joined to them first: a class may have a third of all rows
    told = classes.withColumnRenamed("rep", "node").join(final, "node", "left").join(degree, "node", "left")
    told = shared.written(told.select(*key, F.coalesce("component", "node").alias("component"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")), "shingle-classes")
    some = F.col("n_shingles") > 0
    with_words = sets.filter(some).join(told, key, "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"), F.when(F.col("doc_id").isNotNull(), F.col("n_links")).alias("n_links"))
    without = sets.filter(~some).join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return with_words.unionByName(without)


def keep_one(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The document of least id of each component, with all its columns; of rows that repeat it, one stays. Documents
    without id all stay. An empty table gives none."""
    tables = shared.Tables(docs.sparkSession)
    found = tables.write("shingle-components", join_components(docs, width, counted=False).select("doc_id", "component_id"))
    gone = shared.written(found.filter("component_id < doc_id").select("doc_id").distinct(), "shingle-gone")
    again = shared.written(found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "shingle-again")
    tables.drop("shingle-components")
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if again.isEmpty():
        return kept
    one = kept.join(again, "doc_id").select(*docs.columns).dropDuplicates(["doc_id"])
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(one)
